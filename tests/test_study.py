"""Signals, portfolios, splits and audits: golden values and properties."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.config import StudyConfig, load_config
from sigloom.functions.stats import bootstrap_interval, expected_max_sharpe, kurtosis, probabilistic_sharpe, skewness
from sigloom.operators import audit as A
from sigloom.operators import features as X
from sigloom.operators import landscape as L
from sigloom.operators import panel as P
from sigloom.operators import portfolio as B
from sigloom.operators.signals import Expression, forward_returns, grammar, sample_expression, signals


def long(spark, frame: np.ndarray, name: str = "signal"):
    rows = [(0, i, f"T{j}", None if np.isnan(v) else float(v)) for i, row in enumerate(frame) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, f"expr_id int, d_idx int, ticker string, {name} double")


def make_panel(spark, n: int = 60, m: int = 6, seed: int = 3):
    rng = np.random.default_rng(seed)
    r = rng.normal(0.0003, 0.011, (n, m))
    price, volume = 100 * np.cumprod(1 + r, axis=0), rng.lognormal(14, 0.3, (n, m))
    dates = pd.bdate_range("2018-01-01", periods=n)
    rows = [(i, dates[i].date(), f"T{j}", float(price[i, j]), None if i == 0 else float(r[i, j]), float(volume[i, j])) for i in range(n) for j in range(m)]
    return spark.createDataFrame(rows, "d_idx int, date date, ticker string, price double, ret double, volume double"), r


def column(df, name: str, *by: str):
    return [x[name] for x in df.orderBy(*by).collect()]


def test_grammar_has_351_distinct_expressions():
    texts = [e.json() for e in grammar()]
    assert len(texts) == len(set(texts)) == 351
    assert Expression("momentum", 20).json() == '{"lookback": 20, "normalize_by": null, "primitive": "momentum"}'
    assert all(Expression.of(t).json() == t for t in texts)


@pytest.mark.parametrize("bad", [dict(primitive="x", lookback=5), dict(primitive="momentum"), dict(primitive="ma_crossover", short=40, long=40), dict(primitive="momentum", lookback=0)])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        Expression(**bad)


def test_sampler_is_reproducible():
    a, b = np.random.default_rng(42), np.random.default_rng(42)
    draws = [sample_expression(a) for _ in range(50)]
    assert draws == [sample_expression(b) for _ in range(50)] and draws[0].primitive == "momentum"


def test_signals_match_pandas(spark):
    panel, _ = make_panel(spark)
    wide = panel.toPandas().pivot(index="d_idx", columns="ticker", values=["price", "ret", "volume"])
    price, ret, volume = wide["price"], wide["ret"], wide["volume"]
    want = [
        (1 + ret).rolling(5).apply(np.prod, raw=True) - 1, price - price.rolling(10).mean(), ret.rolling(5).std(), volume / volume.rolling(5).mean(),
        price.ewm(span=5, adjust=False, min_periods=5).mean() - price.rolling(40).mean(), ((1 + ret).rolling(5).apply(np.prod, raw=True) - 1) / ret.rolling(10).std(),
    ]
    asked = [Expression("momentum", 5), Expression("mean_reversion", 10), Expression("volatility", 5), Expression("volume_ratio", 5), Expression("ma_crossover", None, 5, 40), Expression("momentum", 5, normalize_lookback=10)]
    got = signals(panel, asked).toPandas()
    for k, w in enumerate(want):
        g = got[got.expr_id == k].pivot(index="d_idx", columns="ticker", values="signal").astype(float)
        assert (g.isna() == w.isna()).all().all() and np.nanmax(np.abs(g - w)) < 1e-8


def test_rolling_needs_full_frames_and_gaps(spark):
    rows = [(i, "A", p, p, p) for i, p in enumerate([1.0, 2.0, None, 4.0, 5.0])]
    panel = spark.createDataFrame(rows, "d_idx int, ticker string, price double, ret double, volume double")
    from sigloom.operators.signals import with_ewm

    assert column(with_ewm(panel, (2,)), "ewm_2", "d_idx") == [None, *(pytest.approx(v, abs=1e-6) for v in (1.6666667, 1.6666667, 3.6666667, 4.5555556))]
    assert column(forward_returns(panel, 2), "fwd", "d_idx") == [5.0, None, None, 29.0, None]


def test_weights_golden(spark):
    df = long(spark, np.array([[1, 1, 2, np.nan], [3, 3, 3, 3]]))
    assert column(B.weights(df), "w", "d_idx", "ticker") == [-0.25, -0.25, 0.5, None, None, None, None, None]


def test_turnover_golden(spark):
    w = [[0.5, -0.5], [np.nan, 1], [0.5, -0.5], [np.nan, np.nan]]
    held = long(spark, np.array(w), "tw").withColumn("fwd", F.lit(0.0)).withColumn("c", F.lit(None).cast("double"))
    assert column(B.daily(held), "turnover", "d_idx") == [None, 1.5, 1.5, None]


def test_no_lookahead_and_foresight(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.02, (200, 10))
    fwd = long(spark, r, "fwd").drop("expr_id")
    leaked = B.metrics(B.backtest(long(spark, r), fwd), 1).first()
    ahead = B.metrics(B.backtest(long(spark, np.vstack([r[1:], np.full((1, 10), np.nan)])), fwd), 1).first()
    assert ahead.sharpe > 3 and ahead.ic > 0.99 and ahead.sharpe - leaked.sharpe > 3


def test_backtest_matches_pandas_with_gaps(spark):
    rng = np.random.default_rng(5)
    s, f = rng.integers(0, 6, (40, 7)).astype(float), rng.normal(0, 0.02, (40, 7))
    s[rng.random(s.shape) < 0.15], f[rng.random(f.shape) < 0.1] = np.nan, np.nan
    got = B.backtest(long(spark, s), long(spark, f, "fwd").drop("expr_id")).orderBy("d_idx").toPandas().astype(float)
    ranks = pd.DataFrame(s).rank(axis=1)
    c = ranks.sub(ranks.mean(axis=1), axis=0)
    w = c.div(c.abs().sum(axis=1).replace(0, np.nan), axis=0).shift(1)
    t = w.where(pd.DataFrame(f).notna())
    t = t.div(t.abs().sum(axis=1).replace(0, np.nan), axis=0)
    a, b = w.rank(axis=1), pd.DataFrame(f).rank(axis=1)
    a, b = a.sub(a.mean(axis=1), axis=0), b.sub(b.mean(axis=1), axis=0)
    ic = (a * b).sum(axis=1, min_count=2) / np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1)).replace(0, np.nan)
    for name, want in (("port_ret", (t * f).sum(axis=1, min_count=1)), ("turnover", t.diff().abs().sum(axis=1, min_count=1)), ("ic", ic)):
        np.testing.assert_allclose(got[name], want, atol=1e-12)


def test_drawdown_costs_and_infinite_sharpe(spark):
    days = spark.createDataFrame([(0, i, r, 0.0, t) for i, (r, t) in enumerate(zip([0.10, -0.05, -0.10, 0.04, 0.02, -0.03], [None, 2.0, 0.0, 0.0, 0.0, 0.0]))] + [(1, 0, -0.1, 0.0, None), (1, 1, 0.05, 0.0, 0.0), (2, 0, 0.01, 0.0, None)], "expr_id int, d_idx int, port_ret double, ic double, turnover double")
    got = {r.expr_id: r for r in B.metrics(days, 5).collect()}
    assert got[0].max_drawdown == pytest.approx(0.145) and got[1].max_drawdown == pytest.approx(0.10) and got[2].sharpe == math.inf
    assert column(B.net(days.where("expr_id = 0"), 10.0), "port_ret", "d_idx")[:2] == [0.10, pytest.approx(-0.052)]
    with pytest.raises(ValueError):
        B.net(days, -1.0)


def test_split_ranges():
    sizes = {k: b - a for k, (a, b) in B.split_ranges(100, 5, 0.6, 0.2, 0.2).items()}
    assert sizes == {"train": 56, "validation": 16, "test": 16}
    assert B.split_ranges(2889, 5, 0.6, 0.2, 0.2) == {"train": (0, 1729), "validation": (1733, 2307), "test": (2311, 2885)}
    with pytest.raises(ValueError):
        B.split_ranges(10, 5, 0.6, 0.2, 0.2)


def test_moments_and_probabilities(spark):
    got = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double").agg(skewness("x").alias("s"), kurtosis("x").alias("k")).first()
    assert got.s == pytest.approx(1.3309377322) and got.k == pytest.approx(4.5)
    assert probabilistic_sharpe(0.05, 0, 250, 0, 3) == pytest.approx(0.784796107436)
    assert probabilistic_sharpe(0.15, 0, 250, 0, 3) == pytest.approx(0.990707627588)
    trials = spark.createDataFrame([("a", v) for v in (0.1, 0.2, 0.3, 0.4, math.inf)], "optimizer string, sharpe double")
    assert expected_max_sharpe(trials).first().expected_max == pytest.approx(0.385828472542)


def test_bootstrap_follows_the_plain_loop():
    x = np.random.default_rng(9).normal(0.001, 0.01, 100)
    rng, n, size = np.random.default_rng(7), 100, 5
    want = []
    for _ in range(200):
        starts = rng.integers(0, n, size=20)
        s = x[((starts[:, None] + np.arange(size)) % n).ravel()[:n]]
        want.append(s.mean() / s.std(ddof=1) * math.sqrt(252 / 5))
    assert bootstrap_interval(x, 5, replicates=200, seed=7) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))
    assert all(math.isnan(v) for v in bootstrap_interval(np.array([0.1]), 5))


def test_panel_rules(spark):
    rows = [(f"2020-01-0{d}", t, None if (d, t) in {(2, "A"), (3, "A")} else float(d), 1.0) for d in range(1, 6) for t in "ABC"] + [("2020-01-01", "D", None, 5.0)]
    bars = spark.createDataFrame(rows, "date string, ticker string, close double, volume double").withColumn("date", F.to_date("date"))
    assert column(P.common_tickers(bars), "ticker", "ticker") == ["A", "B", "C"]
    assert P.eligible_dates(bars).count() == 3
    assert column(P.filled(bars, 0.5).where("ticker = 'A'"), "close", "date") == [1.0, 1.0, None, 4.0, 5.0]
    assert dict(P.missing_runs(P.dense(bars)).collect()) == {"A": 2, "B": 0, "C": 0}
    assert column(P.build_panel(bars, 0.5).where("ticker = 'B'"), "ret", "d_idx") == [None, 1.0, 0.5, pytest.approx(1 / 3), 0.25]


def trial_table(spark, n: int = 24):
    rng, every = np.random.default_rng(0), grammar()
    rows = [(k, k // 2, "random" if k % 2 else "bayesian", every[(k // 2) * 7].json(), k // 2 * 7, float(rng.normal()), 1.0, 0.01, float(rng.random()), 0.2, 0.1, 100) for k in range(n)]
    return spark.createDataFrame(rows, "iteration long, source_iteration long, optimizer string, expression string, expr_id int, sharpe double, sortino double, ic double, turnover double, annualized_volatility double, max_drawdown double, n_observations long")


def test_selection_duplicates_and_frozen(spark):
    t = trial_table(spark).withColumn("sharpe", F.when(F.col("source_iteration") == 3, math.inf).otherwise(F.col("sharpe")))
    best = A.winners(t)
    assert {r.source_iteration for r in best.collect()} == {3} and all(r.winner_expression_duplicated for r in best.collect())
    assert [r.optimizer for r in A.frozen(best).collect()] == ["bayesian+random"]


def test_features_and_landscape(spark):
    t = trial_table(spark)
    f = X.features(t).toPandas().drop(columns="iteration")
    assert f.shape == (24, 16) and np.isfinite(f.to_numpy()).all() and np.allclose(f.std(ddof=0)[f.std(ddof=0) > 0], 1)
    v = X.as_vectors(X.features(t), "iteration").cache()
    x = np.stack([r.x for r in v.orderBy("key").collect()])
    p = L.pca(v).orderBy("key").toPandas().drop(columns="key").to_numpy()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, ddof=0)))[::-1][:3]
    np.testing.assert_allclose(p.var(axis=0), values, atol=1e-9)
    assert L.kmeans(v, 4, starts=2).select("cluster_kmeans").distinct().count() == 4
    assert L.agglomerative(v, 4).select("cluster_agglomerative").distinct().count() == 4
    assert L.hdbscan(v).count() == L.umap(v).count() == 24
    assert X.neighbours(v, 3).count() == 72 and X.pair_distances(v).count() == 276


def test_clusters_of_clear_blobs():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    truth = np.repeat([0, 1, 2], 20)
    for labels in (L.ward_labels(x, 3), L.hdbscan_labels(x, 5)):
        assert all(len(set(labels[truth == k]) - {-1}) == 1 for k in range(3)) and len(set(labels) - {-1}) == 3
    y = L.umap_layout(x)
    inner = np.mean([L.distances(y[truth == k]).mean() for k in range(3)])
    assert np.isfinite(y).all() and inner < L.distances(y).mean()


def test_bayesian_draws_are_distinct_and_learn():
    seen = A.bayesian_draws(60, 42, lambda e: 1.0 if e.primitive == "volatility" else 0.0)
    assert len({e.json() for _, e in seen}) == 60 and [n for n, _ in seen] == sorted(n for n, _ in seen)
    assert sum(e.primitive == "volatility" for _, e in seen[30:]) > 10


def test_costs_verdicts_and_labels(spark):
    sweep = spark.createDataFrame([(0, b, s) for b, s in ((0.0, 0.4), (1.0, 0.3), (2.0, 0.1), (5.0, -0.2), (10.0, -0.5), (20.0, -1.0))], "expr_id int, bps double, sharpe double")
    assert A.break_even(sweep).first().break_even == pytest.approx(3.0)
    assert list(json.loads(A.cost_json(sweep).first().cost_sensitivity)) == ["0", "1", "10", "2", "20", "5"]
    v = spark.createDataFrame([(40, 6.1), (500, 1.8), (2000, 0.6)], "n long, w double").select(A.power_verdict(F.col("n"), 5, F.col("w")).alias("v"))
    assert [r.v.split(":")[0] for r in v.collect()] == ["Insufficient", "Weak", "Usable"]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("\n".join(f"{k}: {json.dumps(getattr(StudyConfig(), k))}" for k in StudyConfig.__slots__))
    assert load_config(str(path)) == StudyConfig()
    with pytest.raises(ValueError):
        StudyConfig(train_fraction=0.9)
    path.write_text("a: 1")
    with pytest.raises(ValueError):
        load_config(str(path))


def test_sources(spark, tmp_path):
    from sigloom.sources.bars import download, file_bars, read_tables

    calls = []

    def fetch(name):
        calls.append(name)
        if name == "BAD" or calls.count(name) < 2:
            raise OSError("down")
        return pd.DataFrame({"date": pd.to_datetime(["2020-01-01", "2020-01-02"]), "Close": [1.0, float("nan")], "Volume": [3.0, 4.0]})

    with pytest.warns(UserWarning):
        assert download(["A", "B", "A", "BAD"], fetch, tmp_path / "raw", sleep=lambda s: None) == ["BAD"]
    got = file_bars(spark, str(tmp_path / "raw")).orderBy("ticker", "date").collect()
    assert [(r.ticker, r.close) for r in got] == [("A", 1.0), ("A", None), ("B", 1.0), ("B", None)]
    with pytest.raises(FileNotFoundError):
        read_tables(spark, [str(tmp_path / "none")])
    with pytest.raises(RuntimeError):
        download(["X", "Y"], lambda n: pd.DataFrame(), tmp_path / "raw", sleep=lambda s: None)


def test_stream_scores_each_arrival(spark, tmp_path):
    from sigloom.streaming.forward import forward_stream

    src = str(tmp_path / "in")
    one = lambda d: spark.createDataFrame([(d, "A", 1.0, 2.0)], "date string, ticker string, close double, volume double").withColumn("date", F.to_date("date"))
    for k, d in enumerate(("2020-01-01", "2020-01-02")):
        one(d).write.mode("append").parquet(src)
        forward_stream(spark, src, str(tmp_path / "history"), lambda bars: bars.groupBy("ticker").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == k + 1


def test_equal_expressions_are_one_however_they_are_written(spark):
    rows = [("random", 0, 2.0, '{"primitive": "momentum", "lookback": 5, "normalize_by": null}'), ("bayesian", 1, 1.0, '{"lookback":5,"normalize_by":null,"primitive":"momentum"}')]
    best = A.winners(spark.createDataFrame(rows, "optimizer string, iteration long, sharpe double, expression string"))
    assert [r.winner_expression_duplicated for r in best.collect()] == [True, True]
    assert [(r.optimizer) for r in A.frozen(best).collect()] == ["bayesian+random"]


def test_a_backtest_without_common_cells_is_an_error(spark):
    signals_ = spark.createDataFrame([(0, 1, "A", 1.0)], "expr_id int, d_idx int, ticker string, signal double")
    forward = spark.createDataFrame([(1, "B", 0.1)], "d_idx int, ticker string, fwd double")
    with pytest.raises(ValueError):
        B.aligned(signals_, forward)
    assert B.aligned(signals_, forward.withColumn("ticker", F.lit("A"))).count() == 1


def test_a_forward_panel_reaches_back_and_stays_apart(spark, tmp_path):
    from datetime import date, timedelta

    end, asked = date(2024, 1, 10), []
    day = lambda k: end + timedelta(days=k)
    bars = spark.createDataFrame([(day(k), t, 10.0 + k % 7, 5.0) for k in range(-800, 20, 4) for t in "AB"], "date date, ticker string, close double, volume double")
    study = P.build_panel(bars.where(F.col("date") <= F.lit(end)))
    last = study.agg(F.max("date")).first()[0]

    def source(start, stop):
        asked.append((start, stop))
        return bars

    got = A.refresh_forward(study, source, f"{tmp_path}/forward", day(15))
    low, high = got.agg(F.min("date"), F.max("date")).first()
    assert asked == [(last - timedelta(days=730), day(15))] and low >= asked[0][0] and last < high <= day(15)
    with pytest.raises(ValueError):
        A.refresh_forward(study, source, f"{tmp_path}/other", last)


def test_logs_are_found_by_name_with_a_fall_back(spark, tmp_path):
    from sigloom.sources.results import available, read_trajectory

    row = lambda name: spark.createDataFrame([(0, name, '{"primitive": "momentum", "lookback": 5}', 1.0)], "iteration long, optimizer string, expression string, sharpe double")
    with pytest.raises(FileNotFoundError):
        read_trajectory(spark, str(tmp_path))
    row("random").write.parquet(f"{tmp_path}/trajectory.parquet")
    assert read_trajectory(spark, str(tmp_path)).first().row_id == "random:0"
    row("bayesian").write.parquet(f"{tmp_path}/trajectory_combined.parquet")
    assert sorted(available(spark, str(tmp_path))) == ["combined", "random"] and read_trajectory(spark, str(tmp_path)).first().optimizer == "bayesian"
    assert read_trajectory(spark, str(tmp_path), "random").first().expression_label == "momentum (5)"
    from sigloom.operators.features import by_row_id

    both = read_trajectory(spark, str(tmp_path))
    assert by_row_id(both, "bayesian:0").count() == 1 and by_row_id(both, "bayesian:1").count() == 0


def test_timing_has_a_row_for_each_length(spark):
    got = A.timing_check(lambda n: spark.range(n))
    assert [r["iterations"] for r in got] == [5, 10, 20] and all(abs(r["seconds"] - r["seconds_per_iteration"] * r["iterations"]) < 1e-9 for r in got)


def test_many_expressions_are_shuffled_by_expression_and_give_the_same(spark, monkeypatch):
    panel, _ = make_panel(spark)
    asked = [Expression("momentum", 5), Expression("volatility", 10, normalize_lookback=5), Expression("ma_crossover", None, 5, 40)]
    few = sorted(map(str, A.evaluate(panel, asked, 3).select("expr_id", "d_idx", F.round("port_ret", 9), F.round("ic", 9)).collect()))
    monkeypatch.setattr(A, "MANY", 2)
    many = A.evaluate(panel, asked, 3)
    assert few == sorted(map(str, many.select("expr_id", "d_idx", F.round("port_ret", 9), F.round("ic", 9)).collect()))
