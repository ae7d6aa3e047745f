"""One registered query for each operator, over bars of the test tables.

The panel is weekly bars of brands.  Queries without SQL work on the 700 trials
of both searches, those with SQL on a log of sixteen expressions.  Doubles are rounded to six digits at the end, since
sums in different order differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.stats import bootstrap_ci, expected_max_sharpe
from sigloom.operators import audit as A
from sigloom.operators import features as X
from sigloom.operators import landscape as L
from sigloom.operators import panel as P
from sigloom.operators import portfolio as B
from sigloom.operators.signals import Expression, forward_returns, grammar, signals
from sigloom.sources.bars import trade_bars
from sigloom.sources.results import materialized

HORIZON = 5
#: Sixteen expressions of all five families, some normalized, two of them equal, dealt to two optimizers in turn.
TRIALS = [
    Expression("momentum", 5), Expression("volatility", 20), Expression("mean_reversion", 10), Expression("volume_ratio", 5), Expression("ma_crossover", None, 5, 40), Expression("momentum", 20),
    Expression("mean_reversion", 40, normalize_lookback=20), Expression("volatility", 60), Expression("volume_ratio", 20), Expression("ma_crossover", None, 20, 60), Expression("momentum", 60, normalize_lookback=10),
    Expression("mean_reversion", 120), Expression("volatility", 10, normalize_lookback=40), Expression("volume_ratio", 60, normalize_lookback=5), Expression("ma_crossover", None, 20, 120, 20), Expression("momentum", 5),
]
ONE = [Expression("momentum", 20)]
SIGNALS = {
    "sig_momentum": [Expression("momentum", n) for n in (5, 20)],
    "sig_mean_reversion": [Expression("mean_reversion", n) for n in (5, 20)],
    "sig_volatility": [Expression("volatility", n) for n in (5, 20)],
    "sig_volume_ratio": [Expression("volume_ratio", n) for n in (5, 20)],
    "sig_normalized": [Expression("momentum", 20, normalize_lookback=40), Expression("volume_ratio", 10, normalize_lookback=20)],
    "sig_ma_crossover": [Expression("ma_crossover", None, 5, 40), Expression("ma_crossover", None, 20, 60)],
    "sig_build": [Expression("momentum", 10), Expression("mean_reversion", 40, normalize_lookback=20), Expression("volatility", 60), Expression("volume_ratio", 5)],
}

def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


class Study:
    """The tables of one query; each is computed once and kept, so what is built on it stays small."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def bars_by(self, grain: str) -> DataFrame:
        return materialized(trade_bars(self.spark, self.dir, grain))

    @cached_property
    def scan(self) -> DataFrame:
        return trade_bars(self.spark, self.dir)

    @cached_property
    def bars(self) -> DataFrame:
        return self.bars_by("week")

    @cached_property
    def panel(self) -> DataFrame:
        return materialized(P.build_panel(self.bars))

    @cached_property
    def days(self) -> DataFrame:
        return self.days_of(TRIALS)

    def days_of(self, expressions: list[Expression]) -> DataFrame:
        return materialized(A.evaluate(self.panel, expressions, HORIZON))

    @cached_property
    def splits(self) -> DataFrame:
        return B.split_dim(self.panel, HORIZON)

    @cached_property
    def expressions(self) -> DataFrame:
        rows = [(k, "bayesian" if k % 2 else "random", k // 2, e.json()) for k, e in enumerate(TRIALS)]
        return self.spark.createDataFrame(rows, "expr_id int, optimizer string, iteration long, expression string")

    @cached_property
    def logs(self) -> DataFrame:
        """expr_id, optimizer, iteration (of the optimizer), expression and all metrics."""
        return materialized(self.expressions.join(A.trial_rows(A.by_split(self.days, self.splits, HORIZON)), "expr_id"))

    @cached_property
    def trials(self) -> DataFrame:
        """Both logs combined."""
        return A.combine(self.logs.where("optimizer = 'random'"), self.logs.where("optimizer = 'bayesian'"))

    @cached_property
    def held(self) -> DataFrame:
        return B.tradable(B.lagged(B.weights(signals(self.panel, ONE))), forward_returns(self.panel, HORIZON))

    @cached_property
    def vectors(self) -> DataFrame:
        return materialized(X.as_vectors(X.features(self.trials), "iteration"))

    @cached_property
    def search_vectors(self) -> DataFrame:
        """Feature vectors of the 700 trials of both searches."""
        return materialized(X.as_vectors(X.features(A.combine(random_search(self), bayesian_search(self))), "iteration"))

    @cached_property
    def clustered(self) -> DataFrame:
        """The trials in three parts by their Sharpe ratio."""
        place = Window.orderBy(F.desc_nulls_last(F.round("sharpe", 9)), "iteration")  # a row a trial
        return X.exposed(self.trials).withColumn("cluster", F.ntile(3).over(place))

    @cached_property
    def boundary(self) -> int:
        """The last of the first four fifths of the dates."""
        return self.panel.agg(F.floor(F.max("d_idx") * 0.8)).first()[0]

    @cached_property
    def every(self) -> DataFrame:
        """All 351 expressions of the grammar with their split metrics: a row an expression."""
        every = grammar()
        told = A.trial_rows(A.by_split(self.days_of(every), self.splits, HORIZON))
        return materialized(told.join(A.dimension(self.spark, every), "expr_id"))

    @cached_property
    def searched(self) -> DataFrame:
        """The combined log of both searches; expr_id is the place in the grammar."""
        return A.combine(random_search(self), bayesian_search(self)).join(self.every.select("expression", "expr_id"), "expression")


def metric(*names: str) -> Callable[[Study], DataFrame]:
    return lambda t: B.metrics(t.days, HORIZON).select("expr_id", *names)


def random_search(t: Study, n: int = 500, seed: int = 42) -> DataFrame:
    known = {e.json(): k for k, e in enumerate(grammar())}
    return A.log(t.spark, list(enumerate(A.random_draws(n, seed))), "random", t.every.drop("expression"), known)


def bayesian_search(t: Study, n: int = 200, seed: int = 42) -> DataFrame:
    # A row an expression: 351 numbers steer the sampler.
    train = dict(t.every.select("expression", "train_sharpe").collect())
    return A.log(t.spark, A.bayesian_draws(n, seed, lambda e: train[e.json()]), "bayesian", t.every.drop("expression"), {e.json(): k for k, e in enumerate(grammar())})


def holdout_core(t: Study) -> DataFrame:
    test = t.days.join(t.splits.where("split = 'test'").select("d_idx"), "d_idx")
    net = B.net(test, 5.0).groupBy("expr_id").agg(B.sharpe(HORIZON).alias("net_sharpe"))
    told = B.metrics(test, HORIZON).join(net, "expr_id")
    kept = A.winners(t.trials).select("expr_id", "optimizer", "source_iteration", "expression", "winner_expression_duplicated")
    return kept.join(told, "expr_id")


def bootstrap_hash(t: Study, replicates: int = 200) -> DataFrame:
    """The block bootstrap as joins: starts come from a multiplicative hash of replicate and block, so SQL can follow."""
    obs = t.days_of(ONE).where("port_ret IS NOT NULL").select((F.row_number().over(Window.partitionBy("expr_id").orderBy("d_idx")) - 1).cast("long").alias("pos"), "port_ret")
    n = obs.agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(HORIZON), F.round(F.cbrt("n")).cast("long"))
    draws = n.select("n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    at = draws.select("n", "size", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    block, offset = F.floor(F.col("k") / F.col("size")), F.col("k") % F.col("size")
    start = ((F.col("rep") * 7919 + block * 104_729 + 12_345) * 48_271 % 2_147_483_647) % F.col("n")
    sample = at.select("rep", ((start + offset) % F.col("n")).alias("pos")).join(obs, "pos")
    sd = F.stddev_samp("port_ret")
    told = sample.groupBy("rep").agg(F.when(sd > 0, F.avg("port_ret") / sd * B.annual(HORIZON)).alias("sharpe"))
    return told.agg(F.percentile("sharpe", 0.025).alias("ci_lower"), F.percentile("sharpe", 0.975).alias("ci_upper"), F.count("sharpe").alias("replicates"))


def panel_sanity(t: Study) -> DataFrame:
    return P.sanity(t.panel).select("ticker", "start_date", "end_date", "n_dates", "n_tickers", "max_missing_run", "over_5pct_missing", "zero_or_negative_prices", "negative_volume")


def chosen_once(best: DataFrame) -> DataFrame:
    """The distinct winners with the number of their expression."""
    ids = best.groupBy(A.canonical().alias("_key")).agg(F.min("expr_id").alias("expr_id"))
    return A.frozen(best).join(ids, A.canonical() == F.col("_key")).drop("_key")


def forward_metrics(t: Study) -> DataFrame:
    after = t.panel.where(F.col("d_idx") > t.boundary).select("d_idx").distinct()
    told = B.metrics(t.days.join(after, "d_idx"), HORIZON)
    return chosen_once(A.winners(t.trials)).join(told, "expr_id").withColumnRenamed("optimizer", "selected_by")


def forward_test(t: Study) -> DataFrame:
    dates = t.panel.select("d_idx", "date").distinct()
    (boundary,) = dates.where(F.col("d_idx") == t.boundary).select("date").first()
    return A.forward_test(chosen_once(A.winners(t.trials)), t.days, dates, F.lit(boundary), HORIZON).drop("evaluated_on")


def holdout_full(t: Study) -> DataFrame:
    """The winners of both whole searches on the last split."""
    best = A.winners(t.searched, "validation_sharpe").select("expr_id").collect()  # a row an optimizer
    every = grammar()
    ids = sorted({r.expr_id for r in best})
    days = t.days_of([every[k] for k in ids])
    place = t.spark.createDataFrame(list(enumerate(ids)), "place int, expr_id int")
    told = days.withColumnRenamed("expr_id", "place").join(place, "place").drop("place")
    return A.holdout(t.searched, told, t.splits, HORIZON)


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[Study], DataFrame]] = {
        # Panels
        "panel_scan": lambda t: t.scan,
        "panel_common_tickers": lambda t: P.common_tickers(t.bars),
        "panel_eligible_dates": lambda t: P.eligible_dates(t.bars),
        "panel_dense": lambda t: P.dense(t.bars),
        "panel_ffill1": lambda t: P.filled(t.bars_by("day"), 0.5),
        "panel_keep_tickers": lambda t: P.kept_tickers(P.filled(t.bars)),
        "panel_returns": lambda t: t.panel,
        "panel_sanity": panel_sanity,
        "panel_max_missing_run": lambda t: P.missing_runs(P.dense(t.bars_by("day"))),
        "study_boundary": lambda t: P.study_boundary(t.panel),
        # Signals
        **{k: lambda t, e=e: signals(t.panel, e) for k, e in SIGNALS.items()},
        "fwd_returns": lambda t: forward_returns(t.panel, HORIZON),
        # Portfolios
        "cs_rank_avg": lambda t: B.ranks(signals(t.panel, ONE)).select("d_idx", "ticker", "rank"),
        "cs_weights": lambda t: B.weights(signals(t.panel, ONE)).select("d_idx", "ticker", "w"),
        "lagged_weights": lambda t: B.lagged(B.weights(signals(t.panel, ONE))).select("d_idx", "ticker", "w"),
        "tradable_weights": lambda t: t.held.select("d_idx", "ticker", "tw"),
        "portfolio_returns": lambda t: t.days.select("expr_id", "d_idx", "port_ret"),
        "daily_ic": lambda t: t.days.select("expr_id", "d_idx", "ic"),
        "turnover": lambda t: t.days.select("expr_id", "d_idx", "turnover"),
        "net_returns": lambda t: B.net(t.days, 5.0).select("expr_id", "d_idx", "port_ret"),
        "backtest_metrics": metric("sharpe", "sortino", "max_drawdown", "annualized_volatility", "ic", "turnover", "n_observations"),
        "metric_sharpe": metric("sharpe"),
        "metric_sortino": metric("sortino"),
        "metric_max_drawdown": metric("max_drawdown"),
        "metric_volatility": metric("annualized_volatility"),
        "metric_means": metric("ic", "turnover", "n_observations"),
        "split_dim": lambda t: t.splits,
        "split_metrics": lambda t: A.by_split(t.days, t.splits, HORIZON),
        # Joins
        "join_align": lambda t: signals(t.panel, ONE).join(t.panel.select("d_idx", "ticker", "ret").where("ret IS NOT NULL"), ["d_idx", "ticker"]).select("d_idx", "ticker", "signal", "ret"),
        "join_reindex_split": lambda t: t.splits.join(t.days_of(ONE), "d_idx", "left").select("d_idx", "split", "port_ret"),
        "semi_join_optimizers": lambda t: t.expressions.join(X.top_share(t.trials).select("optimizer"), "optimizer", "left_semi"),
        # Search logs
        "trajectory_rows": lambda t: t.logs,
        "combine_trajectories": lambda t: t.trials.select("iteration", "source_iteration", "optimizer", "expression", "sharpe"),
        "select_winners": lambda t: A.winners(t.trials).select("optimizer", "iteration", "expression", "sharpe"),
        "winner_duplicates": lambda t: A.winners(t.trials).select("optimizer", "expression", "winner_expression_duplicated"),
        "search_progress": lambda t: X.progress(t.trials),
        "top10_trials": lambda t: t.trials.orderBy(F.desc_nulls_last("sharpe"), "iteration").limit(10).select("iteration", "optimizer", "sharpe"),
        "top_decile": lambda t: X.top_share(t.trials).select("iteration", "sharpe", "cutoff"),
        "traj_expose_fields": lambda t: X.exposed(t.trials).select("iteration", "primitive", "normalizer", "expression_label", "row_id", "source_iteration"),
        "row_lookup": lambda t: X.by_row_id(X.exposed(t.trials), "bayesian:9").select("iteration", "row_id", "primitive", "sharpe"),
        "traj_filter": lambda t: X.chosen(X.exposed(t.trials), ["momentum"], ["random"], -10.0, 10.0).select("iteration", "primitive", "optimizer", "sharpe"),
        "expression_label": lambda t: X.parsed(t.expressions).select("expression", X.label(F.col("e")).alias("label")),
        "expression_fields": lambda t: X.parsed(t.expressions).select("expr_id", "e.primitive", "e.lookback", "e.normalize_by"),
        # Audits
        "cost_sweep": lambda t: A.swept(t.days, HORIZON),
        "break_even": lambda t: A.break_even(A.swept(t.days, HORIZON)),
        "sharpe_moments": lambda t: A.moments(t.days),
        "psr_zscore": lambda t: A.with_psr(A.moments(t.days), F.lit(0.5), HORIZON).select("expr_id", "psr_z"),
        "holdout_core": holdout_core,
        "bootstrap_hash": bootstrap_hash,
        "frozen_expressions": lambda t: A.frozen(A.winners(t.trials)),
        "forward_dates": lambda t: t.panel.where(F.col("d_idx") > t.boundary).select("d_idx", "date").distinct(),
        "forward_metrics": forward_metrics,
        "power_verdict": lambda t: B.metrics(t.days, HORIZON).select("expr_id", A.power_verdict(F.col("n_observations") - 20 * F.col("expr_id"), HORIZON, F.col("expr_id") * 0.13 + 0.3).alias("verdict")),
        # Features
        "features_raw": lambda t: X.raw_features(t.trials),
        "feature_medians": lambda t: X.medians(X.raw_features(t.trials)),
        "features_imputed": lambda t: X.imputed(X.raw_features(t.trials)),
        "features_scaled": lambda t: X.features(t.trials),
        "pairwise_distance": lambda t: X.pair_distances(t.vectors),
        "mean_pair_distance": lambda t: X.pair_distances(t.vectors).agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("pairs")),
        "distance_histogram": lambda t: X.histogram(X.pair_distances(t.vectors), "distance", 10),
        "knn_graph": lambda t: X.neighbours(t.vectors, 3),
        "mutual_reachability": lambda t: X.mutual_reachability(t.vectors, 4),
        # Aggregates
        "optimizer_summary": lambda t: X.optimizer_summary(t.trials),
        "category_counts": lambda t: X.exposed(t.trials).groupBy("primitive").count(),
        "distinct_counts": lambda t: X.exposed(t.trials).agg(F.countDistinct("expression").alias("expressions"), F.countDistinct("primitive").alias("primitives"), F.countDistinct("optimizer").alias("optimizers")),
        "sharpe_quantiles": lambda t: t.trials.agg(F.percentile("sharpe", 0.9).alias("q90"), F.percentile("sharpe", 0.5).alias("median")),
        "sharpe_box": lambda t: t.trials.groupBy("optimizer").agg(*(F.percentile("sharpe", q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))), F.min("sharpe").alias("low"), F.max("sharpe").alias("high")),
        "cluster_crosstab": lambda t: X.crosstab(t.clustered, "cluster", "primitive", ("momentum", "mean_reversion", "volatility")),
        "cluster_purity": lambda t: X.purity(t.clustered, "cluster", "primitive"),
        "cluster_nmi": lambda t: X.mutual_information(t.clustered, "cluster", "primitive"),
        # Without SQL
        "random_search": random_search,
        "bayesian_search": bayesian_search,
        "bootstrap_ci": lambda t: bootstrap_ci(t.days, HORIZON),
        "probabilistic_sharpe": lambda t: A.with_psr(A.moments(t.days), F.lit(0.5), HORIZON).select("expr_id", "probabilistic_sharpe_ratio"),
        "expected_max_sharpe": lambda t: expected_max_sharpe(t.searched),
        "holdout_full": holdout_full,
        "forward_test": forward_test,
        "cost_json": lambda t: A.cost_json(A.swept(t.days, HORIZON)),
        "pca": lambda t: L.pca(t.search_vectors),
        "kmeans": lambda t: L.kmeans(t.search_vectors),
        "agglomerative": lambda t: L.agglomerative(t.search_vectors),
        "hdbscan": lambda t: L.hdbscan(t.search_vectors),
        "umap": lambda t: L.umap(t.search_vectors),
    }
    # Sums of decimals and one division give the same bits everywhere.
    exact = {"panel_scan", "panel_dense", "panel_ffill1", "panel_returns"}
    return {name: lambda s, d, f=f, same=name in exact: f(Study(s, d)) if same else rounded(f(Study(s, d))) for name, f in q.items()}


QUERIES = _queries()
