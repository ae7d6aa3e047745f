"""Search logs, selection, holdout and forward audits.

The grammar is finite, so searches are lookups: all expressions are evaluated in
one job (``evaluate``), and a sampler's draws are joined with the results.
"""

from __future__ import annotations

import math
import time
from bisect import insort
from collections import Counter
from collections.abc import Callable
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.stats import bootstrap_ci, expected_max_sharpe, kurtosis, normal_cdf, psr_z, skewness
from sigloom.operators.panel import build_panel
from sigloom.operators.portfolio import annual, backtest, metrics, net, sharpe, split_dim
from sigloom.operators.signals import FAMILIES, LONGS, LOOKBACKS, NORMALIZERS, SHORTS, Expression, sample_expression, signals

METRICS = ("sharpe", "sortino", "max_drawdown", "annualized_volatility", "ic", "turnover", "n_observations")
COSTS = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0)
#: Expressions from which on they are parallel enough by themselves.
MANY = 64


def evaluate(panel: DataFrame, expressions: list[Expression], horizon: int) -> DataFrame:
    """expr_id, d_idx, port_ret, ic, turnover of all expressions in one job.

    Many expressions are dealt out by expression once; every window after that
    is within one, so nothing is shuffled again.  Few go by date and ticker, in parallel.
    """
    rows = signals(panel, expressions, horizon)
    return backtest(rows.repartition("expr_id") if len(expressions) >= MANY else rows)


def dimension(spark: SparkSession, expressions: list[Expression]) -> DataFrame:
    """expr_id and the canonical text."""
    return spark.createDataFrame([(k, e.json()) for k, e in enumerate(expressions)], "expr_id int, expression string")


def by_split(days: DataFrame, splits: DataFrame, horizon: int) -> DataFrame:
    """Metrics of each expression in each split; turnover was differenced on the whole panel before."""
    return metrics(days.join(splits.select("d_idx", "split"), "d_idx"), horizon, ("expr_id", "split"))


def trial_rows(split_metrics: DataFrame) -> DataFrame:
    """A row an expression: the validation metrics without prefix, and both splits' with one."""
    pick = lambda split, m: F.max(F.when(F.col("split") == split, F.col(m)))
    named = [pick("validation", m).alias(m) for m in METRICS] + [pick(s, m).alias(f"{s}_{m}") for s in ("train", "validation") for m in METRICS]
    return split_metrics.groupBy("expr_id").agg(*named)


def random_draws(n: int, seed: int) -> list[Expression]:
    rng = np.random.default_rng(seed)
    return [sample_expression(rng) for _ in range(n)]


def log(spark: SparkSession, draws: list[tuple[int, Expression]], optimizer: str, results: DataFrame, known: dict[str, int]) -> DataFrame:
    """The search log of draws (iteration, expression) by lookup in ``results``."""
    rows = spark.createDataFrame([(i, optimizer, e.json(), known[e.json()]) for i, e in draws], "iteration long, optimizer string, expression string, expr_id int")
    return rows.join(results, "expr_id").drop("expr_id")


class CategoricalTpe:
    """A tree-structured Parzen sampler over categories.

    Good trials (the best tenth, at most 25) and the rest each give smoothed
    frequencies of a parameter's values; of some draws by the good ones, that
    with the best ratio of both is suggested.
    """

    def __init__(self, seed: int, warmup: int = 10, draws: int = 24) -> None:
        self.rng, self.warmup, self.draws = np.random.default_rng(seed), warmup, draws
        self.ordered: list[tuple[float, int, dict]] = []  # best first, the earlier of equals
        self.seen: dict[str, Counter] = {}

    def _choose(self, name: str, values: list):
        if len(self.ordered) < self.warmup:
            return values[int(self.rng.integers(0, len(values)))]
        best = Counter(t[name] for _, _, t in self.ordered[: min(25, math.ceil(0.1 * len(self.ordered)))] if name in t)
        every, share = self.seen.get(name, Counter()), []
        for count in ([best[v] for v in values], [every[v] - best[v] for v in values]):
            w = np.array(count, float) + 1.0 / len(values)
            share.append(w / w.sum())
        picks = self.rng.choice(len(values), size=self.draws, p=share[0])
        return values[int(picks[np.argmax(np.log(share[0][picks]) - np.log(share[1][picks]))])]

    def ask(self) -> tuple[dict, Expression]:
        p: dict = {}

        def choose(name: str, values: list):
            p[name] = self._choose(name, values)
            return p[name]

        family = choose("primitive", list(FAMILIES))
        lookback = short = long = by = None
        if family == "ma_crossover":
            short, long = choose("ma_pair", [(s, n) for s in SHORTS for n in LONGS if s < n])
        else:
            lookback = choose("lookback", list(LOOKBACKS))
        if choose("normalize_by", [None, "volatility"]):
            if family == "volatility":  # the pair replaces the lookback that was drawn first
                lookback, by = choose("volatility_pair", [(a, b) for a in LOOKBACKS for b in NORMALIZERS if a != b])
            else:
                by = choose("normalize_lookback", list(NORMALIZERS))
        return p, Expression(family, lookback, short, long, by)

    def tell(self, parameters: dict, value: float) -> None:
        insort(self.ordered, (-(value if math.isfinite(value) else -1e6), len(self.ordered), parameters))
        for name, v in parameters.items():
            self.seen.setdefault(name, Counter())[v] += 1


def bayesian_draws(n: int, seed: int, objective: Callable[[Expression], float | None]) -> list[tuple[int, Expression]]:
    """``n`` distinct expressions with their trial numbers; repeats are pruned, so numbers have gaps."""
    sampler, seen, out = CategoricalTpe(seed), set(), []
    for number in range(100 * n):
        parameters, e = sampler.ask()
        if e.json() in seen:
            sampler.tell(parameters, math.nan)  # so that it looks elsewhere
            continue
        seen.add(e.json())
        out.append((number, e))
        value = objective(e)
        sampler.tell(parameters, math.nan if value is None else value)
        if len(out) == n:
            return out
    raise RuntimeError("too few distinct expressions were found")


def combine(*logs: DataFrame) -> DataFrame:
    """The logs after one another: source_iteration keeps the own number, iteration is counted anew."""
    tagged = [df.withColumn("source_iteration", F.col("iteration")).withColumn("_log", F.lit(k)) for k, df in enumerate(logs)]
    out = tagged[0]
    for other in tagged[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.withColumn("iteration", (F.row_number().over(Window.orderBy("_log", "source_iteration")) - 1).cast("long")).drop("_log")  # a row a trial


def canonical(expression: str = "expression") -> Column:
    """An expression's JSON with sorted keys and no blanks, so that equal ones are equal as texts however they were written."""
    return F.to_json(F.parse_json(expression))


def winners(trials: DataFrame, by: str = "sharpe", order: str = "iteration") -> DataFrame:
    """The best trial of each optimizer (infinite ones too, the first of equals), and whether two chose one expression."""
    place = F.row_number().over(Window.partitionBy("optimizer").orderBy(F.col(by).desc_nulls_last(), order))
    best = trials.withColumn("_place", place).where("_place = 1").drop("_place")
    return best.withColumn("winner_expression_duplicated", F.count("*").over(Window.partitionBy(canonical())) > 1)


def swept(days: DataFrame, horizon: int, costs: tuple[float, ...] = COSTS, by: tuple[str, ...] = ("expr_id",)) -> DataFrame:
    """``by``, bps, sharpe for each cost."""
    rows = days.withColumn("bps", F.explode(F.array(*(F.lit(c) for c in costs))))
    return net(rows, F.col("bps")).groupBy(*by, "bps").agg(sharpe(horizon).alias("sharpe"))


def cost_json(sweep: DataFrame, by: tuple[str, ...] = ("expr_id",)) -> DataFrame:
    """The sweep as one JSON text a group, keys as short as possible and in order of their text."""
    key = F.regexp_replace(F.col("bps").cast("string"), r"\.0$", "")
    value = F.when(F.abs("sharpe") == float("inf"), F.lit("Infinity")).otherwise(F.coalesce(F.col("sharpe").cast("string"), F.lit("NaN")))
    item = F.struct(key.alias("k"), F.concat(F.lit('"'), key, F.lit('": '), value).alias("t"))
    return sweep.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", "), F.lit("}")).alias("cost_sensitivity"))


def break_even(sweep: DataFrame, by: tuple[str, ...] = ("expr_id",)) -> DataFrame:
    """``by``, break_even: the cost where the curve first falls below 0, between two points; null if it doesn't."""
    ahead = Window.partitionBy(*by).orderBy("bps")
    falls = sweep.select(*by, "bps", "sharpe", F.lead("sharpe").over(ahead).alias("s2"), F.lead("bps").over(ahead).alias("b2"))
    at = F.col("bps") + F.col("sharpe") / (F.col("sharpe") - F.col("s2")) * (F.col("b2") - F.col("bps"))
    return falls.groupBy(*by).agg(F.min_by(F.when((F.col("sharpe") >= 0) & (F.col("s2") < 0), at), F.when((F.col("sharpe") >= 0) & (F.col("s2") < 0), F.col("bps"))).alias("break_even"))


def moments(days: DataFrame, by: tuple[str, ...] = ("expr_id",)) -> DataFrame:
    """Sharpe a period (null without deviation), n, skewness, kurtosis."""
    sd = F.stddev_samp("port_ret")
    return days.groupBy(*by).agg(F.when(sd > 0, F.avg("port_ret") / sd).alias("period_sharpe"), F.count("port_ret").alias("n"), skewness("port_ret").alias("skewness"), kurtosis("port_ret").alias("kurtosis"))


def with_psr(told: DataFrame, benchmark: Column, horizon: int) -> DataFrame:
    """Adds psr_z and probabilistic_sharpe_ratio against an annualized benchmark."""
    z = psr_z(F.col("period_sharpe"), benchmark / annual(horizon), F.col("n"), F.col("skewness"), F.col("kurtosis"))
    return told.withColumn("psr_z", z).withColumn("probabilistic_sharpe_ratio", normal_cdf("psr_z"))


def _audit(days: DataFrame, horizon: int, cost: float, prefix: str, seed: int) -> DataFrame:
    """Metrics, moments, interval and costs of each expression's days, one row each."""
    gross = metrics(days, horizon)
    gross = gross.select("expr_id", *(F.col(m).alias(f"{prefix}_{m}") for m in METRICS))
    costs = net(days, cost).groupBy("expr_id").agg(sharpe(horizon).alias(f"{prefix}_net_sharpe"))
    return gross.join(costs, "expr_id").join(moments(days), "expr_id").join(bootstrap_ci(days, horizon, seed=seed), "expr_id").join(cost_json(swept(days, horizon)), "expr_id")


def holdout(trials: DataFrame, days: DataFrame, splits: DataFrame, horizon: int, cost: float = 5.0, seed: int = 42) -> DataFrame:
    """The winner of each optimizer, tested once on the last split.  ``trials`` has expr_id; ``days`` the winners' days."""
    selection = "validation_sharpe" if "validation_sharpe" in trials.columns else "sharpe"
    turnover = "validation_turnover" if "validation_turnover" in trials.columns else "turnover"
    source = "source_iteration" if "source_iteration" in trials.columns else "iteration"
    test = splits.where("split = 'test'")
    told = _audit(days.join(test.select("d_idx"), "d_idx"), horizon, cost, "test", seed)
    best = winners(trials, selection).select(
        "expr_id", "optimizer", F.col(source).alias("source_iteration"), "expression", F.lit(selection).alias("selection_metric"),
        F.col(selection).alias("selection_sharpe"), F.col(turnover).alias("selection_turnover"), "winner_expression_duplicated",
    )
    bench = expected_max_sharpe(trials, selection).select("optimizer", F.col("expected_max").alias("deflated_sharpe_benchmark"))
    count = trials.groupBy("optimizer").agg(F.count("*").alias("n_selection_trials"))
    window = test.agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("test_start"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("test_end"))
    joined = best.join(bench, "optimizer").join(count, "optimizer").join(told, "expr_id").crossJoin(F.broadcast(window))
    out = with_psr(joined, F.col("deflated_sharpe_benchmark"), horizon)
    return out.select(
        *best.columns[1:], F.lit(cost).alias("transaction_cost_bps"), "test_net_sharpe", "n_selection_trials", "deflated_sharpe_benchmark",
        F.col("ci_lower").alias("test_sharpe_ci_lower"), F.col("ci_upper").alias("test_sharpe_ci_upper"), F.lit("circular_moving_block").alias("bootstrap_method"),
        F.lit(2000).cast("long").alias("bootstrap_replications"), "cost_sensitivity", "test_start", "test_end", *(f"test_{m}" for m in METRICS),
        F.col("skewness").alias("test_skewness"), F.col("kurtosis").alias("test_kurtosis"), F.col("probabilistic_sharpe_ratio").alias("test_probabilistic_sharpe_ratio"),
    )


def frozen(chosen: DataFrame) -> DataFrame:
    """expression, optimizer: the distinct selected expressions (the first text of equal ones), and who selected them, as ``a+b``."""
    told = chosen.groupBy(canonical().alias("_key")).agg(F.min("expression").alias("expression"), F.array_join(F.array_sort(F.collect_list("optimizer")), "+").alias("optimizer"))
    return told.drop("_key")


def power_verdict(n: Column, horizon: int, width: Column) -> Column:
    """What a window of so many observations can say, in words."""
    own = F.format_string("%s", F.bround(n / horizon, 0).cast("long"))
    wide = F.coalesce(F.format_string("%.2f", width), F.lit("nan"))
    return (
        F.when(n < 60, F.concat(F.lit("Insufficient: "), own, F.lit(" non-overlapping observations give a "), wide, F.lit("-wide 95% interval. Directional only; no Sharpe claim is supported.")))
        .when(width > 1, F.concat(F.lit("Weak: "), own, F.lit(" non-overlapping observations still leave a "), wide, F.lit("-wide 95% interval spanning both signs.")))
        .otherwise(F.concat(F.lit("Usable: "), own, F.lit(" non-overlapping observations give a "), wide, F.lit("-wide 95% interval.")))
    )


def forward_test(chosen: DataFrame, days: DataFrame, dates: DataFrame, boundary: Column, horizon: int, cost: float = 5.0, seed: int = 42) -> DataFrame:
    """Frozen expressions (expr_id, expression, optimizer) on dates after the boundary; windows reach back before it."""
    after = dates.where(F.col("date") > boundary)
    if after.isEmpty():
        raise ValueError("no dates after the boundary")
    told = _audit(days.join(after.select("d_idx"), "d_idx"), horizon, cost, "forward", seed)
    window = after.agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("forward_start"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("forward_end"))
    told = with_psr(told, F.lit(0.0), horizon).withColumn("width", F.col("ci_upper") - F.col("ci_lower"))
    joined = chosen.join(told, "expr_id").crossJoin(F.broadcast(window))
    return joined.select(
        "expression", F.col("optimizer").alias("selected_by"), F.date_format(boundary, "yyyy-MM-dd").alias("study_boundary"), "forward_start", "forward_end",
        F.date_format(F.current_date(), "yyyy-MM-dd").alias("evaluated_on"), F.lit(cost).alias("transaction_cost_bps"), "forward_net_sharpe",
        F.col("ci_lower").alias("forward_sharpe_ci_lower"), F.col("ci_upper").alias("forward_sharpe_ci_upper"), F.col("width").alias("forward_sharpe_ci_width"),
        (F.col("n") / horizon).alias("non_overlapping_observations"), F.lit("circular_moving_block").alias("bootstrap_method"), F.lit(2000).cast("long").alias("bootstrap_replications"),
        "cost_sensitivity", power_verdict(F.col("n"), horizon, F.col("width")).alias("power_verdict"), *(f"forward_{m}" for m in METRICS),
        F.col("skewness").alias("forward_skewness"), F.col("kurtosis").alias("forward_kurtosis"), F.col("probabilistic_sharpe_ratio").alias("forward_probabilistic_sharpe_ratio"),
    )


WARMUP_DAYS = 730


def forward_bars(bars: DataFrame, boundary: date, end: date) -> DataFrame:
    """The bars of a forward panel: ``WARMUP_DAYS`` before the study's last date up to ``end``; an ``end`` not after it is an error."""
    if end <= boundary:
        raise ValueError(f"no dates after the study, which ends on {boundary}; {end} was asked for")
    return bars.where(F.col("date").between(F.lit(boundary - timedelta(days=WARMUP_DAYS)), F.lit(end)))


def refresh_forward(panel: DataFrame, bars: Callable[[date, date], DataFrame], folder: str, end: date | None = None) -> DataFrame:
    """Build a forward panel in a folder of its own, never in the study's: ``bars(start, end)`` is the source."""
    (boundary,), stop = panel.agg(F.max("date")).first(), end or date.today()
    if stop <= boundary:
        raise ValueError(f"no dates after the study, which ends on {boundary}; {stop} was asked for")
    own = forward_bars(bars(boundary - timedelta(days=WARMUP_DAYS), stop), boundary, stop)
    build_panel(own).write.mode("overwrite").parquet(folder)
    return panel.sparkSession.read.parquet(folder)


def timing_check(search: Callable[[int], DataFrame], counts: tuple[int, ...] = (5, 10, 20)) -> list[dict[str, float]]:
    """Seconds of searches of several lengths: iterations, seconds, seconds_per_iteration."""
    out = []
    for n in counts:
        began = time.perf_counter()
        search(n).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        out.append({"iterations": n, "seconds": took, "seconds_per_iteration": took / n})
    return out
