"""Rank-weighted portfolios without lookahead, and their metrics.

``signals`` (expr_id, d_idx, ticker, signal) on a dense grid go through ranks,
weights, a lag of one row, and a dot product with forward returns.  Windows are
partitioned by expression and date, or expression and ticker: the largest
partition is a cross-section or a history of one expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = 252
INF = float("inf")


def _cross(*more: str):
    return Window.partitionBy("expr_id", "d_idx", *more)


def average_rank(column: str, by: tuple[str, ...] = ("expr_id", "d_idx")) -> Column:
    """Rank within ``by``, ties averaged; null for null."""
    known = Window.partitionBy(*by, F.col(column).isNull())
    return F.when(F.col(column).isNotNull(), F.rank().over(known.orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2)


def ranks(signals: DataFrame) -> DataFrame:
    return signals.withColumn("rank", average_rank("signal"))


def weights(signals: DataFrame) -> DataFrame:
    """expr_id, d_idx, ticker, w: centred ranks over their absolute sum; the deviation of the ranks cancels out."""
    centred = ranks(signals).withColumn("c", F.col("rank") - F.avg("rank").over(_cross()))
    extra = [c for c in signals.columns if c == "fwd"]
    return centred.select("expr_id", "d_idx", "ticker", *extra, "c", F.try_divide("c", F.nullif(F.sum(F.abs("c")).over(_cross()), F.lit(0.0))).alias("w"))


def lagged(weighted: DataFrame) -> DataFrame:
    """The weights of the row before, and their centred ranks."""
    before = Window.partitionBy("expr_id", "ticker").orderBy("d_idx")
    extra = [c for c in weighted.columns if c == "fwd"]
    return weighted.select("expr_id", "d_idx", "ticker", *extra, F.lag("w").over(before).alias("w"), F.lag(F.when(F.col("w").isNotNull(), F.col("c"))).over(before).alias("c"))


def tradable(lagged_: DataFrame, forward: DataFrame | None = None) -> DataFrame:
    """Adds fwd (unless the rows have it), and tw: weights of cells with a realised return, scaled to gross 1 again."""
    joined = lagged_ if forward is None else lagged_.join(forward, ["d_idx", "ticker"])
    held = joined.withColumn("t", F.when(F.col("fwd").isNotNull(), F.col("w")))
    return held.withColumn("tw", F.try_divide("t", F.nullif(F.sum(F.abs("t")).over(_cross()), F.lit(0.0)))).drop("t")


def aligned(signals: DataFrame, forward: DataFrame) -> DataFrame:
    """``backtest`` of tables that needn't have one grid; without a common cell it is an error."""
    if signals.select("d_idx", "ticker").join(forward.select("d_idx", "ticker"), ["d_idx", "ticker"], "left_semi").isEmpty():
        raise ValueError("signals and returns have no date and ticker in common")
    return backtest(signals, forward)


def daily(held: DataFrame) -> DataFrame:
    """expr_id, d_idx, port_ret, ic, turnover: one row a date and expression."""
    before = Window.partitionBy("expr_id", "ticker").orderBy("d_idx")
    near = held.withColumn("fr", F.round("fwd", 10))
    rows = near.withColumn("rr", average_rank("fr")).withColumn("rc", F.col("rr") - F.avg("rr").over(_cross())).withColumn("moved", F.abs(F.col("tw") - F.lag("tw").over(before)))
    both = F.col("c") * F.col("rc")
    scale = F.nullif(F.sqrt(F.sum(F.col("c") * F.col("c")) * F.sum(F.col("rc") * F.col("rc"))), F.lit(0.0))
    return rows.groupBy("expr_id", "d_idx").agg(
        F.sum(F.col("tw") * F.col("fwd")).alias("port_ret"),
        F.when(F.count(both) >= 2, F.try_divide(F.sum(both), scale)).alias("ic"),
        F.sum("moved").alias("turnover"),
    )


def backtest(signals: DataFrame, forward: DataFrame | None = None) -> DataFrame:
    """``daily`` of signals and forward returns on one grid; without ``forward`` the signals bring theirs along as ``fwd``."""
    return daily(tradable(lagged(weights(signals)), forward))


def net(days: DataFrame, bps: float | Column) -> DataFrame:
    """Deducts the cost of the turnover, in basis points of it; no turnover costs nothing."""
    if isinstance(bps, (int, float)) and bps < 0:
        raise ValueError("costs can't be negative")
    cost = F.coalesce("turnover", F.lit(0.0)) * (F.lit(float(bps)) if isinstance(bps, (int, float)) else bps) / 10_000
    return days.withColumn("port_ret", F.col("port_ret") - cost)


def drawdowns(days: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Largest loss from a peak of wealth that starts at 1: ``by``, max_drawdown."""
    so_far = Window.partitionBy(*by).orderBy("d_idx").rowsBetween(Window.unboundedPreceding, 0)
    wealth = days.where("port_ret IS NOT NULL").withColumn("wealth", F.product(1 + F.col("port_ret")).over(so_far))
    peak = F.greatest(F.lit(1.0), F.max("wealth").over(so_far))
    return wealth.withColumn("loss", 1 - F.col("wealth") / peak).groupBy(*by).agg(F.max("loss").alias("max_drawdown"))


def annual(horizon: int) -> float:
    return math.sqrt(PERIODS / horizon)


def sharpe(horizon: int) -> Column:
    """Infinite where there is no deviation, null without observations."""
    sd = F.stddev_samp("port_ret")
    return F.when(F.count("port_ret") > 0, F.when(sd > 0, F.avg("port_ret") / sd * annual(horizon)).otherwise(INF))


def sortino(horizon: int) -> Column:
    down = F.sqrt(F.avg(F.pow(F.least("port_ret", F.lit(0.0)), 2)))
    return F.when(F.count("port_ret") > 0, F.when(down > 0, F.avg("port_ret") / down * annual(horizon)).otherwise(INF))


def metrics(days: DataFrame, horizon: int, by: tuple[str, ...] = ("expr_id",)) -> DataFrame:
    """The metrics of each group: sharpe, sortino, max_drawdown, annualized_volatility, ic, turnover, n_observations."""
    summed = days.groupBy(*by).agg(
        sharpe(horizon).alias("sharpe"), sortino(horizon).alias("sortino"), (F.stddev_samp("port_ret") * annual(horizon)).alias("annualized_volatility"),
        F.avg("ic").alias("ic"), F.avg("turnover").alias("turnover"), F.count("port_ret").alias("n_observations"),
    )
    return summed.join(drawdowns(days, by), list(by), "left")


def split_ranges(n: int, horizon: int, train: float, validation: float, test: float) -> dict[str, tuple[int, int]]:
    """Half-open ranges of d_idx; each split gives up its last ``horizon - 1`` dates, whose returns reach into the next."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    if min(train, validation, test) <= 0 or not math.isclose(train + validation + test, 1.0):
        raise ValueError("fractions must be positive and add up to 1")
    stops = [0, math.floor(n * train), math.floor(n * (train + validation)), n]
    out = {name: (a, b - horizon + 1) for name, a, b in zip(("train", "validation", "test"), stops, stops[1:], strict=False)}
    if any(a >= b for a, b in out.values()):
        raise ValueError("a split is empty")
    return out


def split_dim(panel: DataFrame, horizon: int, fractions: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """d_idx, date, split of all dates that belong to one."""
    dates = panel.select("d_idx", "date").distinct()
    ranges = split_ranges(dates.count(), horizon, *fractions)
    split = F.coalesce(*(F.when(F.col("d_idx").between(a, b - 1), F.lit(name)) for name, (a, b) in ranges.items()))
    return dates.withColumn("split", split).where("split IS NOT NULL")
