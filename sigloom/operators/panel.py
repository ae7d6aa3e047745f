"""Dense panels of dates and tickers, and their quality.

Missing is always null.  Windows count rows of the dense grid, never days.
Panels are as large as dates times tickers, whatever the number of trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of tickers that a date needs, and share of dates that a ticker may miss.
COVERAGE, MISSING = 0.90, 0.05


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def common_tickers(bars: DataFrame) -> DataFrame:
    """Tickers with both a close and a volume somewhere."""
    return bars.groupBy("ticker").agg(F.count("close").alias("c"), F.count("volume").alias("v")).where("c > 0 AND v > 0").select("ticker")


def dense(bars: DataFrame) -> DataFrame:
    """A row for every date and common ticker: the grid is the product of both lists, as many rows as the panel has cells."""
    grid = bars.select("date").distinct().crossJoin(common_tickers(bars))
    return grid.join(bars, ["date", "ticker"], "left").select("date", "ticker", "close", "volume")


def _share(column: str, by: str) -> Column:
    """Share of cells of the grid with a value, among those of one date or ticker."""
    own = Window.partitionBy(by)
    return F.count(column).over(own) / F.count("*").over(own)


def eligible_dates(bars: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Dates on which enough of the tickers have a close: date, covered."""
    return dense(bars).groupBy("date").agg((F.count("close") / F.count("*")).alias("covered")).where(F.col("covered") >= coverage)


def filled(bars: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The grid of eligible dates; the first row of each gap takes the value before it."""
    grid = dense(bars).withColumn("covered", _share("close", "date")).where(F.col("covered") >= coverage)
    first = lambda c: F.coalesce(c, F.lag(c).over(by_ticker())).alias(c)
    return grid.select("date", "ticker", first("close"), first("volume"))


def kept_tickers(grid: DataFrame, missing: float = MISSING) -> DataFrame:
    """Tickers that miss few closes and few volumes: ticker, missing_close, missing_volume."""
    share = lambda c: (1 - F.count(c) / F.count("*")).alias(f"missing_{c}")
    return grid.groupBy("ticker").agg(share("close"), share("volume")).where(f"missing_close <= {missing} AND missing_volume <= {missing}")


def build_panel(bars: DataFrame, coverage: float = COVERAGE, missing: float = MISSING) -> DataFrame:
    """d_idx, date, ticker, price, ret, volume of all cells of the clean panel.

    Windows by date and by ticker over the grid, no joins back to the bars: as
    the grid is dense, a ticker's rows are numbered like the dates.
    """
    grid = filled(bars, coverage).withColumn("lost", F.greatest(1 - _share("close", "ticker"), 1 - _share("volume", "ticker")))
    change = F.try_divide("close", F.lag("close").over(by_ticker())) - 1
    return grid.where(F.col("lost") <= missing).select(
        (F.row_number().over(by_ticker()) - 1).alias("d_idx"), "date", "ticker", F.col("close").alias("price"), change.alias("ret"), "volume"
    )


def missing_runs(grid: DataFrame, column: str = "close") -> DataFrame:
    """Longest run of missing values of each ticker: ticker, longest."""
    lost = F.col(column).isNull()
    turn = F.when(lost != F.lag(lost).over(by_ticker()), 1).otherwise(0)
    islands = grid.withColumn("lost", lost.cast("long")).withColumn("turn", turn).withColumn("island", F.sum("turn").over(by_ticker()))
    return islands.groupBy("ticker", "island").agg(F.sum("lost").alias("n")).groupBy("ticker").agg(F.max("n").alias("longest"))


def sanity(panel: DataFrame) -> DataFrame:
    """A row a ticker with the panel's summary and the ticker's own gaps."""
    whole = panel.agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.countDistinct("date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"),
        F.coalesce(F.bool_or(F.col("price") <= 0), F.lit(False)).alias("zero_or_negative_prices"), F.coalesce(F.bool_or(F.col("volume") < 0), F.lit(False)).alias("negative_volume"),
    )
    own = panel.groupBy("ticker").agg((1 - F.count("price") / F.count("*") > MISSING).alias("over_5pct_missing"))
    return own.join(missing_runs(panel, "price"), "ticker").crossJoin(whole).withColumnRenamed("longest", "max_missing_run")


def study_boundary(panel: DataFrame) -> DataFrame:
    return panel.agg(F.max("date").alias("boundary"))
