"""Forward scoring as new bars arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BARS = "date date, ticker string, close double, volume double"


def forward_stream(spark: SparkSession, folder: str, history: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append the bars that arrive in ``folder`` to ``history``, then score all of it anew into ``out``.

    Each trigger takes what is there and stops, so a scheduler reruns it.  A
    batch is written under its own number, so a repeated one replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{history}/batch={number}")
        score(spark.read.parquet(history).drop("batch").dropDuplicates(["date", "ticker"])).write.mode("overwrite").parquet(out)

    stream = spark.readStream.schema(BARS).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streaming_bars(trades: DataFrame, grain: str = "1 week", late: str = "2 weeks") -> DataFrame:
    """Bars of a stream of trades (ts, ticker, amount, quantity) in tumbling windows; trades later than ``late`` are left out."""
    windowed = trades.withWatermark("ts", late).groupBy(F.window("ts", grain), "ticker")
    return windowed.agg((F.sum("amount") / F.nullif(F.sum("quantity"), F.lit(0.0))).alias("close"), F.sum("quantity").alias("volume")).select(F.col("window.start").cast("date").alias("date"), "ticker", "close", "volume")
