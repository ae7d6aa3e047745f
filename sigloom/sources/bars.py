"""Price and volume bars: from trades, from files by ticker, and from a remote service."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours that a raw file counts as fresh, attempts for a download, and the share of tickers that may fail.
FRESH_HOURS, ATTEMPTS, FAILURE_SHARE = 24, 5, 0.10


def trade_bars(spark: SparkSession, sf_dir: str, grain: str = "week", ticker: str = "p_brand") -> DataFrame:
    """date, ticker, close, volume from ``lineitem`` and ``part``: average price and quantity per grain and kind of part.

    Only five columns are scanned.  Amounts are summed as decimals, so the sums don't depend on their order.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col(ticker).alias("ticker"))
    amount, quantity = (F.sum(F.col(c).cast("decimal(18,2)")).cast("double") for c in ("l_extendedprice", "l_quantity"))
    dated = lines.join(parts, "l_partkey").groupBy(F.date_trunc(grain, "l_shipdate").cast("date").alias("date"), "ticker")
    return dated.agg((amount / F.nullif(quantity, F.lit(0.0))).alias("close"), quantity.alias("volume"))


def file_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The same from one Parquet file a ticker, whose name is the ticker; Close and Volume in any spelling of case.

    Long rows make the alignment on dates superfluous.  Missing values are null.
    """
    raw = spark.read.option("mergeSchema", "true").parquet(folder)
    named = {c.lower(): c for c in raw.columns}
    if missing := [c for c in ("date", "close", "volume") if c not in named]:
        raise ValueError(f"no file has the fields {missing}")
    value = lambda c: F.nanvl(F.col(named[c]).cast("double"), F.lit(None)).alias(c)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.parquet$", "")
    folder_name = F.regexp_extract(F.col("_metadata.file_path"), "ticker=([^/]+)/", 1)
    ticker = F.col("ticker").cast("string") if "ticker" in named else F.when(folder_name != "", folder_name).otherwise(name)
    return raw.select(F.col(named["date"]).cast("date").alias("date"), ticker.alias("ticker"), value("close"), value("volume"))


def write_raw(bars: DataFrame, folder: str) -> None:
    """One folder a ticker; Spark's committer makes the write all or nothing."""
    bars.repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").parquet(folder)


def read_tables(spark: SparkSession, paths: Iterable[str]) -> list[DataFrame]:
    """Saved tables; names all missing ones at once."""
    jvm, conf, missing = spark._jvm, spark._jsc.hadoopConfiguration(), []
    paths = list(paths)
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        if not target.getFileSystem(conf).exists(target):
            missing.append(p)
    if missing:
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    return [spark.read.parquet(p) for p in paths]


def is_fresh(path: str | Path, hours: float = FRESH_HOURS, now: float | None = None) -> bool:
    """Whether a local file is younger than ``hours``."""
    p = Path(path)
    return p.exists() and (now or time.time()) - p.stat().st_mtime < hours * 3600


def download(tickers: Iterable[str], fetch: Callable[[str], object], folder: str | Path, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Fetch a frame for each distinct ticker without a fresh file, with retries; gives the tickers that failed.

    ``fetch`` is the remote service and returns a pandas frame; an empty one
    counts as a failure.  More failures than a tenth of the tickers (one at
    least) raise ``RuntimeError``, fewer are warned of.
    """
    names = list(dict.fromkeys(tickers))
    Path(folder).mkdir(parents=True, exist_ok=True)
    failed = []
    for name in names:
        path = Path(folder) / f"{name}.parquet"
        if is_fresh(path):
            continue
        for attempt in range(1, ATTEMPTS + 1):
            try:
                frame = fetch(name)
                if frame is None or frame.empty:
                    raise ValueError(f"no rows for {name}")
                partial = path.with_suffix(".tmp")
                frame.to_parquet(partial, coerce_timestamps="us", allow_truncated_timestamps=True)  # Spark reads no nanoseconds
                partial.replace(path)
                break
            except (OSError, RuntimeError, ValueError):
                if attempt < ATTEMPTS:
                    sleep(2**attempt)
        else:
            failed.append(name)
    if len(failed) > max(1, math.floor(FAILURE_SHARE * len(names))):
        raise RuntimeError(f"{len(failed)} of {len(names)} tickers failed: {failed[:10]}")
    if failed:
        warnings.warn(f"no data for {failed}", stacklevel=2)
    return failed
