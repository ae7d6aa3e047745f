"""Equi-joins of many rows with few, where one key may hold a third of the rows.

A key with more than a ``HOT``-th of all rows is hot; there can't be more than
``HOT`` of them, so their list is broadcast.  The rows of a hot key are dealt to
parts by a hash of another column, and the one row of the other side is copied
to each part, so no task gets much more than a ``HOT``-th of the rows.  Spark
doesn't do this by itself where a side of the join is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are hot, whatever the input.
HOT = 2000
#: A part isn't made smaller than this.
LEAST = 256


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """``key`` and ``parts`` of hot keys; ``counts`` has one row a key with its number of rows ``n``, ``total`` is at least their sum."""
    share = max(LEAST, total // HOT)
    return F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("parts")))


def dealt(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with ``part``: by a hash of ``by`` where ``key`` is hot, else 0."""
    return rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def copied(few: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``few`` (one row a key) with ``part``: a copy for each part of the key."""
    return few.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
