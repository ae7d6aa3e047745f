"""Trial logs as feature tables, and what is counted and compared on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.signals import FAMILIES

PARAMETERS = ("lookback", "short", "long", "normalize_lookback")
OUTCOMES = ("sharpe", "sortino", "ic", "turnover", "annualized_volatility", "max_drawdown")
EXPRESSION = "struct<lookback: int, long: int, normalize_by: string, normalize_lookback: int, primitive: string, short: int>"
STRUCTURE = (*PARAMETERS, *(f"primitive_{f}" for f in FAMILIES), "normalize_by_volatility")


def parsed(trials: DataFrame) -> DataFrame:
    """Adds ``e``, the expression's fields; an unknown primitive is an error."""
    e = F.from_json("expression", EXPRESSION)
    known = F.when(e["primitive"].isin(*FAMILIES), e)
    return trials.withColumn("e", F.coalesce(known, F.raise_error(F.lit("expression must hold a supported primitive")).cast(EXPRESSION)))


def label(e: Column) -> Column:
    """Short text of an expression."""
    size = F.when(e["primitive"] == "ma_crossover", F.concat_ws("/", e["short"], e["long"])).otherwise(F.coalesce(e["lookback"].cast("string"), F.lit("—")))
    by = F.when(e["normalize_by"] == "volatility", F.concat(F.lit(", ÷ vol "), e["normalize_lookback"])).otherwise("")
    return F.concat(e["primitive"], F.lit(" ("), size, F.lit(")"), by)


def exposed(trials: DataFrame) -> DataFrame:
    """The log with primitive, normalizer, expression_label, row_id and source_iteration as columns."""
    out = parsed(trials).withColumns(
        {"primitive": F.col("e.primitive"), "normalizer": F.coalesce("e.normalize_by", F.lit("none")), "expression_label": label(F.col("e")), "row_id": F.concat_ws(":", "optimizer", "iteration")}
    )
    return (out if "source_iteration" in trials.columns else out.withColumn("source_iteration", F.col("iteration"))).drop("e")


def chosen(trials: DataFrame, primitives: list[str], optimizers: list[str], low: float, high: float) -> DataFrame:
    """The dashboard's filter on an exposed log."""
    return trials.where(F.col("primitive").isin(primitives) & F.col("optimizer").isin(optimizers) & F.col("sharpe").between(low, high))


def by_row_id(exposed_trials: DataFrame, row_id: str) -> DataFrame:
    """The one evaluation that was selected, or no row."""
    return exposed_trials.where(F.col("row_id") == row_id)


def raw_features(trials: DataFrame, key: str = "iteration", outcomes: bool = True) -> DataFrame:
    """``key`` and 16 numbers (10 without outcomes); absent parameters are 0."""
    e = parsed(trials)
    number = [F.coalesce(F.col(f"e.{p}"), F.lit(0)).cast("double").alias(p) for p in PARAMETERS]
    hot = [(F.col("e.primitive") == f).cast("double").alias(f"primitive_{f}") for f in FAMILIES]
    by = F.coalesce(F.col("e.normalize_by") == "volatility", F.lit(False)).cast("double").alias("normalize_by_volatility")
    finite = [F.when(F.abs(m) < float("inf"), F.col(m)).alias(m) for m in OUTCOMES] if outcomes else []
    return e.select(key, *number, *hot, by, *finite)


def medians(raw: DataFrame, key: str = "iteration") -> DataFrame:
    return raw.agg(*(F.percentile(c, 0.5).alias(c) for c in raw.columns if c != key))


def imputed(raw: DataFrame, key: str = "iteration") -> DataFrame:
    """Missing numbers become the column's median, or 0."""
    middle = medians(raw, key).first()  # one row; as literals it doesn't double the plan
    return raw.select(key, *(F.coalesce(F.col(c), F.lit(middle[c]), F.lit(0.0)).alias(c) for c in raw.columns if c != key))


def scaled(full: DataFrame, key: str = "iteration") -> DataFrame:
    """Columns of mean 0 and population deviation 1; constant ones become 0."""
    names = [c for c in full.columns if c != key]
    told = full.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names)).first()
    # Deviations at the level of rounding are none.
    value = lambda c: (F.col(c) - F.lit(told[c].m)) / F.lit(told[c].s) if (told[c].s or 0) > 1e-12 else F.lit(0.0)
    return full.select(key, *(value(c).alias(c) for c in names))


def features(trials: DataFrame, key: str = "iteration", outcomes: bool = True) -> DataFrame:
    return scaled(imputed(raw_features(trials, key, outcomes), key), key)


def as_vectors(table: DataFrame, key: str) -> DataFrame:
    """key, x: all other columns as one array."""
    return table.select(F.col(key).alias("key"), F.array(*(F.col(c).cast("double") for c in table.columns if c != key)).alias("x"))


def pair_distances(vectors: DataFrame) -> DataFrame:
    """a, b, distance of all unordered pairs; for trial logs, which have some hundred rows."""
    a, b = vectors.select(F.col("key").alias("a"), F.col("x").alias("xa")), vectors.select(F.col("key").alias("b"), F.col("x").alias("xb"))
    square = F.aggregate(F.zip_with("xa", "xb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(square).alias("distance"))


def neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """key, neighbour, distance, place: the ``k`` nearest of each, equals by key."""
    half = pair_distances(vectors)
    both = half.select(F.col("a").alias("key"), F.col("b").alias("neighbour"), "distance").unionByName(half.select(F.col("b").alias("key"), F.col("a").alias("neighbour"), "distance"))
    near = Window.partitionBy("key").orderBy(F.round("distance", 9), "neighbour")
    return both.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)


def mutual_reachability(vectors: DataFrame, k: int) -> DataFrame:
    """a, b, distance: no less than either's distance to its ``k``-th neighbour, itself being the first."""
    core = neighbours(vectors, k - 1).groupBy("key").agg(F.max("distance").alias("core"))
    half = pair_distances(vectors)
    out = half.join(core.select(F.col("key").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("key").alias("b"), F.col("core").alias("cb")), "b")
    return out.select("a", "b", F.greatest("distance", "ca", "cb").alias("distance"))


def crosstab(rows: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def purity(rows: DataFrame, cluster: str, kind: str) -> DataFrame:
    counts = rows.groupBy(cluster, kind).count()
    return counts.groupBy(cluster).agg(F.max("count").alias("most"), F.sum("count").alias("all")).agg((F.sum("most") / F.sum("all")).alias("purity"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Normalized by the mean of both entropies; 1 for two partitions of one cell."""
    counts = rows.groupBy(a, b).count()
    own = counts.select("count", F.sum("count").over(Window.partitionBy(a)).alias("ca"), F.sum("count").over(Window.partitionBy(b)).alias("cb"))
    total = own.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    p, pa, pb = F.col("count") / F.col("n"), F.col("ca") / F.col("n"), F.col("cb") / F.col("n")
    # A cell's part of an entropy is its share of the margin's.
    told = total.agg(F.sum(p * F.log(p / (pa * pb))).alias("mi"), F.sum(-p * F.log(pa)).alias("ha"), F.sum(-p * F.log(pb)).alias("hb"))
    return told.select(F.when(F.col("ha") + F.col("hb") > 0, F.greatest(F.lit(0.0), F.col("mi")) * 2 / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def optimizer_summary(trials: DataFrame) -> DataFrame:
    return trials.groupBy("optimizer").agg(F.count("sharpe").alias("count"), F.avg("sharpe").alias("mean"), F.percentile("sharpe", 0.5).alias("median"), F.max("sharpe").alias("max"))


def top_share(trials: DataFrame, q: float = 0.9) -> DataFrame:
    """Trials at or above the quantile of the Sharpe ratio, with the cutoff."""
    (cutoff,) = trials.agg(F.percentile("sharpe", q)).first()
    return trials.withColumn("cutoff", F.lit(cutoff).cast("double")).where("sharpe >= cutoff")


def progress(trials: DataFrame) -> DataFrame:
    """The best Sharpe ratio so far of each optimizer; null where the trial has none."""
    so_far = Window.partitionBy("optimizer").orderBy("source_iteration")
    best = F.when(F.col("sharpe").isNotNull(), F.max("sharpe").over(so_far))
    return trials.select("optimizer", "source_iteration", F.row_number().over(so_far).cast("long").alias("optimizer_evaluation"), best.alias("best_sharpe"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, n, density over equal bins from the least to the greatest value."""
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    counted = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n", (F.col("n") / F.col("total") / F.nullif(width, F.lit(0.0))).alias("density"))
