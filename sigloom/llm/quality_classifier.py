"""Quality classifier: regularised quadratic discriminant.

Each document becomes a vector of transformed statistics of its whole text.  A
class is a normal distribution with its own covariance, shrunk towards the
pooled one and towards a multiple of the identity.  The score is the posterior
of class 1: the difference of both log densities (Mahalanobis distances by
Cholesky factors that are computed once, log determinants, and priors).

Training needs sums of outer products only; each task adds up its own before
the shuffle, so the driver gets a few hundred numbers whatever the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.storage import Workspace, trimmed
from sigloom.llm.textstats import BLANKS, SYMBOLS, n_dup_lines, repeated, word_ids, words

#: Shrinkage towards the pooled covariance, and towards a scaled identity.
POOL, RIDGE = 0.2, 0.02
#: Names of the statistics, in order.
STATISTICS = (
    "words", "word_length", "symbols", "digits", "capitals", "marks", "distinct", "dup_lines", "repeats_2", "repeats_8", "top_word", "neighbours", "line_words", "packed",
)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _share(part: float, whole: float) -> float:
    """Square root of a share: spreads small shares, as counts of rare things have."""
    return math.sqrt(part / whole) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The vector of a whole text; a null text counts as empty."""
    text = text or ""
    items = words(text)
    n, ids = len(items), word_ids(items)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.bincount(np.minimum(codes, 128), minlength=129)
    lines = text.count("\n") + 1
    counts = np.bincount(ids) if n else np.zeros(1, np.int64)
    # Bytes that a general compressor leaves of all pieces of 8 KB: long texts aren't favoured by a longer memory.
    raw = text.encode("utf-8", "surrogatepass")
    packed = sum(len(zlib.compress(raw[k : k + 8192], 1)) for k in range(0, len(raw), 8192))
    return [
        math.log1p(n),
        math.log1p(chars / n) if n else 0.0,
        _share(sum(low[ord(c)] for c in SYMBOLS), chars),
        _share(low[48:58].sum(), chars),
        _share(low[65:91].sum(), chars),
        _share(sum(low[ord(c)] for c in ".,;:!?"), chars),
        math.log1p(len(counts)) / math.log1p(n) if n else 1.0,
        _share(n_dup_lines(text), lines),
        _share(repeated(ids, 2), n),
        _share(repeated(ids, 8), n),
        _share(counts.max(), n),
        _share(int((ids[1:] == ids[:-1]).sum()), n),
        math.log1p(n / lines),
        math.sqrt(packed / len(raw)) if raw else 1.0,
    ]


class Discriminant:
    """Two normal densities with cached Cholesky factors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE) -> None:
        """``sums``: of each class, the number of rows, the sum of vectors and the sum of outer products."""
        self.classes: dict[int, tuple] = {}
        total = sum(n for n, _, _ in sums.values())
        self.share = sums[1][0] / total if total and 1 in sums else (0.0 if total else 0.5)
        if len(sums) < 2:
            return
        size = len(next(iter(sums.values()))[1])
        means = {c: s / n for c, (n, s, _) in sums.items()}
        own = {c: q / n - np.outer(means[c], means[c]) for c, (n, _, q) in sums.items()}
        pooled = sum(own[c] * sums[c][0] for c in own) / total
        # Statistics differ in scale, so the identity stands for the pooled variances.
        spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
        for c in own:
            # Few rows lean more on the pooled covariance.
            lean = min(1.0, pool + size / (size + sums[c][0]))
            shrunk = (1 - ridge) * ((1 - lean) * own[c] + lean * pooled) + ridge * spread
            factor = np.linalg.cholesky(shrunk)
            self.classes[c] = (means[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), math.log(sums[c][0] / total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for the rows of ``x``."""
        if not self.classes:
            return np.full(len(x), self.share)
        log = {}
        for c, (mean, inverse, volume, prior) in self.classes.items():
            z = (x - mean) @ inverse.T
            log[c] = -0.5 * ((z * z).sum(axis=1) + volume) + prior
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the vector of every document; a narrow pass."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                x = [statistics(t) for t in batch.column(1).slice(k, 256).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(k, 256).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def train(rows: DataFrame) -> Discriminant:
    """Fit on all rows of ``x`` and ``quality`` (0 or 1)."""
    size = len(STATISTICS)
    places = size * size + size + 1

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, places))
        for batch in batches:
            x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c in (0, 1):
            yield pa.record_batch([pa.array(np.full(places, c)), pa.array(np.arange(places)), pa.array(total[c])], names=["class", "place", "v"])

    got = np.zeros((2, places))
    summed = rows.select("x", F.col("quality").cast("long")).mapInArrow(run, "class long, place long, v double").groupBy("class", "place").agg(F.sum("v"))
    for c, place, v in summed.collect():
        got[c, place] = v
    return Discriminant({c: (v[0], v[1 : size + 1], v[size + 1 :].reshape(size, size)) for c, v in enumerate(got) if v[0]})


def held_out(folds: int) -> Column:
    """Rows whose ``crc32(doc_id)`` is 0 modulo ``folds``; never those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def fit(known: DataFrame, labels: DataFrame, folds: int) -> Discriminant:
    """Train on the vectors (doc_id, x) that have a label and aren't held out."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out(folds))
    return train(known.join(marks, "doc_id").select("x", "quality"))


def quality_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, cut: float = 0.3) -> DataFrame:
    """Score every document as ``labels.quality`` would mark it.

    Labels whose ``crc32(doc_id)`` is 0 modulo ``folds`` are held out of
    training.  Labels of null or of other values than 0 and 1 are left out;
    where a document has several, the best counts.  Texts of null are scored as
    empty ones.  With one class in training every score is that class; with no
    labels every score is 0.5.  A null doc_id isn't held out.  Repeated rows
    are scored alike; other columns are ignored; no rows give none.
    """
    known = Workspace(spark, "statistics").cut(vectors(docs), "x")
    sent = spark.sparkContext.broadcast(fit(known, labels, folds))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            x = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS))
            score = model.scores(x)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return known.select("doc_id", held_out(folds).alias("held_out"), "x").mapInArrow(run, SCHEMA)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_classifier`` predicts 1; scored where they are read, without a join.

    Rows are scored one by one, so repeated rows, null ids and clashing names
    stay as they are; null and empty texts are scored alike; no rows give none.
    """
    # A table between both Python steps, so a task never holds two workers.
    sent = spark.sparkContext.broadcast(fit(Workspace(spark, "statistics").cut(vectors(docs), "x"), labels, folds))
    at = docs.columns.index("text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array(sent.value.scores(np.array([statistics(t) for t in part.column(at).to_pylist()])) >= cut))

    return docs.mapInArrow(run, docs.schema)
