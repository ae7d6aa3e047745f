"""Quality rules: plain counts, and a likelihood ratio of hashed n-grams.

Two multinomials over hashed character n-grams are counted, one over trusted
texts and one over the raw corpus.  A document's score is the mean over its
n-grams of the logarithm of the ratio of both, so it doesn't grow with length.
Every document is kept or rejected by a fixed threshold; nothing is sampled.

The counts are summed per task before they are shuffled, at most ``buckets``
rows a task, whatever the documents; the model is ``buckets`` numbers.  Trusted
texts that are given by their ids are found without a shuffle of texts: the ids
go to the tasks in blocks of at most ``BLOCK``, one narrow pass a block, and a
block is all that the driver and the tasks hold besides the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.storage import trimmed
from sigloom.llm.textstats import base_counts

#: Number of hash buckets, length of the n-grams, and the lowest score that is kept, in nats an n-gram.
BUCKETS, NGRAM, THRESHOLD = 1 << 14, 3, -0.4
#: Ids that are sent to the tasks at once: 8 bytes each, so 16 MB in the driver and in a Python worker.
BLOCK = 2_000_000
#: Factors of the hash, one a place: hash = (sum of code point * factor) mod PRIME mod buckets.
FACTORS, PRIME = (1_000_003, 10_007, 101), 2_147_483_647
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_grams long, score double"


def hashed(text: str | None, buckets: int = BUCKETS, n: int = NGRAM) -> np.ndarray:
    """The buckets of all character n-grams of a whole text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = len(codes) - n + 1
    if size < 1:
        return np.empty(0, np.int64)
    total = np.zeros(size, np.int64)
    for k in range(n):
        total += codes[k : k + size] * FACTORS[k]
    return total % PRIME % buckets


def counts(texts: DataFrame, buckets: int = BUCKETS, ids: Broadcast | None = None) -> np.ndarray:
    """Occurrences of each bucket in the column ``text`` of all rows, or of those whose ``doc_id`` is in ``ids`` (ascending)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own = batch.column(0)
            if ids is not None:
                x = batch.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
                own = own.filter(pa.array(ids.value[np.minimum(np.searchsorted(ids.value, x), len(ids.value) - 1)] == x))
            for k in range(0, len(own), 256):
                grams = [hashed(t, buckets) for t in own.slice(k, 256).to_pylist()]
                total += np.bincount(np.concatenate(grams), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select("text") if ids is None else texts.where("doc_id IS NOT NULL").select("text", "doc_id")
    for bucket, n in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def id_blocks(ids: DataFrame, most: int = BLOCK) -> Iterator[np.ndarray]:
    """All distinct values of the column ``doc_id``, each in one ascending block; dealt by a hash in slices of about a quarter of ``most``."""
    known = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    slices = 1 + 4 * known.count() // most
    cut = known.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    parts: list[list[int]] = []
    held = most
    for k, n in sorted(cut.groupBy("slice").count().collect()):
        if held + n > most:
            parts.append([])
            held = 0
        parts[-1].append(k)
        held += n
    for part in parts:  # slices of a block follow one another
        yield np.sort(cut.where(F.col("slice").between(part[0], part[-1])).select("doc_id").toArrow()["doc_id"].to_numpy())


def counts_by_id(spark: SparkSession, docs: DataFrame, ids: DataFrame, buckets: int = BUCKETS, most: int = BLOCK) -> np.ndarray:
    """Occurrences of each bucket in all rows of ``docs`` whose ``doc_id`` is in ``ids``: a narrow pass a block of ids."""
    total = np.zeros(buckets, np.int64)
    for block in id_blocks(ids, most):
        sent = spark.sparkContext.broadcast(block)
        total += counts(docs, buckets, sent)
        sent.destroy()
    return total


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Logarithm of the ratio of both multinomials, each with one more of every bucket; zeros if there is nothing to trust."""
    if not trusted.sum():
        return np.zeros(len(raw))
    return np.log((trusted + 1) / (trusted.sum() + len(trusted))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def judge(text: str | None, ratio: np.ndarray, threshold: float) -> tuple:
    """Counts, base_failed, kept, n_grams and score of a whole text."""
    n_words, chars, symbols, lines, repeats = base_counts(text)
    failed = n_words < 20 or 100 * repeats > 30 * n_words
    grams = hashed(text, len(ratio))
    score = float(ratio[grams].sum() / len(grams)) if len(grams) else 0.0
    return n_words, chars, symbols, lines, repeats, failed, not failed and score >= threshold, len(grams), score


def _counted(trusted: DataFrame | np.ndarray, buckets: int) -> np.ndarray:
    return trusted if isinstance(trusted, np.ndarray) else counts(trusted, buckets)


def keep_by_rules(spark: SparkSession, docs: DataFrame, trusted: DataFrame | np.ndarray, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_rules`` keeps; judged where they are read, without a join.

    Rows are judged one by one, so repeated rows, null ids and clashing names
    stay as they are; null and empty texts go; a score equal to the threshold
    is kept; no rows give none.
    """
    sent = spark.sparkContext.broadcast(log_ratio(_counted(trusted, buckets), counts(docs, buckets)))
    at = docs.columns.index("text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array([judge(t, sent.value, threshold)[6] for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(spark: SparkSession, docs: DataFrame, trusted: DataFrame | np.ndarray, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Counts, score and verdict for every document.

    ``trusted`` is a table of texts (column ``text``) known to be good, or the
    counts of their ``buckets`` (see ``counts_by_id``).  A null
    or empty text has zero counts and fails the base rules; a text without an
    n-gram scores 0; a score equal to the threshold is kept; with no trusted texts at all every score is 0, so the base
    rules alone decide.  Repeated rows are judged alike; other columns are
    ignored; no rows give none.
    """
    sent = spark.sparkContext.broadcast(log_ratio(_counted(trusted, buckets), counts(docs, buckets)))  # ``buckets`` doubles

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = [judge(text, sent.value, threshold) for text in batch.column(1).slice(k, 256).to_pylist()]
                yield pa.record_batch(
                    [batch.column(0).slice(k, 256).cast(pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the query over ``documents`` with the good rows of ``labels`` as trusted texts."""
    f1, f2, f3 = FACTORS
    return rf"""
    WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    chars AS MATERIALIZED (SELECT doc_id, string_split(regexp_replace(text, '(?s)(.)', '\1' || chr(57344), 'g'), chr(57344)) AS c FROM docs),
    codes AS (SELECT doc_id, list_transform(c[1:len(c) - 1], lambda x: unicode(x)::BIGINT) AS u FROM chars),
    grams AS MATERIALIZED (
      SELECT doc_id, unnest(list_transform(range(1, greatest(len(u) - 1, 1)), lambda i: (u[i] * {f1} + u[i + 1] * {f2} + u[i + 2] * {f3}) % {PRIME} % {BUCKETS})) AS b
      FROM codes),
    raw AS (SELECT b, count(*) AS n FROM grams GROUP BY b),
    good AS (SELECT b, count(*) AS n FROM grams WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY b),
    ratio AS (
      SELECT raw.b, ln((coalesce(good.n, 0) + 1) / ((SELECT sum(n) FROM good) + {BUCKETS}))
                  - ln((raw.n + 1) / ((SELECT sum(n) FROM raw) + {BUCKETS})) AS r
      FROM raw LEFT JOIN good USING (b)),
    scores AS (SELECT doc_id, count(*) AS n_grams, sum(r) / count(*) AS score FROM grams JOIN ratio USING (b) GROUP BY doc_id),
    word AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
    windows AS (
      SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g
      FROM word WHERE len(w) >= 9),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
    again AS (
      SELECT doc_id, sum(n - 1) AS n FROM (
        SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
      GROUP BY doc_id),
    base AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM word LEFT JOIN again USING (doc_id) LEFT JOIN covered USING (doc_id))
    SELECT base.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(score, 0) >= {threshold} AS kept
    FROM base LEFT JOIN scores USING (doc_id)
    """
