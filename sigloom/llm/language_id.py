"""Language by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three letters, words
padded with a blank) in order of frequency.  A document's profile is compared
with each language's by the out-of-place distance: the sum over its n-grams of
how far their ranks differ, the greatest possible difference where the language
lacks one.  The nearest language wins.

Training sums n-gram counts in each task before the shuffle; the ranking per
language keeps the first ranks in every task before rows of one language meet
(a limit within the window), so a language with most of the rows is no
bottleneck.  Profiles are ``size`` rows a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranks in a profile.
SIZE = 300
_BLANK = 1
_SHIFT = 21
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a whole text, ascending, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, _BLANK).astype(np.int64)
    codes = np.concatenate([[_BLANK], codes, [_BLANK]])
    blank = codes == _BLANK
    two = codes[:-1] << _SHIFT | codes[1:]
    three = two[:-1] << _SHIFT | codes[2:]
    grams = np.concatenate([codes[~blank], two[~(blank[:-1] & blank[1:])], three[~(blank[1:-1])]])
    return np.unique(grams, return_counts=True)


def profile(grams: np.ndarray, count: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts by code."""
    return grams[np.lexsort((grams, -count))[:size]]


class Profiles:
    """Language profiles, ready for comparison."""

    def __init__(self, ranked: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(ranked), size
        self.codes, self.ranks = [], []
        for name in self.names:
            codes = np.array(ranked[name], np.int64)
            order = np.argsort(codes)
            self.codes.append(codes[order])
            self.ranks.append(order)

    def distances(self, own: np.ndarray) -> list[int]:
        """Out-of-place distance to each language."""
        out, mine = [], np.arange(len(own))
        for codes, ranks in zip(self.codes, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            out.append(int(np.where(codes[at] == own, np.abs(ranks[at] - mine), self.size).sum()))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language (the first name of equals) and 1 - distance / greatest distance; ``und``, 0 without letters."""
        own = profile(*gram_counts(text), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        far = self.distances(own)
        best = int(np.argmin(far))
        return self.names[best], 1.0 - far[best] / (self.size * len(own))


def train(rows: DataFrame, size: int = SIZE) -> dict[str, list[int]]:
    """Profiles from columns ``text`` and ``lang`` of all rows; rows without either teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, where = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([c for _, c in held[lang]])).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            grams, count = merged(lang)
            return pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(count, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for text, lang in zip(batch.column(0).slice(k, 256).to_pylist(), batch.column(1).slice(k, 256).to_pylist(), strict=True):
                    held.setdefault(lang, []).append(gram_counts(text))
                    sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1][0])
                for lang in [x for x, n in sizes.items() if n > 1_000_000]:  # memory stays bounded
                    held[lang] = [merged(lang)]
                    sizes[lang] = len(held[lang][0][0])
                    if sizes[lang] > 500_000:
                        yield out(lang)
                        del held[lang], sizes[lang]
        for lang in held:
            yield out(lang)

    taught = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    total = taught.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for lang, gram, _ in total.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size).orderBy("lang", "rank").select("lang", "gram", "rank").collect():
        ranked.setdefault(lang, []).append(gram)
    return ranked


def language_id(spark: SparkSession, docs: DataFrame, folds: int = 4, fold: int = 2, size: int = SIZE) -> DataFrame:
    """Predict every document's language from its text alone.

    Profiles are learned from rows with a language whose ``crc32(doc_id)`` is
    not ``fold`` modulo ``folds``.  A null text, or one without a letter, is
    ``und`` with score 0, as is every text if nothing was learned.  A null
    doc_id is never held out.  Repeated rows are predicted alike; other columns
    are ignored; no rows give none.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    sent = spark.sparkContext.broadcast(train(docs.where(~held), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(sent.value, size)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                got = [profiles.predict(t) for t in batch.column(2).slice(k, 256).to_pylist()]
                yield pa.record_batch(
                    [batch.column(0).slice(k, 256).cast(pa.int64()), batch.column(1).slice(k, 256), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)
