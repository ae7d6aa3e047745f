"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Each document becomes the set of its word shingles, hashed to 64 bits, and a
   SuperMinHash signature of it.  Documents with equal sets form a class;
   from here on only one document a class takes part, so exact copies, however many, cost nothing.
2. Bands of the signature are hashed to bucket keys.  Within a bucket,
   documents aren't paired with each other.  They are all paired with one
   centre, the document that shares most buckets, so the number of pairs is
   linear in the rows.  Pairs are confirmed on full sets.
3. Buckets whose documents are then in one component are done.  In the others,
   documents of different components are paired only where a link is possible.
   The shingles of all waiting documents are counted: those of one document
   can't be shared, those of at most ``RARE`` are rare, the rest are common.  A
   pair either shares a rare shingle, by which it is found in a group of at most
   ``RARE``, or its common shingles alone must be enough, which leaves few
   documents outside the component of their bucket's centre.  Both ways
   together lose no link; the Jaccard distance being a metric, distances to the
   centre may not differ by more than the allowed distance either.
4. Components of confirmed links are found by union-find (see ``components``).

Hot buckets and centres: counts, centres and component bounds are partial
aggregates; joins back to members are dealt by key and part (see ``hot_keys``); a
centre's set goes to the tasks that compare it, once for each ``BLOCK`` members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.components import components
from sigloom.llm.hot_keys import copied, dealt, hot_keys
from sigloom.llm.storage import Workspace, trimmed

#: Bands, and rows of a band.  With 32 of 5, a pair of similarity 0.8 shares no bucket with probability 3e-6, one of 0.85 with 7e-9.
BANDS, ROWS = 32, 5
#: Members of one centre that are compared in one group.
BLOCK = 128
#: Documents that a rare shingle has at most; it only decides by which of two exact ways a pair is found.
RARE = 64
#: A bucket of more waiting documents than this is compared in tiles of two parts of about so many.
TILE = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct runs of ``width`` words, ascending; of all words if there are fewer; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([one(b" ".join(words), 1 + len(words))], np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = mix(out + h[k : len(h) - width + 1 + k] + _GOLD)
    return np.unique(out)


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash of a set.

    Each element runs through its own random permutation of the slots; at step
    ``j`` it offers its slot the rank ``j`` plus a random fraction, and a slot
    keeps the least offer.  When every slot holds less than ``j + 1``, no later
    step can change it, so all elements stop.
    """
    best = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 1 << 15):  # a permutation is ``size`` bytes an element
        x = elements[at : at + (1 << 15)]
        places = rows = None
        for j in range(size):
            if best.max() < np.uint64(j) << np.uint64(48):
                break
            z = mix(x + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            pick = j + ((z & np.uint64(0xFFFF)) * np.uint64(size - j) >> np.uint64(16)).astype(np.int64)
            if j == 0:
                slot, first = pick, pick
            else:
                if places is None:  # the swap of the first step is made up for
                    rows = np.arange(len(x))
                    places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(x), 1))
                    places[rows, first] = 0
                slot = places[rows, pick]
                places[rows, pick] = places[:, j]
            np.minimum.at(best, slot, (np.uint64(j) << np.uint64(48)) | (z >> np.uint64(16)))
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key a band."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for k in range(rows):
        key = mix(key + sig.reshape(bands, rows)[:, k])
    return key.view(np.int64)


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text").alias("text_key")


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, digest of the set (null if empty) and bucket keys of every document."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sizes, digests, keys = [], [], []
                for text in batch.column(1).slice(k, 256).to_pylist():
                    own = shingles(text, width)
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    keys.append(band_keys(signature(own, bands * rows), bands, rows) if len(own) else None)
                yield pa.record_batch(
                    [batch.column(0).slice(k, 256).cast(pa.int64()), batch.column(2).slice(k, 256), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "digest", "keys"],
                )

    return docs.select("doc_id", "text", text_key()).mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, keys array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Similarity of every pair (a, b): adds ``both`` and ``all``, the sizes of the sets' intersection and union.

    The texts of ``b`` come to the text of ``a`` in groups of at most about
    ``BLOCK``; a task reads a group's ``a`` once and streams the rest.
    ``pairs`` is a written table, as it is read more than once.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "a", pairs.count())
    sizes = counts.select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = sizes.join(texts, F.col("a") == F.col("doc_id")).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    placed = dealt(pairs, hot, "a", "b").join(copied(sizes, hot, "a"), ["a", "part"]).select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b")
    right = placed.join(texts, F.col("b") == F.col("doc_id")).select("a", "block", "b", "text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            rows = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b is None:
                    if centre != a:
                        centre, own = a, shingles(text, width)
                    continue
                other = shingles(text, width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                rows.append((a, b, both, len(own) + len(other) - both))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "both", "all"])

    parts = left.unionByName(right).repartition(F.col("a"), F.col("block")).sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return parts.select("a", "b", "text").mapInArrow(run, "a long, b long, both long, all long")


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """shingle and rep: a row for each shingle of each document."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                sets = [shingles(t, width) for t in batch.column(1).slice(k, 64).to_pylist()]
                ids = np.repeat(batch.column(0).slice(k, 64).to_numpy(), [len(x) for x in sets])
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64)), pa.array(ids)], names=["shingle", "rep"])

    return texts.select("doc_id", "text").mapInArrow(run, "shingle long, rep long")


def grouped(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, node, component_id and kept of every row; rows of one ``node`` are linked (null without a set or an id)."""
    space = Workspace(spark, "minhash")
    known = space.cut(sketches(docs, width, bands, rows), "sketches")
    classes = space.cut(known.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("keys").alias("keys"), F.any_value("n_shingles").alias("n_shingles")).select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")

    # Buckets of two documents or more, each row with the number of documents that its document meets anywhere.
    rows_ = classes.select("rep", F.explode("keys").alias("key"))
    shared = space.cut(rows_.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hot = hot_keys(shared, "key", shared.agg(F.sum("n")).first()[0] or 0)
    met = dealt(rows_, hot, "key", "rep").join(copied(shared, hot, "key"), ["key", "part"]).groupBy("rep").agg(F.sum("n").alias("met"), F.collect_list(F.struct("key", "part")).alias("keys"))
    members = space.cut(met.select("rep", "met", F.inline("keys")), "members")
    greatest = members.groupBy("key").agg(F.max(F.struct("met", F.negative("rep").alias("rep"))).alias("c"))
    centres = space.cut(greatest.select("key", F.negative("c.rep").alias("centre")), "centres")
    placed = space.cut(members.join(copied(centres, hot, "key"), ["key", "part"]).select("key", "part", "rep", "centre"), "placed")

    # One text a class, however often its row is repeated and whatever else has its doc_id.
    involved = placed.select("rep").distinct().join(classes, "rep").select("rep", "first.doc_id", "first.text_key")
    found = docs.where("text IS NOT NULL").select("doc_id", "text", text_key()).join(involved, ["doc_id", "text_key"])
    texts = space.cut(found.groupBy("doc_id", "text_key").agg(F.min("rep").alias("rep"), F.min("text").alias("text")).select(F.col("rep").alias("doc_id"), "text"), "texts")

    linked = F.col("both") * 100 >= F.col("all") * percent
    star_pairs = space.cut(placed.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "star-pairs")
    stars = space.cut(confirm(star_pairs, texts, width), "stars")
    first = components(stars.where(linked).select("a", "b"), space, "first")

    # Each member with its component, that of the centre, and its distance to the centre.
    far = stars.select(F.col("a").alias("centre"), F.col("b").alias("rep"), (1 - F.col("both") / F.col("all")).alias("far"))
    mains = centres.join(first.select(F.col("node").alias("centre"), "component"), "centre", "left").select("key", F.coalesce("component", "centre").alias("main"))
    known_by = (
        placed.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(far, ["centre", "rep"])  # the centre itself has met everyone
        .join(copied(mains, hot, "key"), ["key", "part"])
        .select("key", "part", "rep", F.coalesce("component", "rep").alias("component"), "main", "far")
    )
    open_ = known_by.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    waiting = space.cut(known_by.join(copied(open_, hot, "key"), ["key", "part"]).join(classes.select("rep", F.col("n_shingles").alias("n")), "rep"), "waiting")
    # Shingles of the waiting documents: those of one document only, those of few, and the common ones.
    every = space.cut(shingle_rows(texts.join(waiting.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), width), "shingles")
    counted = every.groupBy("shingle").agg(F.count("*").alias("df"), F.min("rep").alias("rep"))
    solo = counted.where("df = 1").groupBy("rep").agg(F.count("*").alias("solo"))
    few = space.cut(every.join(counted.where(F.col("df").between(2, RARE)).select("shingle"), "shingle"), "few")
    told = waiting.join(solo, "rep", "left").join(few.groupBy("rep").agg(F.count("*").alias("rare")), "rep", "left").na.fill(0, ["solo", "rare"])
    told = told.withColumn("common", F.col("n") - F.col("solo") - F.col("rare"))
    enough = lambda shared, n, m: shared * (100 + percent) >= percent * (n + m)

    # Links that common shingles alone allow: within a bucket, for documents outside its centre's component.
    least = told.groupBy("key").agg(F.min("n").alias("least"))
    other_n = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    able = space.cut(told.join(copied(least, hot, "key"), ["key", "part"]).where(enough(F.col("common"), F.col("n"), other_n)).drop("least"), "able")
    apart = (F.col("component") != F.col("main")).alias("apart")
    side = lambda x, *more: [F.col(c).alias(f"{c}_{x}") for c in ("rep", "component", "n", "common", *more)]
    # A crowded bucket is dealt to tasks by tiles: every pair of its documents lies in exactly one.
    crowds = able.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    tiled = able.join(copied(crowds, hot, "key"), ["key", "part"], "left").na.fill(1, ["tiles"]).withColumn("tile", F.pmod(F.hash("rep"), F.col("tiles")))
    across = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = tiled.where("component <> main").select("key", F.col("tile").alias("row"), across.alias("column"), *side("a", "far"))
    right = tiled.select("key", across.alias("row"), F.col("tile").alias("column"), *side("b", "far"), apart)
    near = F.abs(F.col("far_a") - F.col("far_b")) <= 1 - percent / 100 + 1e-9
    once = (F.col("component_a") != F.col("component_b")) & (~F.col("apart") | (F.col("rep_a") < F.col("rep_b")))
    by_common = left.join(right, ["key", "row", "column"]).where(once & near & enough(F.least("common_a", "common_b"), F.col("n_a"), F.col("n_b")))

    # All others need a shingle of few documents in common, so they are found by it.
    reps = told.groupBy("rep").agg(*(F.any_value(c).alias(c) for c in ("component", "n", "common", "rare")))
    sharing = few.join(reps, "rep")
    most = F.least("common_a", "common_b") + F.least("rare_a", "rare_b")
    sides = sharing.select("shingle", *side("a", "rare")).join(sharing.select("shingle", *side("b", "rare")), "shingle")
    by_rare = sides.where((F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & enough(most, F.col("n_a"), F.col("n_b")))
    pairs = by_common.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(by_rare.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    rest = space.cut(confirm(space.cut(pairs.distinct(), "rest-pairs"), texts, width), "rest")

    links = stars.where(linked).select("a", "b").unionByName(rest.where(linked).select("a", "b"))
    groups = components(links, space, "groups")
    members = classes.select("digest", "rep", F.col("first.doc_id").alias("first")).join(groups, F.col("rep") == F.col("node"), "left").select("digest", "first", F.coalesce("component", "rep").alias("node"), F.col("component").isNotNull().alias("more"))
    least = members.where("more").groupBy("node").agg(F.min("first").alias("least"))
    told = members.join(least, "node", "left").select("digest", "node", F.coalesce("least", "first").alias("component_id"))
    out = known.join(told, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    node = F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")
    return out.select("doc_id", "text_key", "n_shingles", node, component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents whose sets of ``width``-word shingles (A-Z lower-cased) overlap by
    ``percent`` per cent or more are linked.  Null and empty texts have no set
    and link with nothing; a text of fewer words is one shingle.  ``doc_id`` is
    a document's key: rows repeated with it get equal results; if its texts
    differ, each is judged by itself.  A row with a null doc_id is linked with
    nothing and is kept, with a null component.  Other columns are ignored; no
    rows give none.
    """
    return grouped(spark, docs, width, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, but one document of each group of near-duplicates: that of the smallest id.

    Rows are judged by id and text: of texts that share a doc_id only
    near-duplicates go.  Of a row that is repeated with its text one stays.
    Rows without an id stay.
    """
    told = grouped(spark, docs.select("doc_id", "text"), width, percent).where("doc_id IS NOT NULL").select("doc_id", "text_key", "node", "kept").distinct()
    once = told.where("kept AND node IS NOT NULL").groupBy("doc_id", "node").agg(F.min("text_key").alias("one"))
    again = told.join(once, ["doc_id", "node"]).where("kept AND text_key <> one")
    gone = told.where("NOT kept").select("doc_id", "text_key").unionByName(again.select("doc_id", "text_key"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), text_key())
    known = rows.join(gone.withColumnRenamed("doc_id", "id"), ["id", "text_key"], "left_anti")
    # The join has brought equal rows together already.
    place = F.row_number().over(Window.partitionBy("id", "text_key").orderBy("row.text"))
    return known.withColumn("place", place).where("place = 1").select("row.*").unionByName(docs.where("doc_id IS NULL"))
