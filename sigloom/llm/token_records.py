"""Token ids as framed binary records with a separate offset index.

A shard is a file of records.  A record is

    8 bytes   length of the payload, unsigned, little-endian
    4 bytes   masked checksum of those 8 bytes
    payload   2 bytes: bytes of an id (2 or 4); 2 bytes: 1 if there is a doc_id, else 0;
              8 bytes doc_id, signed; then the ids
    4 bytes   masked checksum of the payload

and a checksum ``c`` (CRC-32) is masked as ``rotate_right(c, 15) +
0xa282ead8`` modulo 2**32, so that records which hold records keep distinct
checksums.  The index is a Parquet table with a row a record: shard, place,
size, doc_id, number of tokens.  A reader of shuffled samples seeks by the
index; a sequential reader needs the shards only.

Texts are encoded where they are read and never shuffled; their ids go straight
to the shard whose range of doc_id they are in.  The number of shards follows
the texts' bytes, the ranges the quantiles of doc_id; an id that fills several
ranges, and rows without one, are dealt by a hash of their text.  A task writes
its shard under a name of its own attempt, and the index names
the shards of the attempts that succeeded; files of lost attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.library_bpe import encoder, id_width
from sigloom.llm.storage import Workspace

_MASK = 0xA282EAD8
#: Flags and doc_id at the head of a payload.
_HEAD = struct.Struct("<HHq")
#: Bytes of texts of a shard, and of one where there would be fewer shards than the session has shuffle partitions.
SHARD, SMALL = 512 << 20, 4 << 20
ENCODED = "shard int, doc_id long, h long, ids binary"
INDEX = "shard_no int, shard string, record long, place long, size long, doc_id long, n_tokens long"
READ = "shard_no int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """The masked CRC-32 of ``data``."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def records(stream) -> Iterator[bytes]:
    """The payloads of an open shard; raises ``ValueError`` where a length or checksum is wrong."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("damaged record length")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
            raise ValueError("damaged record")
        yield body[:size]


def read_record(folder: str, shard: str, place: int, size: int) -> bytes:
    """One payload, found by its row of the index."""
    files, path = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{path}/{shard}") as f:
        f.seek(place)
        return next(records(pa.BufferReader(f.read(size))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(width, doc_id is not None, doc_id or 0) + ids


def parsed(body: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    width, known, doc_id = _HEAD.unpack_from(body)
    return (doc_id if known else None), np.frombuffer(body, f"<u{width}", offset=_HEAD.size)


class Ranges:
    """Which shard a row belongs to: the first ``nulls`` shards hold rows without an id, the others what lies between ascending ``bounds``."""

    def __init__(self, nulls: int, bounds: list[int]) -> None:
        self.nulls, self.bounds = nulls, np.array(sorted(bounds), np.int64)
        self.count = nulls + len(bounds) + 1

    def places(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The shards of some rows; ``hashes`` deal an id that is several bounds, in ascending order, to as many shards."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        x = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        first, last = (np.searchsorted(self.bounds, x, side) for side in ("left", "right"))
        share = hashes.astype(np.float64) / 2.0**64 + 0.5  # from 0 to 1
        part = lambda n: np.minimum((share * n).astype(np.int64), np.maximum(n - 1, 0))
        return np.where(known, self.nulls + first + part(last - first), part(np.full(len(x), self.nulls))).astype(np.int32)


def ranges(docs: DataFrame, shards: int | None = None) -> Ranges:
    """Ranges of about equally many rows, ``shards`` of them, or as many as the bytes of texts ask for."""
    told = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    size, least = told["size"] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(1, -(-size // SHARD), min(least, size // SMALL))
    nulls = -(-shards * (told.n - told.known) // told.n) if told.n else 0
    rest = max(1, shards - nulls)
    steps = F.array(*(F.lit(k / rest) for k in range(1, rest))) if rest > 1 else None
    bounds = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * rest))).first()[0] if rest > 1 and told.known else []
    return Ranges(nulls, bounds or [])


def encode(docs: DataFrame, tokenizer: str, into: Ranges, end_id: int = 0) -> DataFrame:
    """shard, doc_id, a hash of the text, and the ids, ``end_id`` last, of every document; a narrow pass.

    A null text is the end token alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        for batch in batches:
            at, rows, size = 0, [], 0
            for own in enc.encoded(batch.column(1)):
                rows.append(own.tobytes() + end.tobytes())
                size += len(rows[-1])
                if size > 1 << 22 or at + len(rows) == batch.num_rows:
                    part = batch.slice(at, len(rows))
                    ids = part.column(0).cast(pa.int64())
                    yield pa.record_batch([pa.array(into.places(ids, part.column(2).to_numpy())), ids, part.column(2), pa.array(rows, pa.binary())], names=["shard", "doc_id", "h", "ids"])
                    at, rows, size = at + len(rows), [], 0

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, ENCODED)


def write(encoded: DataFrame, folder: str, shards: int, width: int) -> DataFrame:
    """Frame and write all rows of ``encode`` in ascending ``doc_id`` order; gives the index, as yet unrun.

    Null ids come first; rows with one id are ordered by a hash of their text.
    Ranges balance rows, not keys, so hot sources or copies don't matter;
    memory holds one Arrow batch at a time.
    """
    ordered = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "h").select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        number = TaskContext.get().partitionId()
        name, out, at, record, rows = f"{number:06d}-{uuid.uuid4().hex}.rec", None, 0, 0, []
        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = ids.as_py()
                    framed = frame(payload(doc_id, ids, width))
                    out = out or files.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
                    out.write(framed)
                    rows.append((number, name, record, at, len(framed), doc_id, len(ids) // width))
                    at += len(framed)
                    record += 1
                yield _batch(rows, INDEX)
                rows = []
        finally:
            if out:
                out.close()

    return ordered.mapInArrow(run, INDEX)


def read(index: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Every record of the shards that ``index`` names, checked and digested, with its place among its shard's ids, by ``tasks`` tasks."""
    # One row a shard: the groups of copies, sources and ids of the documents play no part here.
    shards = index.groupBy("shard_no", "shard").agg(F.count("*").alias("n")).repartition(tasks, "shard_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for number, name, count in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, at, seen = [], 0, 0
                with files.open_input_stream(f"{path}/{name}", buffer_size=1 << 20) as stream:
                    for body in records(stream):
                        doc_id, ids = parsed(body)
                        rows.append((number, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                        at += len(ids)
                        seen += 1
                        if len(rows) == 8192:
                            yield _batch(rows, READ)
                            rows = []
                if seen != count:
                    raise ValueError(f"{name} holds {seen} records, its index {count}")
                yield _batch(rows, READ)

    return shards.mapInArrow(run, READ)


def token_records(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents, read the files back, and give each document's place in the corpus.

    Columns doc_id, start, n_tokens, ids_crc32, shard_no.  Extra columns of
    ``docs`` are ignored; an empty table gives no rows; a null doc_id is
    written, and comes back, as null; repeated ids come back as often.
    """
    space = Workspace(spark, "records")
    folder = f"{space.path}/shards"
    folder = folder if ":/" in folder else f"file://{folder}"
    width = id_width(tokenizer)
    into = ranges(docs)
    index = space.cut(write(encode(docs, tokenizer, into, end_id), folder, into.count, width), "index")
    back = read(index, folder, into.count)
    # A row a shard, so this window is over as many rows as there are shards.
    totals = index.groupBy("shard_no").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard_no", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return back.join(F.broadcast(bases), "shard_no").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard_no")
