"""Token counts by a compiled transducer.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

* The outer one (``pieces``) runs over classes of letters and marks where the
  pre-tokenizer cuts.  It is small, so a chunk of text is held as a map from
  every state to the state after it; these maps compose associatively, and a
  parallel prefix scan over the chunks of a slice gives each chunk's first
  state, from which all chunks run side by side.
* The inner one runs over the bytes of a piece and is compiled as far as the
  texts need it.  A state holds the last token of the encoding of every place
  from which a vocabulary token may still be under way, with the trie node
  reached since and the count so far.  Exactly one last token belongs to each
  place (see ``merges``), so the states are a deterministic, finite set: a
  token is at most so long.  Counts are kept relative; the common part is
  emitted on the transition, which thus carries the number of tokens that are
  certain by then.

What runs in parallel: the chunks of a slice, as lanes of one task, and the
texts, over tasks.  Equal pieces are counted once a slice; a text's count is a
difference of prefix sums.  A single piece, however long, is run byte by byte.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sigloom.llm.library_bpe import byte_letters, checked
from sigloom.llm.merges import Merges
from sigloom.llm.pieces import PieceStore, encoded

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_NODE, _LAST, _COUNT = 16, 40, 0xFFFF


class PieceTransducer:
    """Counts the tokens of one piece byte by byte.

    A state is a tuple of numbers, one for each place that is still of account:
    last token + 1, trie node and relative count side by side; the place just
    reached comes last.  ``moves`` maps ``state << 8 | byte`` to
    ``next << 16 | tokens that are certain``.
    """

    #: Compiled states before the tables start anew, and bytes between two looks at their number.
    LIMIT, SLICE = 400_000, 1 << 14

    def __init__(self, tokens: list[bytes], merges: Merges) -> None:
        """``tokens`` in merge order; see ``merges``."""
        self.compatible, self.child, self.ends = merges.compatible, {}, [-1]
        for k, token in enumerate(tokens):
            node = 0
            for byte in token:
                at = node << 8 | byte
                if at not in self.child:
                    self.child[at] = len(self.ends)
                    self.ends.append(-1)
                node = self.child[at]
            self.ends[node] = k
        self.reset()

    def reset(self) -> None:
        start = (0,)  # no last token, the trie's root, nothing counted
        self.ids, self.states, self.moves = {start: 0}, [start], {}

    def _id(self, key: tuple) -> int:
        at = self.ids.setdefault(key, len(self.states))
        if at == len(self.states):
            self.states.append(key)
        return at

    def _compile(self, state: int, byte: int) -> int:
        child, ends, live, ended = self.child.get, self.ends, [], -1
        for entry in self.states[state]:
            node = child((entry >> _NODE & 0xFFFFFF) << 8 | byte)
            if node is None:
                continue
            last, count = (entry >> _LAST) - 1, entry & _COUNT
            live.append(last + 1 << _LAST | node << _NODE | count)
            token = ends[node]
            if token >= 0 and (last < 0 or self.compatible(last, token)):
                if ended >= 0:
                    raise ValueError("two encodings of one text: the merges are out of order")
                ended = token + 1 << _LAST | count + 1
        if ended < 0:
            raise ValueError("a byte is missing in the vocabulary")
        live.append(ended)
        least = min([x & _COUNT for x in live])
        after = self._id(tuple([x - least for x in live]))
        self.moves[state << 8 | byte] = got = after << 16 | least
        return got

    def count(self, piece: bytes) -> int:
        """The tokens of a piece.  The tables may start anew within it: the open state is then carried over by its content."""
        state, total = 0, 0
        for at in range(0, len(piece), self.SLICE):
            if len(self.states) > self.LIMIT:
                key = self.states[state]
                self.reset()
                state = self._id(key)
            move = self.moves.get
            for byte in piece[at : at + self.SLICE]:
                got = move(state << 8 | byte)
                if got is None:
                    got = self._compile(state, byte)
                state = got >> 16
                total += got & _COUNT
        return total + (self.states[state][-1] & _COUNT)


class Counter:
    """Counts for whole texts by one compiled tokenizer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            tokenizer = checked(json.load(f))
        model, unspell = tokenizer["model"], {chr(v): k for k, v in byte_letters().items()}
        ids = {chr(v): k for k, v in byte_letters().items()}
        tokens, pair, halves = [bytes([k]) for k in range(256)], {}, {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair[ids[a], ids[b]] = len(tokens)
            halves[len(tokens)] = (ids[a], ids[b])
            ids[a + b] = len(tokens)
            tokens.append(bytes(unspell[x] for x in a + b))
        self.special = [x["content"] for x in tokenizer["added_tokens"]]
        self.transducer = PieceTransducer(tokens, Merges(pair, halves))
        self._store = PieceStore(self._learn, np.int32)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(map(self.transducer.count, pieces), np.int64, len(pieces)), np.ones(len(pieces), np.int64)

    def _with_special(self, text: str) -> np.ndarray:
        """Strings of special tokens are one token each; what lies between them is counted by itself."""
        parts = [text]
        for special in self.special:
            parts = [y for x in parts for y in x.split(special)]
        return np.append(self.count_many(pa.array(parts)), len(parts) - 1)

    def count_many(self, texts: pa.Array) -> np.ndarray:
        """Counts of whole texts; 0 for null."""
        return np.fromiter((x.sum() for x in encoded(texts, self._store, self._with_special, self.special)), np.int64, len(texts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text.

    A narrow pass without a shuffle.  A null text is empty (0 bytes, 0 tokens);
    repeated rows are repeated; other columns are ignored; no rows give none.
    Tables and caches are bounded, whatever the input; a slice of texts is
    bounded by its bytes, so a very long text is treated by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = own.count_many(batch.column(1))
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), sizes, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
