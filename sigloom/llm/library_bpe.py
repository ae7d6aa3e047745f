"""Token ids by the tokenizers library, one encoder to a Python worker."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sigloom.llm.pieces import PieceStore, encoded
from sigloom.llm.storage import trim

#: A letter outside every vocabulary, between the pieces handed over in one call, and a byte that no text in UTF-8 has.
_BETWEEN, _FREE = 0xE000, 0xFF


def byte_letters() -> dict[int, int]:
    """The printable stand-in that byte-level vocabularies use for every byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def checked(tokenizer: dict) -> dict:
    """The file's content, if its pre-tokenizer is the one that ``pieces`` stands for."""
    pre = tokenizer["pre_tokenizer"] or {}
    if tokenizer.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a byte-level tokenizer with the usual pattern")
    return tokenizer


def id_type(size: int) -> np.dtype:
    """The smallest type that holds the ids of a vocabulary."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def id_width(path: str) -> int:
    """Bytes of an id, from the file alone."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    return id_type(1 + max([*read["model"]["vocab"].values(), *(x["id"] for x in read["added_tokens"])])).itemsize


class LibraryEncoder:
    """Ids of whole texts as little-endian unsigned integers of ``dtype``, equal to the library's own."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        read = checked(json.loads(tokenizer.to_str()))
        self.size = tokenizer.get_vocab_size()
        self.dtype = dtype = id_type(self.size)
        self._special = [x["content"] for x in read["added_tokens"]]
        lengths = np.zeros(self.size, np.int64)
        for token, k in read["model"]["vocab"].items():
            lengths[k] = len(token)
        # The same model over pieces that are already cut and spelled in byte letters.
        tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(chr(_BETWEEN))
        tokenizer.encode_special_tokens = True
        letters = np.full(256, _BETWEEN, "<u2")
        for byte, letter in byte_letters().items():
            letters[byte] = letter if byte != _FREE else _BETWEEN

        def learn(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            raw = np.frombuffer(bytes([_FREE]).join(pieces), np.uint8)
            ids = np.array(tokenizer.encode_batch_fast([letters[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, np.int64)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes)) + 1  # tokens cover their pieces' bytes
            return ids, np.diff(ends, prepend=0)

        self._path, self._store, self._library = path, PieceStore(learn, dtype), None
        del read
        trim()

    def _whole(self, text: str) -> np.ndarray:
        """By the library alone: texts that hold special strings, which it takes out first."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a column in order; none for null."""
        return encoded(texts, self._store, self._whole, self._special)

    def encode_many(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        return list(self.encoded(pa.array(texts, pa.string())))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    """Python workers are reused, so what is known of pieces lasts from task to task."""
    return LibraryEncoder(path)


def release() -> None:
    """Drop the worker's encoders too, for tasks of other stages that run in it later."""
    encoder.cache_clear()
    trim()
