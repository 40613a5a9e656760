"""Encoding with a public byte-level BPE tokenizer, with offsets, and decoding.

Byte-level BPE never merges across pre-tokens, so the ids of a text are the concatenated ids of its
pre-tokens. Each Python worker keeps the ids of the pre-tokens it has met and asks the tokenizers
library only for new ones. Texts with characters on which Python's and the library's character
classes may differ are given to the library whole, so ids always equal the library's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; an argument of every operator here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"

#: Fixed value: the published pre-token pattern of this vocabulary, for characters where the classes agree.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Anything outside plain Latin text and common punctuation is left to the library.
_UNUSUAL = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa0\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]")
_CACHE_LIMIT = 400_000
_PIECE = 256


class Encoder:
    """Ids of texts by a byte-level BPE file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.known: dict[str, list[int]] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def pretokens(self, texts: list[str]) -> list[list[str] | None]:
        """The pre-tokens of each text, all of them known afterwards; None where only the library decides."""
        if len(self.known) > _CACHE_LIMIT:
            self.known.clear()
        split = [_PRETOKEN.findall(t) if t.isascii() and "\x1c" not in t and "\x1d" not in t and "\x1e" not in t and "\x1f" not in t or not _UNUSUAL.search(t) else None for t in texts]
        new = list(set(chain.from_iterable(s for s in split if s)) - self.known.keys())
        if new:
            self.known.update(zip(new, self._library(new), strict=True))
        return split

    def ids(self, texts: list[str]) -> list[list[int]]:
        split, get = self.pretokens(texts), self.known.__getitem__
        whole = iter(self._library([t for t, s in zip(texts, split, strict=True) if s is None]))
        return [next(whole) if s is None else list(chain.from_iterable(map(get, s))) for s in split]

    def counts(self, texts: list[str]) -> list[int]:
        split = self.pretokens(texts)
        size = {w: len(self.known[w]) for w in set(chain.from_iterable(s for s in split if s))}
        whole = iter(self._library([t for t, s in zip(texts, split, strict=True) if s is None]))
        return [len(next(whole)) if s is None else sum(map(size.__getitem__, s)) for s in split]

    def offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the first and the end character of each token; tokens inside one character share it."""
        e = self.library.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]


_encoders: dict[str, Encoder] = {}


def encoder(path: str = BYTE_BPE) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lists(values: list[list[int]], kind: pa.DataType = pa.int32()) -> pa.ListArray:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(values), np.int32 if kind == pa.int32() else np.int64, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids array<int>) for every row; a null or empty text gives an empty list.

    Extra columns of ``df`` are not read. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                part = batch.slice(at, _PIECE)
                ids = enc.ids([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def encode_offsets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids, starts, ends): each token with its first and end character (code points, end exclusive).

    A character of several tokens is reported by each of them; null and empty texts give empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                part = batch.slice(at, _PIECE)
                out = [enc.offsets(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(_lists([o[k] for o in out]) for k in range(3))], [id_col, "ids", "starts", "ends"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, n_tokens int); 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                part = batch.slice(at, _PIECE)
                sizes = enc.counts([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32())], [id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")


def _byte_table() -> dict[str, int]:
    """The published byte-to-character mapping reversed: printable Latin-1 bytes stand for themselves,
    the others are numbered from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


def vocabulary_bytes(path: str = BYTE_BPE) -> dict[int, bytes]:
    """The bytes of every id."""
    table = _byte_table()
    return {i: bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token, i in encoder(path).library.get_vocab().items()}


_bytes: dict[str, dict[int, bytes]] = {}


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(id, text, whole): the text of each list of ids.

    The bytes of all ids are joined before decoding, so characters split over tokens come back whole.
    A list that ends or begins inside a character gives U+FFFD there and ``whole`` false; unknown ids are
    an error. A null or empty list gives the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _bytes:
            _bytes[path] = vocabulary_bytes(path)
        get = _bytes[path].__getitem__
        for batch in batches:
            raw = [b"".join(map(get, ids or ())) for ids in batch.column(1).to_pylist()]
            texts = [r.decode("utf-8", "replace") for r in raw]
            whole = [t.encode() == r for t, r in zip(texts, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())], [id_col, "text", "whole"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string, whole boolean")
