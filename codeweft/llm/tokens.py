"""Encoding with a public byte-level BPE vocabulary by forced-boundary splitting (problem 7).

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, so a text may be cut between the
two bytes and both sides encoded on their own. The pattern that splits text before the merges must not notice the cut
either; that holds where the character before is not white space (else the rule that leaves the last blank to the next
word would see another end) and the one after is no apostrophe (else a contraction could begin there that the whole
text doesn't have). The fragments are words mostly: each distinct one is encoded once per worker, and the ids of a text
are those of its fragments one after another.

Null and empty texts have no ids (an empty list). Strings that look like special tokens are plain text. A text of any
length is handled in one pass; the only state is a bounded cache.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
# White space of the splitting pattern (Unicode White_Space), fixed values.
_SPACE = np.array([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
# The splitting pattern of the vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ForcedBoundaryEncoder:
    """Encoder of one worker. `ranks`: token bytes -> id."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
        self.forced = ~inside
        self.cache: dict[str, list[int]] = {}

    @staticmethod
    def _edges(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last UTF-8 byte of each code point."""
        first = np.where(cps < 0x80, cps, np.where(cps < 0x800, 0xC0 | cps >> 6, np.where(cps < 0x10000, 0xE0 | cps >> 12, 0xF0 | cps >> 18)))
        return first.astype(np.uint8), np.where(cps < 0x80, cps, 0x80 | cps & 0x3F).astype(np.uint8)

    def fragments(self, text: str) -> list[str]:
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first, last = self._edges(cps)
        at = self.forced[last[:-1], first[1:]] & (cps[1:] != 39)
        where = np.flatnonzero(at) + 1
        where = where[~np.isin(cps[where - 1], _SPACE)].tolist()
        return [text[a:b] for a, b in zip([0, *where], [*where, len(text)], strict=True)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        cache = self.cache
        for part in self.fragments(text):
            got = cache.get(part)
            if got is None:
                got = self.whole(part)
                if len(part) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[part] = got
            ids += got
        return ids


@functools.lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken") -> ForcedBoundaryEncoder:
    with open(os.path.join(folder, name), "rb") as f:
        return ForcedBoundaryEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) of every row; other columns don't matter."""
    src = _named(df, key, text)
    schema = f"`{key}` {src.schema['k'].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder).encode
        for batch in batches:
            lists = [enc(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return src.mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens bigint) of every row; null and empty texts have 0."""
    src = _named(df, key, text)
    schema = f"`{key}` {src.schema['k'].dataType.simpleString()}, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder).encode
        for batch in batches:
            n = pa.array([len(enc(t)) for t in batch.column(1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, "n_tokens"])

    return src.mapInArrow(run, schema)
