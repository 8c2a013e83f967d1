"""Splitting oversized texts at natural boundaries (problem 6).

A text over `limit` characters is cut into pieces of at most `limit`, each of which begins with the last `overlap`
characters of the one before. Dynamic programming over the boundary positions picks the cuts with the least sum of cut
penalties and size imbalance: before a function it costs nothing, at a blank line, a line, a blank, between any two
characters ever more; a piece pays the square of its distance from the even size. Only where a stretch of `limit` has no
boundary at all are positions inside a line (and then inside a word) offered.

Texts up to the limit, null and empty texts have no pieces. Positions count code points; a CRLF is not parted where a
line end can be used. Repeated rows of a key give one set of pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.core import cut

LIMIT, OVERLAP = 4000, 200
PENALTY = {"function": 0.0, "blank": 0.35, "line": 1.0, "space": 3.0, "any": 8.0}
EVEN = 2.0  # weight of the imbalance
_FUNCTION = re.compile(
    r"(?:(?:export|default|async|static|inline|virtual|extern|const)\s+){0,4}(?:def|class|function|struct|namespace|template|enum|union|module)\b|@\w"
    r"|(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*=\s*(?:async\s*)?(?:function\b|\([^)\n]*\)\s*=>|[\w$]+\s*=>)"
)


def _opens_function(line: str) -> bool:
    """Whether a line that begins at the margin opens a function or type, in any of the brace or indent languages."""
    if _FUNCTION.match(line):
        return True
    return line.endswith("{") and "(" in line and line[0] not in "#}/*(" and not line.startswith(("if", "for", "while", "switch", "try", "else", "do"))


def boundaries(text: str) -> tuple[list[int], list[float]]:
    """Line starts of a text and what a cut there costs."""
    at, cost = [], []
    pos = text.find("\n") + 1
    blank_before = not text[:pos].strip()
    while 0 < pos < len(text):
        end = text.find("\n", pos)
        line = text[pos : len(text) if end < 0 else end]
        bare = line.strip()
        top = bool(bare) and not line[:1].isspace()
        at.append(pos)
        if bare and top and _opens_function(bare):
            cost.append(PENALTY["function"])
        elif blank_before and bare:
            cost.append(PENALTY["blank"])
        else:
            cost.append(PENALTY["line"])
        blank_before = not bare
        pos = end + 1
    return at, cost


def _fill(text: str, at: list[int], cost: list[float], gap: int) -> tuple[list[int], list[float]]:
    """Add positions within stretches longer than `gap` that have no boundary."""
    out_at, out_cost, prev = [], [], 0
    for p, c in zip([*at, len(text)], [*cost, 0.0], strict=True):
        if p - prev > gap:
            spaces = [m.end() + prev for m in re.finditer(r"[ \t;,]", text[prev:p])]
            last = prev
            for s in [*spaces, p]:
                while s - last > gap:
                    step = last + max(1, gap // 2)
                    while step < s - 1 and "̀" <= text[step] <= "ͯ" or text[step] == "\n" and text[step - 1] == "\r":
                        step += 1
                    out_at.append(step)
                    out_cost.append(PENALTY["any"])
                    last = step
                if s < p:
                    out_at.append(s)
                    out_cost.append(PENALTY["space"])
                    last = s
        if p < len(text):
            out_at.append(p)
            out_cost.append(c)
        prev = p
    return out_at, out_cost


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """End positions of the pieces; the last one is the length of the text."""
    n = len(text)
    if n <= limit:
        return [n]
    stride = limit - overlap
    at, cost = boundaries(text)
    at, cost = _fill(text, at, cost, stride // 4)
    pairs = [(p, c) for p, c in zip(at, cost, strict=True) if p >= max(1, overlap)]
    at, cost = [p for p, _ in pairs] + [n], [c for _, c in pairs] + [0.0]
    even = n / -(-n // stride)
    where = np.array(at, dtype=np.float64)
    best, back = np.full(len(at), np.inf), np.full(len(at), -1)
    first = np.searchsorted(where, where - stride)  # the earliest cut a piece that ends here may follow
    alone = bisect_right(at, limit)
    best[:alone] = np.array(cost[:alone]) + EVEN * ((where[:alone] - even) / stride) ** 2
    for k in range(1, len(at)):
        j = first[k]
        if j < k:
            c = best[j:k] + (EVEN / stride**2) * np.square(where[k] - even - where[j:k])
            m = int(c.argmin())
            if (c := c[m] + cost[k]) < best[k]:
                best[k], back[k] = c, j + m
    out, k = [], len(at) - 1
    while k >= 0:
        out.append(at[k])
        k = back[k]
    return out[::-1]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece."""
    ends = cuts(text, limit, overlap)
    return [(0 if i == 0 else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]


def split(df: DataFrame, columns: dict[str, str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(kind, key, piece_no, start_pos, end_pos, text) of the texts over the limit.

    `columns`: text column -> column with its key; the rows of a key carry the same text. Of those without a
    key, each text counts once. Nothing is shuffled but the
    keys: a task leaves out the repeats it meets, and keys that several tasks gave keep the first.
    """
    src = df.select(
        F.monotonically_increasing_id().alias("uid"),
        *[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(columns.values())],
        *[F.when(F.length(F.col(f"`{t}`")) > limit, F.col(f"`{t}`")).alias(f"t{i}") for i, t in enumerate(columns)],
    ).where(" or ".join(f"t{i} is not null" for i in range(len(columns))))
    names, many = list(columns), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, str | None, str | None]] = set()
        for batch in batches:
            rows: list[tuple] = []
            uid = batch.column(0).to_pylist()
            for i in range(many):
                keys, texts = batch.column(1 + i).to_pylist(), batch.column(1 + many + i)
                for u, k, t in zip(uid, keys, texts, strict=True):
                    if not t.is_valid or (i, k, None) in seen:
                        continue
                    t = t.as_py()
                    h = xxhash.xxh3_128_hexdigest(t) if k is None else None
                    if (i, k, h) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add((i, k, h))
                    rows += [(u, names[i], k, h, no, a, b, t[a:b]) for no, (a, b) in enumerate(pieces(t, limit, overlap))]
                    if len(rows) >= 2000:
                        yield pack(rows)
                        rows = []
            if rows:
                yield pack(rows)

    fields = [("uid", pa.int64()), ("kind", pa.string()), ("key", pa.string()), ("alone", pa.string()), ("piece_no", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("text", pa.string())]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    got = cut(src.mapInArrow(run, "uid bigint, kind string, key string, alone string, piece_no bigint, start_pos bigint, end_pos bigint, text string"))
    given = got.where("piece_no = 0").groupBy("kind", "key", "alone").agg(F.min("uid").alias("first"), F.count("*").alias("c")).where("c > 1")
    again = given.select(F.col("kind").alias("kd"), F.col("key").alias("ky"), F.col("alone").alias("al"), "first")
    return got.join(again, F.col("kind").eqNullSafe(F.col("kd")) & F.col("key").eqNullSafe(F.col("ky")) & F.col("alone").eqNullSafe(F.col("al")), "left").where("first is null or uid = first").select(
        "kind", "key", "piece_no", "start_pos", "end_pos", "text"
    )
