"""Near-duplicate code by bit-sliced comparison (problem 5).

Each text becomes its set of hashed token triples. Texts with equal sets are one class, and only one representative
goes on. Candidates come from prefix filtering, which loses no pair: with triples ordered from rare to common, two sets
whose Jaccard similarity reaches t share a triple among the first n - ceil(t n) + 1 of each. Triples of a single text
count towards the prefix but join nothing, so few postings are left.

Texts that meet at a triple are compared in blocks. A text's sketch has one bit for each of BITS classes of hashes: the
parity of the triples in it. Every triple that only one of two sets has flips one bit, so the sketches differ in at most
as many bits as the sets in elements, and pairs over the radius (na + nb) (1 - t) / (1 + t) are ruled out for certain.
A task stores the sketches of its blocks vertically, once: plane k holds bit k of 64 texts in a word, texts that meet side
by side. A word and the same word shifted by d compare every text with the one d places on, so all pairs of all blocks are
met by shifts (between the words of a large block, by rotations). A carry-save counter adds the planes up, and a word is
abandoned once every comparison in it is over its radius. What is left is checked on the sets themselves.

Postings of a common triple are split into blocks of BLOCK texts and blocks meet two by two, so no task holds a group.
Null, empty and short texts (under `min_tokens` tokens) have no pairs; repeated rows of a key count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.core import cut, cut_counted, discard, spread_join

BITS = 512
BLOCK = 1024
LANES = 1 << 16  # texts in one vertical store
CHECK = 32  # planes between two looks at who is over
BROADCAST_ROWS = 1_000_000
_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Shingler:
    """Hashed sets of three consecutive tokens."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def tokens(self, text: str) -> np.ndarray:
        seen, out = self.seen, []
        if len(seen) > 500_000:
            seen.clear()
        for t in _TOKEN.findall(text):
            h = seen.get(t)
            if h is None:
                h = seen[t] = xxhash.xxh64_intdigest(t)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def triples(self, text: str | None, min_tokens: int) -> np.ndarray | None:
        if not text:
            return None
        t = self.tokens(text)
        if len(t) < max(min_tokens, 3):
            return None
        with np.errstate(over="ignore"):
            h = (t[:-2] * _M1) ^ (np.roll(t, -1)[:-2] * _M2 + (t[2:] ^ (t[2:] >> np.uint64(29))) * _M3)
            h = (h ^ (h >> np.uint64(31))) * _M1
            return np.unique(h ^ (h >> np.uint64(33)))


def sketch(h: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of BITS classes."""
    return np.packbits(np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def sets(df: DataFrame, key: str, text: str, min_tokens: int) -> DataFrame:
    """(key, n, s1, s2, bits, triples) of texts long enough."""
    src = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in batches:
            ids, n, s1, s2, bits, all_h = [], [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = make.triples(t.as_py(), min_tokens)
                if h is None:
                    continue
                ids.append(i)
                n.append(len(h))
                s1.append(np.bitwise_xor.reduce(h))
                s2.append(np.add.reduce(h * _M2))
                bits.append(sketch(h))
                all_h.append(h)
            if not ids:
                continue
            offsets = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum(n, out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_h).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), lists],
                names=["id", "n", "s1", "s2", "bits", "triples"],
            )

    return src.mapInArrow(run, "id bigint, n int, s1 bigint, s2 bigint, bits binary, triples array<bigint>")


WIDTH = int(BITS).bit_length() + 1  # bits of a distance and of a radius


def _vertical(rows: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """Planes (one a column of `rows`, as bits) of the texts at their lanes, 64 lanes a word; lanes without a text are 0."""
    out = np.zeros((words * 64, rows.shape[1]), dtype=np.uint8)
    out[lane] = rows
    return np.ascontiguousarray(np.packbits(out, axis=0, bitorder="little").T).view("<u8")


def _numbers(values: np.ndarray) -> list[np.ndarray]:
    """Planes of numbers below 2 ** WIDTH that lie lane by lane (a row a word)."""
    flat = values.reshape(-1).astype("<u2")
    low, high = (flat & 255).astype(np.uint8), (flat >> 8).astype(np.uint8)
    return [np.packbits((low if k < 8 else high) & (1 << k % 8), bitorder="little").view("<u8") for k in range(WIDTH)]


def near_lanes(a: np.ndarray, b: np.ndarray, d: int, radius: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lane) where the text of `a` and that of `b` d lanes on (around the word's end) differ in at most `radius` bits.

    a, b: planes; radius, valid: a row a word, a column a lane. Words without a valid comparison under its radius are abandoned.
    """
    place = np.arange(a.shape[1])
    real = np.packbits(valid.reshape(-1), bitorder="little").view("<u8")
    some = real != 0
    place, real = place[some], real[some]
    lim = _numbers(np.minimum(radius[some], BITS))
    sums = [np.zeros(len(place), dtype=np.uint64) for _ in range(WIDTH)]
    if not some.all():
        a, b = a[:, some], b[:, some]
    left, right = np.uint64(d), np.uint64(64 - d)

    def add(plane: np.ndarray, at: int) -> None:
        for k in range(at, WIDTH):
            sums[k], plane = sums[k] ^ plane, sums[k] & plane
            if not plane.any():
                return

    def over() -> np.ndarray:
        more, equal = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
        for k in range(WIDTH - 1, -1, -1):
            more |= equal & sums[k] & ~lim[k]
            equal &= ~(sums[k] ^ lim[k])
        return more

    for at in range(0, BITS, 8):
        p = b[at : at + 8]
        p = a[at : at + 8] ^ ((p >> left) | (p << right) if d else p)
        # carry-save: seven planes and the eighth into one of each weight
        u = p[0] ^ p[1]
        s1, c1 = u ^ p[2], (p[0] & p[1]) | (u & p[2])
        u = p[3] ^ p[4]
        s2, c2 = u ^ p[5], (p[3] & p[4]) | (u & p[5])
        u = s1 ^ s2
        s3, c3 = u ^ p[6], (s1 & s2) | (u & p[6])
        u = c1 ^ c2
        t2, f1 = u ^ c3, (c1 & c2) | (u & c3)
        one, c4 = s3 ^ p[7], s3 & p[7]
        two, f2 = t2 ^ c4, t2 & c4
        add(one, 0)
        add(two, 1)
        add(f1, 2)
        add(f2, 2)
        if at % CHECK == CHECK - 8 and at < BITS - 8:
            live = (~over() & real) != 0
            if not live.any():
                return place[:0], place[:0]
            if 4 * np.count_nonzero(live) <= 3 * len(live):
                place, real, a, b = place[live], real[live], a[:, live], b[:, live]
                sums, lim = [x[live] for x in sums], [x[live] for x in lim]
    hits = np.unpackbits((~over() & real).view(np.uint8), bitorder="little").reshape(-1, 64)
    w, lane = np.nonzero(hits)
    return place[w], lane


def within(a: np.ndarray, b: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which rows of two byte matrices differ in at most `radius` bits."""
    out, words, lane = np.zeros(len(a), dtype=bool), -(-len(a) // 64), np.arange(len(a))
    r, valid = np.zeros(words * 64, dtype=np.int64), np.arange(words * 64) < len(a)
    r[: len(a)] = radius
    w, at = near_lanes(*(_vertical(np.unpackbits(x, axis=1), lane, words) for x in (a, b)), 0, r.reshape(-1, 64), valid.reshape(-1, 64))
    out[w * 64 + at] = True
    return out


class Store:
    """Texts that meet in groups, laid out in lanes: groups of up to 64 texts side by side within a word, larger ones over words of their own."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        first = np.zeros(len(size), dtype=np.int64)  # the lane of a group's first text
        word = 0
        cuts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]) if len(size) else np.zeros(0, dtype=np.int64)
        span = []  # (first word, end, group size) of words with groups of one size
        self.wide: list[tuple[int, int]] = []
        for x, y in zip(cuts, np.r_[cuts[1:], len(size)], strict=True):
            m = int(size[x])
            k = np.arange(y - x)
            if m > 64:
                each = -(-m // 64)
                first[x:y] = (word + k * each) * 64
                self.wide += [(int(w), int(w) + each) for w in word + k * each]
                used = each * (y - x)
                span.append((word, word + used, 64))
            else:
                per = 64 // m
                first[x:y] = (word + k // per) * 64 + (k % per) * m
                used = -(-(y - x) // per)
                span.append((word, word + used, m))
            word += used
        self.words, self.span = word, span
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        lane, row = np.repeat(first, size) + within, np.repeat(begin, size) + within
        self.row = np.full(word * 64, -1, dtype=np.int64)
        self.row[lane] = row
        self.group = np.full(word * 64, -1, dtype=np.int32)
        self.group[lane] = np.repeat(np.arange(len(size)), size)
        self.n = np.zeros(word * 64, dtype=np.float32)  # sizes up to 2 ** 24 are exact
        self.n[lane] = n[row]
        self.row, self.group, self.n = (x.reshape(-1, 64) for x in (self.row, self.group, self.n))
        self.planes = _vertical(np.unpackbits(bits[row], axis=1), lane, word)

    def compare(self, wa: np.ndarray | slice, wb: np.ndarray | None, d: int, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of similar size within the radius, of the words `wa` against the words `wb` (None: themselves) d lanes on."""
        other = wa if wb is None else wb
        na, ga = self.n[wa], self.group[wa]
        nb, gb = (np.roll(x[other], -d, axis=1) for x in (self.n, self.group))
        ok = (ga >= 0) & (ga == gb)
        if wb is None:
            ok[:, 64 - d :] = False
        ok &= np.minimum(na, nb) * np.float32(1.00001) >= np.float32(t) * np.maximum(na, nb)  # the exact check follows
        radius = np.minimum((na + nb) * np.float32((1 - t) / (1 + t)) + np.float32(1e-3), BITS)
        w, lane = near_lanes(self.planes[:, wa], self.planes[:, other], d, radius, ok)
        return self.row[wa][w, lane], self.row[other][w, (lane + d) % 64]

    def pairs(self, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of all pairs within a group that may be similar."""
        for d in range(1, 64):
            end = max((e for _, e, m in self.span if m > d), default=0)  # groups come from large to small
            if not end:
                break
            yield self.compare(slice(0, end), None, d, t)
        if self.wide:
            wa = np.concatenate([np.repeat(np.arange(a, b), np.arange(b - a - 1, -1, -1)) for a, b in self.wide])
            wb = np.concatenate([np.concatenate([np.arange(x + 1, b) for x in range(a, b)]) for a, b in self.wide])
            step = max(1, LANES // 64)
            for at in range(0, len(wa), step):
                for d in range(64):
                    yield self.compare(wa[at : at + step], wb[at : at + step], d, t)


def _compare(t: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            k = f[["h", "bi", "bj"]].to_numpy()
            cutoff = len(f) - int(np.argmax((k[::-1] != k[-1]).any(axis=1))) if (k != k[-1]).any() else 0
            rest = f.iloc[cutoff:]
            yield from found(f.iloc[:cutoff])
        if rest is not None:
            yield from found(rest)

    def found(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs of a few whole blocks, LANES texts at a time."""
        if not len(g):
            return
        h, bi, bj, side = (g[c].to_numpy() for c in ("h", "bi", "bj", "side"))
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        size = np.diff(np.r_[start, len(g)])
        bits = np.frombuffer(b"".join(g["bits"]), dtype=np.uint8).reshape(len(g), BITS // 8)
        n, uid = g["n"].to_numpy().astype(np.int64), g["uid"].to_numpy()
        cross = bi[start] != bj[start]
        load = np.cumsum(size)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + LANES, side="right")))
            for i, j in Store(bits, n, start[a:b], size[a:b]).pairs(t):
                keep = uid[i] != uid[j]
                if cross[a:b].any():  # of two blocks that meet, the pairs within one are met elsewhere
                    keep &= (bi[i] == bj[i]) | (side[i] != side[j])
                x, y = uid[i[keep]], uid[j[keep]]
                if len(x):
                    yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()
            a = b

    return run


def similar(df: DataFrame, key: str = "sample_id", text: str = "code", t: float = 0.5, min_tokens: int = 40) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(id, rep) gives each text's class of equal sets, pairs(rep_a, rep_b) the similar classes."""
    d = cut(sets(df, key, text, min_tokens).withColumn("uid", F.monotonically_increasing_id()))
    first = d.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "uid")).alias("m")).select("n", "s1", "s2", F.col("m.id").alias("rep"), F.col("m.uid").alias("uid"))
    first = cut(first)
    members = cut(d.select("id", "n", "s1", "s2").distinct().join(first.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("id", "rep"))
    spare = cut(d.select("uid").join(first.select("uid"), "uid", "left_anti"))
    few = spare.count() <= BROADCAST_ROWS  # else the sets themselves are shuffled
    reps = d.select("uid", "triples").join(F.broadcast(spare) if few else spare, "uid", "left_anti")
    each = reps.select("uid", F.explode("triples").alias("h"))
    df2 = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(df2, "h").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    size = first.select("uid", "n", "rep")
    # of the prefix, the triples that no other text has come first and join nothing
    take = F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1 - (F.col("n") - F.size("s"))
    kept = shared.join(size, "uid").select("uid", F.expr("s.h").alias("hs"), take.cast("int").alias("k")).where("k > 0")
    post = cut(kept.select("uid", F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h")))
    groups = post.groupBy("h").count().where("count > 1").select("h", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    sk = d.select("uid", "n", "bits").join(first.select("uid"), "uid", "left_semi")
    in_blocks = post.join(groups, "h").join(sk, "uid").withColumn("b", F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int"))
    meet = in_blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    meet = meet.select("h", "uid", "n", "bits", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"))
    placed = meet.repartition("h", "bi", "bj").sortWithinPartitions("h", "bi", "bj", "uid")
    near = cut(placed.mapInPandas(_compare(t), "a bigint, b bigint").distinct())
    wanted = cut(near.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
    few = wanted.count() <= BROADCAST_ROWS
    full = cut(d.select("uid", "triples").join(F.broadcast(wanted) if few else wanted, "uid", "left_semi").join(size, "uid"))
    left, right = (full.select(F.col("uid").alias(x), F.col("triples").alias(f"t{x}"), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    ok = near.join(left, "a").join(right, "b").where(both * (1 + t) >= (F.col("na") + F.col("nb")) * t - 1e-9)
    return members, cut(ok.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b")).distinct())


def found_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample_a, sample_b): all similar pairs of texts, classes expanded, the smaller id first.

    A class of many equal texts is expanded in many tasks.
    """
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = spread_join(spread_join(pairs, a, "rep_a", "x"), b, "rep_b", "y").select("x", "y")
    inside = spread_join(a.withColumnRenamed("rep_a", "rep_b"), b, "rep_b", "y").where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): class of equal sets, connected group of similar classes, number of linked classes."""
    links = pairs.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
    links = cut(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    degree = links.groupBy("u").agg(F.count("*").alias("n_links"))
    held = label = cut(links.select("u").distinct().withColumn("g", F.col("u")))
    while True:  # the least id within reach, with a jump to the label's label each round
        near = links.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("g").alias("m"))
        step = label.join(near, "u").select("u", F.least("g", "m").alias("g2"), "g")
        hop = step.join(label.select(F.col("u").alias("g2"), F.col("g").alias("gg")), "g2", "left").select("u", F.least("g2", F.coalesce("gg", "g2")).alias("n"), "g")
        nxt, moved = cut_counted(hop, F.col("n") != F.col("g"))
        if not moved:
            break
        discard(held)
        held, label = nxt, nxt.select("u", F.col("n").alias("g"))
    return members.join(label, F.col("rep") == F.col("u"), "left").join(degree.withColumnRenamed("u", "d"), F.col("rep") == F.col("d"), "left").select(
        "id", F.col("rep").alias("class_id"), F.coalesce("g", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
