"""Near-duplicate code against brute force."""

import random
import re

import numpy as np
import pytest

from codeweft.llm import neardup as N


def brute(texts, t=0.5, least=40):
    sets = {}
    for i, s in texts.items():
        k = re.findall(r"[A-Za-z0-9_]+", s or "")
        if len(k) >= least:
            sets[i] = {tuple(k[j : j + 3]) for j in range(len(k) - 2)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed=3, families=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["if", "return", "x"] * 20
    out, n = {}, 0
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.randint(38, 160))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(int(r.random() * 0.35 * len(w))):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice(words)]
            if r.random() < 0.2:
                h = r.randrange(len(w))
                w = w[h:] + w[:h]
            n += 1
            out[n] = " ".join(w)
        out[n + 1] = out[n]
        n += 1
    return out


def test_bit_sliced_comparison():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (333, N.BITS // 8), dtype=np.uint8)
    b = np.unpackbits(a.copy(), axis=1)
    for i in range(len(b)):
        b[i, r.choice(N.BITS, i, replace=False)] ^= 1
    b = np.packbits(b, axis=1)
    radius = r.integers(0, N.BITS, len(a))
    assert (N.within(a, b, radius) == (np.arange(333) <= radius)).all()
    assert not N.within(a[300:], b[300:], np.zeros(33, dtype=np.int64)).any() and len(N.within(a[:0], b[:0], radius[:0])) == 0


def test_vertical_store_meets_every_pair():
    """Groups of all sizes, with repeats: the pairs within the radius of each, against a count of bits one by one."""
    r = np.random.default_rng(5)
    sizes = np.array([1, 2, 2, 3, 5, 40, 63, 64, 65, 130, 200, 2, 7])
    base = r.integers(0, 256, (len(sizes), N.BITS // 8), dtype=np.uint8)
    bits = np.repeat(base, sizes, axis=0) ^ np.packbits(r.random((sizes.sum(), N.BITS)) < r.random((sizes.sum(), 1)) * 0.2, axis=1)
    n = r.integers(100, 180, sizes.sum())
    begin = np.cumsum(sizes) - sizes
    t, got = 0.5, []
    for i, j in N.Store(bits, n, begin, sizes).pairs(t):
        got += [(min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)]
    want = set()
    for a, m in zip(begin, sizes, strict=True):
        for i in range(a, a + m):
            for j in range(i + 1, a + m):
                apart = int(np.unpackbits(bits[i] ^ bits[j]).sum())
                if apart <= (n[i] + n[j]) / 3 + 1e-9 and min(n[i], n[j]) >= t * max(n[i], n[j]):
                    want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < sum(m * (m - 1) // 2 for m in sizes)


def test_sketches_bound_the_difference():
    m, r = N.Shingler(), random.Random(2)
    for _ in range(200):
        w = [f"a{r.randrange(60)}" for _ in range(80)]
        x, y = m.triples(" ".join(w), 3), m.triples(" ".join(w[r.randrange(40) :] + w[:10]), 3)
        apart = sum(bin(p ^ q).count("1") for p, q in zip(N.sketch(x), N.sketch(y), strict=True))
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))


@pytest.mark.parametrize("block", [1024, 3])
def test_all_pairs_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    texts = corpus() | {9000: None, 9001: "", 9002: "too short " * 5, 9003: "same " * 60, 9004: "same " * 90}
    rows = [(i, s, "x") for i, s in texts.items()] + [(1, texts[1], "again"), (None, texts[1], "n")]
    d = spark.createDataFrame(rows, "sample_id bigint, code string, uid string")
    members, pairs = N.similar(d)
    got = [(r.sample_a, r.sample_b) for r in N.found_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts)
    groups = {r.id: r for r in N.groups(members, pairs).collect()}
    for a, b in got:
        assert groups[a].group_id == groups[b].group_id
    assert groups[9003].class_id == groups[9004].class_id == 9003
    assert set(groups) == {i for i, s in texts.items() if len(re.findall(r"\w+", s or "")) >= 40}


def test_empty(spark):
    members, pairs = N.similar(spark.createDataFrame([], "sample_id bigint, code string"))
    assert members.count() == 0 and N.found_pairs(members, pairs).count() == 0 and N.groups(members, pairs).count() == 0
