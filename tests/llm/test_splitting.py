"""Pieces join to the text, respect the limit, and are cut where they should be."""

import random

import pytest

from codeweft.llm import splitting as S

FUNC = "def f{i}(a):\n" + "    x = a + {i}\n" * 20 + "    return x\n\n\n"


def joined(text, p, overlap):
    return text[: p[0][1]] + "".join(text[a + overlap : b] for a, b in p[1:])


@pytest.mark.parametrize("text", ["x" * 10_001, "ab " * 5000, "\n" * 9000, "a\r\n" * 4000, "é" * 4001, "漢字。" * 4000, "".join(FUNC.format(i=i) for i in range(60)), "a" * 4000, "a" * 7801, "word, " * 900 + "\n\n" + "y" * 9000])
def test_round_trip(text):
    p = S.pieces(text)
    assert all(0 < b - a <= 4000 for a, b in p) and joined(text, p, 200) == text
    assert all(q[0] == p[i][1] - 200 for i, q in enumerate(p[1:]))


def test_random_limits():
    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice("ab \n\t};{()é") for _ in range(r.randint(1, 3000)))
        overlap = r.randint(0, 20)
        limit = overlap + r.randint(30, 400)
        p = S.pieces(text, limit, overlap)
        assert all(b - a <= limit for a, b in p) and joined(text, p, overlap) == text


def test_cuts_between_functions():
    text = "".join(FUNC.format(i=i) for i in range(60))
    p = S.pieces(text)
    assert all(text[b:].startswith("def f") for _, b in p[:-1])
    sizes = [b - a for a, b in p]
    assert max(sizes) - min(sizes) < 1000


def test_best_of_all_cuts():
    """Against every choice of boundaries on small texts."""
    r = random.Random(9)
    for _ in range(25):
        text = "\n".join(r.choice(["", "x = 1", "def g():", "    y"]) for _ in range(r.randint(6, 13))) + "\n"
        limit, overlap = 30, 4
        n, stride = len(text), 26
        if n <= limit:
            continue
        at, cost = S._fill(text, *S.boundaries(text), stride // 4)
        price, even = dict(zip(at, cost, strict=True)), n / -(-n // stride)

        def total(ends):
            return sum(price.get(e, 0.0) if e < n else 0.0 for e in ends) + sum(S.EVEN * ((e - s - even) / stride) ** 2 for s, e in zip([0, *ends], ends, strict=False))

        best = [None]

        def search(ends):
            last = ends[-1] if ends else 0
            if last == n:
                if best[0] is None or total(ends) < best[0]:
                    best[0] = total(ends)
                return
            for p in [*[x for x in at if x >= overlap], n]:
                if last < p <= (last + stride if ends else limit):
                    search([*ends, p])

        if len(at) <= 16:
            search([])
            assert abs(total(S.cuts(text, limit, overlap)) - best[0]) < 1e-9


@pytest.mark.parametrize("dense", [5_000, 150_000])
def test_every_blank_is_offered(dense):
    """No cut within a word where blanks are dense in one part of a long line and sparse in another."""
    text = "1 " * dense + "wordofsomelength " * 3_000
    at, cost = S._fill(text, *S.boundaries(text), 950)
    assert at == [i + 1 for i, c in enumerate(text[:-1]) if c == " "] and set(cost) == {S.PENALTY["space"]}
    assert all(text[b - 1] == " " for _, b in S.pieces(text)) and joined(text, S.pieces(text), 200) == text


def test_rows(spark):
    big = "".join(FUNC.format(i=i) for i in range(40))
    d = spark.createDataFrame([(1, "f", big, big + "#"), (1, "f", big, big + "#"), (2, "f", "short", big + "#"), (3, None, None, None), (4, "g", "", "a" * 4000), (None, "h", "z" * 5000, None)], "sample_id bigint, file_path string, code string, raw_content string").repartition(3)
    rows = S.split(d, {"code": "sample_id", "raw_content": "file_path"}).collect()
    by = {}
    for r in rows:
        by.setdefault((r.kind, r.key), []).append(r)
    assert set(by) == {("code", "1"), ("code", None), ("raw_content", "f")}
    for k, text in ((("code", "1"), big), (("raw_content", "f"), big + "#"), (("code", None), "z" * 5000)):
        p = sorted(by[k], key=lambda r: r.piece_no)
        assert [r.piece_no for r in p] == list(range(len(p))) and all(r.text == text[r.start_pos : r.end_pos] for r in p)
        assert joined(text, [(r.start_pos, r.end_pos) for r in p], 200) == text
    assert S.split(d.limit(0), {"code": "sample_id"}).count() == 0


def test_texts_without_a_key(spark):
    a, b = "a b " * 2000, "c d " * 1500
    d = spark.createDataFrame([(None, a), (None, b), (None, a), ("k", b), ("k", b)], "p string, raw_content string").repartition(4)
    rows = S.split(d, {"raw_content": "p"}).collect()
    parts = sorted((r.key or "", r.piece_no, r.end_pos, r.text) for r in rows)
    want = sorted([("", n, e, a[s:e]) for n, (s, e) in enumerate(S.pieces(a))] + [(k, n, e, b[s:e]) for k in ("", "k") for n, (s, e) in enumerate(S.pieces(b))])
    assert parts == want
