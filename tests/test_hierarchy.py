"""Call hierarchies against brute force."""

import random

from codeweft.operators import hierarchy as H


def brute(nodes, links):
    out = {n: set() for n in nodes}
    inn = {n: set() for n in nodes}
    for a, b in links:
        if a != b and a in out and b in out:
            out[a].add(b)
            inn[b].add(a)
    below = {}
    for n in nodes:
        seen, stack = set(), [n]
        while stack:
            for v in out[stack.pop()]:
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        below[n] = seen
    best = {n: [n] for n in nodes if not inn[n]}
    front = dict(best)
    while front:
        new = {}
        for u, p in front.items():
            for v in out[u]:
                if v not in best and (v not in new or [*p, v] < new[v]):
                    new[v] = [*p, v]
        best.update(new)
        front = new
    return below, best


def a_graph(seed):
    """Chains, trees, rings with tails and dense knots side by side."""
    r = random.Random(seed)
    nodes, links = [], []
    for c in range(10):
        n = r.randint(1, 14)
        own = [f"{c}:{i:02d}" for i in range(n)]
        nodes += own
        kind = c % 5
        for i in range(1, n):
            if kind == 0:
                links.append((own[i - 1], own[i]))
            elif kind == 1:
                links.append((own[r.randrange(i)], own[i]))
            else:
                links += [(own[r.randrange(n)], own[r.randrange(n)]) for _ in range(r.choice((1, 1, 2)))]
        if kind == 3 and n > 2:
            links += [(own[i], own[(i + 1) % n]) for i in range(n)]
        if kind == 4:
            links += [(own[i], own[(i + 1) % (n // 2 + 1)]) for i in range(n // 2 + 1)]
    return nodes, links


def test_random_graphs(spark):
    nodes, links = [], []
    for seed in range(6):
        n, e = a_graph(seed)
        nodes += [f"{seed}/{x}" for x in n]
        links += [(f"{seed}/{a}", f"{seed}/{b}") for a, b in e]
    links += [("0/0:00", "nowhere"), (None, "0/0:00"), links[0], ("0/0:00", "0/0:00")]
    below, best = brute(nodes, links)
    nd = spark.createDataFrame([(n,) for n in nodes] + [(nodes[0],), (None,)], "id string")
    ld = spark.createDataFrame(links, "parent string, child string")
    cyc = {n for n in nodes if n in below[n]}
    assert {r.id for r in H.cycle_members(nd, ld).collect()} == cyc
    paths, pairs = H.hierarchy(nd, ld)
    got = {r.id: r for r in paths.collect()}
    assert set(got) == set(nodes)
    assert {n for n, r in got.items() if r.on_cycle} == cyc
    for n in nodes:
        assert got[n].path == best.get(n)
        assert got[n].depth == (len(best[n]) - 1 if n in best else None)
        assert got[n].root == (best[n][0] if n in best else None)
    want = {(n, d) for n in nodes for d in below[n] if d != n}
    assert {(r.id, r.descendant) for r in pairs.collect()} == want


def test_long_chain_takes_few_rounds(spark):
    n = 200
    links = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(n)], "src string, dst string")
    assert len(H._contract_bare(links)[0]) < 20


def test_empty(spark):
    nd = spark.createDataFrame([], "id string")
    ld = spark.createDataFrame([], "parent string, child string")
    assert H.cycle_members(nd, ld).count() == 0
    paths, pairs = H.hierarchy(nd, ld)
    assert paths.count() == 0 and pairs.count() == 0


def test_call_links_take_both_sides(spark, rows):
    g = spark.createDataFrame([("a", None, ["b", "b", None]), ("b", ["c", "a"], None), ("c", [], [])], "id string, callers array<string>, callees array<string>")
    assert set(rows(H.call_links(g), "parent", "child")) == {("a", "b"), ("c", "b")}
