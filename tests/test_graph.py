"""Call graph building and questions to it."""

import itertools
import random

from pyspark.sql import functions as F

from codeweft.operators import graph_build as G
from codeweft.operators import graph_query as Q


def fixture(spark):
    fn = spark.createDataFrame(
        [("api/user.js", "getUser", 1), ("svc/user.js", "load", 2), ("svc/item.js", "load", 3), ("db.js", "runQuery", 4), ("a.js", "this.update", 5), ("a.js", "loop", 6), ("ctl/x.js", "show", 7), ("old/x.js", "show", 8), ("a.js", "", 9), ("a.js", None, 10), ("a.js", "loop", 11)],
        "file_path string, function_name string, fn_ord bigint",
    )
    calls = spark.createDataFrame(
        [("api/user.js::getUser", 0, "svc.load"), ("api/user.js::getUser", 1, "res.json"), ("svc/user.js::load", 0, "pool.query"), ("svc/item.js::load", 0, "runQuery"), ("a.js::loop", 0, "loop"), ("a.js::this.update", 0, "x.this.update"), ("api/user.js::getUser", 2, "svc.load")],
        "src string, pos int, raw_call string",
    )
    routes = spark.createDataFrame([("GET", "/x", ["ctl.show", " ", "load"]), ("GET", "/u", ["getUser"])], "method string, path string, handlers array<string>")
    return fn, calls, routes


def test_build(spark, rows):
    fn, calls, routes = fixture(spark)
    n = G.nodes(fn)
    assert n.count() == 8 and n.where("id = 'a.js::loop'").first().fn_ord == 6
    assert rows(n.where("is_entry_point"), "id") == ["api/user.js::getUser"]
    assert rows(n.where("is_infrastructure"), "id") == ["db.js::runQuery"]
    # two `show`s and two `load`s: neither or both in handler folders, so no mark; one getUser: marked
    assert rows(G.route_entry_points(n, routes), "id") == ["api/user.js::getUser"]
    r = G.resolve_static(calls, n)
    assert rows(G.internal_edges(r, n), "src", "dst") == [("api/user.js::getUser", "svc/item.js::load"), ("api/user.js::getUser", "svc/user.js::load"), ("svc/item.js::load", "db.js::runQuery")]
    assert rows(G.external_edges(r), "src", "dst") == [("a.js::this.update", "external::x.this.update"), ("api/user.js::getUser", "external::res.json"), ("svc/user.js::load", "external::pool.query")]
    graph, edges = G.build(fn, calls, routes)
    by = {x.id: x for x in graph.collect()}
    assert by["svc/user.js::load"].is_taint_sink and not by["svc/item.js::load"].is_taint_sink
    assert by["external::res.json"].is_external and by["external::res.json"].callers == ["api/user.js::getUser"]
    assert by["api/user.js::getUser"].is_taint_source and by["api/user.js::getUser"].callees == ["external::res.json", "svc/item.js::load", "svc/user.js::load"]
    s = Q.summary(graph).first()
    assert (s.total_functions, s.external_functions, s.entry_points, s.total_edges) == (8, 3, 1, 6)


def test_routes_prefer_handler_folders(spark, rows):
    fn = spark.createDataFrame([("controllers/x.js", "show", 1), ("old/x.js", "show", 2)], "file_path string, function_name string, fn_ord bigint")
    routes = spark.createDataFrame([("GET", "/x", ["ctl.show"])], "method string, path string, handlers array<string>")
    assert rows(G.route_entry_points(G.nodes(fn), routes), "id") == ["controllers/x.js::show"]


def test_imports_reach_dotted_names(spark, rows):
    fn, calls, _ = fixture(spark)
    fn = fn.unionByName(spark.createDataFrame([("models/a.js", "this.update", 20)], fn.schema))
    imps = spark.createDataFrame([("a.js", 0, "x", "../models/a.js"), ("a.js", 1, "x", "./b.js")], "file_path string, pos int, alias string, source string")
    n = G.nodes(fn)
    rest = G.resolve_static(calls, n).where("name is null")
    assert rows(G.resolve_imports(rest, imps, fn, n), "src", "dst") == [("a.js::this.update", "models/a.js::this.update")]


def test_cached_resolution(spark):
    rest = spark.createDataFrame([("s", "res.send"), ("s", "obj.go"), ("s", "obj.stop"), ("s", "obj.ask"), ("s", "obj.fail")], "src string, raw_call string")
    key = lambda c: rest.where(F.col("raw_call") == c).select(G.cache_key(F.col("src"), F.col("raw_call"), F.array(F.lit("b"), F.lit("a")))).first()[0]
    cache = spark.createDataFrame([(key("obj.go"), "a"), (key("obj.stop"), None)], "key string, target string")

    def ask(q):
        if q["raw_call"] == "obj.fail":
            raise RuntimeError("down")
        return {"callee": "b" if len(q["caller_code"]) == 1500 else "zz"}

    got = {r.raw_call: (r.target, r.resolved_by) for r in G.resolve_cached(rest, ["b", "a"], cache, ask, spark.createDataFrame([("s", "x" * 9000)], "id string, code string")).collect()}
    assert got == {"res.send": (None, "static"), "obj.go": ("a", "cache"), "obj.stop": (None, "cache"), "obj.ask": ("b", "resolver"), "obj.fail": (None, "resolver")}
    assert {r.target for r in G.resolve_cached(rest, ["only"], cache).collect()} == {"only"}
    assert G.salvage_target({"edges": [{"callee": "a"}]}, ["a"]) == "a" and G.salvage_target({"target": "x"}, ["a"]) is None and G.salvage_target({}, ["a"]) is None


def bfs(edges, start, limit):
    out = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    paths, queue = {start: [start]}, [start]
    for u in queue:
        if len(paths[u]) <= limit:
            for v in out.get(u, []):
                if v not in paths:
                    paths[v] = [*paths[u], v]
                    queue.append(v)
    return paths


def test_paths_like_breadth_first_search(spark):
    r = random.Random(3)
    ids = [f"n{i:02d}" for i in range(30)]
    edges = {(a, b) for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(60)) if a != b} | {(f"c{i}", f"c{i + 1}") for i in range(12)}
    starts = [*ids[:5], "c0"]
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = {(x.start, x.node): x.path for x in Q.paths_from(spark.createDataFrame([(s,) for s in starts], "id string"), e).collect()}
    want = {(s, n): p for s in starts for n, p in bfs(edges, s, 8).items()}
    assert got == want and ("c0", "c8") in got and ("c0", "c9") not in got


def test_taint_paths(spark):
    n = spark.createDataFrame([(f"f::s{i}", False, True, False, i) for i in range(4)] + [("f::mid", False, False, False, 5), ("f::sink", False, False, True, 6), ("f::far", False, False, False, 7), ("external::x", True, False, False, 8)], "id string, is_external boolean, is_taint_source boolean, is_taint_sink boolean, ord int")
    e = spark.createDataFrame([(f"f::s{i}", "f::mid") for i in range(4)] + [("f::mid", "f::sink"), ("f::mid", "external::x"), ("f::sink", "f::far")], "src string, dst string")
    got = {(r.id, r.rank): r.path for r in Q.taint_paths(n, e).collect()}
    assert [got["f::mid", k] for k in (1, 2, 3)] == [f"s{i} -> mid -> sink" for i in range(3)] and ("f::mid", 4) not in got
    assert got["f::sink", 1] == "s0 -> mid -> sink" and got["f::far", 1] == "s0 -> mid -> sink -> far"
    assert not any(k[0] == "external::x" for k in got)


def test_nearest_against_all_starts(spark):
    r = random.Random(9)
    ids = [f"n{i:02d}" for i in range(40)]
    edges = {(a, b) for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(70)) if a != b}
    starts = {s: i for i, s in enumerate(r.sample(ids, 15))}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    s = spark.createDataFrame(list(starts.items()), "id string, ord int")
    for backward in (False, True):
        reach = {x: bfs({(b, a) for a, b in edges} if backward else edges, x, 4) for x in starts}
        want = {}
        for n in ids:
            for rank, x in enumerate(sorted((x for x in starts if n in reach[x]), key=starts.get)[:2]):
                want[n, rank + 1] = (x, bfs(edges, n, 4)[x] if backward else reach[x][n])
        got = {(x.node, x.rank): (x.start, x.path) for x in Q.nearest(s, e, 2, 4, backward).collect()}
        assert got == want


def test_questions(spark):
    g = spark.createDataFrame([("a::f", "f", ["x"], []), ("b::f", "f", [], ["a::f"])], "id string, function_name string, callers array<string>, callees array<string>")
    q = spark.createDataFrame([(1, "f", "b"), (2, "f", None), (3, "f", "zzz"), (4, "nope", "b"), (5, "a::f", None)], "q int, fn string, path string")
    asked = Q.resolve(q, g)
    assert {r.q: r.id for r in asked.collect()} == {1: "b::f", 2: "a::f", 3: "a::f", 4: None, 5: "a::f"}
    hop = {r.q: (r.callers, r.callees) for r in Q.one_hop(g, asked).collect()}
    assert hop[1] == ([], ["a::f"]) and hop[4] == ([], [])
    assert {r.q for r in Q.node_info(g, asked).collect()} == {1, 2, 3, 5}


def test_empty_graph(spark):
    fn = spark.createDataFrame([], "file_path string, function_name string, fn_ord bigint")
    graph, edges = G.build(fn, spark.createDataFrame([], "src string, pos int, raw_call string"), spark.createDataFrame([], "method string, path string, handlers array<string>"))
    assert graph.count() == 0 and edges.count() == 0 and Q.summary(graph).first().total_edges == 0
    assert list(itertools.islice(Q.paths_from(spark.createDataFrame([], "id string"), edges).collect(), 1)) == []


def test_resolver_answers_in_text(spark):
    rest = spark.createDataFrame([("s", c) for c in ("a.ok", "a.bare", "a.prose", "a.list")], "src string, raw_call string")
    said = {"a.ok": '```json\n{"edges": [{"callee": "x"}]}\n```', "a.bare": '{"target": "y"}', "a.prose": "it is x", "a.list": '["x"]'}
    got = {r.raw_call: r.target for r in G.resolve_cached(rest, ["x", "y"], spark.createDataFrame([], "key string, target string"), lambda q: said[q["raw_call"]]).collect()}
    assert got == {"a.ok": "x", "a.bare": "y", "a.prose": None, "a.list": None}
