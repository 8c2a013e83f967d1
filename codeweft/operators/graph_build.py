"""Call graphs from functions, calls, imports and routes.

Inputs: functions(file_path, function_name, fn_ord), calls(src, pos, raw_call), imports(file_path, pos, alias, source),
routes(method, path, handlers). Names resolve with fan-out: a call reaches every function of that name, itself left out.
Functions without a name are left out; repeated ids are one node with the first ordinal. All steps are equi-joins and
aggregates; calls are reduced to distinct (src, name) before the fan-out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.core import cut, spread_join
from codeweft.functions import text as T

# Objects whose methods are the runtime's, fixed values.
EXTERNAL_OBJECTS = ["res", "req", "console", "fs", "jwt", "bcrypt", "process", "Math", "JSON", "Date", "Object", "Array"]


def nodes(functions: DataFrame, entry_path=T.ENTRY_PATH, entry_name=T.ENTRY_NAME, infrastructure=T.INFRASTRUCTURE, sinks=T.SINK_NAME) -> DataFrame:
    """(id, file_path, function_name, fn_ord, is_entry_point, is_infrastructure, is_sink_name)."""
    named = functions.where(T.missing("function_name").isNotNull()).withColumn("id", T.node_id("file_path", "function_name"))
    one = named.groupBy("id").agg(F.min("fn_ord").alias("fn_ord"), F.min("file_path").alias("file_path"), F.min("function_name").alias("function_name"))
    path = F.coalesce("file_path", F.lit(""))
    return one.select(
        "id", "file_path", "function_name", "fn_ord",
        (T.contains_any(path, entry_path) | T.contains_any("function_name", entry_name)).alias("is_entry_point"),
        T.contains_any("function_name", infrastructure).alias("is_infrastructure"),
        T.contains_any("function_name", sinks).alias("is_sink_name"),
    )


def name_index(nodes: DataFrame) -> DataFrame:
    """(function_name, ids) with sorted ids."""
    return nodes.groupBy("function_name").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def route_entry_points(nodes: DataFrame, routes: DataFrame, entry_path=T.ENTRY_PATH) -> DataFrame:
    """(id) of nodes that routes make entry points: the only candidate of a handler, or the only one in a path of handlers."""
    h = routes.select(F.explode("handlers").alias("raw")).select(F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("raw")).where("raw <> ''").select(T.last_segment("raw").alias("function_name")).distinct()
    preferred = T.contains_any(F.coalesce("file_path", F.lit("")), entry_path)
    c = h.join(nodes, "function_name").groupBy("function_name").agg(
        F.count("*").alias("n"), F.count_if(preferred).alias("n_pref"), F.min("id").alias("only"), F.min(F.when(preferred, F.col("id"))).alias("pref")
    )
    return c.select(F.when(F.col("n") == 1, F.col("only")).when(F.col("n_pref") == 1, F.col("pref")).alias("id")).where("id is not null").distinct()


def with_route_entries(nodes: DataFrame, routes: DataFrame, entry_path=T.ENTRY_PATH) -> DataFrame:
    marked = route_entry_points(nodes, routes, entry_path).withColumn("routed", F.lit(True))
    return nodes.join(marked, "id", "left").withColumn("is_entry_point", F.col("is_entry_point") | F.coalesce("routed", F.lit(False))).drop("routed")


def resolve_static(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls with `name`: the full text if a function is called so, else its last segment if one is, else null (tier 1)."""
    known = nodes.select(F.col("function_name").alias("k")).distinct()
    full = calls.join(known.withColumnRenamed("k", "k1"), F.col("raw_call") == F.col("k1"), "left")
    return full.join(known.withColumnRenamed("k", "k2"), T.last_segment("raw_call") == F.col("k2"), "left").withColumn("name", F.coalesce("k1", "k2")).drop("k1", "k2")


def resolve_imports(unresolved: DataFrame, imports: DataFrame, functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, raw_call, dst) by the first import of the object's alias: functions of that name in files whose path holds the module's stem (tier 2)."""
    first = imports.groupBy("file_path", "alias").agg(F.min_by("source", "pos").alias("source"))
    src = nodes.select(F.col("id").alias("src"), "file_path")
    dotted = unresolved.where(F.col("raw_call").contains(".")).join(src, "src").withColumn("alias", F.substring_index("raw_call", ".", 1)).withColumn("method", F.expr("substring(raw_call, length(alias) + 2)"))
    stem = F.regexp_extract(F.regexp_replace("source", "/+$", ""), r"([^/]+?)(?:\.[^./]*)?$", 1)
    via = dotted.join(first, ["file_path", "alias"]).withColumn("stem", stem)
    f = functions.select(F.col("function_name").alias("method"), F.col("file_path").alias("to_path"), T.node_id("file_path", "function_name").alias("dst")).distinct()
    hit = spread_join(via, f, "method", "dst").where(F.col("to_path").contains(F.col("stem"))).where("dst <> src")
    return hit.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "raw_call", "dst").distinct()


Resolver = Callable[[dict], dict | str]
CODE_CHARS = 1500  # of the caller's code that a resolver is shown


def cache_key(caller, raw_call, candidates):
    """Key of a resolved edge: hash of caller, call and sorted candidates."""
    return F.sha2(F.to_json(F.struct(F.sort_array(candidates).alias("candidates"), caller.alias("caller"), raw_call.alias("raw_call"))), 256)


def resolve_cached(unresolved: DataFrame, candidates: list[str], cache: DataFrame, resolver: Resolver | None = None, code: DataFrame | None = None) -> DataFrame:
    """(src, raw_call, key, target, resolved_by): a sole candidate, else none for runtime objects, else the cache, else the resolver (tier 3).

    A cached null counts as an answer. Errors of the resolver give a null target. Without a resolver the rest stays null.
    The resolver is asked with the first CODE_CHARS characters of the caller's code where `code`(id, code) is given; only
    rows that need it reach it, and columns are cut before they leave the JVM. It answers with a dict, or with a text that is one
    in JSON, fenced or not.
    """
    cand = F.array(*[F.lit(c) for c in sorted(set(candidates))]) if candidates else F.expr("cast(array() as array<string>)")
    d = unresolved.select("src", "raw_call").distinct().withColumn("key", cache_key(F.col("src"), F.col("raw_call"), cand))
    hit = cache.select("key", F.col("target").alias("cached"), F.lit(True).alias("known"))
    j = d.join(hit, "key", "left")
    dotted = F.col("raw_call").contains(".")
    obj = F.when(dotted, F.substring_index("raw_call", ".", 1)).otherwise("")
    single, runtime = F.lit(len(set(candidates)) == 1), obj.isin(*EXTERNAL_OBJECTS)
    by = F.when(single, "single_candidate").when(runtime, "static").when(F.col("known"), "cache").otherwise("resolver")
    target = F.when(single, F.lit(candidates[0] if candidates else None)).when(runtime, F.lit(None)).otherwise(F.col("cached"))
    j = j.select("src", "raw_call", "key", target.alias("target"), by.alias("resolved_by"))
    if resolver is None:
        return j
    allowed = sorted(set(candidates))
    texts = j.select("src").limit(0).select(F.col("src").alias("id"), F.lit("").alias("caller_code")) if code is None else code.select("id", F.substring("code", 1, CODE_CHARS).alias("caller_code"))
    settled = j.where("resolved_by <> 'resolver'")
    asked = j.where("resolved_by = 'resolver'").join(texts, F.col("src") == F.col("id"), "left").drop("id")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.copy()
            for i in f.index:
                try:
                    got = resolver({"caller": f.at[i, "src"], "raw_call": f.at[i, "raw_call"], "caller_code": f.at[i, "caller_code"] or "", "candidates": allowed}) or {}
                    f.at[i, "target"] = salvage_target(json.loads(T.without_fences(got)) if isinstance(got, str) else got, allowed)
                except Exception:  # noqa: BLE001 - a failing service leaves the call unresolved
                    f.at[i, "target"] = None
            yield f[["src", "raw_call", "key", "target", "resolved_by"]]

    return settled.unionByName(asked.mapInPandas(ask, j.schema))


# Keys under which older entries hold the target, fixed values.
_ALTERNATIVES = ("resolved_callee", "callee", "resolved_call", "resolved_to", "call")
_NESTED = ("resolved_edges", "edges", "call_edges")
_NESTED_KEYS = ("callee", "target", "resolved_callee")


def salvage_target(entry: dict, candidates: list[str]) -> str | None:
    """Target of a cache entry or answer in any of the known layouts; only candidates count."""
    def ok(v):
        return v if isinstance(v, str) and v in candidates else None

    if "target" in entry:
        return ok(entry["target"])
    flat = [entry.get(k) for k in _ALTERNATIVES]
    heads = [v[0] for k in _NESTED if isinstance(v := entry.get(k), list) and v and isinstance(v[0], dict)]
    return next((v for v in [*flat, *[h.get(k) for h in heads for k in _NESTED_KEYS]] if ok(v)), None)


def internal_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): fan-out to every node of the resolved name but the caller."""
    want = resolved.where("name is not null").select("src", "name").distinct()
    return spread_join(want, nodes.select(F.col("function_name").alias("name"), F.col("id").alias("dst")), "name", "dst").where("dst <> src").select("src", "dst").distinct()


def external_edges(resolved: DataFrame, via_imports: DataFrame | None = None) -> DataFrame:
    """(src, dst) with dst 'external::<call>' for calls that no tier resolved."""
    rest = resolved.where("name is null").select("src", "raw_call").distinct()
    if via_imports is not None:
        rest = rest.join(via_imports.select("src", "raw_call"), ["src", "raw_call"], "left_anti")
    return rest.select("src", F.concat(F.lit("external::"), "raw_call").alias("dst")).distinct()


def taint_flags(nodes: DataFrame, edges: DataFrame, sinks=T.SINK_EXTERNAL) -> DataFrame:
    """nodes with is_taint_source (entry points) and is_taint_sink (by own name or by an external callee)."""
    ext = edges.where(F.col("dst").startswith("external::")).select("src", T.contains_any(T.last_segment(F.expr("substring(dst, 11)")), sinks).alias("hit"))
    by_callee = ext.groupBy("src").agg(F.bool_or("hit").alias("hit"))
    j = nodes.join(by_callee, F.col("id") == F.col("src"), "left").drop("src")
    return j.withColumn("is_taint_source", F.col("is_entry_point")).withColumn("is_taint_sink", F.col("is_sink_name") | F.coalesce("hit", F.lit(False))).drop("hit", "is_sink_name")


def adjacency(node_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees), sorted; nodes without links have empty lists."""
    out = edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("callees"))
    inn = edges.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("callers"))
    empty = F.expr("cast(array() as array<string>)")
    return node_ids.select("id").distinct().join(inn, F.col("id") == F.col("dst"), "left").join(out, F.col("id") == F.col("src"), "left").select("id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def build(functions: DataFrame, calls: DataFrame, routes: DataFrame, imports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph, edges): nodes with the ten columns of the exported graph, externals included, and all links."""
    n = cut(with_route_entries(nodes(functions), routes))
    r = cut(resolve_static(calls.select("src", "raw_call").distinct(), n))
    via = resolve_imports(r.where("name is null"), imports, functions, n) if imports is not None else None
    inside = internal_edges(r, n)
    if via is not None:
        inside = inside.unionByName(via.select("src", "dst")).distinct()
    edges = cut(inside.unionByName(external_edges(r, via)))
    flagged = taint_flags(n, edges).select("id", "function_name", "file_path", "is_entry_point", "is_infrastructure", F.lit(False).alias("is_external"), "is_taint_source", "is_taint_sink")
    ext = edges.where(F.col("dst").startswith("external::")).select(F.col("dst").alias("id")).distinct()
    no = F.lit(False)
    every = flagged.unionByName(ext.select("id", F.expr("substring(id, 11)").alias("function_name"), F.lit("").alias("file_path"), no.alias("is_entry_point"), no.alias("is_infrastructure"), F.lit(True).alias("is_external"), no.alias("is_taint_source"), no.alias("is_taint_sink")))
    return every.join(adjacency(every, edges), "id").select("id", "function_name", "file_path", "callers", "callees", "is_entry_point", "is_infrastructure", "is_external", "is_taint_source", "is_taint_sink"), edges
