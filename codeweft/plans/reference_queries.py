"""Queries of the code-analytics operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.core import load
from codeweft.functions import text as T
from codeweft.operators import analysis, evaluation, extraction, graph_build, graph_query, patching, results
from codeweft.plans import tables as t
from codeweft.sources import sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _words(column: str, words: list[str]) -> str:
    return f"regexp_matches(lower({column}), '{'|'.join(words)}')"


def _joined(df: DataFrame, *cols: str, by: str = ",") -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.array_join(c, by))
    return df


# -- sources and extraction --------------------------------------------------------------------------------------------


@query(f"WITH {t.FN} SELECT language, count(*) AS n FROM fn GROUP BY language")
def lang_counts(spark, d):
    """R5."""
    return results.language_counts(t.functions(spark, d))


_SUFFIX = "lower(regexp_extract(file_path, '(\\.[^./]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_SUFFIX} = '{s}' THEN '{g}'" for s, g in T.EXTENSIONS.items()) + " ELSE 'unknown' END"


@query(f"SELECT {_LANG} AS language, count(DISTINCT file_path) AS n_files FROM code_samples WHERE file_path IS NOT NULL GROUP BY 1")
def suffix_language(spark, d):
    """S4, J1."""
    return load(spark, d, "code_samples").where("file_path is not null").groupBy(T.language_of("file_path").alias("language")).agg(F.countDistinct("file_path").alias("n_files"))


@query(f"SELECT DISTINCT file_path FROM code_samples WHERE NOT list_has_any(string_split(file_path, '/'), {T.SKIP_DIRS})")
def skip_dirs_filter(spark, d):
    """S2, F2."""
    return load(spark, d, "code_samples").select("file_path").where(~T.in_skipped_folder("file_path")).distinct()


@query(rf"""WITH {t.FILES}, r AS (
  SELECT file_path, 0 AS part, unnest(regexp_extract_all(content, 'const\s+(\w+)\s*=\s*require\(["''](.+?)["'']\)', 1)) AS alias, unnest(regexp_extract_all(content, 'const\s+(\w+)\s*=\s*require\(["''](.+?)["'']\)', 2)) AS source,
    unnest(range(len(regexp_extract_all(content, 'const\s+(\w+)\s*=\s*require\(["''](.+?)["'']\)')))) AS k FROM files
  UNION ALL SELECT file_path, 1, unnest(regexp_extract_all(content, 'import\s+(\w+)\s+from\s+["''](.+?)["'']', 1)), unnest(regexp_extract_all(content, 'import\s+(\w+)\s+from\s+["''](.+?)["'']', 2)),
    unnest(range(len(regexp_extract_all(content, 'import\s+(\w+)\s+from\s+["''](.+?)["'']')))) FROM files)
SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY part, k) - 1 AS INTEGER) AS pos, alias, source FROM r""")
def import_extract(spark, d):
    """X11, D2."""
    return extraction.imports(t.contents(spark, d)).distinct()


@query(rf"""WITH {t.FILES}, r AS (SELECT file_path, unnest(regexp_extract_all(content, '(?s)router\.(get|post|put|delete)\((.+?)\)', 1)) AS m,
  unnest(regexp_extract_all(content, '(?s)router\.(get|post|put|delete)\((.+?)\)', 2)) AS a, unnest(range(len(regexp_extract_all(content, '(?s)router\.(get|post|put|delete)\((.+?)\)')))) AS pos FROM files),
p AS (SELECT file_path, CAST(pos AS INTEGER) AS pos, upper(m) AS method, list_transform(string_split(a, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS p FROM r)
SELECT file_path, pos, method, regexp_replace(p[1], '["'']', '', 'g') AS path, array_to_string(p[2:], ',') AS handlers FROM p""")
def route_extract(spark, d):
    """X12, D3."""
    return _joined(extraction.routes(t.contents(spark, d)), "handlers").distinct()


@query(rf"WITH {t.FNC} SELECT id AS src, x AS raw_call, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(code, '{t.CALL}', 1)) AS x FROM fnc WHERE code IS NOT NULL) GROUP BY ALL")
def call_extract_regex(spark, d):
    """X10, G9."""
    return t.calls(spark, d).groupBy("src", "raw_call").agg(F.count("*").alias("n"))


@query()
def extract_functions(spark, d):
    """Functions of whole files by the parsers (no SQL; tested against fixtures)."""
    f = t.files(spark, d).withColumn("language", T.language_of("file_path"))
    return extraction.extract_functions(f).select("file_path", "function_name", "language", "start_line", "end_line", "start_byte", "end_byte", "pos", "line_count", F.size("calls").alias("n_calls"), F.md5("code").alias("code_md5"))


@query(f"""WITH {t.FN}, f AS (SELECT file_path, id, start_line AS sb, end_line AS eb FROM fn WHERE file_path IS NOT NULL AND start_line IS NOT NULL),
s AS (SELECT * FROM f UNION ALL SELECT file_path, file_path, 1, max(eb) + 1 FROM f GROUP BY file_path),
p AS (SELECT o.file_path, o.id AS outer_id, i.id AS inner_id, o.sb AS os, o.eb AS oe FROM s o JOIN s i ON o.file_path = i.file_path AND o.sb <= i.sb AND i.eb <= o.eb AND NOT (o.sb = i.sb AND o.eb = i.eb))
SELECT file_path, outer_id AS "outer", inner_id AS "inner" FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.file_path = a.file_path AND b.inner_id = a.inner_id AND a.os <= b.os AND b.oe <= a.oe AND NOT (a.os = b.os AND a.oe = b.oe))""")
def nested_direct(spark, d):
    """Functions in functions, and in files."""
    f = t.functions(spark, d).where("file_path is not null and start_line is not null").select("file_path", "id", F.col("start_line").alias("sb"), F.col("end_line").alias("eb"))
    whole = f.groupBy("file_path").agg(F.max("eb").alias("e")).select("file_path", F.col("file_path").alias("id"), F.lit(1).alias("sb"), (F.col("e") + 1).alias("eb"))
    return extraction.nested_direct(f.unionByName(whole))


# -- graph -------------------------------------------------------------------------------------------------------------


@query(f"WITH {t.NODES} SELECT id, fn_ord, file_path, function_name FROM nodes")
def node_dedup(spark, d):
    """G1, G2."""
    return graph_build.nodes(t.functions(spark, d)).select("id", "fn_ord", "file_path", "function_name")


_ENTRY = f"({_words("coalesce(file_path, '')", T.ENTRY_PATH)} OR {_words('function_name', T.ENTRY_NAME)})"


@query(f"WITH {t.NODES} SELECT id FROM nodes WHERE {_ENTRY}")
def entry_points(spark, d):
    """G3."""
    return graph_build.nodes(t.functions(spark, d)).where("is_entry_point").select("id")


@query(f"WITH {t.NODES} SELECT id FROM nodes WHERE {_words('function_name', T.INFRASTRUCTURE)}")
def infra_nodes(spark, d):
    """G4."""
    return graph_build.nodes(t.functions(spark, d)).where("is_infrastructure").select("id")


_SHARED_WORDS = [*T.INFRASTRUCTURE, "socket", "cache"]


@query(f"WITH {t.NODES} SELECT id FROM nodes WHERE {_words('function_name', _SHARED_WORDS)}")
def infra_nodes_wide(spark, d):
    """G4 with words of its own besides."""
    return graph_build.nodes(t.functions(spark, d), infrastructure=_SHARED_WORDS).where("is_infrastructure").select("id")


@query(f"WITH {t.NODES} SELECT function_name, string_agg(id, ',' ORDER BY id) AS ids FROM nodes GROUP BY function_name")
def name_index(spark, d):
    """G5, G6."""
    return _joined(graph_build.name_index(graph_build.nodes(t.functions(spark, d))), "ids")


_HANDLERS = """h AS (SELECT DISTINCT regexp_extract(trim(x), '([^.]*)$', 1) AS function_name FROM (SELECT unnest(r.handlers) AS x FROM (SELECT unnest(routes) AS r FROM code_samples)) WHERE trim(x) <> '')"""


@query(f"""WITH {t.NODES}, {_HANDLERS}, c AS (SELECT n.function_name, count(*) AS n, count(*) FILTER (WHERE {_words("coalesce(file_path, '')", T.ENTRY_PATH)}) AS n_pref, min(id) AS only_id,
  min(id) FILTER (WHERE {_words("coalesce(file_path, '')", T.ENTRY_PATH)}) AS pref FROM h JOIN nodes n ON h.function_name = n.function_name GROUP BY 1)
SELECT DISTINCT CASE WHEN n = 1 THEN only_id ELSE pref END AS id FROM c WHERE n = 1 OR n_pref = 1""")
def route_entry_points(spark, d):
    """G7, G8, J4."""
    return graph_build.route_entry_points(graph_build.nodes(t.functions(spark, d)), t.file_routes(spark, d))


_RESOLVED = t.CALLS + """, known AS (SELECT DISTINCT function_name AS k FROM fnc),
r AS (SELECT c.src, c.raw_call, coalesce(k1.k, k2.k) AS name FROM calls c LEFT JOIN known k1 ON c.raw_call = k1.k LEFT JOIN known k2 ON regexp_extract(c.raw_call, '([^.]*)$', 1) = k2.k),
ie AS (SELECT DISTINCT r.src, f.id AS dst FROM r JOIN (SELECT DISTINCT function_name, id FROM fnc) f ON r.name = f.function_name WHERE f.id <> r.src),
ee AS (SELECT DISTINCT src, 'external::' || raw_call AS dst FROM r WHERE name IS NULL)"""


def _resolved(spark, d):
    n = graph_build.nodes(t.functions(spark, d))
    return graph_build.resolve_static(t.calls(spark, d).select("src", "raw_call").distinct(), n), n


@query(f"WITH {_RESOLVED} SELECT src, dst FROM ie")
def edges_internal(spark, d):
    """G9, G10, G14, J5, J10."""
    return graph_build.internal_edges(*_resolved(spark, d))


@query(f"WITH {_RESOLVED} SELECT src, dst FROM ee")
def edges_external(spark, d):
    """G13, J9."""
    return graph_build.external_edges(_resolved(spark, d)[0])


@query(rf"""WITH {t.CALLS}, imp AS (SELECT file_path, i.alias AS alias, arg_min(i.source, pos) AS source FROM (
  SELECT DISTINCT file_path, unnest(imports) AS i, unnest(range(len(imports))) AS pos FROM code_samples WHERE file_path IS NOT NULL) GROUP BY ALL),
own AS (SELECT DISTINCT id, file_path FROM fnc), c AS (SELECT calls.src, raw_call, own.file_path, string_split(raw_call, '.')[1] AS alias, substr(raw_call, length(string_split(raw_call, '.')[1]) + 2) AS method
  FROM calls JOIN own ON own.id = calls.src WHERE contains(raw_call, '.'))
SELECT DISTINCT c.src, c.raw_call, f.id AS dst FROM c JOIN imp ON imp.file_path = c.file_path AND imp.alias = c.alias JOIN (SELECT DISTINCT id, file_path, function_name FROM fnc) f ON f.function_name = c.method
WHERE contains(f.file_path, regexp_extract(rtrim(imp.source, '/'), '([^/]+?)(?:\.[^./]*)?$', 1)) AND f.id <> c.src""")
def import_resolve(spark, d):
    """G11, J6, J7 for every dotted call."""
    fn = t.functions(spark, d)
    return graph_build.resolve_imports(t.calls(spark, d).select("src", "raw_call").distinct(), t.file_imports(spark, d), fn, graph_build.nodes(fn))


@query(rf"""WITH {t.NODES}, one AS (SELECT file_path, min(id) AS src, max(id) AS last FROM nodes GROUP BY file_path),
imp AS (SELECT file_path, min(i.alias) AS alias FROM (SELECT DISTINCT file_path, unnest(imports) AS i FROM code_samples WHERE file_path IS NOT NULL) GROUP BY file_path),
c AS (SELECT DISTINCT one.src, imp.file_path, imp.alias || '.' || n.function_name AS raw_call, n.function_name AS method FROM one JOIN imp ON imp.file_path = one.file_path JOIN nodes n ON n.file_path = one.file_path),
f AS (SELECT DISTINCT id, file_path, function_name FROM fn)
SELECT DISTINCT c.src, c.raw_call, f.id AS dst FROM c JOIN f ON f.function_name = c.method WHERE contains(f.file_path, regexp_extract(string_split(c.file_path, '/')[-1], '([^/]+?)(?:\.[^./]*)?$', 1)) AND f.id <> c.src""")
def import_resolve_siblings(spark, d):
    """G11, J6, J7 where each file calls its own functions through its first import, which names the file itself."""
    fn = t.functions(spark, d)
    nodes = graph_build.nodes(fn)
    alias = t.file_imports(spark, d).groupBy("file_path").agg(F.min("alias").alias("alias")).where("alias is not null")
    source = F.concat(F.lit("./"), F.element_at(F.split("file_path", "/"), -1))
    src = nodes.groupBy("file_path").agg(F.min("id").alias("src"))
    calls = src.join(alias, "file_path").join(nodes.select("file_path", "function_name"), "file_path").select("src", F.concat_ws(".", "alias", "function_name").alias("raw_call")).distinct()
    return graph_build.resolve_imports(calls, alias.select("file_path", F.lit(0).alias("pos"), "alias", source.alias("source")), fn, nodes)


_CACHED = """key AS (SELECT DISTINCT src, raw_call, sha256('{"candidates":["audit","main"],"caller":' || to_json(src) || ',"raw_call":' || to_json(raw_call) || '}') AS key FROM r WHERE name IS NULL)"""


@query(f"""WITH {_RESOLVED}, {_CACHED} SELECT src, raw_call, key, CASE WHEN split_part(raw_call, '.', 1) IN ({', '.join(repr(x) for x in graph_build.EXTERNAL_OBJECTS)}) AND contains(raw_call, '.') THEN NULL WHEN length(raw_call) % 3 = 0 THEN 'main' END AS target,
CASE WHEN split_part(raw_call, '.', 1) IN ({', '.join(repr(x) for x in graph_build.EXTERNAL_OBJECTS)}) AND contains(raw_call, '.') THEN 'static' WHEN length(raw_call) % 3 < 2 THEN 'cache' ELSE 'resolver' END AS resolved_by FROM key""")
def edge_cache_lookup(spark, d):
    """Cache of every third call with a target, of every third with null."""
    rest = _resolved(spark, d)[0].where("name is null")
    keyed = rest.select("src", "raw_call").distinct().where("length(raw_call) % 3 < 2").withColumn("key", graph_build.cache_key(F.col("src"), F.col("raw_call"), F.array(F.lit("audit"), F.lit("main"))))
    cache = keyed.select("key", F.when(F.length("raw_call") % 3 == 0, "main").alias("target"))
    return graph_build.resolve_cached(rest, ["main", "audit"], cache)


def _answer(question: dict) -> str:
    """A stand-in for the service: answers calls of even length, fenced; the others get no JSON."""
    return '```json\n{"edges": [{"callee": "audit"}]}\n```' if len(question["raw_call"]) % 2 == 0 else "unsure"


@query(f"""WITH {_RESOLVED}, {_CACHED} SELECT src, raw_call, key, CASE WHEN split_part(raw_call, '.', 1) IN ({', '.join(repr(x) for x in graph_build.EXTERNAL_OBJECTS)}) AND contains(raw_call, '.') THEN NULL WHEN length(raw_call) % 2 = 0 THEN 'audit' END AS target,
CASE WHEN split_part(raw_call, '.', 1) IN ({', '.join(repr(x) for x in graph_build.EXTERNAL_OBJECTS)}) AND contains(raw_call, '.') THEN 'static' ELSE 'resolver' END AS resolved_by FROM key""")
def edge_resolver(spark, d):
    """G12, G12d: every call that nothing else settles is put to a resolver; the cache is empty."""
    rest = _resolved(spark, d)[0].where("name is null")
    return graph_build.resolve_cached(rest, ["main", "audit"], spark.createDataFrame([], "key string, target string"), _answer)


@query(f"""WITH {_RESOLVED}, nodes AS (SELECT id, min(file_path) AS file_path, min(function_name) AS function_name FROM fnc GROUP BY id),
s AS (SELECT src, bool_or({_words("regexp_extract(substr(dst, 11), '([^.]*)$', 1)", T.SINK_EXTERNAL)}) AS hit FROM ee GROUP BY src)
SELECT id, {_ENTRY} AS is_taint_source, {_words('function_name', T.SINK_NAME)} OR coalesce(hit, false) AS is_taint_sink FROM nodes LEFT JOIN s ON s.src = id""")
def taint_flags(spark, d):
    """G15-G17."""
    r, n = _resolved(spark, d)
    return graph_build.taint_flags(n, graph_build.external_edges(r)).select("id", "is_taint_source", "is_taint_sink")


@query(f"""WITH {t.EDGES} SELECT g.id, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM edges WHERE dst = g.id), '') AS callers, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE src = g.id), '') AS callees FROM g""")
def adjacency(spark, d):
    """G18."""
    return _joined(graph_build.adjacency(t.graph(spark, d), t.edges(spark, d)), "callers", "callees")


@query(f"""WITH {t.GRAPH} SELECT count(*) FILTER (WHERE NOT is_external) AS total_functions, count(*) FILTER (WHERE is_external) AS external_functions, count(*) FILTER (WHERE is_entry_point AND NOT is_external) AS entry_points,
count(*) FILTER (WHERE is_infrastructure AND NOT is_external) AS infrastructure, count(*) FILTER (WHERE is_taint_source AND NOT is_external) AS taint_sources, count(*) FILTER (WHERE is_taint_sink AND NOT is_external) AS taint_sinks,
CAST(coalesce(sum(len(callees)), 0) AS BIGINT) AS total_edges FROM g""")
def graph_summary(spark, d):
    """T10."""
    return graph_query.summary(t.graph(spark, d))


_ASKED = "asked AS (SELECT DISTINCT f.finding_id AS q, f.function_name AS fn, f.file_path AS path FROM findings f), a AS (SELECT q, coalesce(e.id, (SELECT min(id) FROM g WHERE g.function_name = asked.fn)) AS id FROM asked LEFT JOIN g e ON e.id = asked.path || '::' || asked.fn)"


def _asked(spark, d):
    f = load(spark, d, "findings").select(F.col("finding_id").alias("q"), F.col("function_name").alias("fn"), F.col("file_path").alias("path")).distinct()
    return graph_query.resolve(f, t.graph(spark, d).select("id", "function_name"))


@query(f"""WITH {t.EDGES}, {_ASKED} SELECT a.q, a.id, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM edges WHERE dst = a.id), '') AS callers, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE src = a.id), '') AS callees FROM a""")
def one_hop(spark, d):
    """For the function of every finding."""
    return _joined(graph_query.one_hop(graph_build.adjacency(t.graph(spark, d), t.edges(spark, d)), _asked(spark, d)), "callers", "callees")


@query(f"""WITH {t.GRAPH}, {_ASKED} SELECT a.q, a.id, function_name, file_path, is_entry_point, is_infrastructure, is_external, is_taint_source, is_taint_sink FROM a JOIN g ON a.id = g.id""")
def node_info(spark, d):
    """T2, T6, T8."""
    return graph_query.node_info(t.graph(spark, d), _asked(spark, d)).select("q", "id", "function_name", "file_path", "is_entry_point", "is_infrastructure", "is_external", "is_taint_source", "is_taint_sink")


def _levels(prefix: str, starts: str, edges: str) -> str:
    """Breadth-first levels, unrolled: the least path of each node that no earlier level has."""
    out = [f"{prefix}0 AS (SELECT id AS start, id AS node, [id] AS path FROM {starts})"]
    for k in range(1, graph_query.MAX_DEPTH + 1):
        seen = " UNION ALL ".join(f"SELECT start, node FROM {prefix}{i}" for i in range(k))
        out.append(f"{prefix}{k} AS MATERIALIZED (SELECT p.start, e.dst AS node, min(list_append(p.path, e.dst)) AS path FROM {prefix}{k - 1} p JOIN {edges} e ON e.src = p.node WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.start = p.start AND s.node = e.dst) GROUP BY p.start, e.dst)")
    every = " UNION ALL ".join(f"SELECT start, node, {k} AS depth, path FROM {prefix}{k}" for k in range(graph_query.MAX_DEPTH + 1))
    return ", ".join(out) + f", {prefix} AS ({every})"


@query(f"WITH {t.EDGES}, st AS (SELECT id FROM g WHERE is_entry_point), {_levels('b', 'st', 'edges')} SELECT start, node, depth, array_to_string(path, ' ') AS path FROM b")
def bfs_paths(spark, d):
    """Shortest paths from every entry point."""
    starts = t.graph(spark, d).where("is_entry_point").select("id")
    return _joined(graph_query.paths_from(starts, t.edges(spark, d)), "path", by=" ")


_FLAGGED = f"""fl AS (SELECT g.id, g.function_name, is_external, is_entry_point AS src_flag, {_words('function_name', T.SINK_NAME)} OR coalesce((SELECT bool_or({_words("regexp_extract(substr(dst, 11), '([^.]*)$', 1)", T.SINK_EXTERNAL)}) FROM edges WHERE src = g.id AND dst LIKE 'external::%'), false) AS sink_flag FROM g)"""


def _flagged(spark, d):
    g = t.graph(spark, d)
    n = g.select("id", "function_name", "is_external", "is_entry_point", T.contains_any("function_name", T.SINK_NAME).alias("is_sink_name"), F.col("id").alias("ord"))
    return graph_build.taint_flags(n, t.edges(spark, d))


@query(f"""WITH {t.EDGES}, {_FLAGGED}, inn AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM fl WHERE NOT is_external) AND dst IN (SELECT id FROM fl WHERE NOT is_external)),
s0 AS (SELECT id FROM fl WHERE src_flag AND NOT is_external), {_levels('p', 's0', 'inn')},
pre AS (SELECT node, start, path, row_number() OVER (PARTITION BY node ORDER BY start) AS rank FROM p QUALIFY rank <= {graph_query.MAX_PATHS}),
s1 AS (SELECT DISTINCT node AS id FROM pre), {_levels('o', 's1', 'inn')},
suf AS (SELECT start, arg_min(path, node) AS tail FROM o WHERE node IN (SELECT id FROM fl WHERE sink_flag AND NOT is_external) GROUP BY start)
SELECT pre.node AS id, pre.rank, array_to_string(list_transform(CASE WHEN tail IS NULL THEN path ELSE list_concat(path, tail[2:]) END, lambda x: string_split(x, '::')[-1]), ' -> ') AS path FROM pre LEFT JOIN suf ON suf.start = pre.node""")
def taint_paths(spark, d):
    """Through every function."""
    return graph_query.taint_paths(_flagged(spark, d), t.edges(spark, d))


# -- prompts, answers, memory ------------------------------------------------------------------------------------------


@query(f"""WITH {t.EDGES}, {t.FNC}, bi AS (SELECT id, arg_max(code, fn_ord) AS code FROM fnc GROUP BY id), bn AS (SELECT function_name, arg_max(code, fn_ord) AS code FROM fnc GROUP BY 1)
SELECT e.src AS id, e.dst AS neighbour, md5(coalesce(bi.code, bn.code)) AS code_md5 FROM edges e LEFT JOIN bi ON bi.id = e.dst LEFT JOIN bn ON bn.function_name = string_split(e.dst, '::')[-1] WHERE e.dst NOT LIKE 'external::%'""")
def neighbour_code(spark, d):
    """A16, J12."""
    a = graph_build.adjacency(t.graph(spark, d), t.edges(spark, d))
    return analysis.neighbour_code(a, t.functions(spark, d, "code"), "callees").select("id", "neighbour", F.md5("code").alias("code_md5"))


@query()
def prompt_context(spark, d):
    """A1: one prompt for each function (no SQL; tested on a fixture)."""
    a = graph_build.adjacency(t.graph(spark, d), t.edges(spark, d))
    p = analysis.prompts(t.functions(spark, d, "code"), a)
    return p.select("id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


_RAW = """CASE WHEN finding_id % 7 = 0 THEN 'no verdict' ELSE '```json' || chr(10) || '{"vulnerability_found": ' || CASE WHEN coalesce(vulnerability_found, false) THEN 'true' ELSE 'false' END || ', "cwe_id": "' || coalesce(cwe_id, '') || '", "severity": "' || coalesce(severity, '')
 || '", "confidence": 0.' || CAST(10 + finding_id % 90 AS STRING) || ', "affected_lines": [1, ' || CAST(finding_id % 50 AS STRING) || ']}' || chr(10) || '```' END"""


@query(f"""WITH f AS (SELECT DISTINCT finding_id, vulnerability_found, cwe_id, severity FROM findings) SELECT finding_id, finding_id % 7 <> 0 AND coalesce(vulnerability_found, false) AS vulnerability_found,
CASE WHEN finding_id % 7 = 0 OR coalesce(cwe_id, '') = '' THEN NULL WHEN upper(trim(cwe_id)) LIKE 'CWE-%' THEN 'CWE-' || substr(trim(cwe_id), 5) WHEN regexp_matches(trim(cwe_id), '^[0-9]+$') THEN 'CWE-' || trim(cwe_id) ELSE trim(cwe_id) END AS cwe_id,
CASE WHEN finding_id % 7 <> 0 THEN '1,' || CAST(finding_id % 50 AS VARCHAR) ELSE '' END AS affected_lines, CASE WHEN finding_id % 7 <> 0 THEN coalesce(severity, '') END AS severity,
CASE WHEN finding_id % 7 <> 0 THEN CAST('0.' || CAST(10 + finding_id % 90 AS VARCHAR) AS DOUBLE) ELSE 0.0 END AS confidence, finding_id % 7 = 0 AS hallucination_flag, CASE WHEN finding_id % 7 = 0 THEN 'json_parse_error' END AS error FROM f""")
def parse_response(spark, d):
    """Answers made of the findings, fenced, every seventh no JSON."""
    f = load(spark, d, "findings").select("finding_id", "vulnerability_found", "cwe_id", "severity").distinct()
    return _joined(analysis.answers(f.select("finding_id", F.expr(_RAW).alias("raw"))).drop("explanation"), "affected_lines")


_STEP = """CASE WHEN finding_id % 3 = 0 THEN '{"action": "tool", "tool": "get_source", "args": {"function_name": "f' || CAST(finding_id AS STRING) || '"}, "thought": "look"}' ELSE '{"action": "final", "vulnerability_found": true, "confidence": 0.5}' END"""


@query("""SELECT DISTINCT finding_id, finding_id % 3 <> 0 AS is_final, CASE WHEN finding_id % 3 = 0 THEN 'get_source' END AS tool, CASE WHEN finding_id % 3 = 0 THEN '{"function_name":"f' || CAST(finding_id AS VARCHAR) || '"}' END AS args,
CASE WHEN finding_id % 3 = 0 THEN 'look' END AS thought, CASE WHEN finding_id % 3 <> 0 THEN true END AS vulnerability_found, CASE WHEN finding_id % 3 <> 0 THEN 0.5::DOUBLE END AS confidence FROM findings""")
def agent_steps(spark, d):
    """A5: steps made of the findings, every third a call of a tool."""
    f = load(spark, d, "findings").select("finding_id").distinct().select("finding_id", F.expr(_STEP).alias("raw"))
    return analysis.agent_steps(f).select("finding_id", "is_final", "tool", "args", "thought", "vulnerability_found", "confidence")


@query(f"""WITH {t.FIND}, l AS (SELECT run_id, id, arg_max(coalesce(vulnerability_found, false), finding_ord) AS bad FROM find GROUP BY run_id, id)
SELECT run_id, count(*) AS remembered, count(*) FILTER (WHERE bad) AS vulnerable FROM l GROUP BY run_id""")
def memory_stats(spark, d):
    """A15."""
    return analysis.memory_stats(t.findings(spark, d).withColumnRenamed("finding_ord", "ord"))


_ARGS = "'{\"n\":' || CAST(finding_id AS STRING) || '}'"


@query(f"""WITH {t.FIND} SELECT id AS node_id, string_agg('  step ' || CAST(finding_id AS VARCHAR) || ': get_source({{"n":' || CAST(finding_id AS VARCHAR) || '}})', chr(10) ORDER BY finding_id) AS summary FROM find GROUP BY id""")
def trace_text(spark, d):
    """A step of each finding, rendered by node."""
    f = t.findings(spark, d)
    return analysis.trace_text(f.select(F.col("id").alias("node_id"), F.col("finding_id").alias("step"), F.lit("get_source").alias("tool"), F.expr(_ARGS).alias("args")))


@query(f"""WITH {t.EDGES}, {t.FIND}, nb AS (SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY side, neighbour) - 1 AS pos FROM (
  SELECT dst AS id, src AS neighbour, 0 AS side FROM edges WHERE dst NOT LIKE 'external::%' UNION ALL SELECT src, dst, 1 FROM edges WHERE dst NOT LIKE 'external::%')),
l AS (SELECT me.run_id, me.id, me.finding_ord AS ord, nb.pos, arg_max('  ' || coalesce(b.function_name, '') || ': ' || CASE WHEN coalesce(b.vulnerability_found, false) THEN 'VULNERABLE (' || coalesce(b.cwe_id, 'None') || ', ' || coalesce(b.severity, 'None') || ')' ELSE 'clean' END
  || ' — ' || substr(coalesce(b.explanation, ''), 1, 120), b.finding_ord) AS line FROM find me JOIN nb ON nb.id = me.id JOIN find b ON b.run_id = me.run_id AND b.id = nb.neighbour AND b.finding_ord < me.finding_ord GROUP BY ALL)
SELECT run_id, id, ord, 'Prior findings for related functions:' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS context FROM l GROUP BY run_id, id, ord""")
def memory_context(spark, d):
    """A13, A14, J13."""
    a = graph_build.adjacency(t.graph(spark, d), t.edges(spark, d))
    inner = lambda c: F.filter(c, lambda x: ~x.startswith("external::"))
    nb = a.select("id", F.posexplode(F.concat(inner("callers"), inner("callees"))).alias("pos", "neighbour"))
    f = t.findings(spark, d).withColumnRenamed("finding_ord", "ord")
    return analysis.memory_context(f, nb)


@query(f"WITH {t.FIND} SELECT run_id, finding_id FROM find WHERE NOT coalesce(vulnerability_found, false) AND coalesce(confidence, 0) < 0.1 AND coalesce(error, '') = ''")
def empty_output(spark, d):
    """A12 on verdicts whose confidence and explanation are taken away."""
    f = t.findings(spark, d).where("coalesce(confidence, 0) < 0.1").withColumn("confidence", F.lit(0.0)).withColumn("explanation", F.lit(""))
    return f.where(analysis.is_empty_output()).select("run_id", "finding_id")


@query(f"WITH {t.FIND} SELECT f.run_id, f.finding_id, c.cwe_id, c.severity AS rule_severity, c.mode AS rule_mode FROM find f JOIN cwe_rules c ON upper(trim(f.cwe_id)) = c.cwe_id")
def cwe_dim_join(spark, d):
    """Findings with the severity the table of rules gives."""
    rules = load(spark, d, "cwe_rules").select("cwe_id", F.col("severity").alias("rule_severity"), F.col("mode").alias("rule_mode"))
    return t.findings(spark, d).select("run_id", "finding_id", T.normalize_cwe("cwe_id").alias("cwe_id")).join(rules, "cwe_id")


# -- results -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {t.FIND} SELECT run_id, count(*) AS total, count(*) FILTER (WHERE vulnerability_found) AS found, count(*) FILTER (WHERE error <> '') AS errors, count(*) FILTER (WHERE hallucination_flag) AS hallucinated,
count(*) - count(*) FILTER (WHERE vulnerability_found) - count(*) FILTER (WHERE error <> '') AS clean FROM find GROUP BY run_id""")
def run_summary(spark, d):
    """R1."""
    return results.run_summary(t.findings(spark, d))


@query(f"""WITH {t.FIND}, {t.FN}, s AS (SELECT function_name, file_path, arg_max(start_line, fn_ord) AS s, arg_max(end_line, fn_ord) AS e FROM fn WHERE file_path <> '' GROUP BY ALL),
j AS (SELECT run_id, finding_id, coalesce(affected_lines, []) AS a, s, e FROM find LEFT JOIN s ON s.function_name = find.function_name AND s.file_path = find.file_path),
k AS (SELECT *, list_filter(a, lambda x: x >= s AND x <= e) AS i, list_filter(list_transform(a, lambda x: x + s - 1), lambda x: x >= s AND x <= e) AS h FROM j)
SELECT run_id, finding_id, array_to_string(CASE WHEN coalesce(s, 0) = 0 OR coalesce(e, 0) = 0 OR len(a) = 0 THEN a WHEN len(i) > 0 THEN i WHEN len(h) > 0 THEN h ELSE a END, ',') AS affected_lines FROM k""")
def clamp_lines(spark, d):
    """R2, R3, J14."""
    return _joined(results.with_clamped_lines(t.findings(spark, d), t.functions(spark, d)).select("run_id", "finding_id", "affected_lines"), "affected_lines")


@query(f"""WITH {t.FIND}, e AS (SELECT run_id, function_name, cwe_id, min(finding_ord) AS first, count(*) AS members FROM find WHERE vulnerability_found AND cwe_id <> '' AND function_name <> '' GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY first) - 1 AS no FROM e)
SELECT f.run_id, f.finding_id, CASE WHEN f.vulnerability_found AND r.members > 1 THEN r.no END AS duplicate_group FROM find f LEFT JOIN r ON r.run_id = f.run_id AND r.function_name = f.function_name AND r.cwe_id = f.cwe_id""")
def duplicate_groups(spark, d):
    """R4, F15."""
    return results.duplicate_groups(t.findings(spark, d)).select("run_id", "finding_id", "duplicate_group")


@query(f"""WITH {t.GRAPH}, {t.FIND}, b AS (SELECT id, arg_max(coalesce(nullif(severity, ''), 'low'), finding_ord) AS severity FROM find WHERE vulnerability_found GROUP BY id)
SELECT g.id, b.severity, CASE WHEN b.severity IS NOT NULL THEN 'vulnerable_' || lower(b.severity) WHEN is_taint_sink THEN 'taint_sink' WHEN is_taint_source THEN 'taint_source' WHEN is_entry_point THEN 'entry_point' WHEN is_infrastructure THEN 'infrastructure' ELSE 'default' END AS role FROM g LEFT JOIN b ON b.id = g.id""")
def overlay_roles(spark, d):
    """Findings of all runs."""
    return results.overlay(t.graph(spark, d), t.findings(spark, d), "finding_ord").select("id", "severity", "role")


@query(f"""WITH {t.FIND}, {t.FNC}, s AS (SELECT function_name, file_path, arg_max(struct_pack(c := code, s := start_line), fn_ord) AS x FROM fnc GROUP BY ALL)
SELECT run_id, finding_id, x.s AS start_line, md5(x.c) AS code_md5, CASE WHEN x IS NULL THEN 'source_not_found' END AS error FROM find LEFT JOIN s ON s.function_name = find.function_name AND s.file_path = find.file_path WHERE vulnerability_found""")
def patch_join(spark, d):
    """P1, P2, P8, J17."""
    return patching.patch_input(t.findings(spark, d), t.functions(spark, d, "code")).select("run_id", "finding_id", "start_line", F.md5("code").alias("code_md5"), "error")


@query()
def patch_validate(spark, d):
    """Every proposal applied to the function it was made for (no SQL; tested on fixtures)."""
    fn = t.functions(spark, d, "code").groupBy("function_name", "file_path").agg(F.max_by(F.struct("code", "language"), "fn_ord").alias("f")).select("function_name", "file_path", "f.*")
    p = t.patches(spark, d).select("patch_id", "function_name", "file_path", "unified_diff").join(fn, ["function_name", "file_path"], "left")
    return patching.validated(p).select("patch_id", "valid", "error", F.md5("patched_code").alias("patched_md5"))


@query("""SELECT run_id, count(*) AS total, count(*) FILTER (WHERE patch_valid) AS valid, count(*) FILTER (WHERE NOT coalesce(patch_valid, false)) AS invalid FROM (SELECT DISTINCT run_id, patch_id, patch_valid FROM patches) GROUP BY run_id""")
def patch_summary(spark, d):
    """R9."""
    return results.patch_summary(t.patches(spark, d))


# -- evaluation --------------------------------------------------------------------------------------------------------


def _truth(spark, d):
    return t.truth(spark, d), t.findings(spark, d)


def _verdicts(spark, d):
    return evaluation.verdicts(*_truth(spark, d))


@query(f"WITH {t.MATCH} SELECT run_id, gt_ord, finding_ord, ambiguous FROM m")
def eval_match(spark, d):
    """E1-E3, J18."""
    return evaluation.match(*_truth(spark, d)).drop("candidates")


@query(f"WITH {t.VERDICTS} SELECT run_id, gt_ord, instance_id, vuln_id, vulnerable, gt_cwe, analysed, outcome, got_cwe, cwe_correct, hallucinated FROM v")
def eval_verdicts(spark, d):
    """E4, E5, J20."""
    return _verdicts(spark, d)


@query(f"WITH {t.MATCH} SELECT run_id, gt_ord, function_name, file, paths AS candidates FROM m JOIN truth USING (gt_ord) WHERE ambiguous")
def eval_unresolved(spark, d):
    """E6."""
    return _joined(evaluation.unresolved(*_truth(spark, d)), "candidates", by=" | ")


@query(f"WITH {t.FIND}, {t.TRUTH} SELECT run_id, finding_id, function_name FROM find WHERE NOT EXISTS (SELECT 1 FROM truth WHERE truth.dataset = find.dataset AND truth.function_name = find.function_name)")
def eval_unmatched(spark, d):
    """E7, J19."""
    return evaluation.unmatched(*_truth(spark, d)).select("run_id", "finding_id", "function_name")


_METRICS = """SELECT run_id, tp, fp, fn, tn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM (
SELECT run_id, count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn, count(*) FILTER (WHERE outcome = 'TN') AS tn FROM v GROUP BY run_id))"""
_ACCURACY = "SELECT run_id, count(*) FILTER (WHERE cwe_correct) AS correct, count(cwe_correct) AS judged, CASE WHEN count(cwe_correct) > 0 THEN count(*) FILTER (WHERE cwe_correct) / count(cwe_correct) ELSE 0.0 END AS cwe_accuracy FROM v GROUP BY run_id"
_HALLUCINATION = """SELECT run_id, count(*) FILTER (WHERE outcome IN ('TP', 'FP') AND hallucinated) AS hallucinated, count(*) FILTER (WHERE outcome IN ('TP', 'FP')) AS flagged,
CASE WHEN count(*) FILTER (WHERE outcome IN ('TP', 'FP')) > 0 THEN count(*) FILTER (WHERE outcome IN ('TP', 'FP') AND hallucinated) / count(*) FILTER (WHERE outcome IN ('TP', 'FP')) ELSE 0.0 END AS hallucination_rate FROM v GROUP BY run_id"""
_RECALL = "SELECT run_id, count(*) AS planted, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE detected) / count(*) AS unique_recall FROM grp WHERE planted GROUP BY run_id"
_MODES = "SELECT run_id, nullif(string_agg(DISTINCT nullif(analysis_mode, ''), '/' ORDER BY nullif(analysis_mode, '')), '') AS analysis_mode FROM find GROUP BY run_id"


@query(f"WITH {t.VERDICTS} {_METRICS}")
def eval_metrics(spark, d):
    """E9, E10."""
    return evaluation.metrics(_verdicts(spark, d))


@query(f"WITH {t.VERDICTS} {_ACCURACY}")
def eval_cwe_accuracy(spark, d):
    """E11."""
    return evaluation.cwe_accuracy(_verdicts(spark, d))


@query(f"WITH {t.VERDICTS} {_HALLUCINATION}")
def eval_hallucination(spark, d):
    """E15."""
    return evaluation.hallucination_rate(_verdicts(spark, d))


@query(f"WITH {t.GROUPS} {_RECALL}")
def eval_unique_recall(spark, d):
    """E12, E13."""
    return evaluation.unique_recall(_verdicts(spark, d))


@query(f"WITH {t.GROUPS} SELECT run_id, cwe, count(*) AS planted, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE correct) AS correct FROM grp WHERE planted GROUP BY run_id, cwe")
def eval_cwe_breakdown(spark, d):
    """E14."""
    return evaluation.cwe_breakdown(_verdicts(spark, d))


@query(f"WITH {t.FIND} {_MODES}")
def eval_mode(spark, d):
    """E8."""
    return evaluation.run_modes(t.findings(spark, d))


@query(f"""WITH {t.GROUPS}, me AS ({_METRICS}), ac AS ({_ACCURACY}), ha AS ({_HALLUCINATION}), re AS ({_RECALL}), mo AS ({_MODES})
SELECT me.*, ac.cwe_accuracy, ha.hallucination_rate, re.unique_recall, mo.analysis_mode FROM me LEFT JOIN ac USING (run_id) LEFT JOIN ha USING (run_id) LEFT JOIN re USING (run_id) LEFT JOIN mo USING (run_id)""")
def eval_compare(spark, d):
    """E16, E17, K11."""
    return evaluation.compare(*_truth(spark, d))


_ONE_SET = t.MATCH.replace("t.dataset = f.dataset AND ", "")


@query(f"WITH {_ONE_SET} SELECT got.run_id, got.gt_ord, truth.function_name, truth.file, got.paths AS candidates FROM got JOIN truth USING (gt_ord) WHERE got.finding_ord IS NULL AND got.n > 1")
def eval_unresolved_all(spark, d):
    """E6 where all labels and findings are of one dataset, so that names recur."""
    truth, findings = (x.withColumn("dataset", F.lit("all")) for x in _truth(spark, d))
    return _joined(evaluation.unresolved(truth, findings), "candidates", by=" | ")


_EMPTY = "(SELECT DISTINCT run_id, dataset FROM find UNION SELECT 'empty ' || dataset, dataset FROM evaluation_entries)"


def _empty_runs(truth):
    return truth.select(F.concat(F.lit("empty "), "dataset").alias("run_id"), "dataset").distinct()


@query(f"""WITH {t.GROUPS.replace("(SELECT DISTINCT run_id, dataset FROM find)", _EMPTY)}, me AS ({_METRICS}), ac AS ({_ACCURACY}), ha AS ({_HALLUCINATION}), re AS ({_RECALL}), mo AS ({_MODES})
SELECT me.*, ac.cwe_accuracy, ha.hallucination_rate, re.unique_recall, mo.analysis_mode FROM me LEFT JOIN ac USING (run_id) LEFT JOIN ha USING (run_id) LEFT JOIN re USING (run_id) LEFT JOIN mo USING (run_id)""")
def eval_compare_empty(spark, d):
    """The runs beside one without findings for each dataset."""
    truth, findings = _truth(spark, d)
    return evaluation.compare(truth, findings, _empty_runs(truth))


# -- sinks -------------------------------------------------------------------------------------------------------------


@query(rf"""WITH {t.EDGES}, {t.FIND}, b AS (SELECT id, arg_max(coalesce(nullif(severity, ''), 'low'), finding_ord) AS severity FROM find WHERE vulnerability_found GROUP BY id),
c AS (SELECT g.*, CASE lower(b.severity) WHEN 'critical' THEN 'red' WHEN 'high' THEN 'orangered' WHEN 'medium' THEN 'orange' WHEN 'low' THEN 'gold' END AS vc, b.severity FROM g LEFT JOIN b ON b.id = g.id WHERE NOT is_external)
SELECT 1 AS part, id, '  "' || replace(replace(id, '\', '\\'), '"', '\"') || '" [label="' || replace(replace(function_name || ' (' || string_split(file_path, '/')[-1] || ')', '\', '\\'), '"', '\"') || '", fillcolor='
 || CASE WHEN severity IS NOT NULL THEN coalesce(vc, 'white') WHEN is_taint_sink THEN 'lightcoral' WHEN is_taint_source THEN 'lightgreen' WHEN is_entry_point THEN 'lightblue' WHEN is_infrastructure THEN 'khaki' ELSE 'white' END || '];' AS line FROM c
UNION ALL SELECT 2, src || ' ' || dst, '  "' || replace(replace(src, '\', '\\'), '"', '\"') || '" -> "' || replace(replace(dst, '\', '\\'), '"', '\"') || '";' FROM edges WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)""")
def dot_lines(spark, d):
    """K6, J16."""
    return sinks.dot_lines(results.overlay(t.graph(spark, d), t.findings(spark, d), "finding_ord"), t.edges(spark, d))


@query(f"""WITH {t.EDGES} SELECT src, dst FROM edges WHERE src IN (SELECT id FROM g WHERE NOT is_external) AND dst IN (SELECT id FROM g WHERE NOT is_external)""")
def html_edges(spark, d):
    """K7."""
    return sinks.html_view(results.overlay(t.graph(spark, d), t.findings(spark, d), "finding_ord"), t.edges(spark, d))[1]


@query(f"""WITH {t.FIND} SELECT run_id, finding_ord, 'VULN  ' || upper(coalesce(severity, '?')) || ' ' || coalesce(cwe_id, '?') || '  ' || coalesce(function_name, '?') || ' (' || coalesce(file_path, '?') || ') ' || substr(coalesce(explanation, ''), 1, 120) AS line FROM find WHERE vulnerability_found""")
def run_report(spark, d):
    """K10, R6, F10."""
    f = t.findings(spark, d)
    return sinks.run_report(f, only_vulnerable=True).join(f.select("finding_ord", "run_id"), "finding_ord").select("run_id", "finding_ord", "line")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Windowed counts, as the stream keeps them."""
    from codeweft.streaming.ingest import event_counts

    return event_counts(load(spark, d, "events"))


def flagship(spark, d) -> DataFrame:
    """(kind, name, n): the call graph's counts and its ten widest fan-outs."""
    top = t.edges(spark, d).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    s = graph_query.summary(t.graph(spark, d))
    counts = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in s.columns])).alias("x")).select("x.*")
    return counts.select(F.lit("count").alias("kind"), "name", "n").unionByName(top.select(F.lit("fan-out").alias("kind"), "name", "n"))
