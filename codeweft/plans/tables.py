"""The driver's tables as the code model, in Spark and as SQL common table expressions.

Repeated rows (same key and content, later time) count once; links need a row on both sides or an external callee.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.core import first_of, load
from codeweft.functions.text import missing, node_id
from codeweft.operators import evaluation

CALL = r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\("


def functions(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(fn_ord, repo, file_path, function_name, language, start_line, end_line, id, ...)."""
    t = load(spark, d, "code_samples").where(missing("function_name").isNotNull())
    if more:  # texts stay where they are
        t = first_of(t, "sample_id", "ingested_at")
    rows = t.select(
        F.col("sample_id").alias("fn_ord"), "repo", "file_path", "function_name", F.lower(F.trim("language")).alias("language"), "start_line", "end_line", node_id("file_path", "function_name").alias("id"), *more
    )
    return rows if more else rows.distinct()


def contents(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, content) of every row with a file; a file's rows carry the same content, so what is taken from it is made distinct after."""
    return load(spark, d, "code_samples").where("raw_content is not null").select("file_path", F.col("raw_content").alias("content"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, content) of files."""
    return load(spark, d, "code_samples").where("raw_content is not null").groupBy("file_path").agg(F.min("raw_content").alias("content"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(src, pos, raw_call) by a plain pattern over the code (SQL can follow it; the parser's calls are `extract_functions`)."""
    t = load(spark, d, "code_samples").where(missing("function_name").isNotNull()).where("code is not null")
    found = t.select("sample_id", node_id("file_path", "function_name").alias("src"), F.regexp_extract_all("code", F.lit(CALL), F.lit(1)).alias("calls"))
    # of repeated rows, what they call; an outer explode, or the planner would run the pattern once more to drop empty lists first
    return found.distinct().select("src", F.posexplode_outer("calls").alias("pos", "raw_call")).where("raw_call is not null")


def file_imports(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "code_samples").select("file_path", "imports").where("file_path is not null and imports is not null").groupBy("file_path").agg(F.min(F.to_json("imports")).alias("j"))
    return t.select("file_path", F.posexplode(F.from_json("j", "array<struct<alias:string,source:string>>")).alias("pos", "i")).select("file_path", "pos", "i.alias", "i.source")


def file_routes(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "code_samples").select("file_path", F.explode("routes").alias("r"))
    return t.select("file_path", "r.method", "r.path", "r.handlers").distinct()


def graph(spark: SparkSession, d: str) -> DataFrame:
    """Distinct nodes with their flags and no time; null flags are false, null lists empty."""
    g = load(spark, d, "call_graph_nodes").where("id is not null").drop("exported_at").distinct()
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    empty = F.expr("cast(array() as array<string>)")
    return g.select("id", "function_name", "file_path", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"), *[no(c) for c in ("is_entry_point", "is_infrastructure", "is_external", "is_taint_source", "is_taint_sink")])


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): noted on either side; src a node, dst a node or external."""
    g = graph(spark, d)
    both = g.select(F.col("id").alias("src"), F.explode("callees").alias("dst")).unionByName(g.select(F.explode("callers").alias("src"), F.col("id").alias("dst"))).where("src <> dst").distinct()
    ids = g.select("id")
    known = both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    inside = known.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.unionByName(known.where(F.col("dst").startswith("external::")).select("dst", "src")).select("src", "dst")


def findings(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "findings").drop("created_at").distinct()
    return evaluation.with_dataset(f.withColumn("finding_ord", F.col("finding_id")).withColumn("id", node_id("file_path", F.coalesce("function_name", F.lit("")))))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "evaluation_entries").withColumnRenamed("entry_id", "gt_ord").distinct()


def patches(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "patches").drop("created_at").distinct()


FN = """fn AS (SELECT DISTINCT sample_id AS fn_ord, repo, file_path, function_name, lower(trim(language)) AS language, start_line, end_line,
  coalesce(file_path, '') || '::' || function_name AS id FROM code_samples WHERE function_name <> '')"""
FNC = """fnc AS (SELECT DISTINCT sample_id AS fn_ord, file_path, function_name, lower(trim(language)) AS language, start_line, end_line,
  coalesce(file_path, '') || '::' || function_name AS id, code FROM code_samples WHERE function_name <> '')"""
CALLS = FNC + rf""", calls AS (SELECT DISTINCT id AS src, unnest(regexp_extract_all(code, '{CALL}', 1)) AS raw_call FROM fnc WHERE code IS NOT NULL)"""
FILES = "files AS (SELECT file_path, min(raw_content) AS content FROM code_samples WHERE raw_content IS NOT NULL GROUP BY file_path)"
NODES = FN + """, nodes AS (SELECT id, min(fn_ord) AS fn_ord, min(file_path) AS file_path, min(function_name) AS function_name FROM fn GROUP BY id)"""
GRAPH = """g AS (SELECT DISTINCT id, function_name, file_path, coalesce(callers, []) AS callers, coalesce(callees, []) AS callees,
  coalesce(is_entry_point, false) AS is_entry_point, coalesce(is_infrastructure, false) AS is_infrastructure, coalesce(is_external, false) AS is_external,
  coalesce(is_taint_source, false) AS is_taint_source, coalesce(is_taint_sink, false) AS is_taint_sink FROM call_graph_nodes WHERE id IS NOT NULL)"""
EDGES = GRAPH + """, edges AS (SELECT DISTINCT src, dst FROM (SELECT id AS src, unnest(callees) AS dst FROM g UNION ALL SELECT unnest(callers) AS src, id AS dst FROM g)
  WHERE src <> dst AND src IN (SELECT id FROM g) AND (dst IN (SELECT id FROM g) OR dst LIKE 'external::%'))"""
FIND = r"""find AS (SELECT DISTINCT finding_id AS finding_ord, finding_id, run_id, function_name, file_path, language, vulnerability_found, cwe_id, affected_lines, severity, explanation,
  confidence, hallucination_flag, analysis_mode, error, coalesce(file_path, '') || '::' || coalesce(function_name, '') AS id,
  ltrim(lower(replace(coalesce(file_path, ''), '\', '/')), '/') AS have,
  regexp_extract(ltrim(lower(replace(coalesce(file_path, ''), '\', '/')), '/'), '(?:^|/)datasets/([^/]+)', 1) AS dataset FROM findings)"""
TRUTH = r"""truth AS (SELECT DISTINCT entry_id AS gt_ord, dataset, function_name, file, coalesce(vulnerable, false) AS vulnerable, nullif(cwe_id, '') AS gt_cwe,
  ltrim(lower(replace(coalesce(file, ''), '\', '/')), '/') AS want, coalesce(file, '') || '::' || coalesce(function_name, '') AS instance_id,
  coalesce(nullif(duplicate_of, ''), coalesce(file, '') || '::' || coalesce(function_name, '')) AS vuln_id FROM evaluation_entries)"""
MATCH = FIND + ", " + TRUTH + """, j AS (SELECT t.gt_ord, f.run_id, f.finding_ord, f.file_path, ends_with(f.have, t.want) AS fits FROM truth t JOIN find f
    ON t.dataset = f.dataset AND t.function_name = f.function_name WHERE f.function_name <> ''),
  got AS (SELECT run_id, gt_ord, min(finding_ord) FILTER (WHERE fits) AS finding_ord, count(*) AS n, string_agg(coalesce(file_path, ''), ' | ' ORDER BY finding_ord) AS paths FROM j GROUP BY ALL),
  m AS (SELECT r.run_id, t.gt_ord, got.finding_ord, got.finding_ord IS NULL AND coalesce(got.n, 0) > 1 AS ambiguous, got.paths
    FROM truth t JOIN (SELECT DISTINCT run_id, dataset FROM find) r ON t.dataset = r.dataset LEFT JOIN got ON got.run_id = r.run_id AND got.gt_ord = t.gt_ord)"""
VERDICTS = MATCH + """, v AS (SELECT m.run_id, m.gt_ord, t.instance_id, t.vuln_id, t.vulnerable, t.gt_cwe, m.finding_ord IS NOT NULL AS analysed,
    CASE WHEN t.vulnerable AND coalesce(f.vulnerability_found, false) THEN 'TP' WHEN t.vulnerable THEN 'FN' WHEN coalesce(f.vulnerability_found, false) THEN 'FP' ELSE 'TN' END AS outcome,
    nullif(f.cwe_id, '') AS got_cwe, coalesce(f.hallucination_flag, false) AS hallucinated,
    CASE WHEN t.vulnerable AND coalesce(f.vulnerability_found, false) AND t.gt_cwe IS NOT NULL THEN coalesce(nullif(f.cwe_id, '') = t.gt_cwe, false) END AS cwe_correct
  FROM m JOIN truth t ON m.gt_ord = t.gt_ord LEFT JOIN find f ON f.run_id = m.run_id AND f.finding_ord = m.finding_ord WHERE NOT m.ambiguous)"""
GROUPS = VERDICTS + """, grp AS (SELECT run_id, vuln_id, bool_or(vulnerable) AS planted, bool_or(outcome = 'TP') AS detected, bool_or(coalesce(cwe_correct, false)) AS correct,
    coalesce(arg_min(gt_cwe, gt_ord) FILTER (WHERE instance_id = vuln_id AND gt_cwe IS NOT NULL), arg_min(gt_cwe, gt_ord) FILTER (WHERE gt_cwe IS NOT NULL), 'UNKNOWN') AS cwe FROM v GROUP BY run_id, vuln_id)"""
