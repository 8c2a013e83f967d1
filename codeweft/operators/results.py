"""After an analysis: summaries, line ranges, duplicates, overlays, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.core import numbered
from codeweft.functions.text import missing, node_id

# Colours of severities and roles in graph exports, fixed values.
SEVERITY_COLOURS = {"critical": "#CC0000", "high": "#FF4444", "medium": "#FF9900", "low": "#FFCC00"}
SEVERITY_COLOURS_DOT = {"critical": "red", "high": "orangered", "medium": "orange", "low": "gold"}
ROLE_COLOURS = {
    "vulnerable_critical": "#CC0000", "vulnerable_high": "#FF4444", "vulnerable_medium": "#FF9900", "vulnerable_low": "#FFCC00", "taint_sink": "#FF6666",
    "taint_source": "#44BB99", "entry_point": "#6699CC", "infrastructure": "#FFCC44", "default": "#D2D2D2",
}


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def run_summary(findings: DataFrame) -> DataFrame:
    """(run_id, total, found, errors, hallucinated, clean) of each run; clean is total less found less errors."""
    has_error = missing("error").isNotNull()
    g = findings.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(_yes("vulnerability_found")).alias("found"), F.count_if(has_error).alias("errors"), F.count_if(_yes("hallucination_flag")).alias("hallucinated"))
    return g.withColumn("clean", F.col("total") - F.col("found") - F.col("errors"))


def language_counts(functions: DataFrame) -> DataFrame:
    return functions.groupBy("language").agg(F.count("*").alias("n"))


def clamp_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines within start..end; if none is, the lines shifted by start - 1 that are; if none, the lines as they are."""
    lines = F.coalesce(lines, F.expr("cast(array() as array<int>)"))
    known = start.isNotNull() & end.isNotNull() & (start != 0) & (end != 0)
    inside = F.filter(lines, lambda x: (x >= start) & (x <= end))
    shifted = F.filter(F.transform(lines, lambda x: x + start - 1), lambda x: (x >= start) & (x <= end))
    return F.when(~known | (F.size(lines) == 0), lines).when(F.size(inside) > 0, inside).when(F.size(shifted) > 0, shifted).otherwise(lines)


def with_clamped_lines(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """Findings whose affected_lines lie in the function's range; of several functions of a name and path, the last."""
    span = functions.where(missing("function_name").isNotNull() & missing("file_path").isNotNull()).groupBy("function_name", "file_path").agg(F.max_by(F.struct("start_line", "end_line"), "fn_ord").alias("s"))
    j = findings.join(span, ["function_name", "file_path"], "left")
    return j.withColumn("affected_lines", clamp_lines(F.col("affected_lines"), F.col("s.start_line"), F.col("s.end_line"))).drop("s")


def duplicate_groups(findings: DataFrame, run: str = "run_id", order: str = "finding_id") -> DataFrame:
    """Findings with `duplicate_group`: for vulnerable rows of the same name and CWE in a run, the group's number by first appearance from 0.

    Only groups of two or more have a number, so numbers may have gaps; other rows have null. Groups are aggregated first,
    so that neither a hot group nor a hot run is held by one task.
    """
    eligible = _yes("vulnerability_found") & missing("cwe_id").isNotNull() & missing("function_name").isNotNull()
    key = [run, "function_name", "cwe_id"]
    g = findings.where(eligible).groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("members"))
    ranked = numbered(g, ["first"], "no", within=run).where("members > 1").select(*key, "no")
    return findings.join(ranked, key, "left").withColumn("duplicate_group", F.when(eligible, F.col("no"))).drop("no")


def overlay(nodes: DataFrame, findings: DataFrame, order: str = "finding_id") -> DataFrame:
    """Nodes with severity of their last vulnerable finding ('low' if it has none) and their role."""
    bad = findings.where(_yes("vulnerability_found")).withColumn("id", node_id("file_path", F.coalesce("function_name", F.lit("")))).groupBy("id").agg(F.max_by(F.coalesce(missing("severity"), F.lit("low")), order).alias("severity"))
    j = nodes.join(bad, "id", "left")
    role = (
        F.when(F.col("severity").isNotNull(), F.concat(F.lit("vulnerable_"), F.lower("severity"))).when(_yes("is_taint_sink"), "taint_sink").when(_yes("is_taint_source"), "taint_source")
        .when(_yes("is_entry_point"), "entry_point").when(_yes("is_infrastructure"), "infrastructure").otherwise("default")
    )
    return j.withColumn("role", role)


def patch_summary(patches: DataFrame) -> DataFrame:
    return patches.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(_yes("patch_valid")).alias("valid"), F.count_if(~_yes("patch_valid")).alias("invalid"))
