"""Runs against ground truth.

truth(gt_ord, dataset, function_name, file, vulnerable, cwe_id, severity, affected_lines, notes, duplicate_of),
findings(run_id, finding_ord, function_name, file_path, ...). Every result is by run. Empty text counts as missing.
A run is held against the labels of the datasets it covers: `dataset` of a finding is the folder after `datasets` in its
path (with_dataset), or what the caller sets. A run that found nothing has no such row: `runs` (run_id, dataset) adds what
runs cover besides, and every label of theirs counts as missed or rightly left alone. Matching joins on dataset and function name; the path's ending is checked on
the joined rows, so there is no cross join of runs and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.core import cut
from codeweft.functions.text import missing, norm_path

_KEYS = ["run_id", "gt_ord"]


def instance_id() -> Column:
    return F.concat(F.coalesce("file", F.lit("")), F.lit("::"), F.coalesce("function_name", F.lit("")))


def with_dataset(findings: DataFrame) -> DataFrame:
    """Findings with `dataset` from their path; empty where the path names none."""
    return findings.withColumn("dataset", F.regexp_extract(norm_path(F.coalesce("file_path", F.lit(""))), "(?:^|/)datasets/([^/]+)", 1))


def _candidates(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, gt_ord, finding_ord, n, paths) of labels whose name a run's findings of the dataset bear."""
    t = truth.select("gt_ord", "dataset", "function_name", norm_path(F.coalesce("file", F.lit(""))).alias("want"))
    f = findings.where(missing("function_name").isNotNull()).select("run_id", "dataset", "finding_ord", "function_name", "file_path", norm_path(F.coalesce("file_path", F.lit(""))).alias("have"))
    j = t.join(f, ["dataset", "function_name"])
    fits = F.col("have").endswith(F.col("want"))
    return j.groupBy("run_id", "gt_ord").agg(F.min(F.when(fits, F.col("finding_ord"))).alias("finding_ord"), F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("finding_ord", "file_path"))), lambda x: x["file_path"]).alias("paths"))


def match(truth: DataFrame, findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, gt_ord, finding_ord, ambiguous, candidates) for every run and label of its datasets.

    Of the run's findings of that dataset and name, the first whose path ends with the labelled file; if there are several
    of the name and none fits, the row is ambiguous, with their paths in order.
    """
    covered = findings.select("run_id", "dataset")
    if runs is not None:
        covered = covered.unionByName(runs.select("run_id", "dataset"))
    got = _candidates(truth, findings)
    out = truth.select("gt_ord", "dataset").join(covered.distinct(), "dataset").drop("dataset").join(got, _KEYS, "left")
    ambiguous = F.col("finding_ord").isNull() & (F.coalesce("n", F.lit(0)) > 1)
    return out.select("run_id", "gt_ord", "finding_ord", ambiguous.alias("ambiguous"), F.when(ambiguous, F.col("paths")).alias("candidates"))


def verdicts(truth: DataFrame, findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row for each run and labelled function that is not ambiguous, with its outcome and whether the CWE is right."""
    m = match(truth, findings, runs).where("not ambiguous").drop("ambiguous", "candidates")
    t = truth.select("gt_ord", instance_id().alias("instance_id"), F.coalesce(missing("duplicate_of"), instance_id()).alias("vuln_id"), F.coalesce("vulnerable", F.lit(False)).alias("vulnerable"), missing("cwe_id").alias("gt_cwe"))
    f = findings.select("run_id", "finding_ord", F.coalesce("vulnerability_found", F.lit(False)).alias("flagged"), missing("cwe_id").alias("got_cwe"), "confidence", F.coalesce("hallucination_flag", F.lit(False)).alias("hallucinated"))
    j = m.join(t, "gt_ord").join(f, ["run_id", "finding_ord"], "left")
    flagged = F.coalesce("flagged", F.lit(False))
    outcome = F.when(F.col("vulnerable") & flagged, "TP").when(F.col("vulnerable"), "FN").when(flagged, "FP").otherwise("TN")
    out = j.withColumn("outcome", outcome).withColumn("analysed", F.col("finding_ord").isNotNull())
    right = F.when((F.col("outcome") == "TP") & F.col("gt_cwe").isNotNull(), F.coalesce(F.col("got_cwe") == F.col("gt_cwe"), F.lit(False)))
    return out.select("run_id", "gt_ord", "instance_id", "vuln_id", "vulnerable", "gt_cwe", "analysed", "outcome", F.when(F.col("analysed"), F.col("got_cwe")).alias("got_cwe"), right.alias("cwe_correct"), F.coalesce("hallucinated", F.lit(False)).alias("hallucinated"))


def unresolved(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, gt_ord, function_name, file, candidates) of ambiguous rows."""
    several = _candidates(truth, findings).where("finding_ord is null and n > 1")
    return several.join(truth.select("gt_ord", "function_name", "file"), "gt_ord").select("run_id", "gt_ord", "function_name", "file", F.col("paths").alias("candidates"))


def unmatched(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings whose name no labelled function of their dataset bears; those without a name are among them."""
    return findings.join(truth.select("dataset", "function_name").where("function_name is not null").distinct(), ["dataset", "function_name"], "left_anti")


def _ratio(a: str | Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double") if isinstance(a, str) else a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(v: DataFrame) -> DataFrame:
    """(run_id, tp, fp, fn, tn, precision, recall, f1); 0 where a denominator is empty."""
    n = v.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == o.upper()).alias(o) for o in ("tp", "fp", "fn", "tn")])
    p, r = _ratio("tp", F.col("tp") + F.col("fp")), _ratio("tp", F.col("tp") + F.col("fn"))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def cwe_accuracy(v: DataFrame) -> DataFrame:
    g = v.groupBy("run_id").agg(F.count_if(F.col("cwe_correct")).alias("correct"), F.count("cwe_correct").alias("judged"))
    return g.withColumn("cwe_accuracy", _ratio("correct", F.col("judged")))


def hallucination_rate(v: DataFrame) -> DataFrame:
    flagged = F.col("outcome").isin("TP", "FP")
    g = v.groupBy("run_id").agg(F.count_if(flagged & F.col("hallucinated")).alias("hallucinated"), F.count_if(flagged).alias("flagged"))
    return g.withColumn("hallucination_rate", _ratio("hallucinated", F.col("flagged")))


def vulnerability_groups(v: DataFrame) -> DataFrame:
    """(run_id, vuln_id, planted, detected, correct, cwe): the CWE of the entry the id names, else of the first that has one, else UNKNOWN."""
    has = F.col("gt_cwe").isNotNull()
    own = F.min_by("gt_cwe", F.when(has & (F.col("instance_id") == F.col("vuln_id")), F.col("gt_ord")))
    return v.groupBy("run_id", "vuln_id").agg(
        F.bool_or("vulnerable").alias("planted"), F.bool_or(F.col("outcome") == "TP").alias("detected"), F.bool_or(F.coalesce("cwe_correct", F.lit(False))).alias("correct"),
        F.coalesce(own, F.min_by("gt_cwe", F.when(has, F.col("gt_ord"))), F.lit("UNKNOWN")).alias("cwe"),
    )


def unique_recall(v: DataFrame) -> DataFrame:
    g = vulnerability_groups(v).where("planted").groupBy("run_id").agg(F.count("*").alias("planted"), F.count_if("detected").alias("detected"))
    return g.withColumn("unique_recall", _ratio("detected", F.col("planted")))


def cwe_breakdown(v: DataFrame) -> DataFrame:
    return vulnerability_groups(v).where("planted").groupBy("run_id", "cwe").agg(F.count("*").alias("planted"), F.count_if("detected").alias("detected"), F.count_if("correct").alias("correct"))


def run_modes(findings: DataFrame) -> DataFrame:
    """(run_id, analysis_mode): the run's distinct modes, sorted and joined by '/', null if there are none."""
    return findings.groupBy("run_id").agg(missing(F.array_join(F.array_sort(F.collect_set(missing("analysis_mode"))), "/")).alias("analysis_mode"))


def compare(truth: DataFrame, findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row a run with all measures; runs without findings are those of `runs`."""
    v = cut(verdicts(truth, findings, runs))
    return metrics(v).join(cwe_accuracy(v).select("run_id", "cwe_accuracy"), "run_id", "left").join(hallucination_rate(v).select("run_id", "hallucination_rate"), "run_id", "left").join(
        unique_recall(v).select("run_id", "unique_recall"), "run_id", "left"
    ).join(run_modes(findings), "run_id", "left")
