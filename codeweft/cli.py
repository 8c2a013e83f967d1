"""Commands: analyze, show, graph, patch, evaluate."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.core import cut, local_session
from codeweft.operators import analysis, evaluation, extraction, graph_build, patching, results
from codeweft.sources import scan, sinks


def extract(spark: SparkSession, path: str | None, snippet: str | None, language: str | None, config: scan.Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions with id and fn_ord, imports, routes)."""
    files = scan.snippet(spark, snippet, language or "") if snippet is not None else scan.scan(spark, path, list(config.skip_dirs))
    fn = extraction.extract_functions(files, config.max_function_lines).join(files.select("file_path", "file_ord"), "file_path")
    fn = fn.withColumn("fn_ord", F.col("file_ord").cast("bigint") * 1_000_000 + F.col("pos")).withColumn("id", F.concat("file_path", F.lit("::"), "function_name"))
    return cut(fn), cut(extraction.imports(files)), cut(extraction.routes(files))


def call_graph(fn: DataFrame, imports: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    calls = fn.select(F.col("id").alias("src"), F.explode("calls").alias("c")).select("src", "c.pos", "c.raw_call")
    graph, edges = graph_build.build(fn, calls, routes, imports)
    return cut(graph), cut(edges)


def _findings(spark: SparkSession, paths: list[str]) -> DataFrame:
    return scan.read_runs(spark, paths)


def run(argv: list[str], spark: SparkSession | None = None, model=None, generator=None, now: str | None = None) -> int:
    """The command line; `model` and `generator` are the pluggable services (none: nothing is called)."""
    p = argparse.ArgumentParser(prog="codeweft")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    for flag in ("--path", "--snippet", "--language", "--config", "--run-name", "--dataset"):
        a.add_argument(flag)
    for flag in ("--dry-run", "--react", "--visualize"):
        a.add_argument(flag, action="store_true")
    s = sub.add_parser("show")
    s.add_argument("result")
    s.add_argument("--vulns-only", action="store_true")
    g = sub.add_parser("graph")
    for flag in ("--path", "--graph-file", "--results", "--config"):
        g.add_argument(flag)
    g.add_argument("--output-dir", default="results")
    g.add_argument("--html", action=argparse.BooleanOptionalAction, default=True)
    g.add_argument("--dot", action="store_true")
    h = sub.add_parser("patch")
    for flag in ("--results", "--path"):
        h.add_argument(flag, required=True)
    h.add_argument("--output-dir", default="results")
    h.add_argument("--config")
    h.add_argument("--apply", action="store_true")
    h.add_argument("--yes", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("--results", nargs="+", required=True)
    e.add_argument("--ground-truth", required=True)
    e.add_argument("--output-dir", default="results")
    o = p.parse_args(argv)
    scan.load_env()
    spark = spark or local_session()
    at = now or datetime.datetime.now().isoformat()
    config = scan.load_config(getattr(o, "config", None))
    stamp = at.replace("-", "").replace(":", "").replace("T", "_")[:15]

    if o.command == "analyze":
        if (o.path is None) == (o.snippet is None):
            p.error("give either --path or --snippet")
        dataset = o.dataset or (sinks.dataset_of(o.path) if o.path else None) or "default"
        folder = Path(config.output_dir) / dataset / (o.run_name or f"run_{stamp}")
        fn, imports, routes = extract(spark, o.path, o.snippet, o.language, config)
        sinks.save_extraction(fn, o.path or "<snippet>", str(folder / "extraction.json"), at)
        graph, edges = call_graph(fn, imports, routes)
        sinks.save_call_graph(graph, str(folder / "call_graph.json"), at)
        for r in results.language_counts(fn).orderBy("language").collect():
            print(f"{r.language}: {r.n} functions")
        nothing = spark.createDataFrame([], "file_path string, function_name string, vulnerability_found boolean, severity string, finding_id bigint")
        if o.visualize:
            sinks.export_html(results.overlay(graph, nothing), edges, str(folder / "call_graph.html"))
        if o.dry_run or model is None:
            print("dry run: no analysis" if o.dry_run else "no model is configured: no analysis")
            return 0
        if o.react:
            nodes = {r.id: r.asDict() for r in graph.toLocalIterator()}  # one project's graph; the agent is sequential
            rows = fn.orderBy("fn_ord").select("id", "function_name", "file_path", "language", "code").toLocalIterator()
            samples = [r.asDict() for r in rows]
            agent = analysis.Agent(model, analysis.GraphTools(nodes, {k: s["code"] for s in samples for k in (s["id"], s["function_name"])}), config.max_steps)
            reports = spark.createDataFrame([agent.run(s) for s in samples], analysis.REPORT)
        else:
            prompted = analysis.prompts(fn, graph.select("id", "callers", "callees")).join(fn.select("id", "function_name", "file_path", "language"), "id")
            reports = analysis.analyze(prompted, model).drop("id")
        reports = reports.join(fn.select("function_name", "file_path", "fn_ord"), ["function_name", "file_path"], "left").withColumn("run_id", F.lit(folder.name)).withColumn("finding_id", F.col("fn_ord"))
        final = cut(results.duplicate_groups(results.with_clamped_lines(cut(reports), fn)))
        summary = results.run_summary(final).drop("run_id").first()
        sinks.save_run(final.orderBy("finding_id").drop("finding_id", "fn_ord", "run_id"), summary.asDict() if summary else {}, folder.name, str(folder / "analysis.json"), at)
        print(summary.asDict() if summary else {})
        if o.visualize:
            sinks.export_html(results.overlay(graph, final), edges, str(folder / "call_graph.html"))
    elif o.command == "show":
        for r in sinks.run_report(_findings(spark, [o.result]), o.vulns_only).orderBy("finding_ord").toLocalIterator():
            print(r.line)
    elif o.command == "graph":
        if o.graph_file:
            graph = scan.read_call_graph(spark, o.graph_file)
            edges = graph.select(F.col("id").alias("src"), F.explode("callees").alias("dst"))
        else:
            graph, edges = call_graph(*extract(spark, o.path, None, None, config))
        found = _findings(spark, [o.results]) if o.results else spark.createDataFrame([], "file_path string, function_name string, vulnerability_found boolean, severity string, finding_ord int")
        shown = cut(results.overlay(graph, found, "finding_ord"))
        Path(o.output_dir).mkdir(parents=True, exist_ok=True)
        if o.html:
            print(sinks.export_html(shown, edges, str(Path(o.output_dir) / "call_graph.html")))
        if o.dot:
            print(sinks.export_dot(shown, edges, str(Path(o.output_dir) / "call_graph.dot")))
    elif o.command == "patch":
        findings = _findings(spark, [o.results])
        fn, _, _ = extract(spark, o.path, None, None, config)
        rows = patching.patch_input(findings, fn)
        if not rows.take(1):
            print("no vulnerable findings")
            return 0
        made = patching.generate(rows, generator)
        checked = cut(patching.validated(made.withColumnRenamed("error", "made_error")))
        out = checked.select("function_name", "file_path", "cwe_id", "severity", "start_line", "end_line", "unified_diff", F.col("valid").alias("patch_valid"), F.coalesce("made_error", "error").alias("patch_error"), "patched_code")
        run_id = findings.select(F.first("run_id", True)).first()[0] or "run"
        print(sinks.save_patches(out, run_id, str(Path(o.output_dir) / f"{run_id}_patches.json"), at))
        if o.apply and (o.yes or input("Write valid patches into the sources? [y/N] ").lower() == "y"):
            spans = out.where("patch_valid").join(fn.select("function_name", "file_path", "start_byte", "end_byte"), ["function_name", "file_path"])
            print(patching.write_patched(o.path, [r.asDict() for r in spans.toLocalIterator()]))
    elif o.command == "evaluate":
        truth = scan.read_ground_truth(spark, o.ground_truth)
        name = truth.select(F.first("dataset", True)).first()[0]
        findings = _findings(spark, o.results).withColumn("dataset", F.lit(name))
        runs = scan.read_run_ids(spark, o.results).withColumn("dataset", F.lit(name))
        rows = [r.asDict() for r in evaluation.compare(truth, findings, runs).orderBy("run_id").collect()]  # one row a run
        v = cut(evaluation.verdicts(truth, findings, runs))
        for r in rows:
            sinks.save_evaluation(r, v.where(F.col("run_id") == r["run_id"]).drop("run_id"), str(Path(o.output_dir) / f"eval_{r['run_id']}.json"))
        print(sinks.comparison_table(rows))
    return 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
