"""Documents, command line, stream, entry module."""

import json
import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from codeweft import cli
from codeweft.core import bounded, cut, cut_counted, discard, first_of, latest, load, numbered, shared_folder, spread_join
from codeweft.sources import scan, sinks
from codeweft.streaming import ingest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def project(tmp_path):
    src = tmp_path / "datasets" / "shop"
    src.mkdir(parents=True)
    (src / "api.js").write_text("const db = require('./db');\nfunction handler(req) {\n  return load(req);\n}\nfunction load(x) {\n  return db.query(x);\n}\n")
    (src / "util.py").write_text("def helper(a):\n    return a\n")
    return src


def test_commands(spark, tmp_path, capsys, monkeypatch):
    src = project(tmp_path)
    monkeypatch.chdir(tmp_path)
    at = "2025-01-02T03:04:05"

    def model(prompt):
        return json.dumps({"vulnerability_found": "db.query" in prompt.split("Called by")[0].split("Calls:")[0], "cwe_id": "89", "severity": "high", "affected_lines": [2], "confidence": 0.9, "explanation": "raw query"})

    assert cli.run(["analyze", "--path", str(src), "--run-name", "one", "--visualize"], spark, model, now=at) == 0
    out = tmp_path / "results" / "shop" / "one"
    doc = json.loads((out / "extraction.json").read_text())
    assert doc["function_count"] == 3 and [f["function_name"] for f in doc["functions"]] == ["handler", "load", "helper"]
    graph = json.loads((out / "call_graph.json").read_text())["nodes"]
    assert graph["api.js::handler"]["callees"] == ["api.js::load"] and graph["external::db.query"]["is_external"]
    run = json.loads((out / "analysis.json").read_text())
    found = {f["function_name"]: f for f in run["findings"]}
    assert run["summary"]["found"] == 1 and found["load"]["vulnerability_found"] and found["load"]["affected_lines"] == [6]
    assert "<script>" in (out / "call_graph.html").read_text()
    assert cli.run(["analyze", "--snippet", "def s():\n    pass\n", "--language", "python", "--run-name", "dry", "--dry-run"], spark, model, now=at) == 0
    assert cli.run(["analyze", "--path", str(src), "--run-name", "agent", "--react"], spark, lambda p: '{"vulnerability_found": false, "explanation": "fine", "confidence": 0.1}', now=at) == 0
    assert cli.run(["show", str(out / "analysis.json"), "--vulns-only"], spark) == 0
    assert cli.run(["graph", "--graph-file", str(out / "call_graph.json"), "--results", str(out / "analysis.json"), "--dot", "--output-dir", str(tmp_path / "g")], spark) == 0
    dot = (tmp_path / "g" / "call_graph.dot").read_text()
    assert 'fillcolor=orangered' in dot and '"api.js::handler" -> "api.js::load";' in dot and "external" not in dot
    diff = "@@\n-  return db.query(x);\n+  return db.query('?', x);\n"
    assert cli.run(["patch", "--results", str(out / "analysis.json"), "--path", str(src), "--output-dir", str(tmp_path / "p"), "--apply", "--yes"], spark, generator=lambda r: diff) == 0
    patches = json.loads(next((tmp_path / "p").iterdir()).read_text())
    assert patches["valid"] == 1 and "db.query('?', x)" in (src / "api.js").read_text()
    (tmp_path / "gt.json").write_text(json.dumps({"dataset": "shop", "functions": [{"function_name": "load", "file": "api.js", "vulnerable": True, "cwe_id": "CWE-89"}, {"function_name": "handler", "file": "api.js"}]}))
    assert cli.run(["evaluate", "--results", str(out / "analysis.json"), "--ground-truth", str(tmp_path / "gt.json"), "--output-dir", str(tmp_path / "e")], spark) == 0
    text = capsys.readouterr().out
    assert "VULN  HIGH CWE-89  load" in text and "| 1.00 |" in text
    report = json.loads(next((tmp_path / "e").iterdir()).read_text())
    assert report["tp"] == 1 and report["tn"] == 1 and len(report["instances"]) == 2


def test_readers(spark, tmp_path):
    assert scan.read_call_graph(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert scan.read_call_graph(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "c.yaml").write_text("llm: {model: m}\nagent: {max_steps: 2}\n")
    c = scan.load_config(str(tmp_path / "c.yaml"))
    assert (c.model, c.max_steps, c.max_function_lines) == ("m", 2, 200) and scan.load_config(None) == scan.Config()
    cache = scan.EdgeCache(spark, str(tmp_path / "cache"))
    assert cache.stats() == {"total": 0, "resolved": 0, "external": 0}
    rows = spark.createDataFrame([("k", "t", 1.0, "", "llm"), ("n", None, 0.0, "", "llm")], "key string, target string, confidence double, reasoning string, resolved_by string")
    cache.add(rows)
    cache.add(rows)
    assert cache.stats() == {"total": 2, "resolved": 1, "external": 1}
    cache.delete(["k", "none"])
    assert [r.key for r in cache.table().collect()] == ["n"]
    cache.clear()
    assert cache.stats()["total"] == 0
    assert sinks.dataset_of("x/datasets/shop/a.js") == "shop" and sinks.dataset_of("x") is None
    assert sinks.comparison_table([{"run_id": "r", "precision": 0.125}]).splitlines()[-1].startswith("| r | - | 0.12 |")


def test_stream_gives_what_a_scan_gives(spark, tmp_path):
    src = project(tmp_path)
    table, check = str(tmp_path / "t"), str(tmp_path / "check")
    ingest.ingest(spark, str(src), table, check).awaitTermination()
    assert sorted(r.function_name for r in spark.read.parquet(table).collect()) == ["handler", "helper", "load"]
    time.sleep(1)
    (src / "more.py").write_text("def added():\n    pass\n")
    ingest.ingest(spark, str(src), table, check).awaitTermination()
    assert sorted(r.function_name for r in spark.read.parquet(table).collect()) == ["added", "handler", "helper", "load"]


def test_core(spark):
    assert shared_folder(spark)
    d = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 1)], "k int, v string, t int")
    assert {(r.k, r.v) for r in latest(d, "k", "t").collect()} == {(1, "b"), (None, "c")}
    many = spark.createDataFrame([(i % 3 or None, i * 7 % 101) for i in range(100)], "g int, v int").repartition(5)
    for within in (None, "g"):
        seen = {}
        for r in sorted(numbered(many, ["v"], "no", within).collect(), key=lambda r: r.v):
            key = r.g if within else 0
            assert r.no == seen.get(key, 0)
            seen[key] = r.no + 1
    assert cut(d).count() == 3 and load(spark, SF, "nation").count() == 25


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['codeweft.llm'] = None\nimport __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert q and set(o) <= set(q) and not any(k[:2] in ('p2', 'p9') for k in q), sorted(q)\n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).where("kind = 'fan-out'").count() == 10


def test_joins_of_hot_keys_and_counted_tables(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate("aaabbc")] + [("z", 9), (None, 1)], "k string, i int")
    right = spark.createDataFrame([("a", j) for j in range(50)] + [("b", 1), ("d", 2), (None, 3)], "k string, j int")
    want = sorted((r.k, r.i, r.j) for r in left.join(right, "k").collect())
    for spread in (3, 1000):
        assert sorted((r.k, r.i, r.j) for r in spread_join(left, right, "k", "j", spread).collect()) == want
    table, n = cut_counted(right.where("j > 1"))
    assert n == table.count() == 50 and cut_counted(right, F.col("j") > 40)[1] == 9
    assert bounded(table, n).count() == 50
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    discard(table, right)
    assert not folder.exists()


def test_first_of_repeats(spark):
    d = spark.createDataFrame([(1, 5, "x"), (1, 4, "x"), (2, 1, "y"), (None, 3, "n"), (None, 3, "n")], "k int, t int, v string")
    assert sorted((str(r.k), r.t) for r in first_of(d, "k", "t").collect()) == [("1", 4), ("2", 1), ("None", 3), ("None", 3)]
    assert first_of(d.limit(0), "k", "t").count() == 0
