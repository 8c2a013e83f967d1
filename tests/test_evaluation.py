"""Runs against labels."""

from codeweft.operators import evaluation as E

TRUTH = [
    (0, "d", "login", "src/auth.js", True, "CWE-89", ""), (1, "d", "reset", "src/auth.js", True, "CWE-798", None), (2, "d", "query", "src/a.js", True, "CWE-20", None),
    (3, "d", "query", "src/b.js", True, "CWE-20", "src/a.js::query"), (4, "d", "list", "src/list.js", False, None, None),
]
FIND = "run_id string, dataset string, finding_ord int, function_name string, file_path string, vulnerability_found boolean, cwe_id string, confidence double, hallucination_flag boolean, analysis_mode string"


def tables(spark, findings):
    t = spark.createDataFrame(TRUTH, "gt_ord int, dataset string, function_name string, file string, vulnerable boolean, cwe_id string, duplicate_of string")
    return t, spark.createDataFrame([(r, "d", i, n, p, v, c, 0.9, h, m) for i, (r, n, p, v, c, h, m) in enumerate(findings)], FIND)


def one(run, changes=(), drop=()):
    base = {"login": ("/App/src/auth.js", True, "CWE-89"), "reset": ("\\app\\src\\auth.js", True, "CWE-798"), "qa": ("x/src/a.js", True, "CWE-20"), "qb": ("x/src/b.js", True, "CWE-20"), "list": ("src/list.js", False, None)}
    base |= dict(changes)
    return [(run, {"qa": "query", "qb": "query"}.get(k, k), *v, False, "react_loop") for k, v in base.items() if k not in drop]


def test_perfect(spark):
    t, f = tables(spark, one("r"))
    m = E.compare(t, f).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (4, 0, 0, 1) and m.precision == m.recall == m.f1 == m.cwe_accuracy == 1.0
    assert (m.unique_recall, m.hallucination_rate, m.analysis_mode) == (1.0, 0.0, "react_loop")
    u = E.unique_recall(E.verdicts(t, f)).first()
    assert (u.planted, u.detected) == (3, 3)


def test_mixed(spark):
    t, f = tables(spark, one("r", {"login": ("src/auth.js", True, "CWE-1"), "reset": ("src/auth.js", False, None), "qb": ("src/b.js", False, None), "list": ("src/list.js", True, "CWE-9")}.items()))
    v = E.verdicts(t, f)
    m = E.metrics(v).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 2, 0)
    assert E.cwe_accuracy(v).first().cwe_accuracy == 0.5
    assert E.unique_recall(v).first().unique_recall == 2 / 3
    assert {(r.cwe, r.planted, r.detected, r.correct) for r in E.cwe_breakdown(v).collect()} == {("CWE-89", 1, 1, 0), ("CWE-798", 1, 0, 0), ("CWE-20", 1, 1, 1)}


def test_missing_instance_is_a_miss(spark):
    t, f = tables(spark, one("r", drop=("qb",)))
    by = {r.gt_ord: r for r in E.verdicts(t, f).collect()}
    assert by[2].outcome == "TP" and by[3].outcome == "FN" and not by[3].analysed


def test_ambiguous_and_unmatched(spark):
    t, f = tables(spark, [("r", "query", "p/one.js", True, None, False, None), ("r", "query", "p/two.js", True, None, False, None), ("r", "extra", "e.js", True, None, False, None), ("r", None, "n.js", False, None, False, None)])
    u = {r.gt_ord: r.candidates for r in E.unresolved(t, f).collect()}
    assert u == {2: ["p/one.js", "p/two.js"], 3: ["p/one.js", "p/two.js"]}
    assert {r.file_path for r in E.unmatched(t, f).collect()} == {"e.js", "n.js"}
    m = E.metrics(E.verdicts(t, f)).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (0, 0, 2, 1) and m.precision == 0.0 and m.f1 == 0.0


def test_hallucination_and_modes_of_two_runs(spark):
    first = [(r, n, p, v, c, n == "login", "single") for r, n, p, v, c, _, _ in one("a")]
    t, f = tables(spark, first + one("b"))
    rows = {r.run_id: r for r in E.compare(t, f).collect()}
    assert rows["a"].hallucination_rate == 0.25 and rows["b"].hallucination_rate == 0.0
    assert (rows["a"].analysis_mode, rows["b"].analysis_mode) == ("single", "react_loop")


def test_run_without_findings(spark):
    t, f = tables(spark, one("r"))
    runs = spark.createDataFrame([("none", "d"), ("r", "d"), ("other", "x")], "run_id string, dataset string")
    rows = {r.run_id: r for r in E.compare(t, f, runs).collect()}
    assert set(rows) == {"r", "none"} and (rows["none"].tp, rows["none"].fn, rows["none"].fp, rows["none"].tn) == (0, 4, 0, 1)
    assert rows["none"].recall == rows["none"].unique_recall == 0.0 and rows["none"].analysis_mode is None and rows["r"].tp == 4


def test_empty(spark):
    t, f = tables(spark, one("r"))
    assert E.compare(t, f.limit(0)).count() == 0 and E.verdicts(t.limit(0), f).count() == 0


def test_dataset_from_path(spark):
    d = spark.createDataFrame([("/Datasets/ab/x.js",), ("q\\datasets\\cd\\y.js",), (None,), ("x.js",)], "file_path string")
    assert [r.dataset for r in E.with_dataset(d).collect()] == ["ab", "cd", "", ""]
