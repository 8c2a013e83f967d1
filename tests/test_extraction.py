"""Functions, imports, routes, masking."""

import random

import pytest

from codeweft.functions.source_tokens import call_names, is_balanced
from codeweft.functions.text import in_skipped_folder, language_of
from codeweft.operators import extraction as X
from codeweft.sources import scan

PY = "import os\n\n\ndef first(a):\n    return second(a)\n\n\nasync def second(b):\n    return b.run(os.getcwd())\n\n\nclass Box:\n    def method(self):\n        return first(1)\n"
JS = "const db = require('./db/pool.js');\nimport auth from 'auth-lib';\n\nfunction load(x) { return db.query(x); }\nasync function save(y) {\n  return load(y);\n}\nconst check = (z) => { return auth.verify(z); };\n"
C = '#include <stdio.h>\n\nint add(int a, int b) {\n    return a + b;\n}\n\nstatic char *copy_of(const char *s) {\n    printf("%s {", s);\n    return dup(s);\n}\n'
WRAPPER = "function Service(db) {\n  this.update = function (id) {\n    const inner = function helper() { return 1; };\n    return db.run(id);\n  };\n  this.find = (id) => {\n    return db.get(id);\n  };\n  return db;\n}\n"


def names(text, language, **k):
    return [r["function_name"] for r in X.functions_of(text, language, **k)]


def test_names_by_language():
    assert names(PY, "python") == ["first", "second", "method"]
    assert names(JS, "javascript") == ["load", "save", "check"]
    assert names(C, "c") == ["add", "copy_of"]
    assert names("namespace n {\nclass A {\n public:\n  int get() const { return x_; }\n};\nint A::set(int v) { x_ = v; return v; }\n}\n", "cpp") == ["get", "set"]


def test_lines_and_bytes():
    rows = X.functions_of("# é\n" + PY, "python")
    assert (rows[0]["start_line"], rows[0]["end_line"]) == (5, 6)
    raw = ("# é\n" + PY).encode()
    assert raw[rows[0]["start_byte"] : rows[0]["end_byte"]].decode().startswith("def first(a):")


def test_broken_and_empty_texts_give_lists():
    assert names("def broken(a:\n    return (\n\ndef other():\n    pass\n", "python") == ["broken", "other"]
    assert names("", "python") == [] and names("function x( {", "javascript") in ([], ["x"]) and names("int f(", "c") == []


def test_long_functions_are_left_out_but_not_what_they_hold():
    text = "def big():\n    def small():\n        pass\n" + "    x = 1\n" * 300
    assert names(text, "python", max_lines=50) == ["small"]


def test_nested_bodies_are_masked():
    rows = {r["function_name"]: r for r in X.functions_of(WRAPPER, "javascript")}
    outer = rows["Service"]["code"]
    assert "nested method 'this.update' analyzed separately" in outer and "nested method 'this.find'" in outer
    assert "db.run" not in outer and "return db;" in outer
    assert outer.count("\n") == WRAPPER.rstrip("\n").count("\n")
    assert "db.run" in rows["this.update"]["code"] and "nested method 'helper'" in rows["this.update"]["code"]


def test_calls():
    assert call_names(JS.split("\n")[3], "javascript") == ["db.query"]
    assert call_names("def f(x):\n    # no(call)\n    return a.b(c('d(e)'))", "python") == ["a.b", "c"]
    assert call_names("int f(int a) { if (a) { return g(h(a)); } }", "c") == ["g", "h"]


def test_balance():
    assert is_balanced("function f() { return `a${b}`; }", "javascript") and not is_balanced("function f() { return (1; }", "javascript")
    assert not is_balanced('const a = "open;\n', "javascript") and is_balanced("x = 1\n", "python") and not is_balanced("def f(:\n", "python")


def test_tables(spark, rows):
    f = spark.createDataFrame([("a.py", "python", PY), ("b.js", "javascript", JS), ("c.txt", "unknown", "x"), ("d.js", "javascript", None), ("e.js", "javascript", "router.get('/x/:id', auth, ctl.show)\nrouter.post(\"/y\",\n  save)")], "file_path string, language string, content string")
    got = X.extract_functions(f)
    assert {(r.file_path, r.function_name) for r in got.collect()} == {("a.py", "first"), ("a.py", "second"), ("a.py", "method"), ("b.js", "load"), ("b.js", "save"), ("b.js", "check")}
    assert rows(X.imports(f), "pos", "alias", "source") == [(0, "db", "./db/pool.js"), (1, "auth", "auth-lib")]
    r = {x.path: x for x in X.routes(f).collect()}
    assert r["/x/:id"].handlers == ["auth", "ctl.show"] and r["/y"].method == "POST" and r["/y"].handlers == ["save"]
    assert X.extract_functions(f.limit(0)).count() == 0


def test_nested_direct(spark, rows):
    s = spark.createDataFrame([("f", "a", 0, 100), ("f", "b", 10, 50), ("f", "c", 20, 30), ("f", "d", 60, 70), ("f", "e", 20, 30), ("g", "x", 15, 25)], "file_path string, id string, sb int, eb int")
    assert rows(X.nested_direct(s), "outer", "inner") == [("a", "b"), ("a", "d"), ("b", "c"), ("b", "e")]


def test_nested_direct_of_any_spans(spark, rows):
    """Also of spans that cross or repeat, against the definition."""
    r = random.Random(6)
    spans = [(f"f{k % 4}", f"s{k}", a, a + r.randint(0, 12)) for k, a in ((k, r.randint(0, 20)) for k in range(80))]
    d = spark.createDataFrame([*spans, (None, "n", 1, 2), ("f0", "n", None, 2)], "file_path string, id string, sb int, eb int").repartition(3)
    holds = lambda x, y: x[0] == y[0] and x[2] <= y[2] and y[3] <= x[3] and x[2:] != y[2:]
    want = sorted((x[0], x[1], y[1]) for x in spans for y in spans if holds(x, y) and not any(holds(x, z) and holds(z, y) for z in spans))
    assert rows(X.nested_direct(d), "file_path", "outer", "inner") == want


def test_scan(spark, tmp_path, rows):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text(PY)
    (tmp_path / "sub" / "b.js").write_bytes(b"function q() {} // \xff")
    (tmp_path / "node_modules" / "lib.js").write_text("function no() {}")
    (tmp_path / "readme.md").write_text("# x")
    f = scan.scan(spark, str(tmp_path))
    assert rows(f, "file_path", "language", "file_ord") == [("a.py", "python", 1), ("sub/b.js", "javascript", 2)]
    assert "�" in [r.content for r in f.collect() if r.file_path == "sub/b.js"][0]
    assert rows(scan.scan(spark, str(tmp_path / "a.py")), "file_path") == ["a.py"]
    with pytest.raises(FileNotFoundError):
        scan.scan(spark, str(tmp_path / "none"))
    assert scan.snippet(spark, "x", "cobol").count() == 0 and scan.snippet(spark, "x", "c").count() == 1


def test_unreadable_file_is_left_out(spark, tmp_path, rows):
    for n in ("a.py", "b.py"):
        (tmp_path / n).write_text(PY)
    f = scan.scan(spark, str(tmp_path)).select("file_path", "content")
    (tmp_path / "a.py").unlink()
    assert rows(f, "file_path") == ["b.py"]


def test_environment_file(tmp_path, monkeypatch):
    monkeypatch.setenv("CW_KEPT", "own")
    for name in ("CW_A", "CW_B", "CW_C", "CW_D"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / ".env").write_text("# head\nCW_A=one # note\nexport CW_B=\"t w\\no\"\n CW_C = 'th#ree'\nCW_KEPT=file\nCW_D=\nnot a line\n")
    assert scan.load_env(str(tmp_path / ".env")) == {"CW_A": "one", "CW_B": "t w\no", "CW_C": "th#ree", "CW_KEPT": "file", "CW_D": ""}
    assert [scan.secret(x) for x in ("CW_A", "CW_B", "CW_C", "CW_D", "CW_KEPT", "CW_NONE")] == ["one", "t w\no", "th#ree", None, "own", None]
    assert scan.load_env(str(tmp_path / "none")) == {}
    for name in ("CW_A", "CW_B", "CW_C", "CW_D"):
        monkeypatch.delenv(name, raising=False)


def test_call_graph_documents(spark, tmp_path):
    node = {"function_name": "f", "file_path": "a", "callers": ["x"], "callees": [], "is_entry_point": True}
    for name, text in (("flat", {"a::f": node, "note": 3}), ("nested", {"nodes": {"a::f": node}, "at": "now"}), ("list", [1])):
        (tmp_path / name).write_text(__import__("json").dumps(text, indent=1))
    (tmp_path / "bad").write_text("{")
    for name, n in (("flat", 1), ("nested", 1), ("list", 0), ("bad", 0), ("missing", 0)):
        got = scan.read_call_graph(spark, str(tmp_path / name)).collect()
        assert len(got) == n and all((r.id, r.callers, r.is_entry_point) == ("a::f", ["x"], True) for r in got), name


def test_run_documents_without_findings(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"run_id": "a", "findings": []}))
    (tmp_path / "b.json").write_text(json.dumps({"run_id": "b", "findings": [{"function_name": "f"}]}))
    paths = [str(tmp_path / x) for x in ("a.json", "b.json")]
    assert {r.run_id for r in scan.read_run_ids(spark, paths).collect()} == {"a", "b"} and scan.read_runs(spark, paths).count() == 1


def test_language_and_folders(spark):
    d = spark.createDataFrame([("a/B.PY",), ("x.tsx",), ("x",), (None,), ("my/vendor/x.c",), ("vendors/x.c",)], "p string")
    r = d.select(language_of("p").alias("g"), in_skipped_folder("p").alias("s")).collect()
    assert [x.g for x in r] == ["python", "javascript", "unknown", "unknown", "c", "c"]
    assert [x.s for x in r] == [False, False, False, None, True, False]
