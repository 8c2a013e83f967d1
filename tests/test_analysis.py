"""Prompts, answers, agent, memory, results."""

import json

from codeweft.operators import analysis as A
from codeweft.operators import results as R

FN = [("a::f", "f", "a", "python", 1, 3, "def f(): g()", 1), ("b::g", "g", "b", "python", 1, 2, "def g(): pass", 2), ("c::g", "g", "c", "python", 1, 2, "def g(): return", 3)]


def functions(spark):
    return spark.createDataFrame(FN, "id string, function_name string, file_path string, language string, start_line int, end_line int, code string, fn_ord int")


def test_prompts(spark):
    adj = spark.createDataFrame([("a::f", [], ["b::g", "external::db.query", "z::g"]), ("b::g", ["a::f"], [])], "id string, callers array<string>, callees array<string>")
    p = {r.id: r.prompt for r in A.prompts(functions(spark), adj).collect()}
    assert set(p) == {"a::f", "b::g", "c::g"}
    assert "def f(): g()" in p["a::f"] and "def g(): pass" in p["a::f"] and "External calls: db.query" in p["a::f"] and "Called by" not in p["a::f"]
    assert "def g(): return" in p["a::f"]  # the last function of that name stands for one without a row
    assert "Called by" in p["b::g"] and "Calls" not in p["b::g"]


def test_answers(spark):
    raw = [
        (1, '```json\n{"vulnerability_found": true, "cwe_id": "cwe-89", "affected_lines": [3, 4], "severity": "high", "explanation": "x", "confidence": 0.9}\n```'), (2, "nothing"), (3, '{"cwe_id": 79, "confidence": 1}'),
        (4, None), (5, "[1]"), (6, ""), (7, '{"vulnerability_found": false, "hallucination_flag": true}'),
    ]
    got = {r.k: r for r in A.answers(spark.createDataFrame(raw, "k int, raw string")).collect()}
    assert got[1].vulnerability_found and got[1].cwe_id == "CWE-89" and got[1].affected_lines == [3, 4] and got[1].confidence == 0.9 and got[1].error is None
    assert got[3].cwe_id == "CWE-79" and got[3].confidence == 1.0 and not got[3].vulnerability_found and got[3].affected_lines == []
    assert {k for k, r in got.items() if r.error == "json_parse_error"} == {2, 4, 5, 6} and got[2].hallucination_flag
    assert got[7].hallucination_flag and not got[7].vulnerability_found


def test_analyze_isolates_failures(spark):
    d = spark.createDataFrame([("1", "f", "a", "python", "ok"), ("2", "g", "b", "python", "boom")], "id string, function_name string, file_path string, language string, prompt string")

    def model(p):
        if p == "boom":
            raise RuntimeError("limit")
        return '{"vulnerability_found": true, "cwe_id": "89", "confidence": 0.8, "explanation": "e"}'

    got = {r.id: r for r in A.analyze(d, model).collect()}
    assert got["1"].cwe_id == "CWE-89" and got["2"].error == "api_error: limit"


def test_agent_uses_tools_and_memory():
    nodes = {"a::f": {"function_name": "f", "callers": [], "callees": ["b::g", "external::x"], "is_entry_point": True}, "b::g": {"function_name": "g", "callers": ["a::f"], "callees": []}}
    tools = A.GraphTools(nodes, {"g": "code of g"})
    assert tools.call("get_callees", {"function_name": "f"}) == "Internal callees: b::g\nExternal callees: x"
    assert tools.call("get_callers", {"function_name": "f"}).startswith("No callers") and tools.call("get_callers", {"function_name": "b::g"}) == "Callers: a::f"
    assert "code of g" in tools.call("get_source", {"function_name": "g"}) and tools.call("nope", {}) == "Unknown tool 'nope'."
    assert tools.call("is_entry_point", {"function_name": "f"}) == "'f' is_entry_point: True" and tools.call("get_node_info", {"function_name": "q"}).startswith("No node info")
    seen = []

    def model(p):
        seen.append(json.loads(p))
        if len(seen) == 1:
            return '{"action": "tool", "tool": "get_source", "args": {"function_name": "g"}}'
        return '{"action": "final", "vulnerability_found": true, "cwe_id": "89", "severity": "high", "confidence": 0.9, "explanation": "bad"}'

    agent = A.Agent(model, tools)
    r = agent.run({"function_name": "f", "file_path": "a", "code": "f()"})
    assert r["cwe_id"] == "CWE-89" and r["analysis_mode"] == "react_loop" and agent.trace[0]["tool"] == "get_source"
    agent.run({"function_name": "g", "file_path": "b", "code": "g()"})
    assert "f: VULNERABLE (CWE-89, high) — bad" in seen[-1]["history"]
    loop = A.Agent(lambda p: '{"action": "tool", "tool": "x"}', tools, max_steps=2)
    assert loop.run({"function_name": "f", "file_path": "a"})["error"] == "max_steps_exceeded" and len(loop.trace) == 2
    quiet = A.Agent(lambda p: '{"confidence": 0, "explanation": ""}', tools)
    assert quiet.run({"function_name": "f", "file_path": "a"})["analysis_mode"] == "react_loop_fallback"


def test_memory_sees_earlier_rows_only(spark):
    f = spark.createDataFrame([("r", "a", 1, "fa", True, "CWE-1", "high", "x" * 200), ("r", "b", 2, "fb", False, None, None, None), ("r", "c", 3, "fc", False, None, None, "ok"), ("s", "a", 1, "fa", False, None, None, "other run")], "run_id string, id string, ord int, function_name string, vulnerability_found boolean, cwe_id string, severity string, explanation string")
    nb = spark.createDataFrame([("b", 0, "a"), ("b", 1, "c"), ("c", 0, "b"), ("c", 1, "a"), ("a", 0, "c")], "id string, pos int, neighbour string")
    got = {(r.run_id, r.id): r.context.split("\n") for r in A.memory_context(f, nb).collect()}
    assert set(got) == {("r", "b"), ("r", "c")}
    assert got["r", "b"][1] == "  fa: VULNERABLE (CWE-1, high) — " + "x" * 120
    assert [x.split(":")[0].strip() for x in got["r", "c"][1:]] == ["fb", "fa"]


def test_results(spark):
    f = spark.createDataFrame(
        [("r", 1, "f", "a", True, "CWE-1", "high", [12, 99], None, False), ("r", 2, "g", "a", True, "CWE-2", None, [2], None, True), ("r", 3, "f", "b", True, "CWE-1", "low", None, None, False), ("r", 4, "h", "a", False, "CWE-1", None, [500], "e", None), ("r", 5, "g", "a", True, "CWE-2", "medium", [], None, False)],
        "run_id string, finding_id int, function_name string, file_path string, vulnerability_found boolean, cwe_id string, severity string, affected_lines array<int>, error string, hallucination_flag boolean",
    )
    s = R.run_summary(f).first()
    assert (s.total, s.found, s.errors, s.hallucinated, s.clean) == (5, 4, 1, 1, 0)
    assert {r.finding_id: r.duplicate_group for r in R.duplicate_groups(f).collect()} == {1: 0, 2: 1, 3: 0, 4: None, 5: 1}
    fn = spark.createDataFrame([("f", "a", 10, 20, 1), ("g", "a", 10, 20, 2), ("h", "a", 0, 0, 3)], "function_name string, file_path string, start_line int, end_line int, fn_ord int")
    assert {r.finding_id: r.affected_lines for r in R.with_clamped_lines(f, fn).collect()} == {1: [12], 2: [11], 3: [], 4: [500], 5: []}
    n = spark.createDataFrame([("a::f", False, False, True, False), ("a::g", True, False, False, False), ("x", True, True, True, True), ("y", None, None, None, None), ("z", False, True, True, False)], "id string, is_taint_sink boolean, is_taint_source boolean, is_entry_point boolean, is_infrastructure boolean")
    assert {r.id: r.role for r in R.overlay(n, f, "finding_id").collect()} == {"a::f": "vulnerable_high", "a::g": "vulnerable_medium", "x": "taint_sink", "y": "default", "z": "taint_source"}


def test_failing_tool_answers_with_its_error():
    tools = A.GraphTools({"a::f": {"function_name": "f", "callees": ["external::x"]}}, taint=lambda fn: 1 / 0)
    assert tools.call("get_taint_path", {"function_name": "f"}) == "Tool error: division by zero" and tools.call("get_callees", ["f"]).startswith("Tool error: ")
    assert tools.call("get_callees", {"function_name": "f"}) == "External callees: x" and tools.call("nope", {}) == "Unknown tool 'nope'."
    seen = []

    def model(p):
        seen.append(json.loads(p))
        return '{"action": "tool", "tool": "get_taint_path", "args": {"function_name": "f"}}' if len(seen) == 1 else '{"action": "final", "vulnerability_found": true, "confidence": 0.5, "explanation": "e"}'

    agent = A.Agent(model, tools)
    assert agent.run({"function_name": "f", "file_path": "a", "code": "x"})["vulnerability_found"] and "Tool error" in seen[1]["history"]
    assert (len(agent), agent.vulnerable_count()) == (1, 1) and A.tool_summary(agent.trace[:0]) == "No tools called."
    assert all(c in seen[0]["rules"] for c in ("CWE-639", "CWE-1333", "CWE-89")) and len(A.AGENT_RULES) == 18 and len(A.CWE_RULES) == 7


def test_steps_as_a_batch(spark):
    raw = [
        (1, '```json\n{"action": "tool", "tool": "get_source", "args": {"function_name": "f"}, "thought": "t"}\n```'), (2, '{"action": "tool", "tool": "get_callers"}'), (3, '{"vulnerability_found": true, "cwe_id": "cwe-89", "thought": "u"}'),
        (4, "no json"), (5, None), (6, '{"action": "final"}'),
    ]
    got = {r.k: r for r in A.agent_steps(spark.createDataFrame(raw, "k int, raw string")).collect()}
    assert (got[1].is_final, got[1].tool, json.loads(got[1].args), got[1].thought, got[1].vulnerability_found) == (False, "get_source", {"function_name": "f"}, "t", None)
    assert (got[2].is_final, got[2].tool, got[2].args) == (False, "get_callers", "{}")
    assert got[3].is_final and got[3].vulnerability_found and got[3].cwe_id == "CWE-89" and got[3].tool is None
    assert got[4].error == got[5].error == "json_parse_error" and got[4].is_final and got[6].is_final and got[6].error is None


def test_memory_and_traces_as_tables(spark):
    f = spark.createDataFrame([("r", "a", 1, True), ("r", "a", 2, False), ("r", "b", 3, True), ("s", "a", 1, None)], "run_id string, id string, ord int, vulnerability_found boolean")
    assert {r.run_id: (r.remembered, r.vulnerable) for r in A.memory_stats(f).collect()} == {"r": (2, 1), "s": (1, 0)}
    tr = spark.createDataFrame([("n", 2, "b", "{}"), ("n", 1, "a", '{"x": 1}'), ("m", None, None, None)], "node_id string, step int, tool string, args string")
    got = {r.node_id: r.summary for r in A.trace_text(tr, spark.createDataFrame([("n",), ("m",), ("k",)], "node_id string")).collect()}
    assert got == {"n": '  step 1: a({"x": 1})\n  step 2: b({})', "m": "  step ?: ?({})", "k": "No tools called."}
    assert A.tool_summary([{"step": 1, "tool": "a", "args": {"x": 1}}, {}]) == "  step 1: a({'x': 1})\n  step ?: ?({})"
