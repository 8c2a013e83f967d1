"""Prompts, answers, agent and memory of per-function analyses.

The model is a function from a prompt to a text, given by the caller; tests and offline runs use deterministic ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import normalize_cwe, strip_fences, without_fences
from codeweft.schemas import REPORT

# The CWE table of prompts, fixed values: id, severity and the mode that names it.
CWE_TABLE = [
    ("CWE-89", "high", "both"), ("CWE-347", "high", "both"), ("CWE-798", "high", "both"), ("CWE-20", "medium", "both"), ("CWE-306", "medium", "both"),
    ("CWE-208", "medium", "both"), ("CWE-269", "medium", "both"), ("CWE-639", "high", "agent"), ("CWE-862", "high", "agent"), ("CWE-841", "medium", "agent"),
    ("CWE-915", "medium", "agent"), ("CWE-362", "medium", "agent"), ("CWE-79", "medium", "agent"), ("CWE-95", "high", "agent"), ("CWE-1333", "medium", "agent"),
    ("CWE-117", "medium", "agent"), ("CWE-521", "medium", "agent"), ("CWE-256", "high", "agent"),
]
CWE_RULES = [r for r in CWE_TABLE if r[2] == "both"]  # of a single pass
AGENT_RULES = CWE_TABLE
SUMMARY_CHARS = 120
MAX_STEPS = 5
# Texts of verdicts that stand for a missing answer, fixed values.
UNREADABLE = "Parse error — could not read LLM response."
NO_ANSWER = "ReAct loop reached max steps without a final answer."


def code_map(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by id, by name): the last code of each."""
    by_id = functions.groupBy("id").agg(F.max_by("code", "fn_ord").alias("code"))
    by_name = functions.groupBy("function_name").agg(F.max_by("code", "fn_ord").alias("code"))
    return by_id, by_name


def neighbour_code(adjacent: DataFrame, functions: DataFrame, side: str) -> DataFrame:
    """(id, pos, neighbour, name, code) of the internal callers or callees of each node."""
    by_id, by_name = code_map(functions)
    e = adjacent.select("id", F.posexplode(side).alias("pos", "neighbour")).where(~F.col("neighbour").startswith("external::")).withColumn("name", F.element_at(F.split("neighbour", "::"), -1))
    j = e.join(by_id.select(F.col("id").alias("i"), F.col("code").alias("c1")), F.col("neighbour") == F.col("i"), "left")
    j = j.join(by_name.select(F.col("function_name").alias("n"), F.col("code").alias("c2")), F.col("name") == F.col("n"), "left")
    return j.select("id", "pos", "neighbour", "name", F.coalesce("c1", "c2").alias("code"))


def _block(language: Column, code: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), code, F.lit("\n```"))


def rules_text(rules: list[tuple[str, str, str]]) -> str:
    by_severity: dict[str, list[str]] = {}
    for cwe, severity, _ in rules:
        by_severity.setdefault(severity, []).append(cwe)
    return "\n".join(f"  {s}: {', '.join(c)}" for s, c in by_severity.items())


def prompts(functions: DataFrame, adjacent: DataFrame, rules: list[tuple[str, str, str]] = CWE_RULES) -> DataFrame:
    """(id, prompt): target with its place and code, code of internal callers and callees, external calls, rules, answer format."""
    f = functions.select("id", "function_name", "file_path", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("start_line", F.lit(0)).alias("s"), F.coalesce("end_line", F.lit(0)).alias("e"), F.coalesce("code", F.lit("")).alias("code"))
    out = f
    for side in ("callers", "callees"):
        n = neighbour_code(adjacent, functions, side).join(f.select("id", "language"), "id")
        text = F.concat(F.lit("> "), "name", F.coalesce(F.concat(F.lit("\n"), _block(F.col("language"), F.col("code"))), F.lit("")))
        shown = n.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).alias("x")).select("id", F.array_join(F.transform("x", lambda y: y["t"]), "\n").alias(side))
        out = out.join(shown, "id", "left")
    ext = adjacent.select("id", F.array_join(F.transform(F.filter("callees", lambda c: c.startswith("external::")), lambda c: F.regexp_replace(c, "^external::", "")), ", ").alias("external"))
    out = out.join(ext, "id", "left")
    rule_text = rules_text(rules)
    none = F.lit(None).cast("string")
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title), c)).otherwise(none)
    return out.select("id", F.concat_ws(
        "\n\n",
        F.concat(F.lit("Review the "), "language", F.lit(" function below for security weaknesses in its own code. What its neighbours do is context, not a finding; without direct evidence the answer is no.")),
        F.concat(F.lit("Target: "), "function_name", F.lit("\nFile: "), F.coalesce("file_path", F.lit("")), F.lit(", lines "), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"), F.lit("\n"), _block(F.col("language"), F.col("code"))),
        part("Called by:\n", F.col("callers")), part("Calls:\n", F.col("callees")), part("External calls: ", F.col("external")),
        F.lit("Weakness classes by severity, the most specific applies:\n" + rule_text),
        F.lit('Answer with one JSON object: {"vulnerability_found": bool, "cwe_id": string|null, "affected_lines": [int], "severity": "low"|"medium"|"high"|"critical"|null, "explanation": string, "patch_suggestion": string, "confidence": 0.0-1.0, "hallucination_flag": bool}'),
    ).alias("prompt"))


def answers(raw: DataFrame) -> DataFrame:
    """Verdicts of rows (key..., raw): JSON with or without fences; text that is no JSON object gives the safe verdict."""
    kept = [c for c in raw.columns if c != "raw"]
    body = strip_fences("raw")
    get = lambda k: F.get_json_object("b", f"$.{k}")
    j = raw.select(*kept, body.alias("b")).withColumn("parsed", F.try_parse_json("b").isNotNull() & F.col("b").startswith("{"))
    truthy = lambda k: F.coalesce(~F.lower(get(k)).isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))
    ok = F.col("parsed")
    return j.select(
        *kept,
        F.when(ok, truthy("vulnerability_found")).otherwise(False).alias("vulnerability_found"),
        F.when(ok, normalize_cwe(get("cwe_id"))).alias("cwe_id"),
        F.when(ok, F.coalesce(F.from_json(get("affected_lines"), "array<int>"), F.expr("cast(array() as array<int>)"))).otherwise(F.expr("cast(array() as array<int>)")).alias("affected_lines"),
        F.when(ok, get("severity")).alias("severity"),
        F.when(ok, F.coalesce(get("explanation"), F.lit(""))).otherwise(UNREADABLE).alias("explanation"),
        F.when(ok, F.coalesce(get("confidence").try_cast("double"), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(ok, truthy("hallucination_flag")).otherwise(True).alias("hallucination_flag"),
        F.when(~ok, "json_parse_error").alias("error"),
    )


def agent_steps(raw: DataFrame) -> DataFrame:
    """(key..., is_final, tool, args, thought, verdict...) of answers (key..., raw) of an agent: of many functions, one step each, as one batch.

    An object whose `action` is `tool` asks for a tool, with its arguments as JSON; anything else is final and has the columns of `answers`.
    """
    kept = [c for c in raw.columns if c != "raw"]
    body = strip_fences("raw")
    ask = F.coalesce((F.get_json_object(body, "$.action") == "tool") & body.startswith("{") & F.try_parse_json(body).isNotNull(), F.lit(False))
    step = raw.select(F.struct(*kept).alias("__key"), "raw").withColumn("__ask", ask)
    tool = lambda k, c: F.when(F.col("__ask"), c).alias(k)
    body = strip_fences("raw")
    asked = step.select("__key", "raw", (~F.col("__ask")).alias("is_final"), tool("tool", F.get_json_object(body, "$.tool")), tool("args", F.coalesce(F.get_json_object(body, "$.args"), F.lit("{}"))), F.get_json_object(body, "$.thought").alias("thought"))
    said = answers(asked)
    own = [c for c in said.columns if c not in ("__key", "is_final", "tool", "args", "thought")]
    return said.select("__key.*", "is_final", "tool", "args", "thought", *[F.when(F.col("is_final"), F.col(c)).alias(c) for c in own])


def memory_stats(findings: DataFrame) -> DataFrame:
    """(run_id, remembered, vulnerable): functions of a run with a finding (id, ord, vulnerability_found), and those whose last one is a vulnerability."""
    last = findings.groupBy("run_id", "id").agg(F.max_by(F.coalesce("vulnerability_found", F.lit(False)), "ord").alias("bad"))
    return last.groupBy("run_id").agg(F.count("*").alias("remembered"), F.count_if("bad").alias("vulnerable"))


def tool_summary(history: list[dict]) -> str:
    """The tools an agent called, a line each."""
    return "\n".join(f"  step {h.get('step', '?')}: {h.get('tool', '?')}({h.get('args', {})})" for h in history) or "No tools called."


def trace_text(trace: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, summary) of trace rows (node_id, step, tool, args): the lines of `tool_summary` in the order of steps; `nodes` (node_id) adds those that called none."""
    line = F.concat(F.lit("  step "), F.coalesce(F.col("step").cast("string"), F.lit("?")), F.lit(": "), F.coalesce("tool", F.lit("?")), F.lit("("), F.coalesce("args", F.lit("{}")), F.lit(")"))
    told = trace.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", line.alias("line")))), lambda x: x["line"]), "\n").alias("summary"))
    return told if nodes is None else nodes.select("node_id").distinct().join(told, "node_id", "left").select("node_id", F.coalesce("summary", F.lit("No tools called.")).alias("summary"))


def is_empty_output() -> Column:
    """A verdict that says nothing: not vulnerable, confidence 0, no explanation, no error."""
    return ~F.coalesce("vulnerability_found", F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) == 0) & (F.coalesce("explanation", F.lit("")) == "") & (F.coalesce("error", F.lit("")) == "")


def parse_report(text: str, sample: dict) -> dict:
    """One verdict on the driver's side, for the agent."""
    base = {"function_name": sample.get("function_name"), "file_path": sample.get("file_path"), "language": sample.get("language"), "analysis_mode": None, "error": None}
    try:
        d = json.loads(without_fences(text))
        if not isinstance(d, dict):
            raise ValueError("no object")
    except ValueError:
        return base | {"vulnerability_found": False, "cwe_id": None, "affected_lines": [], "severity": None, "explanation": UNREADABLE, "patch_suggestion": "", "confidence": 0.0, "hallucination_flag": True, "error": "json_parse_error"}
    cwe = str(d["cwe_id"]).strip() if d.get("cwe_id") else None
    if cwe and cwe.upper().startswith("CWE-"):
        cwe = "CWE-" + cwe[4:]
    elif cwe and cwe.isdigit():
        cwe = "CWE-" + cwe
    return base | {
        "vulnerability_found": bool(d.get("vulnerability_found", False)), "cwe_id": cwe, "affected_lines": d.get("affected_lines", []), "severity": d.get("severity"), "explanation": d.get("explanation", ""),
        "patch_suggestion": d.get("patch_suggestion", ""), "confidence": float(d.get("confidence", 0.0)), "hallucination_flag": bool(d.get("hallucination_flag", False)),
    }


Model = Callable[[str], str]


def analyze(prompted: DataFrame, model: Model) -> DataFrame:
    """prompted(id, function_name, file_path, language, prompt) -> reports with id; a failing call gives `api_error: ...`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                try:
                    report = parse_report(model(r["prompt"]), r)
                except Exception as e:  # noqa: BLE001 - a failing call is a verdict of its own
                    report = parse_report("", r) | {"error": f"api_error: {e}"}
                rows.append({"id": r["id"]} | report | {"analysis_mode": "call_graph_context"})
            yield pd.DataFrame(rows, columns=["id", *[x.name for x in REPORT.fields]])

    return prompted.mapInPandas(run, "id string, " + ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in REPORT.fields))


def memory_context(findings: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(run_id, id, ord, context): what earlier findings of the same run say of a function's neighbours, callers before callees.

    findings(run_id, id, ord, function_name, vulnerability_found, cwe_id, severity, explanation), neighbours(id, pos,
    neighbour). Of a neighbour's earlier findings the latest counts. Nothing earlier: no row.

    Findings and questions of a neighbour stand in one order, and each question takes the last finding before it: no finding
    meets all later questions.
    """
    said = F.when(F.coalesce("vulnerability_found", F.lit(False)), F.concat(F.lit("VULNERABLE ("), F.coalesce("cwe_id", F.lit("None")), F.lit(", "), F.coalesce("severity", F.lit("None")), F.lit(")"))).otherwise("clean")
    line = F.concat(F.lit("  "), F.coalesce("function_name", F.lit("")), F.lit(": "), said, F.lit(" — "), F.substring(F.coalesce("explanation", F.lit("")), 1, SUMMARY_CHARS))
    told = findings.select("run_id", F.col("id").alias("neighbour"), F.col("ord").alias("at"), F.lit(1).alias("kind"), line.alias("line"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("pos", "int"))])
    asked = findings.select("run_id", "id", "ord").join(neighbours, "id").select("run_id", "neighbour", F.col("ord").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line"), "id", F.col("pos").cast("int").alias("pos"))
    w = Window.partitionBy("run_id", "neighbour").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = told.unionByName(asked).withColumn("line", F.last("line", True).over(w)).where("kind = 0 and line is not null").select("run_id", "id", F.col("at").alias("ord"), "pos", "line")
    return last.groupBy("run_id", "id", "ord").agg(F.concat(F.lit("Prior findings for related functions:\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("context"))


@dataclass
class GraphTools:
    """Answers of the six tools to an agent, from a collected neighbourhood (nodes: id -> row as dict; code: id or name -> text).

    The wording of the answers is fixed: prompts and recorded traces rely on it.
    """

    nodes: dict[str, dict]
    code: dict[str, str] = field(default_factory=dict)
    taint: Callable[[str], list[str]] = lambda fn: []

    def _id(self, fn: str) -> str | None:
        return fn if fn in self.nodes else min((i for i, n in self.nodes.items() if n["function_name"] == fn), default=None)

    def _callees(self, fn: str, node: dict) -> str:
        every = node.get("callees") or []
        outside = [x.removeprefix("external::") for x in every if x.startswith("external::")]
        inside = [x for x in every if not x.startswith("external::")]
        told = [f"{label} callees: " + ", ".join(names) for label, names in (("Internal", inside), ("External", outside)) if names]
        return "\n".join(told) or f"No callees found for '{fn}'."

    def _callers(self, fn: str, node: dict) -> str:
        return "Callers: " + ", ".join(node["callers"]) if node.get("callers") else f"No callers found for '{fn}' — may be an entry point."

    def _source(self, fn: str, node: dict) -> str:
        code = self.code.get(fn) or next((c for k, c in self.code.items() if k.endswith(f"::{fn}")), None)
        return f"Source of '{fn}':\n```\n{code}\n```" if code else f"Source not found for '{fn}'."

    def _entry(self, fn: str, node: dict) -> str:
        return f"'{fn}' is_entry_point: {bool(node.get('is_entry_point'))}"

    def _info(self, fn: str, node: dict) -> str:
        keys = ("callers", "callees", "is_entry_point", "is_taint_source", "is_taint_sink")
        return "\n".join(f"{k}: {node.get(k)}" for k in keys) if node else f"No node info for '{fn}'."

    def _taint(self, fn: str, node: dict) -> str:
        paths = self.taint(fn)
        if not paths:
            return f"No taint paths found involving '{fn}'. It may not be on a source→sink flow, or the graph has no entry points."
        return "\n".join([f"Taint paths through '{fn}':", *[f"  Path {i}: {p}" for i, p in enumerate(paths, 1)]])

    TOOLS = {"get_callees": _callees, "get_callers": _callers, "get_source": _source, "is_entry_point": _entry, "get_node_info": _info, "get_taint_path": _taint}

    def call(self, tool: str | None, args: dict) -> str:
        """What a tool answers; one that fails answers with its error."""
        if not tool or not self.nodes:
            return "Tool unavailable — no call graph loaded."
        try:
            fn = (args or {}).get("function_name", "")
            answer = self.TOOLS.get(tool)
            return answer(self, fn, self.nodes.get(self._id(fn) or "", {})) if answer else f"Unknown tool '{tool}'."
        except Exception as e:  # noqa: BLE001 - the agent goes on
            return f"Tool error: {e}"


def history_text(history: list[dict]) -> str:
    return "\n".join(f"Step {i}: {h.get('tool', '?')}({json.dumps(h.get('args', {}))})\nResult: {h.get('result', '')}\n" for i, h in enumerate(history, 1))


@dataclass
class Agent:
    """Reason, act, observe: at most `max_steps` tool calls, then one call that must answer. Sequential, as memory needs."""

    model: Model
    tools: GraphTools
    max_steps: int = MAX_STEPS
    rules: list[tuple[str, str, str]] = field(default_factory=lambda: AGENT_RULES)
    memory: dict[str, dict] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.memory)

    def vulnerable_count(self) -> int:
        return sum(bool(m["found"]) for m in self.memory.values())

    def run(self, sample: dict) -> dict:
        me = f"{sample.get('file_path') or ''}::{sample['function_name']}"
        node = self.tools.nodes.get(me, {})
        history = []
        prior = [self.memory[n] for n in [*(node.get("callers") or []), *(node.get("callees") or [])] if n in self.memory]
        if prior:
            said = [f"  {p['name']}: {'VULNERABLE (%s, %s)' % (p['cwe_id'], p['severity']) if p['found'] else 'clean'} — {p['summary']}" for p in prior]
            history.append({"tool": "memory", "args": {}, "result": "\n".join(["Prior findings for related functions:", *said])})
        report = None
        for step in range(self.max_steps + 1):
            if step == self.max_steps:
                history.append({"tool": "system", "args": {}, "result": f"Max steps ({self.max_steps}) reached. You MUST emit a final answer now."})
            text = self.model(json.dumps({"function": sample["function_name"], "code": sample.get("code"), "rules": rules_text(self.rules), "history": history_text(history) or "(none yet)"}))
            try:
                d = json.loads(without_fences(text))
            except ValueError:
                d = {}
            if isinstance(d, dict) and d.get("action") == "tool" and step < self.max_steps:
                result = self.tools.call(d.get("tool"), d.get("args") or {})
                history.append({"tool": d.get("tool"), "args": d.get("args") or {}, "result": result})
                self.trace.append({"node_id": me, "step": step + 1, "tool": d.get("tool"), "args": json.dumps(d.get("args") or {}), "result": result})
                continue
            if not (isinstance(d, dict) and d.get("action") == "tool"):
                report = parse_report(text, sample)
            break
        if report is None:
            report = parse_report("", sample) | {"explanation": NO_ANSWER, "error": "max_steps_exceeded"}
        report["analysis_mode"] = "react_loop"
        if not report["vulnerability_found"] and not report["confidence"] and not report["explanation"] and not report["error"]:
            report = parse_report(self.model(json.dumps({"function": sample["function_name"], "code": sample.get("code")})), sample) | {"analysis_mode": "react_loop_fallback"}
        self.memory[me] = {"name": sample["function_name"], "found": report["vulnerability_found"], "cwe_id": report["cwe_id"], "severity": report["severity"], "summary": (report["explanation"] or "")[:SUMMARY_CHARS]}
        return report
