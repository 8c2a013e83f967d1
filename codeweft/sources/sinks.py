"""Result documents: JSON, DOT, HTML, reports.

Rows are aggregated by Spark; a document itself is one file of one project and is written by the driver, row by row from
an iterator, so that it never stands in memory as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.results import ROLE_COLOURS, SEVERITY_COLOURS_DOT

SCHEMA_VERSION = "1.0"
EXTRACTION_COLUMNS = ["file_path", "function_name", "language", "start_line", "end_line", "code"]


def _rows(df: DataFrame) -> Iterable[str]:
    for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield r.j


def _document(path: str, head: dict, key: str, rows: Iterable[str], keyed: bool = False) -> str:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False)[:-1] + (", " if head else "") + json.dumps(key) + (": {" if keyed else ": ["))
        for i, r in enumerate(rows):
            f.write((",\n" if i else "\n") + r)
        f.write("}}" if keyed else "]}")
    return str(target)


def save_extraction(functions: DataFrame, source: str, path: str, at: str) -> str:
    """K1. `at`: time of the run, a parameter so that documents can be compared."""
    n = functions.count()
    order = [c for c in ("file_ord", "pos") if c in functions.columns] or ["file_path"]
    return _document(path, {"schema_version": SCHEMA_VERSION, "source_path": source, "extracted_at": at, "function_count": n}, "functions", _rows(functions.orderBy(*order).select(*EXTRACTION_COLUMNS)))


def save_call_graph(graph: DataFrame, path: str, at: str) -> str:
    """K2: nodes keyed by id."""
    rows = (f"{json.dumps(r.id)}: {r.j}" for r in graph.select("id", F.to_json(F.struct(*[c for c in graph.columns if c != "id"]), {"ignoreNullFields": "false"}).alias("j")).orderBy("id").toLocalIterator())
    return _document(path, {"schema_version": SCHEMA_VERSION, "generated_at": at}, "nodes", rows, keyed=True)


def save_run(findings: DataFrame, summary: dict, run_id: str, path: str, at: str, meta: dict | None = None) -> str:
    """K3. findings in their order, lines clamped and duplicates numbered by the caller."""
    head = {"schema_version": SCHEMA_VERSION, "run_id": run_id, "created_at": at, "summary": summary} | ({"meta": meta} if meta else {})
    return _document(path, head, "findings", _rows(findings))


def save_patches(patches: DataFrame, run_id: str, path: str, at: str) -> str:
    """K4."""
    r = patches.agg(F.count("*").alias("n"), F.count_if(F.coalesce("patch_valid", F.lit(False))).alias("v")).first()
    return _document(path, {"schema_version": SCHEMA_VERSION, "run_id": run_id, "created_at": at, "total": r.n, "valid": r.v, "invalid": r.n - r.v}, "patches", _rows(patches))


def save_evaluation(report: dict, verdicts: DataFrame, path: str) -> str:
    """K5: measures rounded to four places as Python rounds, then the instances."""
    head = {k: round(v, 4) if isinstance(v, float) else v for k, v in report.items()}
    return _document(path, {"schema_version": SCHEMA_VERSION} | head, "instances", _rows(verdicts.orderBy("gt_ord")))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line) of a graph description: internal nodes by role (from `overlay`), links between declared nodes."""
    colour = F.coalesce(F.create_map(*[F.lit(x) for k, v in SEVERITY_COLOURS_DOT.items() for x in (f"vulnerable_{k}", v)])[F.col("role")],
                        F.create_map(*[F.lit(x) for kv in (("taint_sink", "lightcoral"), ("taint_source", "lightgreen"), ("entry_point", "lightblue"), ("infrastructure", "khaki")) for x in kv])[F.col("role")], F.lit("white"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    own = nodes.where("not is_external")
    file = F.element_at(F.split("file_path", "/"), -1)
    n = own.select(F.lit(1).alias("part"), "id", F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(F.concat("function_name", F.lit(" ("), file, F.lit(")"))), F.lit(", fillcolor="), colour, F.lit("];")).alias("line"))
    ids = own.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = inside.select(F.lit(2).alias("part"), F.concat("src", F.lit(" "), "dst").alias("id"), F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(";")).alias("line"))
    return n.unionByName(e)


def export_dot(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """K6."""
    with Path(path).open("w", encoding="utf-8") as f:
        f.write("digraph calls {\n  rankdir=LR;\n  node [shape=box, style=filled];\n")
        for r in dot_lines(nodes, edges).orderBy("part", "id").toLocalIterator():
            f.write(r.line + "\n")
        f.write("}\n")
    return path


_PAGE = """<!doctype html><meta charset="utf-8"><title>Call graph</title>
<style>body{font:13px sans-serif;margin:1em}#n div{padding:2px 6px;margin:1px;border-radius:3px}.dim{opacity:.15}input{width:24em}</style>
<p><input id=q placeholder="filter by name"> <span id=l></span></p><div id=n></div><script>
const N=%s,E=%s,C=%s,box=document.getElementById('n'),el={};
document.getElementById('l').innerHTML=Object.entries(C).map(([k,v])=>`<span style="background:${v}">&nbsp;${k}&nbsp;</span>`).join(' ');
for(const x of N){const d=document.createElement('div');d.style.background=C[x.role]||C.default;d.textContent=`${x.name}  in ${x.file}  (${x.callers} callers, ${x.callees} callees)`;d.title=x.id;d.onclick=()=>mark(x.id);el[x.id]=d;box.append(d)}
function mark(id){let s=new Set([id]);for(let k=0;k<2;k++){const t=new Set(s);for(const[a,b]of E){if(s.has(a))t.add(b);if(s.has(b))t.add(a)}s=t}for(const k in el)el[k].className=s.has(k)?'':'dim'}
document.getElementById('q').oninput=e=>{for(const x of N)el[x.id].className=x.name.includes(e.target.value)?'':'dim'};
</script>"""


def html_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7v: (id, name, file, role, callers, callees) of internal nodes and the links among them."""
    own = nodes.where("not is_external").select("id", F.col("function_name").alias("name"), F.element_at(F.split("file_path", "/"), -1).alias("file"), "role", F.size("callers").alias("callers"), F.size("callees").alias("callees"))
    inside = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    return own, inside.select("src", "dst")


def export_html(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """K7: one self-contained page of one project's graph; click marks two degrees around a node, the field filters."""
    n, e = html_view(nodes, edges)
    js = lambda x: json.dumps(x).replace("</", "<\\/")
    colours = iter([js(ROLE_COLOURS)])
    rows = [(js(r.asDict()) for r in n.orderBy("id").toLocalIterator()), (js([r.src, r.dst]) for r in e.toLocalIterator()), colours]
    with Path(path).open("w", encoding="utf-8") as f:  # a row at a time
        for i, (text, values) in enumerate(zip(_PAGE.split("%s"), [*rows, ()], strict=True)):
            f.write(text + "[" * (i < 2))
            for k, v in enumerate(values):
                f.write("," * (k > 0) + v)
            f.write("]" * (i < 2))
    return path


def run_report(findings: DataFrame, only_vulnerable: bool = False) -> DataFrame:
    """(finding_ord, line) of a console report; explanations are cut to 120 characters."""
    f = findings.where("vulnerability_found") if only_vulnerable else findings
    mark = F.when(F.coalesce("vulnerability_found", F.lit(False)), F.concat(F.lit("VULN  "), F.upper(F.coalesce("severity", F.lit("?"))), F.lit(" "), F.coalesce("cwe_id", F.lit("?")))).otherwise("clean")
    return f.select("finding_ord", F.concat(mark, F.lit("  "), F.coalesce("function_name", F.lit("?")), F.lit(" ("), F.coalesce("file_path", F.lit("?")), F.lit(") "), F.substring(F.coalesce("explanation", F.lit("")), 1, 120)).alias("line"))


def comparison_table(rows: list[dict]) -> str:
    """Markdown table of runs; numbers as Python formats them."""
    head = ["run_id", "analysis_mode", "precision", "recall", "f1", "cwe_accuracy", "hallucination_rate", "unique_recall"]
    show = lambda v: f"{v:.2f}" if isinstance(v, float) else str(v if v is not None else "-")
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(show(r.get(h)) for h in head) + " |" for r in rows]])


def dataset_of(path: str) -> str | None:
    """The folder after `datasets`."""
    m = re.search(r"(?:^|/)datasets/([^/]+)", path.replace("\\", "/"))
    return m[1] if m else None
