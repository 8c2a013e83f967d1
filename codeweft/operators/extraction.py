"""Functions, imports, routes and calls of source files.

files(file_path, language, content): null or empty contents give no rows; a file that doesn't parse gives what can be
found in it; over-long functions are left out but what they hold is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.source_tokens import call_names, find_functions
from codeweft.schemas import FUNCTION

SUPPORTED = ["python", "javascript", "c", "cpp"]
MAX_LINES = 200
# Import and route patterns, fixed values.
REQUIRE = r"""(?U)const\s+(\w+)\s*=\s*require\(["'](.+?)["']\)"""
IMPORT = r"""(?U)import\s+(\w+)\s+from\s+["'](.+?)["']"""
ROUTE = r"(?s)router\.(get|post|put|delete)\((.+?)\)"


def mask_nested(body: bytes, children: list[tuple[int, int, str]]) -> bytes:
    """A function's bytes with its direct children replaced by a marker; the number of lines stays."""
    out, at = [], 0
    for a, b, name in sorted(children):
        out.append(body[at:a])
        out.append(f"/* --- nested method '{name}' analyzed separately --- */".encode() + b"\n" * body[a:b].count(b"\n"))
        at = b
    return b"".join(out) + body[at:]


class OpenSpans:
    """Spans (start, end, name) that pass by start, the longest first: gives for each the names of those that hold it with none in between.

    Only spans that may still hold others are kept. Equal ones don't hold each other.
    """

    def __init__(self) -> None:
        self.around: list[tuple] = []

    def holders(self, start: int, end: int, name) -> list:
        around = self.around
        while around and around[-1][1] < start:
            around.pop()
        held: list[tuple] = []
        for x in reversed(around):  # what lies within a span comes after it
            if x[1] >= end and x[:2] != (start, end) and (not held or x[1] < held[-1][1] or x[:2] == held[-1][:2]):
                held.append(x)
        around.append((start, end, name))
        return [x[2] for x in held]


def functions_of(content: str, language: str, max_lines: int = MAX_LINES) -> list[dict]:
    """Rows of one file. Bodies hold their own source; nested functions that have rows of their own are masked."""
    raw = content.encode("utf-8", "replace")
    offsets = None if content.isascii() else [0]
    if offsets is not None:
        for c in content:
            offsets.append(offsets[-1] + len(c.encode("utf-8", "replace")))
    byte = (lambda i: i) if offsets is None else (lambda i: offsets[i])
    kept = []
    for f in find_functions(content, language):
        a, b = content.count("\n", 0, f.start) + 1, content.count("\n", 0, f.end) + 1
        if b - a + 1 <= max_lines:
            kept.append((byte(f.start), byte(f.end), f.name, a, b, content[f.start : f.end]))
    children: list[list[int]] = [[] for _ in kept]
    spans = OpenSpans()
    for k in sorted(range(len(kept)), key=lambda k: (kept[k][0], -kept[k][1])):
        for j in spans.holders(*kept[k][:2], k):
            children[j].append(k)
    rows = []
    for pos, (s, e, name, a, b, text) in enumerate(kept):
        code = mask_nested(raw[s:e], [(kept[k][0] - s, kept[k][1] - s, kept[k][2]) for k in children[pos]]).decode("utf-8", "replace")
        calls = [{"pos": i, "raw_call": c} for i, c in enumerate(call_names(text, language))]
        rows.append({"function_name": name, "start_line": a, "end_line": b, "start_byte": s, "end_byte": e, "pos": pos, "line_count": b - a + 1, "code": code, "calls": calls})
    return rows


def extract_functions(files: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """One row for each named function of at most `max_lines` lines, in the order of the file."""
    src = files.where(F.col("language").isin(*SUPPORTED)).select("file_path", "language", "content")
    names = [f.name for f in FUNCTION.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, content in zip(frame["file_path"], frame["language"], frame["content"], strict=True):
                if content:
                    rows += [{"file_path": path, "language": language} | r for r in functions_of(content, language, max_lines)]
            yield pd.DataFrame(rows, columns=names)

    return src.mapInPandas(run, FUNCTION)


def _found(text: Column, pattern: str) -> Column:
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))
    return F.transform(zipped, lambda x: F.struct(x["0"].alias("alias"), x["1"].alias("source")))


def imports(files: DataFrame) -> DataFrame:
    """(file_path, pos, alias, source): all require matches first, then all import matches."""
    text = F.coalesce(F.col("content"), F.lit(""))
    both = F.concat(_found(text, REQUIRE), _found(text, IMPORT))
    return files.select("file_path", F.posexplode(both).alias("pos", "i")).select("file_path", "pos", "i.alias", "i.source")


def routes(files: DataFrame) -> DataFrame:
    """(file_path, pos, method, path, handlers) of every file, also of those without functions."""
    text = F.coalesce(F.col("content"), F.lit(""))
    each = F.arrays_zip(F.regexp_extract_all(text, F.lit(ROUTE), F.lit(1)), F.regexp_extract_all(text, F.lit(ROUTE), F.lit(2)))
    r = files.select("file_path", F.posexplode(each).alias("pos", "r")).select("file_path", "pos", F.upper(F.col("r")["0"]).alias("method"), F.split(F.col("r")["1"], ",").alias("p"))
    parts = F.transform("p", lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return r.select("file_path", "pos", "method", F.regexp_replace(parts[0], "[\"']", "").alias("path"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("handlers"))


def with_file_context(functions: DataFrame, imps: DataFrame, rts: DataFrame) -> DataFrame:
    """Functions with their file's imports and routes as arrays (empty where there are none)."""
    i = imps.groupBy("file_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "alias", "source"))), lambda x: F.struct(x["alias"].alias("alias"), x["source"].alias("source"))).alias("imports"))
    r = rts.groupBy("file_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "method", "path", "handlers"))), lambda x: F.struct(x["method"].alias("method"), x["path"].alias("path"), x["handlers"].alias("handlers"))).alias("routes"))
    return functions.join(i, "file_path", "left").join(r, "file_path", "left")


def nested_direct(spans: DataFrame) -> DataFrame:
    """(file_path, outer, inner) of spans(file_path, id, sb, eb): contained, with nothing contained in between.

    A file's spans pass by in order; only those still open are held. Rows with a null are left out.
    """
    src = spans.select("file_path", "id", "sb", "eb").dropna()
    kinds = {c: src.schema[c].dataType.simpleString() for c in ("file_path", "id")}
    placed = src.repartition("file_path").sortWithinPartitions("file_path", "sb", F.desc("eb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, open_spans = None, OpenSpans()
        for f in frames:
            out = []
            for p, i, s, e in zip(f["file_path"], f["id"], f["sb"], f["eb"], strict=True):
                if p != path:
                    path, open_spans = p, OpenSpans()
                out += [(p, j, i) for j in open_spans.holders(s, e, i)]
            yield pd.DataFrame(out, columns=["file_path", "outer", "inner"])

    return placed.mapInPandas(run, f"file_path {kinds['file_path']}, outer {kinds['id']}, inner {kinds['id']}")
