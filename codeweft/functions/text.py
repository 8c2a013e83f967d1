"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix -> language, fixed values.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp",
}
# Folders a scan leaves out, fixed values.
SKIP_DIRS = ["node_modules", ".git", "__pycache__", "vendor", "dist", "build", ".next", "coverage", ".venv", "venv"]
# Name patterns of the call graph, fixed values.
ENTRY_PATH = ["controller", "route", "middleware", "api"]
ENTRY_NAME = ["handler", "route", "endpoint", "controller", "main"]
INFRASTRUCTURE = ["execute", "query", "connect", "disconnect"]
SINK_NAME = ["execute", "exec_query", "run_query", "run_command", "eval", "shell_exec"]
SINK_EXTERNAL = ["execute", "query", "eval", "exec", "system", "popen", "spawn", "shell", "run_command", "subprocess", "write_file", "write", "send_response"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def language_of(path: Column | str) -> Column:
    """Language by suffix, 'unknown' where none fits; a null path gives 'unknown'."""
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[suffix(path)], F.lit("unknown"))


def in_skipped_folder(path: Column | str, skip: list[str] = SKIP_DIRS) -> Column:
    return F.arrays_overlap(F.split(_col(path), "/"), F.array(*[F.lit(s) for s in skip]))


def node_id(path: Column | str, name: Column | str) -> Column:
    return F.concat(F.coalesce(_col(path), F.lit("")), F.lit("::"), _col(name))


def contains_any(text: Column | str, words: list[str]) -> Column:
    """Case-insensitive: the text holds one of the words."""
    import re

    return F.lower(_col(text)).rlike("|".join(re.escape(w) for w in words))


def last_segment(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", -1)


def norm_path(path: Column | str) -> Column:
    """Forward slashes, lower case, no leading slash."""
    return F.regexp_replace(F.lower(F.replace(_col(path), F.lit("\\"), F.lit("/"))), "^/+", "")


def normalize_cwe(c: Column | str) -> Column:
    """'CWE-n' from cwe-n or n; empty is null; other text is trimmed."""
    c = _col(c)
    s = F.trim(c)
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(F.upper(s).startswith("CWE-"), F.concat(F.lit("CWE-"), F.substring(s, 5, 1_000_000))).when(
        s.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), s)
    ).otherwise(s)


def strip_fences(c: Column | str) -> Column:
    """Text without the ``` lines, if it begins with one; trimmed."""
    t = F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")
    kept = F.array_join(F.filter(F.split(t, r"\r\n|[\n\r]"), lambda x: ~x.startswith("```")), "\n")
    return F.when(t.startswith("```"), F.regexp_replace(kept, r"(?U)^\s+|\s+$", "")).otherwise(t)


def missing(c: Column | str) -> Column:
    """Null for null or empty text."""
    return F.nullif(_col(c), F.lit(""))


def without_fences(text: str) -> str:
    """A model's answer without the code fence around it."""
    text = text.strip()
    return "\n".join(x for x in text.splitlines() if not x.startswith("```")).strip() if text.startswith("```") else text
