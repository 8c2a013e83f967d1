"""Generated, minified, vendored and data files by the grammars of their token sequences (problem 2).

Each file becomes a token sequence: words of identifiers, numbers as one symbol, literals by their kind, line ends. A
Re-Pair grammar is inferred for every file (all files of a batch side by side: in a round each file's pairs are counted
and the locally most frequent ones that repeat are replaced everywhere at once). From the grammar come

* family: the most symbols that long rules the file uses again and again cover in one stretch. Machine-written families
  of accessors, tables and descriptors stand together; what people write repeats here and there;
* blob: the share of the text in literals that no grammar shortens (their own Re-Pair over characters saves next to
  nothing), and the number of bare values that stand in one row;
* shared: a second grammar over the file's code lines (comments and blanks left out), whose pairs are taken by their
  contents alone, so that a stretch yields the same rules, named by content hashes, in whatever file it stands. Rules that
  join one definition to the next, with SIDE or more lines of each, are counted over repositories. A file of START_LINES or
  more lines is copied in, whatever its head says, if MIN_REPOS or more repositories hold its start rule (all of its code),
  or rules under SHARED or more of its joints, MIN_JOINTS at least. Rules within one definition do not count: developers copy single functions from
  project to project, but not rows of them in one order;
* notes: the comment lines at the head of the file (all up to the first code) and after its last code. Those that state an
  origin mark generated and copied-in files. A copyright or licence line alone states none: its holder must not be the
  project itself, and the notes must give a release of what was copied.

Identifiers of one or two letters on lines without end mark minified text (its sequence has hardly any line ends). A file
in a folder for foreign code is copied in.

Null and empty texts are hand-written; a file of many rows is judged once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.core import cut

LONG, OFTEN, FAMILY, GAP, BLOB, BLOB_CHARS, VALUES, LISTED, MIN_REPOS = 8, 4, 120, 4, 0.35, 300, 60, 3, 3
START_LINES = 60  # fewer lines may agree by chance or habit
SHARED, MIN_JOINTS, SIDE = 0.25, 2, 3  # share and number of joints of definitions under shared rules; lines on either side of one
HEAD_LINES = 24  # among which comments at the margin count as the head's although code came before
BATCH_SYMBOLS, BLOCK_CHARS = 1_500_000, 1 << 20
_TOKEN = re.compile(
    r"(?P<nl>\n)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<num>\d[\w.]*)|(?P<word>[A-Za-z][a-z]*|_+)|(?P<op>[^\s\w])|(?P<other>\w+)"
)
_ROW = re.compile(r"(?=[\[({\d\"'-])(?:[\[({]?\s*+(?:-?(?:0[xX][0-9a-fA-F]++|\d[\d.]*+(?:[eE]-?\d++)?)[uUlLfF]*+|\"[^\"\n]{0,24}\"|'[^'\n]{0,24}')\s*+[\])}]?\s*+,\s*+){24,}")
_VALUE = re.compile(r"-?\d[\w.]*|\"[^\"]*\"|'[^']*'")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*KEY-----.*?(?:-----END [A-Z ]*KEY-----|\Z)", re.S)
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.){40,})\"|'((?:[^'\\\n]|\\.){40,})'|`([^`]{200,})`")
_NAME = re.compile(r"(?<![\w$\"'.])[A-Za-z_$][\w$]*")
# Folders for foreign code, fixed values.
_FOREIGN = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendor|vendored|third[_-]?party|3rdparty|extern|externals|deps|(?:contrib|src|lib)/bundled|(?:static|public|assets)/(?:libs?|vendors?))/")
# Statements of origin, fixed values: how tools and people say it.
_GENERATED = re.compile(
    r"(?i)@generated\b|\bgenerated (?:file|code|section) (?:ends?|starts?|begins?)\b|\b(?:end|start|begin(?:ning)?) of (?:the )?(?:auto-?)?generated (?:file|code|section)\b|<auto-?generated|\bauto-?generated (?:file|source|code|by|from|on)|\b(?:file|code|source|module|header|content)s? (?:is|was|has been|were|are)? ?(?:automatically |auto-?|machine )?generated (?:by|from|with|using|on)"
    r"|^\W*(?:code |file |source )?generated (?:by|from|with|automatically|on) |this is an? (?:auto-?|automatically |machine-?)?generated (?:source|file|code)|\bmachine[- ]generated ?:|automatically generated (?:from|by|on|file|source)|g[ée]n[ée]r[ée]e? (?:par|automatiquement|à partir|depuis|avec)|fichier g[ée]n[ée]r[ée]"
    r"|archivo (?:generado|producido|creado autom)|generado (?:por|autom|desde|a partir)|automatisch (?:erzeugt|generiert|erstellt)|(?:erzeugt|generiert) (?:aus|von|mit)\b|arquivo gerado|gerado (?:por|automaticamente)|сгенерирован|自动生成|自動生成|자동 생성"
)
_COPIED = re.compile(
    r"(?i)\bvendored (?:from|copy|at)|imported (?:unchanged|verbatim|as is|unmodified)|copied (?:unchanged|verbatim|unmodified)|unmodified copy|\bdistributed by the\b.*\b(?:project|under)\b|^\W*upstream:\s*\S|report to the upstream"
    r"|^\W*origin: .{1,40} release"
)
# Holders of rights and releases: evidence of copying only together, and only if the holder is not the project itself.
_HOLDER = re.compile(r"(?i)(?:\(c\)|copyright|filecopyrighttext:?)[\s\d,–-]*(?:\(c\)[\s\d,–-]*)?(?:the )?(?P<h>[\w .-]{2,60}?)[ ,]+(?:and )?(?:its )?(?:contributors|authors|developers|maintainers|project|team)\b")
_RELEASE = re.compile(r"(?i)^\W*@?version:?\s+v?\d+\.\d|\bv?\d+\.\d+\.\d+\b")
_BANNER = re.compile(r"(?i)^\W*(?P<h>[\w.-]+)\s+v\d+\.\d+\.\d+ \| ")
_DENIED = re.compile(
    r"(?i)\bnot (?:auto-?)?generated\b|generated (?:\w+ )?(?:files?|code|stubs?|client|types?|bindings?) (?:are|is|were|was|we|that|which|must|should)\b|-generated \w+ (?:we|that|which)\b|\b(?:writes?|checks?|detects?|skips?|finds?|removes?|replaces?|tests?|parses?|reads?|adds?|looks?|strips?|lists?|counts?|handles?|tells?|explains?)\b.{0,60}\b(?:generated|do not edit|vendor|minif|marker)"
    r"|hand[- ]?(?:written|maintained|kept)|by hand, edit|written by hand"
)
_SOURCE_NOTE = re.compile(r"^\s*(?://|#|/\*|\*)\s*(?:source: ?)?[\w./-]+\.[a-z]\w{0,9}:\d+\s*(?:\*/)?\s*$", re.M)
# A comment that is nothing but a line of a generator's input (schemas, grammars, templates): fixed suffixes.
_INPUT_NOTE = re.compile(r"\.(?:proto|idl|thrift|avdl|fbs|capnp|xsd|wsdl|y|yy|l|ll|g4|peg|tmpl|tpl|j2|mako|erb|in):\d+\s*(?:\*/)?\s*$")
_DESCRIPTOR = re.compile(r"=\s*b?[\"'](?:\\x[0-9a-fA-F]{2}){3,}[\w\\]*[\"']")


class Sequences:
    """Token sequences of the texts of a batch, as symbol numbers."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def of(self, text: str) -> list[int]:
        ids, out = self.ids, []
        if len(ids) > 2_000_000:
            ids.clear()
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "num":
                s = "0"
            elif kind == "str":
                v = m[0]
                s = '"x' if "\\x" in v else '"w' if len(v) < 60 else '"l'
            else:
                s = m[0]
            n = ids.get(s)
            if n is None:
                n = ids[s] = len(ids) + 1
            out.append(n)
        return out


def repair(seqs: list[np.ndarray], least: int = 2, spans: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair grammars of several sequences, each with its own counts.

    Returns (owner, symbol, length) of what is left of the sequences, `length` being the number of first symbols under one,
    and the number of rules of each sequence.
    A round replaces every pair that repeats in its sequence and is nowhere beside a more frequent one; where that leaves
    none, the most frequent one. Sequences in which no pair repeats are finished and leave the rounds. Every place of a rule
    of LONG or more first symbols is added to `spans` as (begin among all first symbols, length, places of the rule).
    """
    owner = np.repeat(np.arange(len(seqs), dtype=np.int64), [len(s) for s in seqs])
    sym = np.concatenate(seqs).astype(np.int64) if seqs else np.zeros(0, dtype=np.int64)
    length, start = np.ones(len(sym), dtype=np.int64), np.arange(len(sym))
    rules = np.zeros(len(seqs), dtype=np.int64)
    fresh = int(sym.max()) + 1 if len(sym) else 1
    done = []
    while len(sym) > 1:
        same = owner[1:] == owner[:-1]
        with np.errstate(over="ignore"):
            key = (sym[:-1] * np.int64(-7046029254386353131)) ^ (sym[1:] * np.int64(-4417276706812531889) + (owner[1:] << np.int64(20)))
        key[~same] = -1 - np.arange(int((~same).sum()))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        c = np.where(same, counts[inverse], 0)
        # in a run of one symbol only every other place counts
        place = np.arange(len(c))
        begins = np.r_[True, inverse[1:] != inverse[:-1]]
        c = np.where((place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 1, 0, c)
        before, after = np.r_[0, c[:-1]], np.r_[c[1:], 0]
        pick = (c >= least) & (c > before) & (c >= after)
        pick[1:] &= ~pick[:-1]
        at = np.flatnonzero(pick)
        used = np.bincount(inverse[at], minlength=len(counts))
        at = at[used[inverse[at]] >= least]
        busy = np.zeros(len(seqs), dtype=bool)
        busy[owner[at]] = True
        usable = np.flatnonzero(c >= least)
        usable = usable[~busy[owner[usable]]]
        if len(usable):
            rank = np.bincount(inverse[usable], minlength=len(counts))[inverse[usable]] * np.int64(len(counts)) + inverse[usable]
            best = np.full(len(seqs), np.int64(least) * len(counts))
            np.maximum.at(best, owner[usable], rank)
            more = usable[rank == best[owner[usable]]]
            more = more[np.bincount(inverse[more], minlength=len(counts))[inverse[more]] >= least]
            at = np.sort(np.r_[at, more])
            busy[owner[more]] = True
        if not len(at):
            break
        _, made, used = np.unique(inverse[at], return_inverse=True, return_counts=True)
        sym[at] = fresh + made
        rules += np.bincount(owner[at[np.unique(made, return_index=True)[1]]], minlength=len(seqs))
        length[at] += length[at + 1]
        if spans is not None:
            big = length[at] >= LONG
            spans.append((start[at[big]], length[at[big]], used[made[big]]))
        fresh += int(made.max()) + 1
        left = np.ones(len(sym), dtype=bool)
        left[at + 1] = False
        live = left & busy[owner]
        if not busy[owner[left]].all():
            over = left & ~busy[owner]
            done.append((owner[over], sym[over], length[over]))
        sym, length, owner, start = sym[live], length[live], owner[live], start[live]
    if done:
        owner, sym, length = (np.concatenate(x) for x in zip(*done, (owner, sym, length), strict=True))
        order = np.argsort(owner, kind="stable")
        owner, sym, length = owner[order], sym[order], length[order]
    return owner, sym, length, rules


def families(seqs: list[np.ndarray]) -> np.ndarray:
    """Of each sequence, the most symbols in one stretch under long rules that the sequence uses often.

    A rule's places within longer rules count. A stretch may be broken by GAP other symbols (the word that differs from
    member to member).
    """
    out = np.zeros(len(seqs))
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    repair(seqs, spans=spans)
    if not spans:
        return out.astype(np.int64)
    begin, length, used = (np.concatenate(x) for x in zip(*spans, strict=True))
    often = used >= OFTEN
    total = sum(map(len, seqs))
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, begin[often], 1)
    np.add.at(edge, begin[often] + length[often], -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(at):
        return out.astype(np.int64)
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])[at]
    new = np.r_[True, (np.diff(at) > GAP + 1) | (np.diff(owner) != 0)]
    np.maximum.at(out, owner[new], np.bincount(np.cumsum(new) - 1))
    return out.astype(np.int64)


def _incompressible(parts: list[str]) -> np.ndarray:
    """Of each literal, whether a grammar over its characters saves next to nothing (in bits, the rules included).

    Literals over BLOCK_CHARS are taken block by block, and the bits of the blocks added up.
    """
    if not parts:
        return np.zeros(0, dtype=bool)
    bits, plain = np.zeros(len(parts)), np.zeros(len(parts))
    blocks = [(k, p[at : at + BLOCK_CHARS]) for k, p in enumerate(parts) for at in range(0, len(p), BLOCK_CHARS)]
    while blocks:
        size, many = 0, 0
        while many < len(blocks) and size < 2 * BLOCK_CHARS:
            size, many = size + len(blocks[many][1]), many + 1
        now, blocks = blocks[:many], blocks[many:]
        which = np.array([k for k, _ in now])
        seqs = [np.frombuffer(p.encode("utf-16-le"), dtype=np.uint16).astype(np.int64) for _, p in now]
        owner, sym, _, rules = repair(seqs)
        left = np.bincount(owner, minlength=many)
        kinds = np.bincount(np.unique(np.stack([owner, sym]), axis=1)[0], minlength=many)
        n, alphabet = np.array([len(x) for x in seqs]), np.array([len(np.unique(x)) for x in seqs])
        np.add.at(bits, which, (left + 2 * rules) * np.log2(kinds + 2))
        np.add.at(plain, which, n * np.log2(alphabet + 1))
    return bits > 0.8 * plain


def blob_parts(text: str) -> tuple[list[tuple[int, str]], int]:
    """(size, characters to compress) of the literals that may be mere data, and the values in the longest row of bare values."""
    out, most = [], 0
    for m in _ROW.finditer(text):
        values = _VALUE.findall(m[0])
        most = max(most, len(values))
        out.append((len(m[0]), "".join(v[2:] if v[:2] in ("0x", "0X") else v.strip("\"'") for v in values)))
    bare = _KEY_BLOCK.sub(lambda m: " " * len(m[0]), text) if "KEY-----" in text else text
    for m in _LITERAL.finditer(bare):
        v = m[m.lastindex]
        if v.count(" ") > len(v) / 24:  # words
            continue
        out.append((len(v), v.replace("\\x", "") if "\\x" in v else v))
    return out, most


_CODE_LIKE = ("#include", "#define", "#if", "#pragma", "#ifndef", "#endif", "#!")
_BLOCK_COMMENT = re.compile(r"^[ \t]*/\*(?s:.*?)\*/[ \t\r]*$", re.M)
_HEAD_STRING = re.compile(r"\A(?:[ \t]*(?:#[^\n]*)?\n)*+(?:\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)''')")
_GUARD = re.compile(r"#!|#\s*(?:ifndef|define|pragma)\b|['\"]use strict['\"]")


def _is_note(line: str, s: str) -> bool:
    return s.startswith(("//", "#", "--", "<!--", "*")) and not s.startswith(_CODE_LIKE) and line[:1] not in " \t"


def head_notes(text: str) -> list[str]:
    """Comment lines before the first code, however many (after it, those that stand at the margin among the first lines)."""
    out, inside, code, at, no = [], "", False, 0, 0
    while at <= len(text) and (no < HEAD_LINES or not code or inside):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].replace("\r", "")
        at, no = end + 1, no + 1
        s = line.strip()
        if inside:
            if not code or no <= HEAD_LINES:
                out.append(s)
            elif no > HEAD_LINES:
                break
            if inside in s:
                inside = ""
        elif s.startswith("/*"):
            inside = "" if "*/" in s else "*/"
            out.append(s)
        elif s[:3] in ('"""', "'''"):
            inside = "" if len(s) > 5 and s.endswith(s[:3]) else s[:3]
            if line[:1] in "\"'":
                out.append(s)
        elif _is_note(line, s):
            out.append(s)
        elif s and not _GUARD.match(s):
            code = True
    return out


def tail_notes(text: str) -> list[str]:
    """Comment lines after the last code."""
    out, end = [], len(text.rstrip())
    while end > 0:
        at = text.rfind("\n", 0, end) + 1
        line = text[at:end].replace("\r", "")
        s = line.strip()
        if s.endswith("*/"):
            at = text.rfind("/*", 0, end)
            if at < 0 or text[text.rfind("\n", 0, at) + 1 : at].strip():
                break
            out += [x.strip() for x in text[at:end].split("\n")]
            at = text.rfind("\n", 0, at) + 1
        elif s and _is_note(line, s):
            out.append(s)
        elif s:
            break
        end = at - 1
    return out


# A line with which a definition begins that no other one holds.
_DEFINES = re.compile(
    r"(?:async )?def |class |function\b|(?:export |default |async )+(?:function|class|const|let)\b|(?:const|let|var) [\w$]+ = (?:async )?(?:function\b|\(|[\w$]+ =>)"
    r"|(?:struct|enum|union|namespace|template|typedef)\b|(?!(?:if|for|while|switch|return|else|do|import|from)\b)[\w][\w:<>,*&~ ]*\([^;]*\)[\w ]*\{?$"
)


def code_lines(text: str) -> tuple[list[str], list[int]]:
    """Code lines without comment lines, docstring at the head, blanks and indentation, and which of them begin definitions at the margin."""
    rows = _HEAD_STRING.sub("", _BLOCK_COMMENT.sub("", text)).split("\n")
    kept, starts = [], []
    for x in rows:
        s = x.strip()
        if s and not (s.startswith(("//", "#", "--", "<!--")) and not s.startswith(_CODE_LIKE)):
            if x[0] not in " \t" and _DEFINES.match(s):
                starts.append(len(kept))
            kept.append(" ".join(s.split()))
    return kept, starts


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair."""
    with np.errstate(over="ignore"):
        x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(7)))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))


def content_rules(lines: list[list[str]], starts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """Of each file, (rule, first, number) of the rules that hold joints, by the first of them and how many they are; the whole file's start rule as (rule, -1, 0).

    Joints are the starts of definitions but one in the first line, numbered in each file from 0.

    Runs of a symbol become one, then each pair that is less than its neighbours by its hash becomes a rule, until one symbol
    is left of every file. What becomes a pair depends on the symbols beside it and nothing else.
    """
    out: list[list[tuple[int, int, int]]] = [[(xxhash.xxh64_intdigest("\n".join(x)) - (1 << 63), -1, 0)] for x in lines]
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    if not len(owner):
        return out
    sym = np.array([xxhash.xxh64_intdigest(x) for one in lines for x in one], dtype=np.uint64)
    size = np.array([len(x) for x in lines])
    base = np.r_[0, np.cumsum(size)[:-1]]
    mark = np.zeros(len(sym) + 1, dtype=np.int64)
    for k, at in enumerate(starts):
        mark[base[k] + np.array([x for x in at if x], dtype=np.int64)] = 1
    upto = np.r_[0, np.cumsum(mark[:-1])]
    begin, length = np.arange(len(sym)), np.ones(len(sym), dtype=np.int64)

    def emit(fresh: np.ndarray) -> None:
        fresh = fresh[length[fresh] >= 2 * SIDE]
        o, b, e = owner[fresh], begin[fresh] + SIDE, begin[fresh] + length[fresh] - SIDE + 1
        first, many = upto[b] - upto[base[o]], upto[e] - upto[b]
        good = many > 0
        for k, *r in zip(o[good].tolist(), sym[fresh][good].view(np.int64).tolist(), first[good].tolist(), many[good].tolist(), strict=True):
            out[k].append(tuple(r))

    while True:
        before = len(sym)
        new = np.r_[True, (sym[1:] != sym[:-1]) | (owner[1:] != owner[:-1])]
        if not new.all():  # runs
            first = np.flatnonzero(new)
            many = np.diff(np.r_[first, len(sym)])
            total = np.add.reduceat(length, first)
            sym, owner, begin, length = sym[first], owner[first], begin[first], total
            run = np.flatnonzero(many > 1)
            sym[run] = _mix(sym[run], many[run].astype(np.uint64))
            emit(run)
        if len(sym) < 2:
            break
        inside = owner[1:] == owner[:-1]
        rank = _mix(sym[:-1], sym[1:]) >> np.uint64(1)
        rank[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
        pick = inside & (rank < np.r_[np.uint64(0xFFFFFFFFFFFFFFFF), rank[:-1]]) & (rank <= np.r_[rank[1:], np.uint64(0xFFFFFFFFFFFFFFFF)])
        at = np.flatnonzero(pick)
        sym[at] = _mix(sym[at], sym[at + 1])
        length[at] += length[at + 1]
        left = np.ones(len(sym), dtype=bool)
        left[at + 1] = False
        moved = np.zeros(len(sym), dtype=bool)
        moved[at] = True
        sym, owner, begin, length, moved = sym[left], owner[left], begin[left], length[left], moved[left]
        emit(np.flatnonzero(moved))
        if len(sym) == before:
            break
    return out


_RULE = pa.struct([("rule", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
_FIELDS = [
    ("file_path", pa.string()), ("repo", pa.string()), ("n_symbols", pa.int64()), ("n_chars", pa.int64()), ("family", pa.int64()), ("blob", pa.float64()), ("row_values", pa.int64()), ("name_len", pa.float64()),
    ("line_symbols", pa.float64()), ("listed", pa.int64()), ("says", pa.string()), ("joints", pa.int64()), ("rules", pa.list_(_RULE)),
]
_SCHEMA = "file_path string, repo string, n_symbols bigint, n_chars bigint, family bigint, blob double, row_values bigint, name_len double, line_symbols double, listed bigint, says string, joints bigint, rules array<struct<rule:bigint,at:bigint,n:bigint>>"


def _plain_name(s: str) -> str:
    return "-".join(re.findall(r"[^\W_]+", s.lower()))


def _own(holder: str, repo: str | None) -> bool:
    """Whether a named holder is the project that a repository is named for."""
    name, own = _plain_name(holder), _plain_name(repo or "")
    return not name or own == name or own.startswith(name + "-")


def _judge_notes(text: str, repo: str | None = None) -> list[str]:
    """'generated' or 'copied' for each note of a file that states an origin."""
    notes = [x for x in dict.fromkeys(head_notes(text) + tail_notes(text)) if not _DENIED.search(x)]
    kinds = ["generated" if _GENERATED.search(x) else "copied" if _COPIED.search(x) or (m := _BANNER.search(x)) and not _own(m["h"], repo) else "" for x in notes]
    foreign = any((m := _HOLDER.search(x)) and not _own(m["h"], repo) for x in notes)
    return [k for k in kinds if k] or ["copied"] * (foreign and any(_RELEASE.search(x) for x in notes))


def listed_inputs(text: str) -> int:
    """Comments that name a line of another file and literals of raw bytes given to names; one that names a generator's input is enough."""
    notes = _SOURCE_NOTE.findall(text)
    return LISTED if any(_INPUT_NOTE.search(x) for x in notes) else len(notes) + len(_DESCRIPTOR.findall(text))


def features(df: DataFrame) -> DataFrame:
    """One row a file and task: grammar features, content rules and stated origin of (repo, file_path, raw_content)."""
    src = df.select("file_path", "repo", "raw_content").where("file_path is not null and raw_content is not null and raw_content <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        make = Sequences()
        held: list[tuple[str, str | None, str, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            seqs = [s for *_, s in held]
            family = families(seqs)
            bare = [blob_parts(text) for *_, text, _s in held]
            parts = [(k, n, p) for k, (found_parts, _) in enumerate(bare) for n, p in found_parts]
            dull = _incompressible([p for *_, p in parts])
            blob = np.zeros(len(held))
            for (k, n, _), d in zip(parts, dull, strict=True):
                blob[k] += n * bool(d)
            kept = [code_lines(text) for *_, text, _s in held]
            big = [k for k, (x, _) in enumerate(kept) if len(x) >= START_LINES]
            rules = dict(zip(big, content_rules([kept[k][0] for k in big], [kept[k][1] for k in big]), strict=True))
            cols: list[list] = [[] for _ in _FIELDS]
            for k, (path, repo, text, seq) in enumerate(held):
                names = _NAME.findall(text)
                lines = sum(1 for x in text.split("\n") if x.strip()) or 1
                row = (path, repo, len(seq), len(text), int(family[k]), float(blob[k] / len(text)), bare[k][1], sum(map(len, names)) / max(1, len(names)), len(seq) / lines,
                       listed_inputs(text), max(_judge_notes(text, repo), default=None), sum(x > 0 for x in kept[k][1]), [{"rule": r, "at": x, "n": n} for r, x, n in rules.get(k, ())])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

        for batch in batches:
            paths, repos, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for path, repo, t in zip(paths, repos, texts, strict=True):
                if path in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(path)
                text = t.as_py()
                seq = np.array(make.of(text), dtype=np.int64)
                held.append((path, repo, text, seq))
                size += len(seq)
                if size >= BATCH_SYMBOLS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return src.mapInArrow(run, _SCHEMA)


def shared_joints(rules: DataFrame) -> DataFrame:
    """(file_path, whole, held) of (file_path, repo, rule, at, n): whether MIN_REPOS or more repositories hold a file's start rule, and its joints under rules they hold."""
    many = rules.select("rule", "repo").distinct().groupBy("rule").agg(F.count("*").alias("repos")).where(F.col("repos") >= MIN_REPOS).select("rule")
    places = F.when(F.col("at") >= 0, F.sequence("at", F.col("at") + F.col("n") - 1))
    held = F.array_distinct(F.flatten(F.collect_set(places)))  # a file's own, no more than its lines
    return rules.join(many, "rule", "left_semi").groupBy("file_path").agg(F.bool_or(F.col("at") < 0).alias("whole"), F.size(held).alias("held"))


def judged(df: DataFrame) -> DataFrame:
    """(file_path, repo, generated, minified, copied, data_only, hand_written) and the features of every file."""
    kept = [n for n, _ in _FIELDS if n != "file_path"]
    one = cut(features(df).groupBy("file_path").agg(F.min_by(F.struct(*kept), F.coalesce("repo", F.lit(""))).alias("f")).select("file_path", "f.*"))
    rules = one.select("file_path", F.coalesce("repo", F.lit("")).alias("repo"), F.explode("rules").alias("r")).select("file_path", "repo", "r.*")
    f = one.drop("rules").join(shared_joints(rules), "file_path", "left").withColumn("shared", F.coalesce(F.try_divide("held", "joints"), F.lit(0.0)))
    says = lambda kind: F.coalesce(F.col("says") == kind, F.lit(False))
    f = f.withColumn("generated", says("generated") | ((F.col("family") >= FAMILY) & (F.col("row_values") < VALUES)) | (F.col("listed") >= LISTED))
    f = f.withColumn("minified", (F.col("name_len") < 5.2) & (F.col("line_symbols") > 40))
    f = f.withColumn("copied", says("copied") | F.coalesce(F.col("whole") | ((F.col("shared") >= SHARED) & (F.col("held") >= MIN_JOINTS)), F.lit(False)) | F.col("file_path").rlike(_FOREIGN.pattern))
    f = f.withColumn("data_only", ((F.col("blob") >= BLOB) & (F.col("blob") * F.col("n_chars") >= BLOB_CHARS)) | (F.col("row_values") >= VALUES))
    return f.withColumn("hand_written", ~(F.col("generated") | F.col("minified") | F.col("copied") | F.col("data_only"))).drop("says", "whole", "held")


def found(df: DataFrame) -> DataFrame:
    return judged(df).where("not hand_written").select("file_path")
