"""Grammars of token sequences and what they tell about files."""

import base64
import random

import numpy as np
import pytest

from codeweft.llm import provenance as P

R = random.Random(11)
WORDS = ["frame", "ledger", "socket", "bundle", "region", "voucher", "matrix", "pivot", "carrier", "signal", "tunnel", "window"]


def hand(n=30, seed=0):
    r = random.Random(seed)
    w = lambda: r.choice(WORDS) + "_" + r.choice(WORDS)
    lines = [r.choice([f"    {w()} = {w()}.{r.choice(WORDS)}", f"    if {w()} > {r.randint(1, 99)}:\n        {w()}({w()}, '{r.choice(WORDS)} {r.choice(WORDS)}')", f"    {w()}.append({w()}[{r.randint(0, 9)}])", f"    return {w()}"]) for _ in range(n)]
    return f"import os\n\n\ndef {w()}({w()}):\n" + "\n".join(lines) + "\n"


ACCESSORS = "".join(f"int get_{R.choice(WORDS)}_{i}(Msg& m) {{ return m.f[{i}]; }}\nvoid set_{R.choice(WORDS)}_{i}(Msg& m, int v) {{ m.f[{i}] = v; }}\n" for i in range(20))
TABLE = "_STATES = [" + ", ".join(str(R.randint(-99, 400)) for _ in range(200)) + "]\n" + hand()
DATA = "def rows():\n    return [\n" + "".join("        " + ", ".join(str(R.randint(1, 99999)) for _ in range(10)) + ",\n" for _ in range(20)) + "    ]\n"
BLOB = 'def blob():\n    return (\n' + "".join(f'        "{base64.b64encode(R.randbytes(57)).decode()}"\n' for _ in range(12)) + "    )\n"
MINIFIED = "function a_(b,c){" + "".join(f"let d{i}=b?.x{i};if (!c)return null;c.p(d{i},{i});" for i in range(40)) + "}\n"
OTHER = {
    "generated": ["# Code generated by protoc-x v1.2.3. DO NOT EDIT.\n", "// Fichier généré par l'outil, ne pas modifier\n", "/*\n * This file was automatically generated from a.b. Do not modify it by hand.\n */\n", "// @generated by tool\n"],
    "copied": ["// Vendored from https://x.example/src at revision 72441ba082e2.\n", "/*\n * ! libx v1.13.3 | (c) libx contributors | MIT\n * upstream: https://x.example/\n */\n", '"""This is a copy of libx 1.5, imported unchanged from upstream.\nDo not patch here.\n"""\n'],
    "hand": ["# Not generated: this is kept by hand, edit freely.\n", "# Checks that generated files are skipped by tenant.\n", "# Writes the DO NOT EDIT marker into the files of the tool.\n", "# Minifies nothing; keeps session readable.\n", "# Replaces the protobuf-generated stub we used before; hand written since 2.0.\n",
             "# Copyright (c) the x project team. Internal use.\n# Licensed under the terms in LICENSE.\n", "# Part of x. See LICENSE in the top folder.\n", "CODES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]\n", 'SQL = "SELECT ' + ", ".join(WORDS * 8) + '"\n', 'pixel = "data:image/png;base64,' + base64.b64encode(R.randbytes(60)).decode() + '"\n'],
}


def test_repair_covers_and_keeps_lengths():
    r = np.random.default_rng(0)
    seqs = [np.array([1, 2, 3, 4] * 50), r.integers(0, 1000, 300), np.array([7]), np.array([5] * 33), np.zeros(0, dtype=np.int64)]
    owner, sym, length, rules = P.repair(seqs)
    for k, s in enumerate(seqs):
        assert length[owner == k].sum() == len(s)
    assert (owner == 0).sum() < 20 and (owner == 1).sum() > 250 and rules[0] >= 3


def test_grammars_do_not_depend_on_the_batch():
    texts = [hand(seed=i) for i in range(6)] + [ACCESSORS, TABLE]
    make = P.Sequences()
    seqs = [np.array(make.of(t)) for t in texts]
    together = P.families(seqs)
    assert [int(P.families([s])[0]) for s in seqs] == together.tolist()
    assert together[6] >= P.FAMILY and max(together[:6]) < P.FAMILY / 2


def test_incompressible():
    parts = [base64.b64encode(R.randbytes(300)).decode(), "abc" * 100, "0" * 400, "".join(str(R.randint(0, 9)) for _ in range(800))]
    assert P._incompressible(parts).tolist() == [True, False, False, True]


def test_literals_are_judged_whole():
    r = random.Random(5)
    packed = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=600_000))
    assert P._incompressible(["A" * 70_000 + packed, packed[:70_000] + "AB" * 600_000]).tolist() == [True, False]


def test_grammars_are_finished():
    r = np.random.default_rng(3)
    seqs = [r.integers(0, 4, 3000), r.integers(0, 60, 2000), np.array([1, 2] * 40_000), np.array([1, 2, 3] * 5), np.array([9] * 17)]
    owner, sym, length, _ = P.repair(seqs)
    for k, s in enumerate(seqs):
        x = sym[owner == k].tolist()
        pairs, last = {}, None
        for i, p in enumerate(zip(x, x[1:], strict=False)):
            if p == last and i - 1 == at:  # the middle of a run
                last = None
                continue
            pairs[p], last, at = pairs.get(p, 0) + 1, p, i
        assert length[owner == k].sum() == len(s) and max(pairs.values(), default=0) < 2


@pytest.fixture(scope="module")
def verdict(spark):
    files = {"a/acc.cpp": ACCESSORS, "a/table.py": TABLE, "a/data.py": DATA, "a/blob.py": BLOB, "a/min.js": MINIFIED, "x/node_modules/y/z.js": hand(seed=5), "static/libs/q-1.2/f.py": hand(seed=6), "src/vendor-01/minify.py": hand(seed=7), "e.py": "", "n.py": None}
    for kind, heads in OTHER.items():
        for i, h in enumerate(heads):
            files[f"{kind}/{i}.py"] = h + "\n" + hand(seed=100 + i)
    rows = [(p, p.split("/")[0], t, "c") for p, t in files.items()] + [("a/acc.cpp", "a", ACCESSORS, "again"), (None, "a", BLOB, "x")]
    df = spark.createDataFrame(rows, "file_path string, repo string, raw_content string, notes string").repartition(4)
    return {r.file_path: r for r in P.judged(df).collect()}, {r.file_path for r in P.found(df).collect()}


def test_kinds(verdict):
    by, found = verdict
    assert by["a/acc.cpp"].generated and by["a/table.py"].data_only and by["a/data.py"].data_only and by["a/blob.py"].data_only and by["a/min.js"].minified
    assert by["x/node_modules/y/z.js"].copied and by["static/libs/q-1.2/f.py"].copied
    assert all(by[p].generated for p in by if p.startswith("generated/")) and all(by[p].copied for p in by if p.startswith("copied/"))
    assert not any(p.startswith(("hand/", "src/")) for p in found) and "e.py" not in found
    assert found == {p for p, r in by.items() if not r.hand_written}


LICENSE = "".join(f"// Clause {i}: redistribution is permitted, conditions {i} apply.\n" for i in range(180))


@pytest.mark.parametrize("note", ["Code generated by protoc-x v1.2.3. DO NOT EDIT.", "Vendored from https://x.example/src at revision 72441ba082e2."])
def test_notes_below_a_long_licence_and_at_the_foot(note):
    body = "#include <a.h>\n" + hand(60)
    block = "/*\n" + LICENSE.replace("// ", " * ") + " */\n"
    for text in (LICENSE + f"// {note}\n" + body, block + f"/* {note} */\n" + body, body + f"\n// {note}\n\n", body + f"/*\n * x\n * {note}\n */\n", body + f"# {note}\r\n"):
        assert len(P._judge_notes(text)) == 1
    assert not P._judge_notes(body + f"    # {note}\n" + body) and not P._judge_notes(LICENSE + body)


def test_copies_in_several_repositories(spark):
    """Marked whatever their heads say; copies in two repositories and short ones are not."""
    lib, two, short = hand(80, seed=50), hand(80, seed=51), hand(8, seed=52)
    heads = ["", "# Grown in the lab.\n# Second line.\n\n", '"""Some words.\n\nMore of them.\n"""\n\n']
    files = [(f"r{i}/lib.py", f"r{i}", h + lib) for i, h in enumerate(heads)] + [(f"r{i}/short.py", f"r{i}", short) for i in range(3)] + [(f"r{i}/{n}.py", f"r{i}", two) for i in range(2) for n in "ab"]
    df = spark.createDataFrame(files, "file_path string, repo string, raw_content string").repartition(3)
    assert {r.file_path for r in P.found(df).collect()} == {"r0/lib.py", "r1/lib.py", "r2/lib.py"}


def library(n, seed):
    return "import os\n\n" + "\n".join(hand(9, seed=seed * 1000 + i).split("\n\n\n")[1] for i in range(n))


def test_changed_copies_share_rules(spark):
    """A file of many definitions in several repositories without a note, each copy changed in places; single functions in common are no copy."""
    r = random.Random(8)
    lib, fns = library(60, 1), [hand(30, seed=700 + i).split("\n\n\n")[1] for i in range(6)]
    files = []
    for k in range(8):
        lines = lib.split("\n")
        for _ in range(3):
            lines[r.randrange(len(lines))] = f"    changed_{k} = {r.random()}"
        files.append((f"r{k}/lib.py", f"r{k}", "\n".join(lines)))
        files.append((f"r{k}/own.py", f"r{k}", library(4, 50 + k) + fns[k % 6] + library(4, 80 + k) + fns[(k + 2) % 6] + library(4, 110 + k)))
    files += [(f"r{k}/two.py", f"r{k}", library(40, 3)) for k in range(2)]
    d = spark.createDataFrame(files, "file_path string, repo string, raw_content string").repartition(5)
    got = {x.file_path: x for x in P.judged(d).collect()}
    assert {p for p, x in got.items() if not x.hand_written} == {f"r{k}/lib.py" for k in range(8)}
    assert min(got[f"r{k}/lib.py"].shared for k in range(8)) > 2 * P.SHARED and max(x.shared for p, x in got.items() if "lib" not in p) == 0


def test_rules_depend_on_contents_alone():
    a, b, c = (P.code_lines(library(12, k)) for k in (5, 6, 7))
    alone = [P.content_rules([x], [at])[0] for x, at in (a, b, c)]
    assert P.content_rules([a[0], b[0], c[0]], [a[1], b[1], c[1]]) == alone and P.content_rules([], []) == []
    runs = P.content_rules([["0,"] * 500, ["x"]], [[3, 9], []])
    assert runs[0][0][1:] == (-1, 0) and len(runs[1]) == 1


@pytest.mark.parametrize(
    ("note", "kinds"),
    [("# (c) 2024 Harbor contributors", []), ("# @license MIT", []), ("# SPDX-FileCopyrightText: 2024 Harbor Gateway authors", []), ("# harbor-gateway v1.2.3 | MIT", []), ("# (c) 2021 the fjordkit authors", []),
     ("# @name fjordkit\n# @version 1.17.5\n# @license BSD-3-Clause, (c) the fjordkit authors", ["copied"]), ("# fjordkit v1.17.5 | MIT", ["copied"]), ("# (c) Harbor contributors\n# version 1.0.2", [])],
)
def test_holders(note, kinds):
    assert P._judge_notes(note + "\n" + hand(), "harbor-gateway") == kinds


@pytest.mark.parametrize(("line", "listed"), [("    # utils.c:12", False), ("    mark = '\\x01\\x02\\x03\\x04'", False), ("    # socket.proto:53", True)])
def test_lone_signs(line, listed):
    assert (P.listed_inputs(hand() + line + "\n" + hand(seed=3)) >= P.LISTED) == listed


def test_empty(spark):
    assert P.found(spark.createDataFrame([], "file_path string, repo string, raw_content string")).count() == 0


@pytest.mark.parametrize(("note", "yes"), [("# generated file ends here", True), ("# end of generated code", True), ("# end of the code that reads generated files", False), ("# Checks that generated files are skipped at the end of the run.", False)])
def test_generated_sections_said_at_the_foot(note, yes):
    assert bool(P._judge_notes(hand(40) + "\n" + note + "\n")) == yes
