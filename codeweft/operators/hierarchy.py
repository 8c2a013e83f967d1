"""Parent-child links of unknown depth: roots, paths, depths, descendants and cycles by contraction.

The graph is contracted in rounds. A round rakes nodes at an end (their links are recorded) and compresses nodes with
exactly one parent and one child (the two links become one). Neighbouring unary nodes are not compressed in the same round;
of neighbours, the one with the smallest salted hash goes. A chain of n nodes thus takes O(log n) rounds instead of n. What
can neither be raked nor compressed is the core: every node in it leads into a cycle and is led to by one. Strongly connected
parts of the core are found by colour propagation, and then the recorded rounds are undone, last one first, which gives every
removed node its values from nodes that went later.

Cycles and descendants rake nodes without children and nodes without parents alike, and links carry nothing: when a unary
node v between u and w comes back, w and all below it gain v, and v gains u and all above it. Paths rake nodes without
children only, and a link remembers the nodes it stands for, since they are part of the result.

Ids are numbered in their order first, so the rounds carry two numbers a link, whatever the ids' length, and paths compare
as their ids would. Everything is joins and aggregates on those numbers; no task and no driver variable holds a tree. Each round's rows are written
once and never again: what later rounds add has ids of its own, so results are unions of the rounds.

Inputs: nodes(id), links(parent, child). Links with a null side, to ids without a node and from a node to itself are
left out; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.core import cut, cut_counted, discard, numbered

_NONE = "cast(array() as array<bigint>)"


def indexed(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, links): index(id, n) numbers the nodes in the order of their ids; distinct (src, dst) numbers with both sides among them, without self links."""
    index = cut(numbered(nodes.select("id").where("id is not null").distinct(), ["id"], "n"))
    pairs = links.select("parent", "child").where("parent <> child")
    pairs = pairs.join(index.select(F.col("id").alias("parent"), F.col("n").alias("src")), "parent").select("child", "src")
    return index, pairs.join(index.select(F.col("id").alias("child"), F.col("n").alias("dst")), "child").select("src", "dst").distinct()


def _named(df: DataFrame, index: DataFrame, *columns: str) -> DataFrame:
    """df with the ids in place of the numbers in some columns."""
    for c in columns:
        df = df.join(index.select(F.col("n").alias(c), F.col("id").alias("__id")), c).drop(c).withColumnRenamed("__id", c)
    return df


def call_links(graph: DataFrame) -> DataFrame:
    """(parent, child) of exported call-graph rows: a calls b if b is in a's callees or a in b's callers."""
    down = graph.select(F.col("id").alias("parent"), F.explode("callees").alias("child"))
    up = graph.select(F.explode("callers").alias("parent"), F.col("id").alias("child"))
    return down.unionByName(up).where("parent is not null and child is not null")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ends(e: DataFrame, salt: int, roots: bool) -> DataFrame:
    """(id, p, c, top, end, r) of nodes that may go: ends (without children, with `roots` also without parents: `top`) and unary nodes with their parent and child."""
    none = F.lit(None).cast(e.schema["src"].dataType)
    link = lambda i, p, c: F.struct(F.col(i).alias("id"), (none if p is None else F.col(p)).alias("p"), (none if c is None else F.col(c)).alias("c"))
    both = e.select(F.explode(F.array(link("src", None, "dst"), link("dst", "src", None))).alias("x")).select("x.*")
    deg = both.groupBy("id").agg(F.count("p").alias("i"), F.count("c").alias("o"), F.min("p").alias("p"), F.min("c").alias("c"))
    end = (F.col("o") == 0) | ((F.col("i") == 0) & F.lit(roots))
    return deg.where(end | ((F.col("i") == 1) & (F.col("o") == 1))).select("id", "p", "c", (F.col("o") > 0).alias("top"), end.alias("end"), F.xxhash64(F.lit(salt), "id").alias("r"))


def _chosen(low: DataFrame) -> DataFrame:
    """(v, u, w): unary nodes, none beside an end or another one that goes, with parent and child."""
    near = low.select(F.col("id").alias("n"), F.col("end").alias("ne"), F.col("r").alias("nr"))
    free = F.expr("ne is null or (not ne and (r < nr or (r = nr and id < n)))")
    up = low.where("not end").join(near, F.col("p") == F.col("n"), "left").where(free).select("id", "p", "c", "r")
    return up.join(near, F.col("c") == F.col("n"), "left").where(free).select(F.col("id").alias("v"), F.col("p").alias("u"), F.col("c").alias("w"))


def _going(low: DataFrame, chosen: DataFrame) -> DataFrame:
    """One table of the nodes a round takes out: (v, end, top, ...) with what `chosen` says of unary ones, null for ends."""
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in chosen.schema.fields if f.name != "v"]
    ends = low.where("end").select(F.col("id").alias("v"), "end", "top", *rest)
    return ends.unionByName(chosen.select("*", F.lit(False).alias("end"), F.lit(False).alias("top")))


def _without(e: DataFrame, gone: DataFrame) -> DataFrame:
    return e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def core_parts(core: DataFrame) -> DataFrame:
    """(id, part): strongly connected parts with two or more nodes of the core, by trimming and colour propagation."""
    e, n = cut_counted(core.select("src", "dst").distinct())
    found, before = [], 0
    while n:
        while n and n != before:  # nodes without parents or without children lie on no cycle
            before = n
            e, n = cut_counted(e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        if not n:
            break
        colour = e.select(F.col("src").alias("id"), F.col("src").alias("part")).distinct()  # every node has a child

        def further(c: DataFrame) -> DataFrame:
            """Each node with the largest of the colours that it and those before it had, and whether that is new."""
            pushed = e.join(c.select("id", "part"), F.col("src") == F.col("id")).groupBy("dst").agg(F.max("part").alias("new"))  # noqa: B023
            return c.join(pushed, F.col("id") == F.col("dst"), "left").select("id", F.greatest("part", "new").alias("part"), F.coalesce(F.col("new") > F.col("part"), F.lit(False)).alias("moved"))

        moved = 1
        while moved:  # the largest id that leads to a node, two steps at a time
            after, moved = cut_counted(further(further(colour)), F.col("moved"))
            discard(colour)
            colour = after
        own = colour.select("id", "part")
        same = cut(
            e.join(own.select(F.col("id").alias("src"), F.col("part").alias("cs")), "src")
            .join(own.select(F.col("id").alias("dst"), F.col("part").alias("cd")), "dst").where("cs = cd").select("src", "dst", "cs")
        )
        front, fresh = cut_counted(own.where("id = part"))
        back = [front]
        while fresh:  # against the links, from each colour's first node, two steps at a time
            def behind(f: DataFrame) -> DataFrame:
                return same.join(f.select(F.col("id").alias("i"), F.col("part").alias("p")), F.expr("dst = i and cs = p")).select(F.col("src").alias("id"), F.col("cs").alias("part"))  # noqa: B023

            once = behind(front)
            front, fresh = cut_counted(once.unionByName(behind(once)).distinct().join(_union(back).select("id"), "id", "left_anti"))
            back.append(front)
        found += back
        e, n = cut_counted(_without(e, _union(back).select("id")))
        before = 0
    if not found:
        return core.select(F.col("src").alias("id"), F.col("src").alias("part")).limit(0)
    every = _union(found)
    many = every.groupBy("part").count().where("count > 1").select("part")
    return every.join(many, "part", "left_semi").select("id", "part")


def _contract_bare(links: DataFrame, keep: bool = True) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """(rounds, core) where links carry nothing and both kinds of ends are raked.

    A round's tables: the links before it (without `keep` they are deleted) and the nodes that went (`_going`).
    """
    rounds: list[tuple[DataFrame, DataFrame]] = []
    e, n = cut_counted(links.select("src", "dst"))
    while n:
        low = _ends(e, len(rounds), True)
        went, some = cut_counted(_going(low, _chosen(low)))
        if not some:
            break
        rounds.append((e, went))
        new = went.where("not end and u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"))
        left, n = cut_counted(_without(e, went.select(F.col("v").alias("id"))).select("src", "dst").unionByName(new).distinct())
        if not keep:
            discard(e)
        e = left
    return rounds, e


def _cycles(rounds: list[DataFrame], core: DataFrame) -> DataFrame:
    """(id, part) of the core's parts and of the nodes (v, u, w) that went in rounds.

    A unary node that went between u and w belongs to their part if u is w, or if both belong to the same part.
    """
    parts = [cut(core_parts(core))]
    for rec in reversed(rounds):
        part = _union(parts)
        pu, pw = (part.select(F.col("id").alias(a), F.col("part").alias(f"p{a}")) for a in ("u", "w"))
        got = rec.join(pu, "u", "left").join(pw, "w", "left").where("u = w or pu = pw")
        # v is new; u is as well where it had no part
        add = got.select(F.explode(F.array(F.struct(F.col("v").alias("id"), F.coalesce("pu", "u").alias("part")), F.struct(F.when(F.col("pu").isNull(), F.col("u")).alias("id"), F.col("u").alias("part")))).alias("x")).select("x.*")
        parts.append(cut(add.where("id is not null").distinct()))
    return _union(parts)


def cycle_members(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, part): every node that lies on a cycle of two or more nodes; `part` names its strongly connected part."""
    index, e = indexed(nodes, links)
    rounds, core = _contract_bare(e, keep=False)
    return _named(_cycles([went.where("not end") for _, went in rounds], core), index, "id", "part")


def descendants(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, descendant): every node below a node, itself left out."""
    index, links = indexed(nodes, links)
    rounds, core = _contract_bare(links)
    front, fresh = cut_counted(core.select(F.col("dst").alias("id"), F.col("src").alias("anc")))
    above = [front]
    while fresh:  # within the core, step by step
        step = core.join(front, core.src == front.id).select(core.dst.alias("id"), "anc").where("id <> anc").distinct()
        front, fresh = cut_counted(step.join(_union(above), ["id", "anc"], "left_anti"))
        above.append(front)
    for e, went in reversed(rounds):
        known, made = _union(above), went.where("not end")
        tops = went.where("end and top").select(F.col("v").alias("src"))
        leaves = went.where("end and not top").select(F.col("v").alias("dst"))
        # nodes that come back above others: those, and what is below them, gain them
        over = made.select(F.col("w").alias("at"), F.col("v").alias("new")).unionByName(
            e.join(tops, "src", "left_semi").join(leaves, "dst", "left_anti").select(F.col("dst").alias("at"), F.col("src").alias("new"))
        )
        gained = over.select(F.col("at").alias("id"), F.col("new").alias("anc")).unionByName(known.join(over, F.col("anc") == F.col("at")).select("id", F.col("new").alias("anc")))
        above.append(cut(gained.where("id <> anc").distinct()))
        known = _union(above)
        # nodes that come back below others gain those and what is above them
        under = made.select(F.col("v").alias("new"), F.col("u").alias("by")).unionByName(e.join(leaves, "dst", "left_semi").select(F.col("dst").alias("new"), F.col("src").alias("by")))
        below = under.select(F.col("new").alias("id"), F.col("by").alias("anc")).unionByName(under.join(known, F.col("by") == F.col("id")).select(F.col("new").alias("id"), "anc"))
        above.append(cut(below.where("id <> anc").distinct()))
    return _named(_union(above).select(F.col("anc").alias("id"), F.col("id").alias("descendant")), index, "id", "descendant").select("id", "descendant")


def _contract_paths(links: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame, DataFrame]], DataFrame]:
    """(rounds, core) where a link (src, dst, len, mid) stands for the shortest, then first way through the nodes `mid`.

    A round's tables: the links to the nodes it raked, those to the unary ones that went, and (v, u, w) of these.
    """
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    e, n = cut_counted(links.select("src", "dst", F.lit(1).alias("len"), F.expr(f"{_NONE} mid")))
    while n:
        low = _ends(e, len(rounds), False)
        inn, on = (e.select(F.col(a).alias("v"), F.col("len").alias(f"l{i}"), F.col("mid").alias(f"m{i}")) for i, a in ((1, "dst"), (2, "src")))
        went, some = cut_counted(_going(low, _chosen(low).join(inn, "v").join(on, "v")))
        if not some:
            break
        made, leaves = went.where("not end"), went.where("end").select(F.col("v").alias("id"))
        rounds.append((e.join(leaves.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "len", "mid"), made.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("l1").alias("len"), F.col("m1").alias("mid")), made.select("v", "u", "w")))
        new = made.where("u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"), (F.col("l1") + F.col("l2")).alias("len"), F.concat("m1", F.array("v"), "m2").alias("mid"))
        left = _without(e, went.select(F.col("v").alias("id"))).select(*new.columns)
        e, n = cut_counted(left.unionByName(new).groupBy("src", "dst").agg(F.min(F.struct("len", "mid")).alias("m")).select("src", "dst", "m.len", "m.mid"))
    return rounds, e


def _shortest(index: DataFrame, e0: DataFrame, rounds: list[tuple[DataFrame, DataFrame, DataFrame]], core: DataFrame) -> DataFrame:
    """(id, path) in numbers: the shortest path from a node without parents, of several the first. Nodes that only cycles lead to have no row."""
    roots = index.select(F.col("n").alias("id")).join(e0.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    best = cut(roots.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")))

    def through(rec: DataFrame, known: DataFrame) -> DataFrame:
        j = rec.join(known, rec.src == known.id).select(rec.dst.alias("id"), (F.col("depth") + F.col("len")).alias("depth"), F.concat("path", "mid", F.array(rec.dst)).alias("path"))
        return j.groupBy("id").agg(F.min(F.struct("depth", "path")).alias("b")).select("id", "b.depth", "b.path")

    front, fresh = best, core.limit(1).count()
    while fresh:  # relaxation over the core only
        cand = through(core, front)
        old = best.select(F.col("id").alias("i"), F.struct("depth", "path").alias("o"))
        front, fresh = cut_counted(cand.join(old, F.col("id") == F.col("i"), "left").where(F.expr("o is null or struct(depth, path) < o")).select("id", "depth", "path"))
        if fresh:
            best = cut(best.join(front, "id", "left_anti").unionByName(front))
    parts = [best]
    for raked, squeezed, _ in reversed(rounds):
        parts.append(cut(through(raked.unionByName(squeezed), _union(parts))))
    return _union(parts).select("id", "path")


def paths(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root, depth, path, on_cycle) of every node: its shortest path from a node without parents, of several the first by its ids; a root has depth 0.

    A node that only cycles lead to has null root, depth and path.
    """
    index, e0 = indexed(nodes, links)
    e0 = cut(e0)
    rounds, core = _contract_paths(e0)
    back = _cycles([made for _, _, made in rounds], core).select("id", F.lit(True).alias("back"))
    steps = _shortest(index, e0, rounds, core).select("id", F.posexplode("path").alias("at", "n")).join(index.withColumnRenamed("id", "name"), "n")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])  # a node's own path
    named = steps.groupBy("id").agg(F.max("at").alias("depth"), whole.alias("path"))
    found = index.select("id", F.col("n")).join(named.withColumnRenamed("id", "n"), "n", "left").join(back.withColumnRenamed("id", "n"), "n", "left")
    return found.select("id", F.element_at("path", 1).alias("root"), "depth", "path", F.coalesce("back", F.lit(False)).alias("on_cycle"))


def hierarchy(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, descendants) of a graph."""
    return paths(nodes, links), descendants(nodes, links)
