"""Questions to a call graph.

Paths are found level by level for all starts at once: a frontier of (start, node, path) is joined to the links, keeps
the least path for each new node, and leaves out what was reached before. Breadth-first search over sorted neighbours
returns exactly the alphabetically first shortest path, so both agree. At most MAX_DEPTH links are followed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.core import cut, cut_counted, discard

MAX_DEPTH = 8
MAX_PATHS = 3


def resolve(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """questions(q, fn, path) with `id`: path::fn if there is such a node, else the first node of that name, else null.

    A node id given as `fn` is taken as it is.
    """
    exact = nodes.select(F.col("id").alias("e"))
    first = nodes.groupBy("function_name").agg(F.min("id").alias("first"))
    j = questions.join(exact, F.concat(F.col("path"), F.lit("::"), F.col("fn")) == F.col("e"), "left")
    j = j.join(exact.withColumnRenamed("e", "own"), F.col("fn") == F.col("own"), "left").join(first, F.col("fn") == F.col("function_name"), "left")
    return j.select("q", "fn", "path", F.coalesce("e", "own", "first").alias("id"))


def one_hop(adjacent: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, id, callers, callees) for resolved questions; unknown ones have empty lists."""
    empty = F.expr("cast(array() as array<string>)")
    return asked.join(adjacent, "id", "left").select("q", "id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def node_info(graph: DataFrame, asked: DataFrame) -> DataFrame:
    """The graph's row of each resolved question; unknown ones are left out."""
    return asked.select("q", "id").join(graph, "id")


def paths_from(starts: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(start, node, depth, path) of every node within reach of starts(id), the start itself included at depth 0."""
    front, fresh = cut_counted(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.array("id").alias("path")).distinct())
    levels = [front]
    e = cut(edges.select("src", "dst").distinct())
    while fresh and len(levels) <= max_depth:
        seen = reduce(DataFrame.unionByName, [x.select("start", "node") for x in levels])  # two columns of each level's file
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti")
        front, fresh = cut_counted(best.select("start", "node", F.lit(len(levels)).alias("depth"), "path"))
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def nearest(starts: DataFrame, edges: DataFrame, keep: int, max_depth: int = MAX_DEPTH, backward: bool = False) -> DataFrame:
    """(node, rank, start, ord, depth, path): of the starts(id, ord) within reach of a node the `keep` least by `ord`, each with its shortest, then first path.

    Links are followed from the starts on, or against their direction (`backward`: the path then leads from the node to the
    start). A node never holds more than `keep` rows, on the way either: who is not among the least of a node is not
    among those of the nodes behind it, since all that beat it there get there as soon.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = cut(edges.select(F.col(a).alias("from"), F.col(b).alias("next")).distinct())
    held, fresh = cut_counted(starts.select(F.col("id").alias("node"), F.lit(1).alias("rank"), F.col("id").alias("start"), "ord", F.lit(0).alias("depth"), F.array("id").alias("path")))
    w = Window.partitionBy("node").orderBy("ord", "start")
    for depth in range(1, max_depth + 1):
        if not fresh:
            break
        path = F.concat(F.array("next"), "path") if backward else F.concat("path", F.array("next"))
        step = held.where(F.col("depth") == depth - 1).join(e, F.col("node") == F.col("from")).select(F.col("next").alias("node"), "start", "ord", F.lit(depth).alias("depth"), path.alias("path"))
        one = held.drop("rank").unionByName(step).groupBy("node", "start").agg(F.min("ord").alias("ord"), F.min(F.struct("depth", "path")).alias("m")).select("node", "start", "ord", "m.depth", "m.path")
        least = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
        new, fresh = cut_counted(least, F.col("depth") == depth)
        discard(held)
        held = new
    return held


def taint_paths(nodes: DataFrame, edges: DataFrame, targets: DataFrame | None = None, limit: int = MAX_PATHS) -> DataFrame:
    """(id, rank, path): up to three source-to-sink paths through each node, names joined by ' -> '.

    Sources come in graph order (`ord` of nodes); a path is the way from the source to the node and on to the first sink in
    graph order that is the node itself or within reach; without such a sink it ends at the node.
    """
    inner = nodes.where("not is_external")
    src, sink = (inner.where(flag).select("id", "ord") for flag in ("is_taint_source", "is_taint_sink"))
    inside = edges.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(inner.select(F.col("id").alias("dst")), "dst", "left_semi")
    before = nearest(src, inside, limit).select("node", "rank", "path")
    if targets is not None:
        before = before.join(targets.select(F.col("id").alias("node")), "node", "left_semi")
    after = nearest(sink, inside, 1, backward=True).select("node", F.col("path").alias("tail"))
    j = before.join(after, "node", "left")
    whole = F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", F.slice("tail", F.lit(2), F.greatest(F.size("tail") - 1, F.lit(0)))))
    return j.select(F.col("node").alias("id"), F.col("rank").cast("bigint").alias("rank"), F.array_join(F.transform(whole, lambda x: F.element_at(F.split(x, "::"), -1)), " -> ").alias("path"))


def summary(graph: DataFrame) -> DataFrame:
    """One row of counts; edges are all entries of all callee lists."""
    inner = ~F.col("is_external")
    return graph.agg(
        F.count_if(inner).alias("total_functions"), F.count_if(F.col("is_external")).alias("external_functions"),
        F.count_if(inner & F.coalesce("is_entry_point", F.lit(False))).alias("entry_points"), F.count_if(inner & F.coalesce("is_infrastructure", F.lit(False))).alias("infrastructure"),
        F.count_if(inner & F.coalesce("is_taint_source", F.lit(False))).alias("taint_sources"), F.count_if(inner & F.coalesce("is_taint_sink", F.lit(False))).alias("taint_sinks"),
        F.coalesce(F.sum(F.when(F.size("callees") > 0, F.size("callees")).otherwise(0)), F.lit(0)).alias("total_edges"),
    )
