"""Problem 1: call hierarchies over call_graph_nodes."""

from pyspark.sql import functions as F

from codeweft.core import load
from codeweft.operators import hierarchy as H


def p1_found(spark, sf_dir):
    g = load(spark, sf_dir, "call_graph_nodes").select("id", "callers", "callees")
    return H.cycle_members(g, H.call_links(g)).select("id").distinct()


def p1_hierarchy(spark, sf_dir):
    """id, root, depth, path (ids joined by ' > '), on_cycle, is_top (nothing calls it) beside the entry point noted in the table."""
    g = load(spark, sf_dir, "call_graph_nodes").select("id", "callers", "callees", "is_entry_point")
    paths = H.paths(g, H.call_links(g))
    noted = g.groupBy("id").agg(F.bool_or("is_entry_point").alias("noted_entry_point"))
    return paths.join(noted, "id").select(
        "id", "root", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", " > ").alias("path"), "on_cycle", F.coalesce(F.col("depth") == 0, F.lit(False)).alias("is_top"), "noted_entry_point"
    )


def p1_descendants(spark, sf_dir):
    g = load(spark, sf_dir, "call_graph_nodes").select("id", "callers", "callees")
    return H.descendants(g, H.call_links(g))


_LINKS = """
links AS (
  SELECT DISTINCT a, b FROM (
    SELECT id AS a, unnest(callees) AS b FROM call_graph_nodes
    UNION ALL SELECT unnest(callers) AS a, id AS b FROM call_graph_nodes)
  WHERE a <> b AND a IN (SELECT id FROM call_graph_nodes) AND b IN (SELECT id FROM call_graph_nodes)),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""

QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants}

ORACLE = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT a AS id FROM reach WHERE a = b",
    "p1_descendants": f"WITH RECURSIVE {_LINKS} SELECT a AS id, b AS descendant FROM reach WHERE a <> b",
    "p1_hierarchy": f"""
WITH RECURSIVE {_LINKS},
ids AS (SELECT DISTINCT id FROM call_graph_nodes WHERE id IS NOT NULL),
walk(id, path) AS (
  SELECT id, [id] FROM ids WHERE id NOT IN (SELECT b FROM links)
  UNION ALL
  SELECT l.b, list_append(w.path, l.b) FROM walk w JOIN links l ON w.id = l.a WHERE NOT list_contains(w.path, l.b)),
best AS (SELECT id, min({{'n': len(path), 'p': path}}) AS m FROM walk GROUP BY id)
SELECT i.id AS id, b.m.p[1] AS root, CAST(b.m.n - 1 AS BIGINT) AS depth, array_to_string(b.m.p, ' > ') AS path,
  EXISTS (SELECT 1 FROM reach r WHERE r.a = i.id AND r.b = i.id) AS on_cycle, coalesce(b.m.n = 1, false) AS is_top,
  (SELECT bool_or(is_entry_point) FROM call_graph_nodes c WHERE c.id = i.id) AS noted_entry_point
FROM ids i LEFT JOIN best b ON i.id = b.id""",
}
