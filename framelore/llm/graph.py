"""Connected components by parallel hooking and shortcutting over joined tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.tables import stage, stage_counted, unstage


def _hook(edges: DataFrame) -> DataFrame:
    """Each root with a smaller neighbour gets its smallest neighbour as parent.

    The minimum is taken with map-side combine, so a hub with a third of all
    edges sends one row per task.
    """
    both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
    return both.groupBy("node").agg(F.min("parent").alias("parent"))


def _shortcut(parents: DataFrame, label: str) -> DataFrame:
    """Pointer jumping until every parent is a root; the number of rounds is the log of the longest chain."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        jumped, moved = stage_counted(
            parents.join(up, "parent", "left").select("node", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("moved")), label, "moved"
        )
        unstage(parents)
        parents_next = jumped.select("node", "parent")
        parents_next._framelore_path = jumped._framelore_path
        parents = parents_next
        if not moved:
            return parents


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (a, b) to (node, root): the smallest node of its component for every node that has an edge to another.

    Rounds: hook, shortcut, then contract the edges to edges between roots and
    drop those inside one component.  Each round at least halves the roots
    that still have edges, and every round's tables are written to the shared
    folder, so lost executors re-read them.  Null ends and loops are ignored;
    repeated edges change nothing; no edges give no rows.
    """
    rest, open_edges = stage_counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), f"{label}-edges")
    roots: DataFrame | None = None
    while open_edges:
        parents = _shortcut(stage(_hook(rest), f"{label}-parents"), f"{label}-parents")
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        contracted = rest.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("pa", "a").alias("u"), F.coalesce("pb", "b").alias("v")).where("u <> v")
        left, open_edges = stage_counted(contracted.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), f"{label}-edges")
        if roots is None:
            ends = rest.select(F.col("a").alias("node")).union(rest.select(F.col("b"))).distinct()
            moved = stage(ends.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("root")), f"{label}-roots")
        else:
            over = parents.select(F.col("node").alias("root"), "parent")
            moved = stage(roots.join(over, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), f"{label}-roots")
            unstage(roots)
        unstage(rest)
        unstage(parents)
        rest, roots = left, moved
    if roots is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
