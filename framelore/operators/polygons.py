"""Polygons of instances: metrics, validity and hit tests.

A ring is array<struct<x, y>> with implicit closure; an instance has one or
more rings that are separate components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.functions import geometry as G
from framelore.tables import stage

RING = "array<struct<x: double, y: double>>"
CELL = 256.0  # pixels of a cell of the hit test
MAX_RINGS, MAX_VERTICES = 256, 2048
IN_ROW = 64  # an instance of up to as many edges is compared inside its row, a larger one by bands; the result is the same


def rings_from_values(value: Column) -> Column:
    """A ring stored as JSON, points or flat numbers, as array of points."""
    points = F.from_json(value, "array<array<double>>")
    flat = F.from_json(value, "array<double>")
    from_points = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1))
    from_flat = F.transform(steps, lambda i: F.struct(F.get(flat, i * 2).alias("x"), F.get(flat, i * 2 + 1).alias("y")))
    return F.when(value.rlike(r"^\s*\[\s*\["), from_points).otherwise(from_flat)


def metrics(rings: DataFrame, key: list[str]) -> DataFrame:
    """Extent and area per instance: the rings' areas add up, there are no holes."""
    x1, y1, x2, y2 = G.ring_extent(F.col("ring"))
    return rings.groupBy(*key).agg(
        F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2"), F.sum(F.abs(G.signed_area2(F.col("ring"))) / 2).alias("area"), F.count("*").alias("rings")
    )


def _finite(ring: Column) -> Column:
    return F.forall(ring, lambda p: p.x.isNotNull() & p.y.isNotNull() & ~F.isnan(p.x) & ~F.isnan(p.y) & (F.abs(p.x) < F.lit(float("inf"))) & (F.abs(p.y) < F.lit(float("inf"))))


def ring_fault(ring: Column) -> Column:
    """Why a ring by itself is not valid, or null: few points, not finite, repeated, no area, doubling back."""
    after = G.next_points(ring)
    over = G.next_points(after)
    back = F.zip_with(F.arrays_zip(ring.alias("a"), after.alias("b")), over, lambda p, c: (G.cross(p.a, p.b, c) == 0) & ((p.a.x - p.b.x) * (c.x - p.b.x) + (p.a.y - p.b.y) * (c.y - p.b.y) > 0))
    return (
        F.when(ring.isNull() | (F.size(ring) < 3), "too_few_points")
        .when(~_finite(ring), "not_finite")
        .when(F.size(F.array_distinct(ring)) != F.size(ring), "repeated_vertex")
        .when(F.abs(G.signed_area2(ring)) < 1e-8, "no_area")
        .when(F.exists(back, lambda b: b), "doubles_back")
    )


def _beyond() -> Column:
    return (F.col("_rings") > MAX_RINGS) | (F.col("_points") > MAX_VERTICES)


def _sizes(rings: DataFrame, key: list[str]) -> tuple[DataFrame, bool, bool]:
    """Rings and points per instance, whether any is beyond the limits, and whether any is too large to be compared inside its row."""
    sizes = stage(rings.groupBy(*key).agg(F.count("*").alias("_rings"), F.sum(F.greatest(F.size("ring"), F.lit(0))).alias("_points")), "polygon-sizes")
    n = sizes.agg(F.count_if(_beyond()).alias("beyond"), F.count_if(F.col("_points") > IN_ROW).alias("wide")).first()
    return sizes, n["beyond"] > 0, n["wide"] > 0


def _instances(rings: DataFrame, sizes: DataFrame, beyond: bool, key: list[str]) -> DataFrame:
    """One row per instance within the limits: its rings in order, their points, and the first of their faults.

    The limits are applied before the rings are brought together, so what is
    collected is at most 2,048 points.
    """
    fit = rings.join(sizes.where(~_beyond()).select(*key), key, "left_semi") if beyond else rings
    rows = fit.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ring_no", "ring"))).alias("rings"))
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.greatest(F.size(r.ring), F.lit(0)))
    return rows.withColumn("_points", points).withColumn("_ring", F.array_min(F.transform("rings", lambda r: ring_fault(r.ring))))


def _with_edges(instances: DataFrame) -> DataFrame:
    """``edges`` (ring_no, n, edge_no, a, b) in order; a ring with a coordinate that is not finite has none."""
    numbered = lambda r: F.transform(
        F.arrays_zip(r.ring.alias("a"), G.next_points(r.ring).alias("b")), lambda e, i: F.struct(r.ring_no.alias("ring_no"), F.size(r.ring).alias("n"), i.alias("edge_no"), e.a.alias("a"), e.b.alias("b"))
    )
    return instances.withColumn("edges", F.flatten(F.transform(F.filter("rings", lambda r: F.coalesce(_finite(r.ring), F.lit(False))), numbered)))


def _clash(e: Column, f: Column) -> Column:
    """Edge ``f``, which comes after ``e``, meets it without being its neighbour."""
    near = (e.ring_no == f.ring_no) & ((f.edge_no - e.edge_no == 1) | (e.edge_no == 0) & (f.edge_no == e.n - 1))
    return ~near & G.segments_meet(e.a, e.b, f.a, f.b)


def _after(i: Column) -> Column:
    return F.slice("edges", i + 2, F.greatest(F.size("edges") - i - 1, F.lit(0)))


def _conflicts_in_row(instances: DataFrame, key: list[str]) -> DataFrame:
    pair = lambda e, f: F.struct(e.ring_no.alias("ring_a"), e.edge_no.alias("edge_a"), f.ring_no.alias("ring_b"), f.edge_no.alias("edge_b"))
    pairs = F.flatten(F.transform("edges", lambda e, i: F.transform(F.filter(_after(i), lambda f: _clash(e, f)), lambda f: pair(e, f))))
    return instances.select(*key, F.explode(pairs).alias("p")).select(*key, "p.*")


def _conflicts_by_bands(instances: DataFrame, key: list[str]) -> DataFrame:
    """Edges are laid on as many horizontal bands as the root of their number; those of one band meet by equality.

    A pair counts in the first band that both touch, so it comes once.
    """
    low, high = (lambda e: F.least(e.a.y, e.b.y)), (lambda e: F.greatest(e.a.y, e.b.y))
    bands = F.ceil(F.sqrt(F.size("edges"))).cast("int")
    rows = instances.withColumns({"_k": bands, "_y": F.array_min(F.transform("edges", low)), "_top": F.array_max(F.transform("edges", high))})
    height = (F.col("_top") - F.col("_y")) / F.col("_k")
    at = lambda y: F.when(F.col("_h") > 0, F.least(F.col("_k") - 1, F.greatest(F.lit(0), F.floor((y - F.col("_y")) / F.col("_h")).cast("int")))).otherwise(F.lit(0))
    laid = rows.withColumn("_h", height).select(*key, "_k", "_y", "_h", F.explode("edges").alias("e")).withColumn("_lo", at(low(F.col("e")))).withColumn("_hi", at(high(F.col("e"))))
    laid = laid.select(*key, "e", "_lo", F.explode(F.sequence("_lo", "_hi")).alias("_band"))
    left = laid.select(*key, "_band", F.col("e").alias("e"), F.col("_lo").alias("_lo_e"))
    right = laid.select(*key, "_band", F.col("e").alias("f"), F.col("_lo").alias("_lo_f"))
    e, f = F.col("e"), F.col("f")
    later = (e.ring_no < f.ring_no) | (e.ring_no == f.ring_no) & (e.edge_no < f.edge_no)
    met = left.join(right, [*key, "_band"]).where(later & (F.col("_band") == F.greatest("_lo_e", "_lo_f")) & _clash(e, f))
    return met.select(*key, e.ring_no.alias("ring_a"), e.edge_no.alias("edge_a"), f.ring_no.alias("ring_b"), f.edge_no.alias("edge_b"))


def edge_conflicts(rings: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of edges of one instance that meet without being neighbours: key, ring and edge numbers of both.

    Instances beyond the limits have no pairs (``faults`` names them), nor
    have rings with a coordinate that is not finite.
    """
    sizes, beyond, wide = _sizes(rings, key)
    instances = _with_edges(_instances(rings, sizes, beyond, key))
    pairs = _conflicts_in_row(instances.where(F.col("_points") <= IN_ROW), key)
    return pairs.unionByName(_conflicts_by_bands(instances.where(F.col("_points") > IN_ROW), key)) if wide else pairs


def faults(rings: DataFrame, key: list[str]) -> DataFrame:
    """Every instance with ``fault``: too large, the first of ring faults, crossing edges, rings inside rings; null if valid.

    Sizes come first: an instance beyond the limits is never brought together,
    and one with a faulty ring is not searched for crossings.
    """
    sizes, beyond, wide = _sizes(rings, key)
    instances = _with_edges(_instances(rings, sizes, beyond, key))
    sound = F.col("_ring").isNull()
    crossing = F.when(sound & (F.col("_points") <= IN_ROW), F.exists(F.transform("edges", lambda e, i: F.exists(_after(i), lambda f: _clash(e, f))), lambda met: met))
    first = lambda r: F.get(r.ring, F.lit(0))
    inside = F.exists("rings", lambda r: F.exists("rings", lambda o: (r.ring_no != o.ring_no) & G.ring_contains(r.ring, first(o).x, first(o).y)))
    judged = instances.select(*key, F.col("_ring"), crossing.alias("_cross"), F.when(sound & (F.size("rings") > 1), inside).alias("_inside"))
    if wide:
        met = _conflicts_by_bands(instances.where(F.col("_points") > IN_ROW).where(sound), key).select(*key).distinct().withColumn("_wide", F.lit(True))
        judged = judged.join(met, key, "left").withColumn("_cross", F.col("_cross") | F.col("_wide"))
    fault = F.when(F.col("_ring").isNotNull(), F.col("_ring")).when(F.col("_cross"), "edges_meet").when(F.col("_inside"), "ring_in_ring")
    out = judged.select(*key, fault.alias("fault"))
    return out.unionByName(sizes.where(_beyond()).select(*key, F.lit("too_large").alias("fault"))) if beyond else out


def hit_test(points: DataFrame, shapes: DataFrame, key: str = "image_key") -> DataFrame:
    """The topmost shape under each point: points (image_key, point_id, px, py), shapes (image_key, shape_id, z, ring, x1, y1, x2, y2).

    Of several hits the one with the largest ``z`` is taken, then the larger
    id.  Shapes lie on a grid and points meet those of their cell, then the
    boxes are compared, then the rings: a crowded picture pairs neighbours only.
    """
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    laid = shapes.withColumn("_gx", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("_gy", F.explode(F.sequence(cell("y1"), cell("y2"))))
    hits = points.withColumn("_gx", cell("px")).withColumn("_gy", cell("py")).join(laid, [key, "_gx", "_gy"]).where("px >= x1 and px <= x2 and py >= y1 and py <= y2").where(G.ring_contains(F.col("ring"), F.col("px"), F.col("py")))
    return hits.groupBy(key, "point_id").agg(F.max_by("shape_id", F.struct("z", "shape_id")).alias("shape_id"))


def nearest_vertex(points: DataFrame, rings: DataFrame, tolerance: float) -> DataFrame:
    """The nearest vertex within ``tolerance`` of each point of the same instance: point_id, vertex, distance."""
    vertices = rings.select("shape_id", "ring_no", F.posexplode("ring").alias("vertex", "p"))
    d = F.sqrt(F.pow(F.col("p.x") - F.col("px"), 2) + F.pow(F.col("p.y") - F.col("py"), 2))
    return points.join(vertices, "shape_id").withColumn("d", d).where(F.col("d") <= tolerance).groupBy("point_id").agg(F.min(F.struct("d", "ring_no", "vertex")).alias("m")).select("point_id", "m.ring_no", "m.vertex", F.col("m.d").alias("distance"))
