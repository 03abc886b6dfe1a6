"""Polygon and mask queries over shapes derived from the annotations' boxes, and over the real nested shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.functions import geometry as G
from framelore.operators import masks as M
from framelore.operators import nested
from framelore.operators import polygons as P
from framelore.tables import table

# A box becomes a ring of five points; the fifth lies inside or far outside, so some rings cross themselves.
_RING = """transform(array(array(x1, y1), array(x2, y1), array(x2, y2), array((x1 + x2) / 2, y2 - (ann_key % 7 - 1) * (y2 - y1) / 4), array(x1, y2)),
 p -> named_struct('x', p[0], 'y', p[1]))"""
_INNER = "transform(array(array(x1 + (x2 - x1) / 4, y1 + (y2 - y1) / 8), array(x1 + (x2 - x1) / 2, y1 + (y2 - y1) / 8), array(x1 + (x2 - x1) / 2, y1 + (y2 - y1) / 4)), p -> named_struct('x', p[0], 'y', p[1]))"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    b = [F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return table(spark, d, "annotations").where("size(bbox) = 4").select("ann_key", "image_key", *b).where("x2 > x1 and y2 > y1")


def _rings(spark, d):
    """One ring per instance, a second inside or beside it for every fifth key."""
    base = _boxes(spark, d)
    second = F.when(F.col("ann_key") % 5 == 0, F.array(F.expr(_RING), F.expr(_INNER))).otherwise(F.array(F.expr(_RING)))
    return base.select("ann_key", "image_key", F.posexplode(second).alias("ring_no", "ring"))


def polygon_metrics(spark, d):
    return P.metrics(_rings(spark, d), ["ann_key"]).select("ann_key", "x1", "y1", "x2", "y2", "area", "rings")


def polygon_edge_conflicts(spark, d):
    return P.edge_conflicts(_rings(spark, d), ["ann_key"])


def polygon_faults(spark, d):
    return P.faults(_rings(spark, d), ["ann_key"])


def point_in_polygon(spark, d):
    rings = _rings(spark, d).where("ring_no = 0").join(_boxes(spark, d), "ann_key")
    px, py = F.expr("x1 + (ann_key % 8) * (x2 - x1) / 8"), F.expr("y1 + (ann_key % 16) * (y2 - y1) / 16")
    return rings.select("ann_key", F.coalesce(G.ring_contains(F.col("ring"), px, py), F.lit(False)).alias("inside"))


def hit_test(spark, d):
    """The topmost box under the centre of each object of the same picture."""
    boxes = _boxes(spark, d).where("image_key is not null")
    points = boxes.select("image_key", F.col("ann_key").alias("point_id"), F.expr("(x1 + x2) / 2").alias("px"), F.expr("(y1 + y2) / 2").alias("py"))
    square = F.expr("transform(array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2)), p -> named_struct('x', p[0], 'y', p[1]))")
    shapes = boxes.select("image_key", F.col("ann_key").alias("shape_id"), (F.col("ann_key") % 10).alias("z"), square.alias("ring"), "x1", "y1", "x2", "y2")
    return P.hit_test(points, shapes)


_RUNS = "array(ann_key % 500, 1 + ann_key % 300, 1 + ann_key * 7 % 900, 1 + ann_key * 13 % 400)"


def _tiles(spark, d):
    """One tile per object; objects of a picture share tiles, so unions overlap."""
    runs = F.expr(f"transform({_RUNS}, n -> cast(n as int))")
    rows = table(spark, d, "annotations").where("image_key is not null").select("ann_key", "image_key", F.expr("cast(ann_key % 3 * 128 as int)").alias("x"), F.lit(0).alias("y"), runs.alias("r"))
    return rows.select("ann_key", "image_key", "x", "y", F.array_append("r", (F.lit(G.MASK_PIXELS) - F.aggregate("r", F.lit(0), lambda s, n: s + n)).cast("int")).alias("counts"))


def mask_metrics(spark, d):
    return M.metrics(_tiles(spark, d), ["ann_key"])


def mask_faults(spark, d):
    """Every ninth tile is off its grid, every eleventh has an empty run."""
    broken = F.when(F.col("ann_key") % 11 == 0, F.concat(F.slice("counts", 1, 2), F.array(F.lit(0), F.lit(0)), F.slice("counts", 3, 3))).otherwise(F.col("counts"))
    return M.faults(_tiles(spark, d).withColumn("x", F.col("x") + F.when(F.col("ann_key") % 9 == 0, 1).otherwise(0)).withColumn("counts", broken), ["ann_key"])


def mask_union(spark, d):
    return M.union_masks(_tiles(spark, d), ["image_key"]).select("image_key", "x", "y", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


def mask_pixels(spark, d):
    points = table(spark, d, "annotations").where("image_key is not null").select("ann_key", F.expr("ann_key % 384 + 0.5").alias("px"), F.expr("ann_key % 5 + 0.5").alias("py"))
    return M.pixel_lookup(points, _tiles(spark, d), ["ann_key"]).select("ann_key", "inside")


def coco_rle_round_trip(spark, d):
    """Encoding and decoding gives the runs back; the length of the text is checked by arithmetic in SQL."""
    coded = _tiles(spark, d).select("ann_key", "counts", G.encode_coco_counts(F.col("counts")).alias("text"))
    return coded.select("ann_key", F.length("text").alias("length"), F.array_join(G.decode_coco_counts(F.col("text")).cast("array<string>"), ",").alias("counts"))


def mask_column_major(spark, d):
    """Row-major tiles to column-major runs of the picture and back."""
    tiles = _tiles(spark, d).select(F.col("ann_key").alias("object_id"), F.lit(512).alias("width"), F.lit(256).alias("height"), "x", "y", "counts")
    back = M.from_column_major(M.to_column_major(tiles).select("object_id", F.lit(512).alias("width"), F.lit(256).alias("height"), "counts"))
    return back.select(F.col("object_id").alias("ann_key"), "x", "y", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"), "fault")


def mask_raster(spark, d):
    """Pixels and tiles of each box drawn as a ring of its picture."""
    sized = table(spark, d, "images").select("image_key", "width", "height")
    ring = F.expr("array(transform(array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2)), p -> named_struct('x', p[0], 'y', p[1])))")
    drawn = M.rasterize_rings(_boxes(spark, d).join(sized, "image_key").select(F.col("ann_key").alias("object_id"), "width", "height", ring.alias("rings")))
    return drawn.groupBy(F.col("object_id").alias("ann_key")).agg(F.sum("pixels").alias("pixels"), F.count("x").alias("tiles"), F.max("fault").alias("fault"))


def mask_erase(spark, d):
    """Pixels left of each mask after a brush has gone along the upper border of the picture."""
    tiles = _tiles(spark, d).select(F.col("ann_key").alias("object_id"), F.lit(512).alias("width"), F.lit(256).alias("height"), "x", "y", "counts")
    left = M.paint_masks(tiles, (0.0, 0.0), (512.0, 0.0), 2.6, erase=True)
    return M.metrics(left.select(F.col("object_id").alias("ann_key"), "x", "y", "counts"), ["ann_key"]).select("ann_key", F.col("area").alias("pixels"))


def document_polygons(spark, d):
    """Extent and area of the polygons stored in the annotation documents, with their fault."""
    rings = nested.flat_tables(table(spark, d, "annotation_docs"))["rings"].select("doc_key", "object_id", F.col("ordinal").alias("ring_no"), P.rings_from_values(F.col("value")).alias("ring"))
    key = ["doc_key", "object_id"]
    return P.metrics(rings, key).join(P.faults(rings, key), key)


def document_masks(spark, d):
    """Extent and pixels of the masks stored in the annotation documents, with their fault."""
    tiles = nested.flat_tables(table(spark, d, "annotation_docs"))["tiles"]
    key = ["doc_key", "object_id"]
    return M.metrics(tiles, key).join(M.faults(tiles, key), key)


_SQL_BOXES = "b as (select ann_key, image_key, bbox[1] as x1, bbox[2] as y1, bbox[3] as x2, bbox[4] as y2 from annotations where len(bbox) = 4 and bbox[3] > bbox[1] and bbox[4] > bbox[2])"
_SQL_RINGS = (
    _SQL_BOXES
    + """,
pts as (select ann_key, 0 as ring_no, 5 as n, unnest([0, 1, 2, 3, 4]) as i, unnest([x1, x2, x2, (x1 + x2) / 2, x1]) as x, unnest([y1, y1, y2, y2 - (ann_key % 7 - 1) * (y2 - y1) / 4, y2]) as y from b
  union all select ann_key, 1, 3, unnest([0, 1, 2]), unnest([x1 + (x2 - x1) / 4, x1 + (x2 - x1) / 2, x1 + (x2 - x1) / 2]), unnest([y1 + (y2 - y1) / 8, y1 + (y2 - y1) / 8, y1 + (y2 - y1) / 4]) from b where ann_key % 5 = 0),
e as (select p.ann_key, p.ring_no, p.n, p.i, p.x as ax, p.y as ay, q.x as zx, q.y as zy from pts p join pts q on p.ann_key = q.ann_key and p.ring_no = q.ring_no and q.i = (p.i + 1) % p.n)"""
)
_SQL_CONFLICTS = (
    _SQL_RINGS
    + """,
c as (select a.ann_key, a.ring_no as ring_a, a.i as edge_a, z.ring_no as ring_b, z.i as edge_b from e a join e z on a.ann_key = z.ann_key
  and (a.ring_no, a.i) < (z.ring_no, z.i) and not (a.ring_no = z.ring_no and (z.i - a.i = 1 or (a.i = 0 and z.i = a.n - 1)))
  where greatest(a.ax, a.zx) >= least(z.ax, z.zx) and greatest(z.ax, z.zx) >= least(a.ax, a.zx) and greatest(a.ay, a.zy) >= least(z.ay, z.zy) and greatest(z.ay, z.zy) >= least(a.ay, a.zy)
  and sign((a.zx - a.ax) * (z.ay - a.ay) - (a.zy - a.ay) * (z.ax - a.ax)) * sign((a.zx - a.ax) * (z.zy - a.ay) - (a.zy - a.ay) * (z.zx - a.ax)) <= 0
  and sign((z.zx - z.ax) * (a.ay - z.ay) - (z.zy - z.ay) * (a.ax - z.ax)) * sign((z.zx - z.ax) * (a.zy - z.ay) - (z.zy - z.ay) * (a.zx - z.ax)) <= 0)"""
)
_SQL_TILES = """t as (select ann_key, image_key, (ann_key % 3 * 128)::int as x, 0 as y, ann_key % 500 as r0, 1 + ann_key % 300 as r1, 1 + ann_key * 7 % 900 as r2, 1 + ann_key * 13 % 400 as r3 from annotations where image_key is not null),
runs as (select ann_key, image_key, x, y, r0 as s, r1 as n from t union all select ann_key, image_key, x, y, r0 + r1 + r2, r3 from t)"""
_SQL_COUNTS = "r0 || ',' || r1 || ',' || r2 || ',' || r3 || ',' || (16384 - r0 - r1 - r2 - r3)"
_GROUPS = lambda v: f"(case when {v} between -16 and 15 then 1 when {v} between -512 and 511 then 2 when {v} between -16384 and 16383 then 3 else 4 end)"

ORACLES = {
    "polygon_metrics": f"""with {_SQL_RINGS}, r as (select ann_key, ring_no, abs(sum(ax * zy - zx * ay)) / 2 as area, min(ax) as x1, min(ay) as y1, max(ax) as x2, max(ay) as y2 from e group by all)
select ann_key, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, sum(area) as area, count(*) as rings from r group by 1""",
    "polygon_edge_conflicts": "with " + _SQL_CONFLICTS + " select * from c",
    "polygon_faults": "with " + _SQL_CONFLICTS
    + """,
alone as (select ann_key, min(fault) as fault from (select ann_key, ring_no, case when count(distinct (ax, ay)) < max(n) then 'repeated_vertex' when abs(sum(ax * zy - zx * ay)) < 1e-8 then 'no_area' end as fault from e group by all) group by 1),
back as (select distinct a.ann_key from e a join e z on a.ann_key = z.ann_key and a.ring_no = z.ring_no and z.i = (a.i + 1) % a.n
  where (a.zx - a.ax) * (z.zy - a.ay) = (a.zy - a.ay) * (z.zx - a.ax) and (a.ax - a.zx) * (z.zx - a.zx) + (a.ay - a.zy) * (z.zy - a.zy) > 0),
firsts as (select ann_key, ring_no, x, y from pts where i = 0),
inside as (select distinct ann_key from (select e.ann_key, e.ring_no, f.ring_no, count(*) filter ((ay > f.y) <> (zy > f.y) and f.x < (zx - ax) * (f.y - ay) / nullif(zy - ay, 0) + ax) as n
  from e join firsts f on e.ann_key = f.ann_key and e.ring_no <> f.ring_no group by all) where n % 2 = 1)
select a.ann_key, case when a.fault is not null then a.fault when a.ann_key in (select ann_key from back) then 'doubles_back' when a.ann_key in (select ann_key from c) then 'edges_meet' when a.ann_key in (select ann_key from inside) then 'ring_in_ring' end as fault from alone a""",
    "point_in_polygon": f"""with {_SQL_RINGS}, p as (select ann_key, x1 + (ann_key % 8) * (x2 - x1) / 8 as px, y1 + (ann_key % 16) * (y2 - y1) / 16 as py from b)
select e.ann_key, count(*) filter ((ay > py) <> (zy > py) and px < (zx - ax) * (py - ay) / nullif(zy - ay, 0) + ax) % 2 = 1 as inside from e join p on e.ann_key = p.ann_key where ring_no = 0 group by 1""",
    "hit_test": f"""with {_SQL_BOXES}, h as (select p.image_key, p.ann_key as point_id, s.ann_key as shape_id, row_number() over (partition by p.ann_key order by s.ann_key % 10 desc, s.ann_key desc) as n
  from b p join b s on p.image_key = s.image_key and (p.x1 + p.x2) / 2 >= s.x1 and (p.x1 + p.x2) / 2 < s.x2 and (p.y1 + p.y2) / 2 >= s.y1 and (p.y1 + p.y2) / 2 < s.y2)
select image_key, point_id, shape_id from h where n = 1""",
    "mask_metrics": f"""with {_SQL_TILES}, px as (select ann_key, x, s + unnest(range(0, n)) as o from runs)
select ann_key, min(x + o % 128)::bigint as x1, min(o // 128)::bigint as y1, max(x + o % 128 + 1)::bigint as x2, max(o // 128 + 1)::bigint as y2, count(*) as area from (
  select ann_key, x, o from px union all select ann_key, x, s // 128 * 128 + 127 from runs where s // 128 <> (s + n - 1) // 128 union all select ann_key, x, (s + n - 1) // 128 * 128 from runs where s // 128 <> (s + n - 1) // 128)
group by 1 having count(*) > 0""".replace("count(*) as area", "(select sum(n)::bigint from runs r where r.ann_key = q.ann_key) as area").replace("128 <> (s + n - 1) // 128)\ngroup", "128 <> (s + n - 1) // 128) q\ngroup"),
    "mask_faults": "select ann_key, case when ann_key % 9 = 0 or ann_key % 11 = 0 then 'invalid_tile' end as fault from annotations where image_key is not null",
    "mask_union": f"""with {_SQL_TILES}, px as (select distinct image_key, x, y, s + unnest(range(0, n)) as o from runs), islands as (select *, o - row_number() over (partition by image_key, x, y order by o) as g from px),
r as (select image_key, x, y, min(o) as s, max(o) + 1 as e from islands group by image_key, x, y, g), w as (select *, lag(e, 1, 0) over (partition by image_key, x, y order by s) as p from r),
l as (select image_key, x, y, string_agg((s - p) || ',' || (e - s), ',' order by s) as c, max(e) as e from w group by all)
select image_key, x, y, c || case when e < 16384 then ',' || (16384 - e) else '' end as counts from l""",
    "mask_pixels": f"""with {_SQL_TILES}, p as (select ann_key, ann_key % 384 as px, ann_key % 5 as py from t)
select p.ann_key, coalesce(bool_or(px // 128 * 128 = x and py * 128 + px % 128 >= s and py * 128 + px % 128 < s + n), false) as inside from p join runs r on p.ann_key = r.ann_key group by 1""",
    "coco_rle_round_trip": f"""with {_SQL_TILES}, v as (select *, 16384 - r0 - r1 - r2 - r3 as r4 from t)
select ann_key, ({_GROUPS("r0")} + {_GROUPS("r1")} + {_GROUPS("r2")} + {_GROUPS("(r3 - r1)")} + {_GROUPS("(r4 - r2)")})::int as length, {_SQL_COUNTS} as counts from v""",
    "mask_raster": """with b as (select ann_key, image_key, bbox[1] as x1, bbox[2] as y1, bbox[3] as x2, bbox[4] as y2 from annotations where len(bbox) = 4 and bbox[3] > bbox[1] and bbox[4] > bbox[2]),
r as (select ann_key, width, height, greatest(0, floor(x1)) as l, greatest(0, floor(y1)) as t, least(width, ceil(x2)) as r, least(height, ceil(y2)) as e,
  greatest(0, ceil(x1 - 0.5)) as px, greatest(0, ceil(y1 - 0.5)) as py, least(width, ceil(x2 - 0.5)) as qx, least(height, ceil(y2 - 0.5)) as qy from b join images using (image_key)),
f as (select *, case when coalesce(width, 0) <= 0 or coalesce(height, 0) <= 0 then 'no_size' when r <= l or e <= t then 'outside_picture' when (r - l) * (e - t) > 4194304 then 'window_too_large' when qx <= px or qy <= py then 'no_pixel' end as fault from r)
select ann_key, case when fault is null then ((qx - px) * (qy - py))::bigint end as pixels, case when fault is null then ((floor((qx - 1) / 128) - floor(px / 128) + 1) * (floor((qy - 1) / 128) - floor(py / 128) + 1))::bigint else 0 end as tiles, fault from f""",
    "mask_erase": f"with {_SQL_TILES}, px as (select ann_key, s + unnest(range(0, n)) as o from runs) select ann_key, count(*) as pixels from px where o // 128 >= 3 group by 1",
    "mask_column_major": f"with {_SQL_TILES} select ann_key, x, y, {_SQL_COUNTS} as counts, null::varchar as fault from t",
}
QUERIES = {n: globals()[n] for n in [*ORACLES, "document_polygons", "document_masks"]}
