"""Routing, boxes, search and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.functions import text as T
from framelore.operators import boxes as B
from framelore.operators import routing as R
from framelore.tables import table


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "images").select("image_key", "path", "width", "height", "split", "status")


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").where("source = 'imported_coarse' and image_key is not null").select("image_key")


def route_images(spark, d):
    return R.route_images(_sized(spark, d), _coarse(spark, d)).where("strategy is not null").select("image_key", "strategy", "estimated_tiles")


def route_summary(spark, d):
    routed = R.route_images(_sized(spark, d), _coarse(spark, d)).where("strategy is not null")
    pixels = F.sum(F.col("width").cast("bigint") * F.col("height"))
    return routed.groupBy("strategy").agg(F.count("*").alias("images"), pixels.alias("pixels"), F.max("width").alias("max_width"), F.max("height").alias("max_height"), F.sum("estimated_tiles").alias("tiles"))


def tile_grid(spark, d):
    return R.tile_grid(_sized(spark, d).where("width is not null"))


def _boxed(spark, d):
    rows = table(spark, d, "annotations").join(table(spark, d, "images").select("image_key", "width", "height"), "image_key")
    return rows, B.box_columns(F.col("bbox"))


def crop_normalize(spark, d):
    rows, b = _boxed(spark, d)
    rows = rows.where("width is not null and size(bbox) = 4 and width >= 64 and height >= 64")
    whole = [F.floor(c).cast("int") for c in (b[0], b[1], F.abs(b[2] - b[0]), F.abs(b[3] - b[1]))]
    out = R.crop_window(*whole, F.col("width"), F.col("height"))
    return rows.select("ann_key", *[c.cast("bigint").alias(n) for c, n in zip(out, ("crop_x", "crop_y", "crop_width", "crop_height"))])


def center_crops(spark, d):
    out = R.center_crop(F.col("width"), F.col("height"))
    return _sized(spark, d).where("width > 0 and height > 0").select("image_key", *[c.cast("bigint").alias(n) for c, n in zip(out, ("crop_x", "crop_y", "crop_width", "crop_height"))])


def box_clean(spark, d):
    rows, b = _boxed(spark, d)
    return rows.select("ann_key", *[c.alias(n) for n, c in B.clean_box(b, F.size("bbox"), F.col("width"), F.col("height")).items()])


def box_human_save(spark, d):
    rows, b = _boxed(spark, d)
    return rows.select("ann_key", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), B.saved_box(b, F.col("width"), F.col("height")))]).where("x1 is not null")


def box_rejects(spark, d):
    return B.rejected_rows(table(spark, d, "annotations"), table(spark, d, "images"), table(spark, d, "label_catalog")).where("code is not null")


def _good(spark, d):
    """Boxes in order inside a sized picture."""
    rows, b = _boxed(spark, d)
    named = [c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))]
    return rows.where("width > 0 and height > 0").select("ann_key", "image_key", "label", "confidence", "width", "height", *named).where("x2 > x1 and y2 > y1")


_B = ["x1", "y1", "x2", "y2"]


def _cols():
    return [F.col(c) for c in _B]


def coco_boxes(spark, d):
    out = B.to_coco(_cols())
    back = B.from_coco(out)
    return _good(spark, d).select("ann_key", *[c.alias(n) for c, n in zip(out, ("x", "y", "w", "h"))], *[c.alias(f"back_{n}") for c, n in zip(back, _B)])


def yolo_boxes(spark, d):
    out = B.to_yolo(_cols(), F.col("width"), F.col("height"))
    return _good(spark, d).select("ann_key", *[F.round(c, 9).alias(n) for c, n in zip(out, ("cx", "cy", "w", "h"))])


def voc_boxes(spark, d):
    out = B.to_voc(_cols())
    return _good(spark, d).select("ann_key", *[c.alias(n) for c, n in zip(out, ("xmin", "ymin", "xmax", "ymax"))])


def label_studio_boxes(spark, d):
    out = B.to_percent(_cols(), F.col("width"), F.col("height"))
    return _good(spark, d).select("ann_key", *[F.round(c, 9).alias(n) for c, n in zip(out, ("x", "y", "w", "h"))])


def iou_pairs(spark, d):
    return B.overlapping_pairs(_good(spark, d).withColumnRenamed("ann_key", "key")).withColumn("iou", F.round("iou", 9))


def nms_greedy(spark, d):
    return B.suppress(_good(spark, d).withColumnRenamed("ann_key", "key")).withColumnRenamed("key", "ann_key")


def path_validity(spark, d):
    return _sized(spark, d).select("image_key", F.coalesce(T.portable_path(F.col("path")), F.lit(False)).alias("portable"))


def path_keys(spark, d):
    return _sized(spark, d).where("path is not null").select("image_key", T.path_key(F.col("path")).alias("path_key"), T.path_key(F.col("path"), 12).alias("suffix"))


def slugs(spark, d):
    return table(spark, d, "annotations").where("label is not null").groupBy(T.slug(F.col("label")).alias("slug")).agg(F.count("*").alias("rows"))


def label_files(spark, d):
    moved = F.regexp_replace("path", "/(cam[0-9]+|roll|CAM-[0-9]+)/", "/images/")
    return _sized(spark, d).where("path is not null").select("image_key", T.label_file(moved).alias("label_file"))


def redact_text(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(T.redact_text(F.concat(F.lit("from /srv/data/a b.txt or C:\\x y: "), "text"))).alias("digest"))


def label_normalize(spark, d):
    rows = table(spark, d, "annotations").where("label is not null")
    return rows.groupBy(T.normalize_label(F.col("label")).alias("name")).agg(F.count("*").alias("rows"))


def color_hash(spark, d):
    return table(spark, d, "label_catalog").select("category_id", T.color_hash(F.col("category_name")).alias("color"))


def path_search_page(spark, d, query: str = "CAM0", split: str = "train", offset: int = 40, limit: int = 20):
    """A page of a literal, ASCII-case-blind search in one split; the page is the feature."""
    found = _sized(spark, d).where(T.contains_literally(F.col("path"), query) & (F.col("split") == split))
    return found.select("image_key", "path").orderBy("image_key").offset(offset).limit(limit)


def path_search_total(spark, d, query: str = "CAM07"):
    return _sized(spark, d).where(T.contains_literally(F.col("path"), query)).groupBy("split").agg(F.count("*").alias("total"))


def keyset_page(spark, d, position: int = 100, limit: int = 50):
    """Rows from a key on; a range filter that reaches the scan, no global sort of the table."""
    return _sized(spark, d).where(F.col("image_key") >= position).select("image_key", "path").orderBy("image_key").limit(limit)


def model_json_boxes(spark, d):
    """Boxes of a model's answers in thousandths of a crop, brought to picture coordinates."""
    body = F.concat(
        F.lit('Here you are:\n```json\n{"summary": "s", "objects": [{"label": '), F.to_json(F.struct(F.col("label").alias("v"))), F.lit(', "bbox": ['),
        F.col("width").cast("string"), F.lit(", -5, 1200.5, "), F.col("height").cast("string"), F.lit('], "confidence": 0.25}, {"bbox": [1, 2], "label": {"v": "x"}}]}\n```'),
    )
    rows = _good(spark, d).where("label is not null").withColumn("answer", body)
    parsed = F.from_json(T.model_object(F.col("answer")), "objects array<struct<label: struct<v: string>, bbox: array<double>, confidence: double>>")
    items = rows.select("ann_key", "width", "height", F.posexplode(parsed.objects).alias("n", "o")).where("size(o.bbox) = 4")
    cut = [F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col("o.bbox")[i])) for i in range(4)]
    items = items.select("ann_key", "n", "width", "height", F.trim("o.label.v").alias("label"), F.coalesce("o.confidence", F.lit(0.5)).alias("confidence"), *[c.alias(n) for c, n in zip(cut, _B)])
    return items.where("x2 > x1 and y2 > y1").select(
        "ann_key", "n", "label", "confidence", *[F.round(F.col(c) / 1000 * F.col(s), 6).alias(c) for c, s in zip(_B, ("width", "height", "width", "height"))]
    )


_SIZED = "width > 0 and height > 0"
_STRIDE, _TILE = R.stride_of(1536), 1536
_SQL_ROUTED = f"""
with coarse as (select distinct image_key from annotations where source = 'imported_coarse'),
routed as (select i.*, case when greatest(width, height) <= 1536 and width::bigint * height <= 8000000 then 'direct'
  when c.image_key is not null then 'annotation_crops' when width::bigint * height <= 20000000 and greatest(width, height) <= 4608 then 'resize_whole'
  else 'overlap_tiles' end as strategy from images i left join coarse c on i.image_key = c.image_key where {_SIZED}),
tiled as (select *, case when strategy = 'overlap_tiles' then
  (case when width > {_TILE} then ceil((width - {_TILE}) / {_STRIDE}) + 1 else 1 end * case when height > {_TILE} then ceil((height - {_TILE}) / {_STRIDE}) + 1 else 1 end)::int else 1 end as estimated_tiles from routed)"""
_SQL_BOXED = "select a.*, i.width, i.height from annotations a join images i on a.image_key = i.image_key"
_SQL_GOOD = "good as (select a.ann_key, a.image_key, a.label, a.confidence, i.width, i.height, bbox[1] as x1, bbox[2] as y1, bbox[3] as x2, bbox[4] as y2 from annotations a join images i on a.image_key = i.image_key where width > 0 and height > 0 and bbox[3] > bbox[1] and bbox[4] > bbox[2])"
_SQL_CODE = """case when coalesce(len(bbox), 0) <> 4 then 'not_four_values' when bbox[1] is null or bbox[2] is null or bbox[3] is null or bbox[4] is null or not (isfinite(bbox[1]) and isfinite(bbox[2]) and isfinite(bbox[3]) and isfinite(bbox[4])) then 'not_finite'
  when bbox[3] <= bbox[1] or bbox[4] <= bbox[2] then 'reversed_or_empty' when width is null or height is null then 'no_size'
  when not (bbox[1] < width and bbox[3] > 0 and bbox[2] < height and bbox[4] > 0) then 'outside_image'
  when bbox[1] < 0 or bbox[2] < 0 or bbox[3] > width or bbox[4] > height then 'clipped_bbox' end"""

ORACLES = {
    "route_images": _SQL_ROUTED + " select image_key, strategy, estimated_tiles from tiled",
    "route_summary": _SQL_ROUTED + " select strategy, count(*) as images, sum(width::bigint * height)::bigint as pixels, max(width) as max_width, max(height) as max_height, sum(estimated_tiles)::bigint as tiles from tiled group by 1",
    "tile_grid": f"""
with axis as (select distinct n from (select width as n from images where {_SIZED} union all select height from images where {_SIZED})),
starts as (select distinct n, (s // 16) * 16 as s from (
  select n, unnest(range(0, greatest(n - {_TILE}, 0) + 1, {_STRIDE})) as s from axis union all select n, greatest(n - {_TILE}, 0) from axis)),
numbered as (select n, s, row_number() over (partition by n order by s) - 1 as k, count(*) over (partition by n) as c from starts)
select image_key, (r.k * x.c + x.k)::int as tile_index, x.s::bigint as x, r.s::bigint as y, least({_TILE + 15}, width - x.s)::int as tile_width, least({_TILE + 15}, height - r.s)::int as tile_height
from images i join numbered x on x.n = i.width join numbered r on r.n = i.height where {_SIZED}""",
    "crop_normalize": f"""
with b as ({_SQL_BOXED}), s as (select *, greatest(64, least(4096, floor(abs(bbox[3] - bbox[1])), width)) as w, greatest(64, least(4096, floor(abs(bbox[4] - bbox[2])), height)) as h from b where width >= 64 and height >= 64 and len(bbox) = 4)
select ann_key, (floor(greatest(0, least(width - w, floor(bbox[1]))) / 16) * 16)::bigint as crop_x, (floor(greatest(0, least(height - h, floor(bbox[2]))) / 16) * 16)::bigint as crop_y, w::bigint as crop_width, h::bigint as crop_height from s""",
    "center_crops": f"""select image_key, ((width - least(width, 1024)) // 2 // 16 * 16)::bigint as crop_x, ((height - least(height, 1024)) // 2 // 16 * 16)::bigint as crop_y,
least(width, 1024)::bigint as crop_width, least(height, 1024)::bigint as crop_height from images where {_SIZED}""",
    "box_clean": f"""
with b as (select *, {_SQL_CODE} as code from ({_SQL_BOXED}))
select ann_key, code, case when code is null or code = 'clipped_bbox' then greatest(bbox[1], 0.0) end as x1, case when code is null or code = 'clipped_bbox' then greatest(bbox[2], 0.0) end as y1,
case when code is null or code = 'clipped_bbox' then least(bbox[3], width) end as x2, case when code is null or code = 'clipped_bbox' then least(bbox[4], height) end as y2 from b""",
    "box_human_save": f"""
with b as ({_SQL_BOXED}), c as (select ann_key, list_transform([bbox[1], bbox[3]], lambda v: case when v < 0 then 0.0 when v > width then width else v end) as x, list_transform([bbox[2], bbox[4]], lambda v: case when v < 0 then 0.0 when v > height then height else v end) as y
  from b where len(bbox) = 4 and bbox[1] is not null and bbox[2] is not null and bbox[3] is not null and bbox[4] is not null and width is not null and height is not null)
select ann_key, list_min(x)::double as x1, list_min(y)::double as y1, list_max(x)::double as x2, list_max(y)::double as y2 from c where list_min(x) < list_max(x) and list_min(y) < list_max(y)""",
    "box_rejects": f"""
with n as (select *, row_number() over (partition by image_key, object_id order by ann_key) as n from annotations),
b as (select n.*, i.image_key as found, width, height, c.category_name from n left join images i on n.image_key = i.image_key left join label_catalog c on c.category_name = n.label),
j as (select ann_key, case when found is null then 'missing_image' when n > 1 then 'duplicate_id' when category_name is null then 'unknown_category' else {_SQL_CODE} end as code from b)
select * from j where code is not null""",
    "coco_boxes": f"with {_SQL_GOOD} select ann_key, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, x1 as back_x1, y1 as back_y1, x2 as back_x2, y2 as back_y2 from good",
    "yolo_boxes": f"with {_SQL_GOOD} select ann_key, round((x1 + x2) / (2 * width), 9) as cx, round((y1 + y2) / (2 * height), 9) as cy, round((x2 - x1) / width, 9) as w, round((y2 - y1) / height, 9) as h from good",
    "voc_boxes": f"with {_SQL_GOOD} select ann_key, floor(x1)::int + 1 as xmin, floor(y1)::int + 1 as ymin, ceil(x2)::int as xmax, ceil(y2)::int as ymax from good",
    "label_studio_boxes": f"with {_SQL_GOOD} select ann_key, round(100 * x1 / width, 9) as x, round(100 * y1 / height, 9) as y, round(100 * (x2 - x1) / width, 9) as w, round(100 * (y2 - y1) / height, 9) as h from good",
    "iou_pairs": f"""
with {_SQL_GOOD}, p as (select a.image_key, a.label, a.ann_key as key_a, b.ann_key as key_b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as s from good a join good b on a.image_key = b.image_key and a.label = b.label and a.ann_key < b.ann_key
  where least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1))
select image_key, label, key_a, key_b, round(i / (s - i), 9) as iou from p where i / (s - i) >= 0.5""",
    "nms_greedy": f"""
with recursive {_SQL_GOOD}, o as (select *, row_number() over (partition by image_key, label order by coalesce(confidence, 0) desc, x1, y1, x2, y2, ann_key) as n from good where label is not null),
r as (
  select image_key, label, n, [ann_key] as kept, [[x1, y1, x2, y2]] as boxes, true as is_kept, ann_key, 0 as rank from o where n = 1
  union all
  select o.image_key, o.label, o.n,
    case when k.hit then r.kept else list_append(r.kept, o.ann_key) end, case when k.hit then r.boxes else list_append(r.boxes, [o.x1, o.y1, o.x2, o.y2]) end, not k.hit, o.ann_key, len(r.kept)::int
  from r join o on o.image_key = r.image_key and o.label = r.label and o.n = r.n + 1,
  lateral (select len(list_filter(r.boxes, lambda b: least(b[3], o.x2) > greatest(b[1], o.x1) and least(b[4], o.y2) > greatest(b[2], o.y1)
    and (least(b[3], o.x2) - greatest(b[1], o.x1)) * (least(b[4], o.y2) - greatest(b[2], o.y1))
    / ((b[3] - b[1]) * (b[4] - b[2]) + (o.x2 - o.x1) * (o.y2 - o.y1) - (least(b[3], o.x2) - greatest(b[1], o.x1)) * (least(b[4], o.y2) - greatest(b[2], o.y1))) >= 0.5)) > 0 as hit) k)
select image_key, label, ann_key, rank from r where is_kept""",
    "path_validity": r"""select image_key, coalesce(trim(path) <> '' and path = trim(path) and not regexp_matches(path, '[\\:\x00-\x1f]') and not regexp_matches(path, '^\s|\s$|^[\x{00A0}]|[\x{00A0}]$') and not starts_with(path, '/')
and not list_contains(string_split(path, '/'), '..') and len(list_filter(string_split(path, '/'), lambda p: p not in ('', '.'))) > 0, false) as portable from images""",
    "path_keys": "select image_key, left(sha256(path), 24) as path_key, left(sha256(path), 12) as suffix from images where path is not null",
    "slugs": r"""select coalesce(nullif(left(lower(trim(regexp_replace(label, '[^A-Za-z0-9_-]+', '-', 'g'), '-')), 48), ''), 'project') as slug, count(*) as rows from annotations where label is not null group by 1""",
    "label_files": r"""with m as (select image_key, regexp_replace(path, '/(cam[0-9]+|roll|CAM-[0-9]+)/', '/images/', 'g') as p from images where path is not null),
s as (select image_key, string_split(p, '/') as s from m), f as (select image_key, s, list_position(list_reverse(s[1:-2]), 'images') as back from s),
j as (select image_key, array_to_string(case when back > 0 then list_concat(s[1:len(s) - 1 - back], ['labels'], s[len(s) - back + 1:]) else s end, '/') as p from f)
select image_key, regexp_replace(p, '([^/])\.[^./]+$', '\1') || '.txt' as label_file from j""",
    "redact_text": r"""select doc_id, md5(regexp_replace('from /srv/data/a b.txt or C:\x y: ' || text, '(^|[^\pL\pM\pN_:/])((?:/[\pL\pM\pN_.~-][^\s"''<>\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*|[A-Za-z]:[\\/][^\s"''<>]*))', '\1[local-path]', 'g')) as digest from documents where text is not null""",
    "label_normalize": r"""select trim(regexp_replace(label, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as name, count(*) as rows from annotations where label is not null group by 1""",
    "color_hash": """
with recursive c as (select category_id, category_name as s, 0::bigint as h, 0 as i from label_catalog
union all select category_id, s, (h * 31 + unicode(s[i + 1])) % 4294967296, i + 1 from c where i < length(s))
select category_id, h % 12 as color from c where i = length(s)""",
    "path_search_page": "select image_key, path from images where contains(lower(path), 'cam0') and split = 'train' order by image_key limit 20 offset 40",
    "path_search_total": "select split, count(*) as total from images where contains(lower(path), 'cam07') group by 1",
    "keyset_page": "select image_key, path from images where image_key >= 100 order by image_key limit 50",
    "model_json_boxes": f"""with {_SQL_GOOD} select ann_key, 0 as n, trim(label, ' ') as label, 0.25::double as confidence, round(least(width, 1000) / 1000 * width, 6) as x1, 0.0::double as y1, width::double as x2,
round(least(height, 1000) / 1000 * height, 6) as y2 from good where label is not null and least(width, 1000) < 1000""",
}
_NAMES = list(ORACLES)
QUERIES = {n: globals()[n] for n in _NAMES}
