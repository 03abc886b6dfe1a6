"""Revision, import, catalog and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore import exports as E
from framelore.functions.text import document_digest
from framelore.operators import catalogs as C
from framelore.operators import revisions as R
from framelore.operators.preflight import preflight
from framelore.tables import table


def _images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "images")


def _docs(spark, d):
    return table(spark, d, "annotation_docs").select("doc_key", "image_key", "layer", "revision", "saved_at")


def effective_status(spark, d):
    return R.effective_revisions(_images(spark, d), _docs(spark, d)).select("image_key", "layer", "doc_key", "status")


def effective_by_digest(spark, d):
    """As ``effective_status``, drafts judged by the digest of what they were made on.

    The tables hold no base digest, so two of three drafts get that of the
    document in force without drafts, the others their own.
    """
    docs = table(spark, d, "annotation_docs").select("doc_key", "image_key", "layer", "revision", "saved_at", document_digest("body").alias("digest"))
    base = R.effective_revisions(_images(spark, d), docs, include_drafts=False).select("image_key", "doc_key").join(docs.select("doc_key", F.col("digest").alias("_base")), "doc_key").select("image_key", "_base")
    made = docs.join(base, "image_key", "left").withColumn("base_digest", F.when(F.col("layer") == R.DRAFTS, F.when(F.col("doc_key") % 3 < 2, F.col("_base")).otherwise(F.reverse("digest"))))
    return R.effective_revisions(_images(spark, d), made).select("image_key", "layer", "doc_key", "status")


def review_outcomes(spark, d):
    """Decisions on the model's objects; every seventh picture has moved on, some of those hold the value already."""
    a = table(spark, d, "annotations").where("image_key is not null")
    items = a.where("source = 'ai_suggestion'").select(F.col("image_key").alias("entity"), F.col("ann_key").alias("item_id"), F.when(F.col("ann_key") % 4 == 0, "accepted").otherwise("pending").alias("status"), F.lit("r1").alias("base"), (F.col("ann_key") % 10).cast("string").alias("value"))
    decisions = a.where("ann_key % 5 <> 0 and source in ('ai_suggestion', 'imported_coarse')").select(F.col("image_key").alias("entity"), F.col("ann_key").alias("item_id"), F.when(F.col("ann_key") % 3 == 0, "reject").otherwise("accept").alias("action"))
    bases = a.select(F.col("image_key").alias("entity")).distinct().select("entity", F.when(F.col("entity") % 7 == 0, "r2").otherwise("r1").alias("base"), F.array(F.lit("1"), F.lit("2")).alias("values"))
    return R.review_suggestions(items, decisions, bases)


def source_faults(spark, d):
    """Pictures against their files, some of which are gone, changed or resized since."""
    images = _images(spark, d).where("path is not null").groupBy("path").agg(F.min(F.struct("image_key", "width", "height", "sha256")).alias("i")).select("path", "i.*")
    actual = images.where("image_key % 11 <> 0").select("path", F.when(F.col("image_key") % 13 == 0, F.col("width") + 1).otherwise(F.col("width")).alias("width"), "height", F.when(F.col("image_key") % 17 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return E.source_faults(images, actual)


def _snapshot(policy):
    def run(spark, d):
        taken, _ = R.snapshot(_images(spark, d), _docs(spark, d), policy)
        counts = table(spark, d, "annotations").where("image_key is not null").groupBy("image_key").agg(F.count("*").alias("objects"))
        return taken.join(counts, "image_key", "left").groupBy("layer", "status").agg(F.count("*").alias("images"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.count_if(F.col("objects").isNull()).alias("empty_images"))

    return run


snapshot_reviewed, snapshot_reviewed_or_ai, snapshot_all = (_snapshot(p) for p in R.POLICIES)


def skipped_images(spark, d):
    _, skipped = R.snapshot(_images(spark, d), _docs(spark, d), "reviewed_or_ai", ["train", "val"])
    return skipped.select("image_key", "status")


CUT = "2023-01-08 00:00:00"


def _merge(policy):
    def run(spark, d):
        """Pictures imported from a day on meet those imported before it."""
        rows = _images(spark, d).where("path is not null").select("path", F.col("image_key").alias("ord"), "status", "split", (F.col("imported_at") < F.lit(CUT).cast("timestamp_ntz")).alias("old"))
        return R.merge_import(rows.where("old"), rows.where("not coalesce(old, false)"), policy)

    return run


import_merge_keep, import_merge_update, import_merge_error = (_merge(p) for p in ("keep_existing", "update_coarse", "error"))


def import_summary(spark, d):
    return R.import_summary(_merge("update_coarse")(spark, d))


def split_counts(spark, d):
    return R.split_counts(_images(spark, d))


def dataset_counts(spark, d):
    """Per source: pictures, objects, pictures without objects."""
    per = table(spark, d, "annotations").where("image_key is not null").groupBy("image_key").agg(F.count("*").alias("n"))
    return _images(spark, d).join(per, "image_key", "left").groupBy("source_id").agg(F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"), F.count_if(F.col("n").isNull()).alias("empty_images"))


def constraint_violations(spark, d):
    return R.violations(_images(spark, d), table(spark, d, "annotations"), table(spark, d, "label_catalog"), table(spark, d, "import_sources"))


def export_preflight(spark, d):
    return preflight(table(spark, d, "annotations"), _images(spark, d))


def revision_chain(spark, d):
    return R.revision_chain(_docs(spark, d))


def _classes(spark, d):
    s = table(spark, d, "import_sources").select("source_id", F.posexplode("labels").alias("pos", "name"))
    return s.select("source_id", "name", F.concat_ws("/", "source_id", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("ord"))


def category_merge(spark, d):
    return C.merge_categories(_classes(spark, d))


def category_append(spark, d):
    known = table(spark, d, "label_catalog").select("category_id", F.col("category_name").alias("name"))
    mapping = table(spark, d, "import_sources").select("source_id", F.explode("category_mapping").alias("name", "target"))
    incoming = _classes(spark, d).join(mapping, ["source_id", "name"], "left").select("name", "target", "ord")
    return C.append_categories(known, incoming.unionByName(mapping.select("name", "target", F.concat_ws("/", F.lit("~"), "source_id", "name").alias("ord"))))


def coco_category_ids(spark, d):
    catalog = table(spark, d, "label_catalog")
    own = F.when(F.col("category_id") % 4 == 0, F.lit(None).cast("int")).when(F.col("category_id") % 5 == 0, F.lit(7)).otherwise(F.col("category_id") - 2)
    return C.coco_ids(catalog.select(F.col("category_id").alias("ord"), F.col("category_name").alias("name"), own.alias("source_id")))


def label_catalog_merge(spark, d):
    """The catalog meets itself with some ids moved, and its first aliases as further names."""
    catalog = table(spark, d, "label_catalog")
    current = catalog.select(F.col("category_id").alias("label_id"), F.col("category_name").alias("name"))
    moved = F.col("category_id") + F.when(F.col("category_id") % 3 == 0, 100).when(F.col("category_id") % 7 == 0, 1).otherwise(0)
    aliases = catalog.select((F.col("category_id") + 1000).alias("label_id"), F.get("aliases", F.lit(0)).alias("name")).where("name is not null")
    return C.merge_label_catalogs(current, catalog.select(moved.alias("label_id"), F.col("category_name").alias("name")).unionByName(aliases))


def labels_first_seen(spark, d):
    return C.first_seen(table(spark, d, "annotations"), "label", "ann_key").select("label", "position", "number")


def issue_histogram(spark, d):
    issues = table(spark, d, "import_reports").select("report_key", F.explode("issues").alias("i"))
    return issues.groupBy("i.severity", "i.code").agg(F.count("*").alias("issues"), F.count_distinct("report_key").alias("reports"))


def import_totals(spark, d):
    """Totals per source; reports that came twice count once, by their smallest key."""
    r = table(spark, d, "import_reports").groupBy("import_id").agg(F.min(F.struct("report_key", "source_id", "image_count", "object_count", "skipped_objects", "issues")).alias("r"))
    return r.groupBy("r.source_id").agg(F.count("*").alias("imports"), F.sum("r.image_count").alias("images"), F.sum("r.object_count").alias("objects"), F.sum("r.skipped_objects").alias("skipped"), F.sum(F.coalesce(F.size("r.issues"), F.lit(0))).alias("issues"))


def latest_reports(spark, d):
    """The newest report per source, a later key breaking ties."""
    newest = F.max(F.struct("started_at", "report_key", "import_id")).alias("m")
    return table(spark, d, "import_reports").where("source_id is not null").groupBy("source_id").agg(newest).select("source_id", "m.report_key", "m.import_id")


def job_states(spark, d):
    """States of suggestions per picture source: pending, accepted and rejected counts."""
    a = table(spark, d, "annotations")
    state = F.when(F.col("source") == "ai_suggestion", "pending").when(F.col("source").isin("human_reviewed", "final_reviewed"), "accepted").otherwise("rejected")
    s = a.withColumn("state", state)
    return s.groupBy("import_source_id").agg(*[F.count_if(F.col("state") == n).alias(n) for n in ("pending", "accepted", "rejected")], F.bool_and(F.col("state") == "accepted").alias("all_accepted"))


def suggestion_filter(spark, d):
    a = table(spark, d, "annotations").where("image_key is not null and size(bbox) = 4")
    box = [F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    frame = (F.col("ann_key") % 50).alias("frame")
    wanted = a.where("source = 'ai_suggestion'").select(F.col("ann_key").alias("key"), F.col("image_key").alias("entity"), frame, "label", *box)
    points = a.where("source = 'human_reviewed'").select(F.col("image_key").alias("entity"), frame)
    ranges = a.where("source = 'imported_coarse'").select(F.col("image_key").alias("entity"), frame.alias("first"), (F.col("ann_key") % 50 + 5).alias("last"))
    sized = _images(spark, d).where("width is not null and height is not null").select(F.col("image_key").alias("entity"), "width", "height")
    return R.new_suggestions(wanted, points, ranges, table(spark, d, "label_catalog"), sized).select("key", "entity", "frame", "label")


def extract_new_frames(spark, d):
    """Range starts that are wanted as pictures and are not there yet, by the picture's video and frame."""
    there = _images(spark, d).select(F.regexp_extract("path", "(video-[0-9a-f]{24})-frame-", 1).alias("video_id"), F.regexp_extract("path", "-frame-0*([0-9]+)", 1).try_cast("int").alias("frame_index")).where("frame_index is not null").distinct()
    wanted = table(spark, d, "visibility_ranges").where("start_frame >= 0 and video_id is not null").select("video_id", F.col("start_frame").alias("frame_index")).distinct()
    return wanted.join(there, ["video_id", "frame_index"], "left_anti")


_SQL_EFFECTIVE = """now as (select image_key, layer, arg_max(doc_key, (coalesce(revision, -1), coalesce(saved_at, timestamp '0001-01-01'), doc_key)) as doc_key, max(revision) as revision from annotation_docs where image_key is not null and layer is not null group by 1, 2),
ranked as (select *, row_number() over (partition by image_key order by case layer when 'annotations' then 1 when 'suggestions' then 2 else 3 end) as n from now where layer in ('annotations', 'suggestions', 'revisions')),
base as (select i.image_key, i.split, coalesce(r.layer, 'import') as layer, r.doc_key, coalesce(r.revision, 0) as revision,
  case r.layer when 'annotations' then 'human_reviewed' when 'suggestions' then 'ai_suggestion' when 'revisions' then 'ai_suggestion' else coalesce(i.status, 'unreviewed') end as status
  from images i left join ranked r on i.image_key = r.image_key and r.n = 1),
full_ as (select b.image_key, b.split, case when d.doc_key is not null then 'ai_drafts' else b.layer end as layer, coalesce(d.doc_key, b.doc_key) as doc_key, case when d.doc_key is not null then 'ai_suggestion' else b.status end as status
  from base b left join now d on d.image_key = b.image_key and d.layer = 'ai_drafts' and d.revision - 1 = b.revision)"""
_SQL_OBJECTS = "c as (select image_key, count(*) as n from annotations where image_key is not null group by 1)"


def _sql_snapshot(source: str, accepted: str) -> str:
    return f"with {_SQL_EFFECTIVE}, {_SQL_OBJECTS} select layer, status, count(*) as images, coalesce(sum(n), 0)::bigint as objects, count(*) filter (n is null) as empty_images from {source} f left join c on f.image_key = c.image_key where status in ({accepted}) group by 1, 2"


def _sql_merge(policy: str) -> str:
    wish = {"keep_existing": "'keep_existing'", "error": "'error'", "update_coarse": "case when h.status = 'unreviewed' or e.status in ('human_reviewed', 'final_reviewed', 'ai_suggestion') then 'keep_existing' else 'update_coarse' end"}[policy]
    return f"""select path, action, split, case action when 'add' then new_status when 'update_coarse' then 'imported_coarse' else old_status end as status from (
select coalesce(e.path, h.path) as path, case when h.path is null then 'untouched' when e.path is null then 'add' else {wish} end as action, coalesce(e.split, h.split) as split, h.status as new_status, e.status as old_status
from (select * from images where imported_at < timestamp '{CUT}' and path is not null qualify row_number() over (partition by path order by image_key) = 1) e
full join (select * from images where (imported_at >= timestamp '{CUT}' or imported_at is null) and path is not null qualify row_number() over (partition by path order by image_key) = 1) h on e.path = h.path)"""


_SQL_CLASSES = "k as (select source_id, unnest(labels) as name, generate_subscripts(labels, 1) - 1 as pos from import_sources), cl as (select source_id, name, source_id || '/' || lpad(pos::varchar, 6, '0') as ord from k)"
_SQL_MAPPING = "mp as (select source_id, unnest(map_keys(category_mapping)) as name, unnest(map_values(category_mapping)) as target from import_sources)"
ORACLES = {
    "effective_status": f"with {_SQL_EFFECTIVE} select image_key, layer, doc_key, status from full_",
    "effective_by_digest": f"""with {_SQL_EFFECTIVE}, docs as (select * from annotation_docs),
judged as (select b.image_key, b.layer, b.doc_key, b.status, n.doc_key as draft from base b left join docs k on k.doc_key = b.doc_key left join now n on n.image_key = b.image_key and n.layer = 'ai_drafts' and n.doc_key % 3 < 2 and json_valid(k.body))
select image_key, case when draft is not null then 'ai_drafts' else layer end as layer, coalesce(draft, doc_key) as doc_key, case when draft is not null then 'ai_suggestion' else status end as status from judged""",
    "review_outcomes": """with a as (select * from annotations where image_key is not null),
i as (select image_key as entity, ann_key as item_id, case when ann_key % 4 = 0 then 'accepted' else 'pending' end as status, ann_key % 10 as v from a where source = 'ai_suggestion'),
q as (select image_key as entity, ann_key as item_id, case when ann_key % 3 = 0 then 'reject' else 'accept' end as action from a where ann_key % 5 <> 0 and source in ('ai_suggestion', 'imported_coarse')),
o as (select coalesce(i.entity, q.entity) as entity, coalesce(i.item_id, q.item_id) as item_id, status, case when i.item_id is null then 'unknown_item' when action is null or status <> 'pending' then 'unchanged' when action = 'reject' then 'rejected'
  when i.entity % 7 = 0 and v in (1, 2) then 'already_there' when i.entity % 7 = 0 then 'conflict' else 'accepted' end as outcome from i full join q on i.entity = q.entity and i.item_id = q.item_id)
select entity, item_id, case when outcome in ('accepted', 'already_there') then 'accepted' when outcome = 'rejected' then 'rejected' else status end as status, outcome from o""",
    "source_faults": """with i as (select * from images where path is not null qualify row_number() over (partition by path order by image_key) = 1)
select * from (select path, case when image_key % 11 = 0 then 'missing' when sha256 is not null and image_key % 17 = 0 then 'content_changed' when image_key % 13 = 0 and width is not null then 'size_changed' end as fault from i) where fault is not null""",
    "snapshot_reviewed": _sql_snapshot("base", "'human_reviewed', 'final_reviewed'"),
    "snapshot_reviewed_or_ai": _sql_snapshot("full_", "'human_reviewed', 'final_reviewed', 'ai_suggestion'"),
    "snapshot_all": _sql_snapshot("full_", "'human_reviewed', 'final_reviewed', 'ai_suggestion', 'imported_coarse'"),
    "skipped_images": f"with {_SQL_EFFECTIVE} select image_key, status from full_ where split in ('train', 'val') and status not in ('human_reviewed', 'final_reviewed', 'ai_suggestion')",
    "import_merge_keep": _sql_merge("keep_existing"),
    "import_merge_update": _sql_merge("update_coarse"),
    "import_merge_error": _sql_merge("error"),
    "import_summary": f"select count(*) filter (action = 'add') as added, count(*) filter (action = 'update_coarse') as updated, count(*) filter (action = 'keep_existing') as skipped, count(*) filter (action = 'error') = 0 as commit_allowed from ({_sql_merge('update_coarse')})",
    "split_counts": "select s.split, count(i.image_key) as images from (values ('train'), ('val'), ('test'), ('unspecified')) s(split) left join images i on i.split = s.split group by 1",
    "dataset_counts": f"with {_SQL_OBJECTS} select source_id, count(*) as images, coalesce(sum(n), 0)::bigint as objects, count(*) filter (n is null) as empty_images from images i left join c on i.image_key = c.image_key group by 1",
    "constraint_violations": """
select 'duplicate_path' as rule, count(*) as rows from (select path from images where path is not null group by 1 having count(*) > 1)
union all select 'duplicate_source', count(*) from (select source_id from import_sources group by 1 having count(*) > 1)
union all select 'unknown_source', count(*) from images where source_id is not null and source_id not in (select source_id from import_sources)
union all select 'unknown_image', count(*) from annotations where image_key is not null and image_key not in (select image_key from images)
union all select 'duplicate_object', count(*) from (select 1 from annotations where image_key is not null group by image_key, object_id having count(*) > 1)
union all select 'unknown_label', count(*) from annotations where label is not null and label not in (select category_name from label_catalog)
union all select 'kind_not_allowed', count(*) from annotations where kind not in ('polygon', 'mask')
union all select 'outside_image', count(*) from annotations a join images i on a.image_key = i.image_key where bbox[1] < 0 or bbox[2] < 0 or bbox[3] > width or bbox[4] > height""",
    "revision_chain": """with recursive n as (select doc_key, image_key, layer, row_number() over (partition by image_key, layer order by revision nulls first, saved_at nulls first, doc_key) as k from annotation_docs where image_key is not null and layer is not null),
c as (select doc_key, image_key, layer, k, null::bigint as parent, 0 as depth from n where k = 1 union all select n.doc_key, n.image_key, n.layer, n.k, c.doc_key, c.depth + 1 from c join n on n.image_key = c.image_key and n.layer = c.layer and n.k = c.k + 1)
select doc_key, parent, depth from c""",
    "category_merge": f"""with {_SQL_CLASSES}, t as (select trim(name) as name, source_id, ord from cl where trim(name) <> '')
select (row_number() over (order by min(ord), name) - 1)::int as category_id, name, arg_min(source_id, ord) as source_id, string_agg(source_id, ',' order by ord) as source_ids, count(*) > 1 as duplicate from t group by name""",
    "category_append": f"""with {_SQL_CLASSES}, {_SQL_MAPPING}, cur as (select category_id, category_name as name from label_catalog),
w as (select coalesce(target, cl.name) as name, ord from cl left join mp on cl.source_id = mp.source_id and cl.name = mp.name union all select coalesce(target, name), '~/' || source_id || '/' || name from mp),
fresh as (select name, min(ord) as o from w where name not in (select name from cur) group by 1)
select category_id, name, false as added from cur union all select ((select max(category_id) from cur) + row_number() over (order by o, name))::int, name, true from fresh""",
    "coco_category_ids": """with recursive r as (select category_id as ord, category_name as name, case when category_id % 4 = 0 then null when category_id % 5 = 0 then 7 else category_id - 2 end as s, row_number() over (order by category_id) as k from label_catalog),
f as (select 0::bigint as k, []::bigint[] as used, null::bigint as coco_id, null::varchar as name
  union all select r.k, list_append(f.used, v.id), v.id, r.name from f join r on r.k = f.k + 1, lateral (select case when r.s >= 0 and not list_contains(f.used, r.s::bigint) then r.s::bigint
    else list_min(list_filter(range(1, len(f.used) + 2), lambda x: not list_contains(f.used, x))) end as id) v)
select name, coco_id from f where k > 0""",
    "label_catalog_merge": """with cur as (select category_id as label_id, category_name as name from label_catalog),
inc as (select category_id + case when category_id % 3 = 0 then 100 when category_id % 7 = 0 then 1 else 0 end as label_id, category_name as name from label_catalog union all select category_id + 1000, aliases[1] from label_catalog where aliases[1] is not null),
j as (select i.*, a.name as by_id, b.label_id as by_name from inc i left join cur a on a.label_id = i.label_id left join cur b on b.name = i.name)
select label_id, name, case when by_id = name then label_id when by_id is not null then null else coalesce(by_name, label_id) end as target_id, case when by_id = name then 'same' when by_id is not null then 'conflict' when by_name is not null then 'by_name' else 'new' end as outcome from j""",
    "labels_first_seen": "select label, min(ann_key) as position, (row_number() over (order by min(ann_key), label) - 1)::int as number from annotations where label is not null group by 1",
    "issue_histogram": "with i as (select report_key, unnest(issues) as i from import_reports) select i.severity as severity, i.code as code, count(*) as issues, count(distinct report_key) as reports from i group by 1, 2",
    "import_totals": """with r as (select * from import_reports qualify row_number() over (partition by import_id order by report_key) = 1)
select source_id, count(*) as imports, sum(image_count)::bigint as images, sum(object_count)::bigint as objects, sum(skipped_objects)::bigint as skipped, sum(coalesce(len(issues), 0))::bigint as issues from r group by 1""",
    "latest_reports": "select source_id, report_key, import_id from import_reports where source_id is not null qualify row_number() over (partition by source_id order by started_at desc, report_key desc) = 1",
    "job_states": """select import_source_id, count(*) filter (source = 'ai_suggestion') as pending, count(*) filter (source in ('human_reviewed', 'final_reviewed')) as accepted,
count(*) filter (source is null or source not in ('ai_suggestion', 'human_reviewed', 'final_reviewed')) as rejected, count(*) = count(*) filter (source in ('human_reviewed', 'final_reviewed')) as all_accepted from annotations group by 1""",
    "suggestion_filter": """with a as (select *, ann_key % 50 as frame from annotations where image_key is not null and len(bbox) = 4),
w as (select a.* from a join images i on a.image_key = i.image_key where source = 'ai_suggestion' and label in (select category_name from label_catalog) and bbox[1] >= 0 and bbox[2] >= 0 and bbox[3] <= width and bbox[4] <= height and bbox[3] > bbox[1] and bbox[4] > bbox[2])
select ann_key as key, image_key as entity, frame, label from w where not exists (select 1 from a where a.source = 'human_reviewed' and a.image_key = w.image_key and a.frame = w.frame)
and not exists (select 1 from a where a.source = 'imported_coarse' and a.image_key = w.image_key and w.frame between a.frame and a.frame + 5)""",
    "extract_new_frames": """select distinct video_id, start_frame as frame_index from visibility_ranges v where start_frame >= 0 and video_id is not null and not exists (
select 1 from images i where regexp_extract(path, '(video-[0-9a-f]{24})-frame-', 1) = v.video_id and try_cast(regexp_extract(path, '-frame-0*([0-9]+)', 1) as int) = v.start_frame)""",
    "export_preflight": r"""with f(format, geo, conf, spl, px, xml, need, jpeg) as (values ('coco_detection', 'bbox', false, false, false, false, false, false), ('coco_segmentation', 'polygon mask', false, false, false, false, false, false),
  ('yolo_detection', 'bbox', false, true, false, false, true, false), ('voc_detection', 'bbox', false, true, true, true, false, true), ('cvat_detection', 'bbox', false, false, false, true, false, false), ('labelme_detection', 'bbox', false, false, false, false, false, false),
  ('label_studio_detection', 'bbox', true, false, false, true, false, false), ('native', 'bbox polygon mask', true, true, false, false, false, false)),
i as (select format, 'unsupported_geometry' as code, 'blocking' as severity, count(*) as rows from f join annotations on not contains(geo, kind) group by 1
 union all select format, 'confidence_sidecar', 'loss', count(*) from f join annotations on confidence is not null where not conf group by 1
 union all select format, 'splits_sidecar', 'loss', count(*) from f join images on split <> 'unspecified' where not spl group by 1
 union all select format, 'unspecified_to_train', 'conversion', count(*) from f join images on split = 'unspecified' where need group by 1
 union all select format, 'integer_boxes', 'conversion', count(*) from f join annotations on len(list_filter(bbox, lambda v: v <> floor(v))) > 0 where px group by 1
 union all select format, 'jpeg_conversion', 'conversion', count(*) from f join images on not regexp_matches(lower(path), '[.]jpe?g$') where jpeg group by 1
 union all select format, 'invalid_xml_text', 'blocking', count(*) from f join annotations on regexp_matches(label, '[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]') where xml group by 1)
select * from i where rows > 0""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
