"""Queries of problems 4, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.operators import intervals, nested, rejects
from framelore.tables import table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return rejects.judge_lines(table(spark, d, "raw_label_lines"), table(spark, d, "label_catalog"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("code is not null").select("line_key", "code")


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded_objects(_judged(spark, d))


def p4_skipped(spark: SparkSession, d: str) -> DataFrame:
    return rejects.skipped_per_import(_judged(spark, d), table(spark, d, "import_reports"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tracks = intervals.merge_intervals(intervals.track_intervals(table(spark, d, "visibility_ranges")), 1, "tracks")
    videos = intervals.merge_intervals(intervals.event_intervals(table(spark, d, "video_events")), 0, "events")
    return tracks.unionByName(videos).withColumnRenamed("entity", "entity_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.node_table(table(spark, d, "annotation_docs"), values=False)
    return nested.link_children(nodes).select("doc_key", "object_id", "child", "ordinal")


def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "annotation_docs"))["objects"].withColumn("bbox", F.to_json("bbox"))


def p7_tiles(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "annotation_docs"))["tiles"].withColumn("counts", F.to_json("counts"))


def p7_fields(spark: SparkSession, d: str) -> DataFrame:
    """Attributes and lineage of all objects, entry by entry."""
    tables = nested.flat_tables(table(spark, d, "annotation_docs"))
    return tables["attributes"].withColumn("kind", F.lit("attribute")).unionByName(tables["lineage"].withColumn("kind", F.lit("lineage"))).drop("parent_pre")


QUERIES = {f.__name__: f for f in (p4_found, p4_objects, p4_skipped, p6_found, p7_found, p7_objects, p7_tiles, p7_fields)}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NINE = "^" + ",".join(["(" + _FIELD + ")"] * 9) + "$"
_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _sql_number(value: str) -> str:
    return f"(case when regexp_matches({value}, '{_NUMBER}') and isfinite(try_cast({value} as double)) then try_cast({value} as double) end)"


def _sql_judged() -> str:
    f = [f"f{i}" for i in range(9)]
    corner = [_sql_number(f"f{i}") for i in range(2, 6)]
    y = [_sql_number(f"y[{i}]") for i in range(2, 6)]
    parts = ", ".join(f"replace(regexp_replace(regexp_replace(regexp_extract(l, '{_NINE}', {i + 1}, 's'), '^\"', ''), '\"$', ''), '\"\"', '\"') as f{i}" for i in range(9))
    return f"""
with cleaned as (
  select line_key, import_id, line_format, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^\\x{{FEFF}}', ''), '[\\s\\x{{00A0}}]+$', '') as l from raw_label_lines),
lines as (select * from cleaned where l <> '' and not starts_with(l, '#')),
csv as (select *, regexp_matches(l, '^{_FIELD}(,{_FIELD})*$', 's') as sound, regexp_matches(l, '{_NINE}', 's') as nine, {parts} from lines where line_format = 'csv'),
csv_judged as (
  select line_key, case when not sound then 'broken_quoting' when not nine then 'column_count'
    when f0 = '' or f0 <> trim(f0) or contains(f0, '\\') or contains(f0, ':') or starts_with(f0, '/') or list_contains(string_split(f0, '/'), '..')
      or trim(f1) = ''
      or not coalesce({corner[0]} < {corner[2]} and {corner[1]} < {corner[3]}, false)
      or not (f6 = '' or coalesce({_sql_number("f6")} between 0 and 1, false))
      or not (f7 = '' or coalesce(regexp_matches(f7, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\dZ?)?$') and try_cast(left(f7, 10) as date) is not null, false))
    then 'invalid_value' end as code from csv),
yolo as (select line_key, string_split_regex(trim(regexp_replace(l, '\\s+', ' ', 'g')), ' ') as y from lines where line_format = 'yolo'),
yolo_judged as (
  select line_key, case when len(y) <> 5 then 'column_count'
    when not regexp_matches(y[1], '^[+-]?\\d+$') or try_cast(y[1] as bigint) not in (select category_id from label_catalog)
      or not coalesce({y[0]} between 0 and 1 and {y[1]} between 0 and 1 and {y[2]} > 0 and {y[2]} <= 1 and {y[3]} > 0 and {y[3]} <= 1, false)
    then 'invalid_value' end as code from yolo),
found as (select line_key, code from csv_judged where code is not null union all select line_key, code from yolo_judged where code is not null)"""


def _sql_objects() -> str:
    f = [_sql_number(f"f{i}") for i in range(7)]
    y = [_sql_number(f"y[{i + 1}]") for i in range(5)]
    return f"""{_sql_judged()}
select line_key, import_id, 'csv' as format, null::int as category_id, f1 as label, f0 as image_path, {f[2]} as x1, {f[3]} as y1, {f[4]} as x2, {f[5]} as y2, {f[6]} as confidence,
  case when f7 <> '' then try_cast(left(f7, 10) as date) end as reviewed_on, f8 as note from csv where line_key not in (select line_key from found)
union all select line_key, import_id, 'yolo', y[1]::int, null, null, {y[1]} - {y[3]} / 2, {y[2]} - {y[4]} / 2, {y[1]} + {y[3]} / 2, {y[2]} + {y[4]} / 2, null, null, null from yolo join lines using (line_key) where line_key not in (select line_key from found)"""


def _sql_skipped() -> str:
    return f"""{_sql_judged()},
per as (select c.import_id, count(*) filter (code is null and c.line_key in (select line_key from lines)) as loaded_objects, count(code) as skipped_objects,
  count(*) filter (code = 'broken_quoting') as broken_quoting, count(*) filter (code = 'column_count') as column_count, count(*) filter (code = 'invalid_value') as invalid_value from cleaned c left join found using (line_key) group by 1),
stated as (select import_id, arg_min(skipped_objects, report_key) filter (skipped_objects is not null) as stated_skipped from import_reports where import_id is not null group by 1)
select per.*, stated_skipped from per left join stated using (import_id)"""


def _decoded(v: str) -> str:
    """A JSON value, or the JSON that a text holds."""
    return f"(case when json_type({v}) = 'VARCHAR' then try_cast({v} ->> '$' as json) else {v} end)"


def _records(v: str, marks: tuple[str, ...]) -> str:
    """How many records a value is: a list, one record by its marks, or records by name."""
    marked = " or ".join(f"json_type({v} -> '{m}') is not null" for m in marks)
    return f"""(case json_type({v}) when 'ARRAY' then len(list_filter(from_json({v}, '["json"]'), lambda e: json_type({_decoded("e")}) = 'OBJECT'))
  when 'OBJECT' then case when len(json_keys({v})) = 0 then 0 when {marked} then 1 when len(list_filter(json_keys({v}), lambda k: coalesce(json_type({_decoded(f"({v} -> k)")}), '') <> 'OBJECT')) = 0 then len(json_keys({v})) else 1 end else 0 end)"""


def _sql_children() -> str:
    single = " or ".join(f"coalesce(json_type(os -> '{f}'), 'OBJECT') <> 'OBJECT'" for f in ("id", "kind", "label", "category_id"))
    number, elements = "in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT')", "from_json(p, '[\"json\"]')"
    pair = f"json_type(e) = 'ARRAY' and json_array_length(e) = 2 and json_type(e -> 0) {number} and json_type(e -> 1) {number}"
    return f"""
with d as (select doc_key, try_cast(body as json) as b from annotation_docs where json_valid(body)),
h as (select doc_key, b as h from d where json_type(b) = 'OBJECT' union all select doc_key, i from (select doc_key, {_decoded("(b -> 'image')")} as i from d where json_type(b) = 'OBJECT') where json_type(i) = 'OBJECT'),
o as (select doc_key, {_decoded("(h -> 'objects')")} as os from h),
x as (select doc_key, {_decoded("e")} as x, null::varchar as k from (select doc_key, unnest(from_json(os, '["json"]')) as e from o where json_type(os) = 'ARRAY')
  union all select doc_key, os, null from o where json_type(os) = 'OBJECT' and ({single})
  union all select doc_key, {_decoded("(os -> k)")}, k from (select doc_key, os, unnest(json_keys(os)) as k from o where json_type(os) = 'OBJECT' and not ({single}))),
y as (select doc_key, case when json_type(x -> 'id') is null then k else x ->> 'id' end as object_id, {_decoded("(x -> 'polygons')")} as p, {_decoded("(x -> 'mask')")} as m, {_decoded("(x -> 'provenance')")} as v from x where json_type(x) = 'OBJECT'),
z as (select *, {_decoded("(m -> 'tiles')")} as t, {_decoded("(v -> 'imports')")} as g from y),
n as (select doc_key, object_id,
  case when coalesce(json_type(p), '') <> 'ARRAY' or json_array_length(p) = 0 then 0
    when len(list_filter({elements}, lambda e: json_type(e) {number})) = json_array_length(p) or len(list_filter({elements}, lambda e: {pair})) = json_array_length(p) then 1
    else len(list_filter({elements}, lambda e: json_type({_decoded("e")}) = 'ARRAY' and json_array_length({_decoded("e")}) > 0)) end as ring,
  case when json_type(m) = 'OBJECT' then {_records("t", ("counts", "x", "y"))} else 0 end as tile, case when json_type(v) = 'OBJECT' then {_records("g", ("source", "name", "source_id"))} else 0 end as origin from z)
select doc_key, object_id, child, unnest(range(count))::int as ordinal from (unpivot n on ring, tile, origin into name child value count)"""


ORACLES = {
    "p7_found": _sql_children(),
    "p4_found": _sql_judged() + " select line_key, code from found",
    "p4_objects": _sql_objects(),
    "p4_skipped": _sql_skipped(),
    "p6_found": """
with rows as (
  select track_id as entity_id, start_frame::bigint as s, end_frame::bigint as e, 1 as touch, 't' as kind_of from visibility_ranges
  where track_id is not null and start_frame >= 0 and end_frame >= start_frame
  union all
  select video_id, round(start_s * 1000)::bigint, round(end_s * 1000)::bigint, 0, 'v' from video_events
  where kind = 'interval' and video_id is not null and start_s >= 0 and round(end_s * 1000) > round(start_s * 1000)),
ordered as (select *, max(e) over (partition by kind_of, entity_id order by s, e rows between unbounded preceding and 1 preceding) as before from rows),
numbered as (select *, sum(case when before is null or s > before + touch then 1 else 0 end) over (partition by kind_of, entity_id order by s, e rows unbounded preceding) as n from ordered),
periods as (select kind_of, entity_id, touch, n, min(s) as s, max(e) as e from numbered group by all),
following as (select *, lead(s) over (partition by kind_of, entity_id order by n) as nxt from periods)
select entity_id, 'period' as kind, s as start_at, e as end_at from following
union all
select entity_id, 'gap', e + touch, nxt - touch from following where nxt is not null""",
}
