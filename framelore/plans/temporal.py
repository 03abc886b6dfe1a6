"""Timeline and track queries.

Frames come from the event stream (a user's events in order are a recording of
uneven timing), tracks from the visibility ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelore.operators import timeline as L
from framelore.operators import tracks as K
from framelore.tables import table


def _frames(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), "event_type")
    first = events.groupBy("video_id").agg(F.min("us").alias("us0"))
    return events.join(first, "video_id").select("video_id", "event_id", (F.col("n") - 1).alias("frame_index"), ((F.col("us") - F.col("us0")) / 1e6).alias("ts"), "event_type")


def _limits(frames: DataFrame) -> DataFrame:
    """The middle of each recording."""
    return frames.groupBy("video_id").agg((F.max("ts") / 8).alias("lower"), (F.max("ts") * 7 / 8).alias("upper"))


def frame_order(spark, d):
    return L.frame_order(_frames(spark, d)).select("video_id", "frame_index", "increasing", F.round("duration", 6).alias("duration"))


def _probes(spark, d):
    """Times between the frames: each event's time moved by its number."""
    return _frames(spark, d).select("video_id", F.col("event_id").alias("point_id"), (F.col("ts") + F.col("event_id") % 1000 - 400).alias("at"))


def frame_asof(spark, d):
    return L.frame_at(_probes(spark, d), _frames(spark, d))


def frame_nearest(spark, d):
    f = _frames(spark, d)
    return L.nearest_frame(_probes(spark, d), f, _limits(f)).select("video_id", "point_id", "frame_index")


def sample_interval(spark, d, step: float = 100000.0):
    f = _frames(spark, d)
    return L.sample_interval(f, _limits(f), step).select("video_id", "frame_index", "fault")


def sample_count(spark, d, count: int = 9):
    f = _frames(spark, d)
    return L.sample_count(f, _limits(f), count).select("video_id", "frame_index")


def sample_events(spark, d):
    f = _frames(spark, d)
    at = f.where("event_type = 'error'").select("video_id", F.col("event_id").alias("point_id"), (F.col("ts") + 0.5).alias("at"))
    return L.sample_events(f, _limits(f), at).select("video_id", "frame_index")


def even_indices(spark, d):
    v = table(spark, d, "video_manifest").where("frame_count > 0")
    return v.select("video_key", F.explode(L.even_indices(F.lit(0), F.col("frame_count") - 1, 8)).alias("frame_index"))


def event_faults(spark, d):
    length = table(spark, d, "video_manifest").groupBy("video_id").agg(F.max("duration").alias("duration"))
    e = table(spark, d, "video_events").join(length, "video_id", "left")
    fault = L.event_fault(F.col("kind"), F.col("start_s"), F.col("end_s"), F.col("label_id"), F.col("description"), F.col("duration"))
    return e.select("event_key", fault.alias("fault"))


def timeline_placement(spark, d):
    """Left edge and width of each event as fractions of its recording."""
    length = table(spark, d, "video_manifest").where("duration > 0").groupBy("video_id").agg(F.max("duration").alias("duration"))
    at = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / F.col("duration")))
    e = table(spark, d, "video_events").where("start_s is not null").join(length, "video_id")
    left = at(F.col("start_s"))
    return e.select("event_key", F.round(left, 9).alias("left_edge"), F.round(at(F.coalesce("end_s", "start_s")) - left, 9).alias("width"))


def review_state(spark, d):
    """Whether all events of a recording are reviewed, and how many are not."""
    return table(spark, d, "video_events").groupBy("video_id").agg(F.bool_and("reviewed").alias("all_reviewed"), F.count_if(~F.col("reviewed")).alias("open_events"))


def _spans(spark, d):
    return table(spark, d, "visibility_ranges").where("track_id is not null and start_frame >= 0 and end_frame >= start_frame")


def _tracks(spark, d):
    life = _spans(spark, d).groupBy("track_id").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    third = F.floor((F.col("end_frame") - F.col("start_frame")) / 3).cast("int")
    return life.withColumn("ask_start", F.col("start_frame") + third).withColumn("ask_end", F.col("end_frame") - third)


def coverage(spark, d):
    return K.coverage(_tracks(spark, d), _spans(spark, d))


def span_overlaps(spark, d):
    return K.overlapping_spans(_spans(spark, d))


def frame_state(spark, d):
    t = _tracks(spark, d)
    asked = t.select("track_id", F.explode(F.array("start_frame", "ask_start", F.col("ask_end") + 1, F.col("end_frame") + 1)).alias("frame_index")).distinct()
    spans = _spans(spark, d)
    keys = spans.where("start_frame = end_frame").select("track_id", F.col("start_frame").alias("frame_index"), "visibility")
    return K.frame_states(asked, t, keys, spans.where("start_frame < end_frame"))


_RANGE = ["range_key", "track_id", "start_frame", "end_frame", "reviewed"]


def track_split(spark, d):
    cuts = _tracks(spark, d).where("ask_start > start_frame").select("track_id", F.col("ask_start").alias("at"))
    return K.split_tracks(_spans(spark, d).select(*_RANGE), cuts)


def split_references(spark, d):
    """Events refer to their recording's two halves; the cut lies at a quarter of the recording."""
    length = table(spark, d, "video_manifest").where("duration > 0").groupBy("video_id").agg(F.max("duration").alias("duration"))
    cuts = length.select(F.col("video_id").alias("old"), F.concat("video_id", F.lit("/2")).alias("new"), (F.col("duration") / 4).alias("boundary"))
    events = table(spark, d, "video_events").where("start_s is not null").select(F.col("event_key").alias("event_id"), "kind", F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.array("video_id", F.lit("other")).alias("track_ids"))
    return K.split_references(events, cuts).select("event_id", F.array_join("track_ids", ",").alias("track_ids"))


def track_merge(spark, d):
    """All tracks of one recording become its smallest."""
    spans = _spans(spark, d)
    first = spans.groupBy("video_id").agg(F.min("track_id").alias("into"))
    merges = spans.select("video_id", F.col("track_id").alias("old")).distinct().join(first, "video_id").where("old <> into").select("old", "into").groupBy("old").agg(F.min("into").alias("into"))
    return K.merge_tracks(spans.select(*_RANGE), merges)


def range_delete(spark, d):
    cleared = _tracks(spark, d).where("ask_end >= ask_start").select("track_id", F.col("ask_start").alias("from_frame"), F.col("ask_end").alias("to_frame"))
    return K.clear_span(_spans(spark, d).select(*_RANGE), cleared)


def suggestion_accept(spark, d):
    spans = _spans(spark, d)
    keys = spans.select("track_id", F.col("start_frame").alias("frame_index"), F.when(F.col("reviewed"), "human").otherwise("ai").alias("origin")).groupBy("track_id", "frame_index").agg(F.max("origin").alias("origin"))
    suggestions = spans.select("track_id", F.explode(F.array("start_frame", "end_frame")).alias("frame_index"))
    return K.accepted_suggestions(keys, suggestions, spans.where("visibility = 'occluded'").select("track_id", "start_frame", "end_frame"))


def video_duplicates(spark, d):
    """Imports of a recording already there by digest: the first is kept, later ones are relinked or skipped."""
    v = table(spark, d, "video_manifest").where("sha256 is not null")
    first = v.groupBy("sha256").agg(F.min(F.struct("imported_at", "video_key", "name")).alias("f"))
    action = F.when(F.col("video_key") == F.col("f.video_key"), "import").when(F.col("name").eqNullSafe(F.col("f.name")), "skip").otherwise("relink")
    return v.join(first, "sha256").select("video_key", action.alias("action"))


_SQL_FRAMES = """e as (select user_id as video_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_index, event_type from events),
f as (select video_id, event_id, frame_index, (us - min(us) over (partition by video_id)) / 1e6 as ts, event_type from e),
lim as (select video_id, max(ts) / 8 as lower, max(ts) * 7 / 8 as upper from f group by 1),
g as (select f.* from f join lim using (video_id) where ts >= lower and ts <= upper)"""
_SQL_NEAR = """near as (select p.video_id, p.point_id, g.frame_index, row_number() over (partition by p.video_id, p.point_id order by abs(g.ts - p.at), g.frame_index) as n from p join g on p.video_id = g.video_id)"""
_SQL_SPANS = """s as (select * from visibility_ranges where track_id is not null and start_frame >= 0 and end_frame >= start_frame),
t0 as (select track_id, min(start_frame) as a, max(end_frame) as b from s group by 1), t as (select *, a + (b - a) // 3 as qa, b - (b - a) // 3 as qb from t0)"""

ORACLES = {
    "frame_order": f"""with {_SQL_FRAMES}, n as (select a.video_id, a.frame_index, a.ts, b.ts as nxt, c.ts as prv from f a left join f b on a.video_id = b.video_id and b.frame_index = a.frame_index + 1 left join f c on a.video_id = c.video_id and c.frame_index = a.frame_index - 1)
select video_id, frame_index::int as frame_index, prv is null or ts > prv as increasing, round(coalesce(nxt - ts, ts - prv, 0.0), 6) as duration from n""",
    "frame_asof": f"""with {_SQL_FRAMES}, p as (select video_id, event_id as point_id, ts + event_id % 1000 - 400 as at from f)
select p.video_id, p.point_id, coalesce(f.frame_index, 0)::bigint as frame_index from (select *, p."at" + 1e-6 as moved from p) p asof left join f on p.video_id = f.video_id and p.moved >= f.ts""",
    "frame_nearest": f"""with {_SQL_FRAMES}, p as (select video_id, event_id as point_id, ts + event_id % 1000 - 400 as at from f),
a as (select p.video_id, p.point_id, p.at, g.frame_index, g.ts from p asof left join g on p.video_id = g.video_id and p.at >= g.ts),
b as (select p.video_id, p.point_id, g.frame_index, g.ts from p asof left join g on p.video_id = g.video_id and p.at <= g.ts)
select a.video_id, a.point_id, case when b.ts is null then a.frame_index when a.ts is null or b.ts - a.at < a.at - a.ts then b.frame_index else a.frame_index end as frame_index
from a join b on a.video_id = b.video_id and a.point_id = b.point_id where a.ts is not null or b.ts is not null""",
    "sample_interval": f"""with {_SQL_FRAMES}, p as (select video_id, k as point_id, lower + k * 100000.0::double as at from (select *, unnest(range(0, floor((upper - lower) / 100000.0::double)::bigint + 1)) as k from lim where floor((upper - lower) / 100000.0::double) < 1000)), {_SQL_NEAR}
select distinct video_id, frame_index, null::varchar as fault from near where n = 1
union all select video_id, null, 'too_many_samples' from lim where floor((upper - lower) / 100000.0::double) >= 1000""",
    "sample_count": f"""with {_SQL_FRAMES}, p as (select video_id, k as point_id, lower + (upper - lower) * k / 8 as at from (select *, unnest(range(0, 9)) as k from lim)), {_SQL_NEAR} select distinct video_id, frame_index from near where n = 1""",
    "sample_events": f"""with {_SQL_FRAMES}, p as (select f.video_id, f.event_id as point_id, f.ts + 0.5 as at from f join lim using (video_id) where event_type = 'error' and f.ts + 0.5 >= lower and f.ts + 0.5 <= upper), {_SQL_NEAR}
select distinct f.video_id, f.frame_index from near join f on near.video_id = f.video_id and abs(f.frame_index - near.frame_index) <= 1 where n = 1""",
    "even_indices": "select distinct video_key, round_even((frame_count - 1) * k / 7, 0)::bigint as frame_index from (select *, unnest(range(0, 8)) as k from video_manifest where frame_count > 0)",
    "event_faults": """with d as (select video_id, max(duration) as duration from video_manifest group by 1)
select event_key, case when kind is null or kind not in ('interval', 'point') then 'unknown_kind' when start_s is null or isnan(start_s) or start_s < 0 then 'bad_start' when kind = 'point' and end_s is not null then 'point_with_end'
when kind = 'interval' and (end_s is null or isnan(end_s)) then 'missing_end' when kind = 'interval' and end_s <= start_s then 'reversed' when coalesce(end_s, start_s) > duration + 1e-6 then 'past_video_end'
when trim(coalesce(label_id, '')) || trim(coalesce(description, '')) = '' then 'nothing_said' end as fault from video_events left join d using (video_id)""",
    "timeline_placement": """with d as (select video_id, max(duration) as duration from video_manifest where duration > 0 group by 1),
p as (select event_key, greatest(0.0, least(1.0, start_s / duration)) as a, greatest(0.0, least(1.0, coalesce(end_s, start_s) / duration)) as b from video_events join d using (video_id) where start_s is not null)
select event_key, round(a, 9) as left_edge, round(b - a, 9) as width from p""",
    "review_state": "select video_id, count(*) = count(*) filter (reviewed) as all_reviewed, count(*) filter (not reviewed) as open_events from video_events group by 1",
    "coverage": f"""with {_SQL_SPANS},
c as (select s.track_id, qa, qb, start_frame as x, end_frame as y from s join t on s.track_id = t.track_id where reviewed and start_frame <= qb and end_frame >= qa),
m as (select *, max(y) over (partition by track_id order by x, y rows between unbounded preceding and 1 preceding) as before from c),
gaps as (select track_id, qa as g from t where qa <= qb and not exists (select 1 from c where c.track_id = t.track_id and x <= qa)
  union all select track_id, before + 1 from m where x > before + 1 and before + 1 <= qb and before + 1 >= qa
  union all select track_id, max(y) + 1 from c group by track_id having max(y) < min(qb))
select t.track_id, min(g) is null as covered, min(g)::bigint as first_gap from t left join gaps on t.track_id = gaps.track_id group by 1""",
    "span_overlaps": f"with {_SQL_SPANS}, n as (select track_id, end_frame, lead(start_frame) over (partition by track_id order by start_frame, end_frame) as nxt from s) select distinct track_id from n where end_frame >= nxt",
    "frame_state": f"""with {_SQL_SPANS}, q as (select distinct track_id, unnest([a, qa, qb + 1, b + 1]) as frame_index from t)
select q.track_id, q.frame_index, case when q.frame_index > b then 'inactive' else coalesce(min(visibility) filter (start_frame = end_frame), min(visibility) filter (start_frame < end_frame), 'missing') end as state
from q join t on q.track_id = t.track_id left join s on s.track_id = q.track_id and q.frame_index between start_frame and end_frame group by q.track_id, q.frame_index, b""",
    "track_split": f"""with {_SQL_SPANS}, c as (select track_id, qa as cut from t where qa > a)
select range_key, s.track_id, start_frame, least(end_frame, coalesce(cut - 1, end_frame)) as end_frame, reviewed and cut is null as reviewed from s left join c on s.track_id = c.track_id where cut is null or start_frame < cut
union all select range_key, s.track_id || '/2', greatest(start_frame, cut), end_frame, false from s join c on s.track_id = c.track_id where end_frame >= cut""",
    "split_references": """with d as (select video_id, max(duration) / 4 as boundary from video_manifest where duration > 0 group by 1)
select event_key as event_id, case when boundary is null or e.video_id is null then concat_ws(',', e.video_id, 'other') else array_to_string(list_filter([case when start_s < boundary then e.video_id end, 'other',
  case when (kind = 'interval' and end_s > boundary) or (kind <> 'interval' and start_s >= boundary) then e.video_id || '/2' end], lambda x: x is not null), ',') end as track_ids
from video_events e left join d on e.video_id = d.video_id where start_s is not null""",
    "track_merge": f"""with {_SQL_SPANS}, v as (select video_id, min(track_id) as target from s group by 1), m as (select old, min(target) as target from (select distinct s.track_id as old, target from s join v on s.video_id = v.video_id) where old <> target group by 1)
select range_key, coalesce(m.target, s.track_id) as track_id, start_frame, end_frame, reviewed and m.target is null and s.track_id not in (select target from m) as reviewed from s left join m on s.track_id = m.old""",
    "range_delete": f"""with {_SQL_SPANS}, c as (select track_id, qa, qb from t where qb >= qa)
select range_key, s.track_id, start_frame, end_frame, reviewed from s where track_id not in (select track_id from c)
union all select range_key, s.track_id, start_frame, case when end_frame < qa then end_frame else qa - 1 end, reviewed from s join c on s.track_id = c.track_id where start_frame < qa
union all select range_key, s.track_id, case when start_frame > qb then start_frame else qb + 1 end, end_frame, reviewed from s join c on s.track_id = c.track_id where end_frame > qb""",
    "suggestion_accept": f"""with {_SQL_SPANS}, k as (select track_id, start_frame as frame_index, bool_or(reviewed) as human from s group by 1, 2),
g as (select distinct track_id, unnest([start_frame, end_frame]) as frame_index from s),
free as (select g.* from g left join k on g.track_id = k.track_id and g.frame_index = k.frame_index where not coalesce(human, false)
  and not exists (select 1 from s where s.track_id = g.track_id and visibility = 'occluded' and g.frame_index between start_frame and end_frame))
select track_id, frame_index, case when human then 'human' else 'ai' end as origin from k union select track_id, frame_index, 'ai' from free""",
    "video_duplicates": """with f as (select sha256, arg_min(name, (imported_at, video_key)) as name, arg_min(video_key, (imported_at, video_key)) as k from video_manifest where sha256 is not null group by 1)
select video_key, case when video_key = k then 'import' when v.name is not distinct from f.name then 'skip' else 'relink' end as action from video_manifest v join f using (sha256)""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
