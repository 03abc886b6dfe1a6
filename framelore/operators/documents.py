"""Video documents: validity, review, export and import of bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.operators.tracks import coverage, overlapping_spans

TOLERANCE = 1e-6
MAX_SPANS = 20_000


def document_faults(videos: DataFrame, tracks: DataFrame, keyframes: DataFrame, ranges: DataFrame, labels: DataFrame) -> DataFrame:
    """Faults of segmentation documents: video_id, track_id, fault.

    videos (video_id, frame_count, width, height), tracks (video_id, track_id,
    label_id, start_frame, end_frame, reviewed), keyframes (track_id,
    frame_index, visibility, reviewed, x1, y1, x2, y2), ranges (track_id,
    start_frame, end_frame, reviewed), labels (label_id).
    """
    life = tracks.join(videos, "video_id", "left")
    named = lambda df, fault: df.select("video_id", "track_id", F.lit(fault).alias("fault"))
    keys = keyframes.join(tracks.select("video_id", "track_id", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e")), "track_id").join(videos, "video_id")
    spans = ranges.join(tracks.select("video_id", "track_id", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e")), "track_id")
    shaped = F.col("x1").isNotNull()
    all_spans = keyframes.select("track_id", F.col("frame_index").alias("start_frame"), F.col("frame_index").alias("end_frame"), "reviewed").unionByName(ranges.select("track_id", "start_frame", "end_frame", "reviewed"))
    whole = tracks.withColumn("ask_start", F.col("start_frame")).withColumn("ask_end", F.col("end_frame"))
    uncovered = coverage(whole.select("track_id", "start_frame", "end_frame", "ask_start", "ask_end"), all_spans).where("not covered").select("track_id")
    owner = tracks.select("video_id", "track_id")
    many = all_spans.join(owner, "track_id").groupBy("video_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_SPANS).select("video_id", F.lit(None).cast("string").alias("track_id"), F.lit("too_many_spans").alias("fault"))
    parts = [
        named(tracks.groupBy("video_id", "track_id").count().where("count > 1"), "duplicate_track"),
        named(life.join(labels, "label_id", "left_anti"), "unknown_label"),
        named(life.where("end_frame >= frame_count or frame_count is null"), "past_video_end"),
        named(keys.where("frame_index < _s or frame_index > _e"), "keyframe_outside_lifetime"),
        named(keys.where((F.col("visibility") == "visible") != shaped), "shape_does_not_fit_state"),
        named(keys.where("x1 < 0 or y1 < 0 or x2 > width or y2 > height"), "shape_outside_video"),
        named(spans.where("start_frame < _s or end_frame > _e"), "range_outside_lifetime"),
        named(overlapping_spans(all_spans).join(owner, "track_id"), "overlapping_spans"),
        named(tracks.where("reviewed").join(uncovered, "track_id", "left_semi"), "reviewed_without_coverage"),
    ]
    out = many
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def edited_keyframes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keyframes after a save: one that a model made and a person changed loses its origin and its review.

    Both (track_id, frame_index, geometry, origin, reviewed); geometry is
    compared as canonical text.
    """
    old = before.select("track_id", "frame_index", F.col("geometry").alias("_g"), F.col("origin").alias("_o"))
    touched = (F.col("_o") == "ai") & ~F.col("geometry").eqNullSafe(F.col("_g"))
    return after.join(old, ["track_id", "frame_index"], "left").withColumn("origin", F.when(touched, "human").otherwise(F.col("origin"))).withColumn("reviewed", F.col("reviewed") & ~F.coalesce(touched, F.lit(False))).drop("_g", "_o")


def propagation_input(keyframes: DataFrame, ranges: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(seeds, protected) of a propagation: visible keyframes of people, reviewed ones or chosen ones; frames and ranges a model must not touch."""
    human = (F.col("origin") == "human") | F.col("reviewed")
    seeds = keyframes.where("visibility = 'visible'")
    seeds = seeds.where(human) if chosen is None else seeds.join(chosen.select("track_id", "frame_index"), ["track_id", "frame_index"], "left_semi")
    points = keyframes.where(human).select("track_id", F.col("frame_index").alias("start_frame"), F.col("frame_index").alias("end_frame"))
    held = ranges.where("reviewed").select("track_id", "start_frame", "end_frame")
    return seeds, points.unionByName(held)


def exported_events(events: DataFrame, policy: str) -> DataFrame:
    """One JSON per recording: video_id, content.  ``reviewed`` keeps reviewed events only; a recording without any keeps an empty list."""
    if policy not in ("all", "reviewed"):
        raise ValueError(f"unknown policy: {policy}")
    keep = F.lit(True) if policy == "all" else F.coalesce("reviewed", F.lit(False))
    item = F.when(keep, F.struct("start_s", "event_key", F.to_json(F.struct("event_id", "kind", "start_s", "end_s", "label_id", "description", "reviewed")).alias("j")))
    rows = events.where("video_id is not null").groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["j"]).alias("e"))
    return rows.select("video_id", F.concat(F.lit('{"video_id":"'), "video_id", F.lit('","events":['), F.array_join("e", ","), F.lit("]}")).alias("content"))


def import_bundle(bundle: DataFrame, videos: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a bundle (sha256, event_id, label_id, ...): recordings are matched by digest, review is reset.

    One unknown digest or label rejects the whole bundle: then no events come
    out and every reason is in the rejects.
    """
    known = videos.where("sha256 is not null").groupBy(F.lower("sha256").alias("sha256")).agg(F.min("video_id").alias("video_id"))
    rows = bundle.withColumn("sha256", F.lower("sha256")).join(known, "sha256", "left").join(labels.select("label_id").distinct().withColumn("_label", F.lit(True)), "label_id", "left")
    fault = F.when(F.col("video_id").isNull(), "unknown_video").when(F.col("label_id").isNotNull() & F.col("_label").isNull(), "unknown_label")
    rows = rows.withColumn("fault", fault)
    rejects = rows.where("fault is not null").select("event_id", "fault")
    bad = rejects.agg((F.count("*") > 0).alias("_bad"))
    events = rows.join(F.broadcast(bad)).where("not _bad").drop("_bad", "_label", "fault").withColumn("reviewed", F.lit(False))  # one row
    return events, rejects


def normalized_rotation(degrees: Column) -> Column:
    """Right angles from 0 to 270; null for any other."""
    turned = F.pmod(degrees, F.lit(360))
    return F.when(turned.isin(0, 90, 180, 270), turned.cast("int"))


def pts_seconds(pts: Column, first: Column, numerator: Column, denominator: Column) -> Column:
    """Seconds of a time stamp from the first, in an exact rational time base."""
    return ((pts - first) * numerator).cast("double") / denominator


def extracted_pictures(frames: DataFrame, wanted: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, skipped) frames (video_id, frame_index): each wanted frame once, those extracted before are skipped."""
    asked = wanted.select("video_id", "frame_index").distinct().join(frames, ["video_id", "frame_index"])
    old = there.select("video_id", "frame_index").distinct()
    path = F.format_string("%s-frame-%08d.jpg", "video_id", F.col("frame_index").cast("int"))
    return asked.join(old, ["video_id", "frame_index"], "left_anti").withColumn("path", path), asked.join(old, ["video_id", "frame_index"], "left_semi")
