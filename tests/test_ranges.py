"""Grid and block joins against brute force over random input (property tests)."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framelore.operators import boxes, catalogs, intervals, polygons, tracks
from framelore.operators.ranges import within


def test_within_finds_every_pair_once(spark):
    rnd = random.Random(7)
    points = [(i, rnd.choice("aab"), rnd.randrange(-600, 4000)) for i in range(300)] + [(1000, None, 5), (1001, "a", None)]
    ranges = [(i, rnd.choice("aab"), s, s + rnd.choice([0, 3, 511, 512, 2000, -4])) for i, s in enumerate(rnd.randrange(-700, 4000) for _ in range(120))] + [(900, "a", None, 5)]
    got = sorted((r["p"], r["r"]) for r in within(spark.createDataFrame(points, "p int, k string, at int"), spark.createDataFrame(ranges, "r int, k string, lo int, hi int"), "k", "at", "lo", "hi").collect())
    want = sorted((p, r) for p, k, at in points for r, q, lo, hi in ranges if k and k == q and at is not None and lo is not None and lo <= at <= hi)
    assert got == want


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0


def test_pairs_and_suppression_of_a_crowded_picture(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        x, y, w = rnd.randrange(0, 3000), rnd.randrange(0, 3000), rnd.choice([20, 40, 300, 900, 2500])
        rows.append((i, 1, rnd.choice("xy"), rnd.choice([None, 0.1, 0.5, 0.5, 0.9]), float(x), float(y), float(x + w + rnd.randrange(9)), float(y + w)))
    df = spark.createDataFrame(rows, "key int, image_key int, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    box = {r[0]: r[4:] for r in rows}
    label = {r[0]: r[2] for r in rows}
    for t in (0.5, 0.25):
        want = {(a, b) for a in box for b in box if a < b and label[a] == label[b] and _iou(box[a], box[b]) >= t}
        assert {(r["key_a"], r["key_b"]) for r in boxes.overlapping_pairs(df, t).collect()} == want
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], -(r[3] or 0), r[4:], r[0])):
        if not any(label[k] == r[2] and _iou(box[k], r[4:]) >= 0.5 for k in kept):
            kept.append(r[0])
    assert {r["key"] for r in boxes.suppress(df).collect()} == set(kept)


def test_hits_of_a_crowded_picture(spark):
    rnd = random.Random(5)
    shapes = [(1, i, rnd.randrange(5), *(lambda x, y, w: (float(x), float(y), float(x + w), float(y + w)))(rnd.randrange(900), rnd.randrange(900), rnd.choice([5, 100, 700]))) for i in range(150)]
    points = [(1, i, rnd.randrange(1700) + 0.5, rnd.randrange(1700) + 0.5) for i in range(200)]
    ring = "transform(array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2)), p -> named_struct('x', p[0], 'y', p[1]))"
    s = spark.createDataFrame(shapes, "image_key int, shape_id int, z int, x1 double, y1 double, x2 double, y2 double").selectExpr("*", f"{ring} as ring")
    got = {r["point_id"]: r["shape_id"] for r in polygons.hit_test(spark.createDataFrame(points, "image_key int, point_id int, px double, py double"), s).collect()}
    want = {}
    for _, p, x, y in points:
        hits = [(z, i) for _, i, z, x1, y1, x2, y2 in shapes if x1 <= x < x2 and y1 <= y < y2]
        if hits:
            want[p] = max(hits)[1]
    assert got == want


def test_overlapping_spans_do_not_touch(spark):
    rows = [("touch", 0, 3), ("touch", 4, 5), ("share", 0, 3), ("share", 3, 5), ("inside", 0, 9), ("inside", 2, 3), ("same", 1, 1), ("same", 1, 1), ("one", 1, 2), (None, 1, 2), (None, 1, 2), ("bad", 5, 1)]
    df = spark.createDataFrame(rows, "track_id string, start_frame int, end_frame int")
    assert {r["track_id"] for r in tracks.overlapping_spans(df).collect()} == {"share", "inside", "same"}


def test_first_seen_numbers_are_dense(spark):
    rnd = random.Random(1)
    rows = [(i, f"v{rnd.randrange(300)}") for i in range(2000)] + [(5000, None)]
    got = sorted((r["number"], r["position"], r["v"]) for r in catalogs.first_seen(spark.createDataFrame(rows, "i int, v string"), "v", "i").collect())
    seen: dict = {}
    for i, v in rows:
        if v is not None:
            seen.setdefault(v, i)
    assert got == [(n, i, v) for n, (v, i) in enumerate(sorted(seen.items(), key=lambda x: x[1]))]


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=40), st.sampled_from([0, 1]))
def test_interval_map_is_the_union(spans, touch):
    state = intervals.IntervalMap(touch)
    for s, n in spans:
        state.insert(s, s + n)
    points = {s + i / 2 for s, n in spans for i in range(2 * n + 1)}
    merged: list = []
    for s, e in sorted((s, s + n) for s, n in spans):
        if merged and s <= merged[-1][1] + touch:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    assert state.periods() == [tuple(m) for m in merged]
    assert all(any(a <= p <= b for a, b in state.periods()) for p in points)


def test_damaged_bounds_cost_two_blocks(spark):
    """A range to the end of all numbers lies on at most two blocks, and still holds its points."""
    from framelore.operators.ranges import within

    ranges = spark.createDataFrame([("a", 0, 2**31 - 1), ("a", 5, 5), ("a", 700, 300000), ("b", -(2**40), 2**40), ("c", 9, 3), (None, 0, 9)], "k string, lo bigint, hi bigint")
    points = spark.createDataFrame([("a", 5), ("a", 512), ("a", 299999), ("a", 2**31), ("b", -7), ("c", 5), (None, 5), ("a", None)], "k string, at bigint")
    got = sorted((r["k"], r["at"], r["lo"]) for r in within(points, ranges, "k", "at", "lo", "hi").collect())
    assert got == [("a", 5, 0), ("a", 5, 5), ("a", 512, 0), ("a", 299999, 0), ("a", 299999, 700), ("b", -7, -(2**40))]


def test_frames_across_stretches(spark):
    """Nearest and shown frames of points in other stretches than any frame, against a search of all frames."""
    import random

    from framelore.operators import timeline

    rnd = random.Random(11)
    frames = [(v, i, t) for v in ("x", "y") for i, t in enumerate(sorted(rnd.uniform(-5000, 90000) for _ in range(40)))]
    points = [(v, n, rnd.uniform(-20000, 120000)) for n, v in enumerate(["x", "y", "x", "none"] * 60)] + [("x", 900 + k, t) for k, (v, _, t) in enumerate(frames) if v == "x"]
    f = spark.createDataFrame(frames, "video_id string, frame_index bigint, ts double")
    p = spark.createDataFrame(points, "video_id string, point_id bigint, at double")
    near = {r["point_id"]: r["frame_index"] for r in timeline.nearest_frame(p, f).collect()}
    shown = {r["point_id"]: r["frame_index"] for r in timeline.frame_at(p, f).collect()}
    for v, n, at in points:
        mine = [(t, i) for w, i, t in frames if w == v]
        assert near.get(n) == (min(mine, key=lambda x: (abs(x[0] - at), x[0]))[1] if mine else None)
        assert shown.get(n) == (max([x for x in mine if x[0] <= at + timeline.TOLERANCE] or [min(mine)])[1] if mine else None)
