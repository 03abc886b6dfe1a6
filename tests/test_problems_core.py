"""Problems 4, 6 and 7 against brute force, on small fixtures with all edge cases."""

import json
import random
from collections import defaultdict

import pytest

from framelore.operators import intervals, nested, rejects
from framelore.plans import data_quality

LINES = "line_key bigint, import_id string, file_path string, line_no int, line_format string, raw_line string"
GOOD = 'a/b.jpg,cat,1,2,3,4,0.5,2024-02-29,"x, ""y"" z"'
CASES = [
    ("yolo", "3 .5 0.5 1e-1 .2", None),
    ("yolo", "﻿3 .5 0.5 1e-1 .2 \r", None),
    ("yolo", "3 .5 0.5 1e-1", "column_count"),
    ("yolo", "3 .5 0.5 1e-1 .2 .3", "column_count"),
    ("yolo", "99 .5 0.5 .1 .2", "invalid_value"),
    ("yolo", "3.0 .5 0.5 .1 .2", "invalid_value"),
    ("yolo", "3 1.5 0.5 .1 .2", "invalid_value"),
    ("yolo", "3 .5 0.5 0 .2", "invalid_value"),
    ("yolo", "3 nan 0.5 .1 .2", "invalid_value"),
    ("yolo", "3 1e-999 0.5 .1 1e999", "invalid_value"),
    ("yolo", "# note", None),
    ("yolo", "  ", None),
    ("yolo", None, None),
    ("csv", GOOD, None),
    ("csv", GOOD + "  \r", None),
    ("csv", 'a/b.jpg,cat,1,2,3,4,,,"line\nbreak"', None),
    ("csv", "a/b.jpg,cat,1,2,3,4,,,\\q and \\b", None),
    ("csv", 'a/b.jpg,"cat,1,2,3,4,,,', "broken_quoting"),
    ("csv", 'a/b.jpg,ca"t,1,2,3,4,,,', "broken_quoting"),
    ("csv", 'a/b.jpg,"ca"t,1,2,3,4,,,', "broken_quoting"),
    ("csv", 'a/b.jpg,x"cat",1,2,3,4,,,', "broken_quoting"),
    ("csv", "a/b.jpg,cat,1,2,3,4,,", "column_count"),
    ("csv", "a/b.jpg,cat,1,2,3,4,,,,", "column_count"),
    ("csv", "../b.jpg,cat,1,2,3,4,,,", "invalid_value"),
    ("csv", "/b.jpg,cat,1,2,3,4,,,", "invalid_value"),
    ("csv", "C:/b.jpg,cat,1,2,3,4,,,", "invalid_value"),
    ("csv", " b.jpg,cat,1,2,3,4,,,", "invalid_value"),
    ("csv", "b.jpg, ,1,2,3,4,,,", "invalid_value"),
    ("csv", "b.jpg,cat,3,2,3,4,,,", "invalid_value"),
    ("csv", "b.jpg,cat,1,2,3,inf,,,", "invalid_value"),
    ("csv", "b.jpg,cat,1,2,3,4,1.2,,", "invalid_value"),
    ("csv", "b.jpg,cat,1,2,3,4,,2023-02-29,", "invalid_value"),
    ("csv", "b.jpg,cat,1,2,3,4,,2024-02-29T24:00:00,", "invalid_value"),
    ("csv", "b.jpg,cat,1,2,3,4,,2024-02-29T23:59:59Z,", None),
    ("json", "{}", "unknown_format"),
    (None, "x", "unknown_format"),
    ("csv", "b.jpg,cat,1,2,3,4,,," + "n" * 300000, None),
    ("csv", "b.jpg,cat,1,2,3,4,,," + '"' + 'a""' * 100000 + '"', None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(3, "cat"), (None, "x"), (4, None)], "category_id int, category_name string")


def test_lines_are_judged(spark, catalog):
    rows = [(i, "im", "f", i, f, r) for i, (f, r, _) in enumerate(CASES)]
    got = {r["line_key"]: r["code"] for r in rejects.judge_lines(spark.createDataFrame(rows, LINES), catalog).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(CASES)}


def test_lines_repeated_keys_nulls_and_clashing_columns(spark, catalog):
    rows = [(1, None, "f", 1, "yolo", "3 .5 .5 .1 .2"), (1, None, "f", 1, "yolo", "3 .5 .5 .1"), (None, "i", "f", 1, "yolo", "9 .5 .5 .1 .1"), (None, "i", "f", 1, "yolo", "9 .5 .5 .1 .1")]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], LINES + ", code string, value string")
    got = sorted((str(r["line_key"]), str(r["code"]), r["value"]) for r in rejects.judge_lines(df, catalog).collect())
    assert got == [("1", "None", "old"), ("1", "column_count", "old"), ("None", "invalid_value", "old"), ("None", "invalid_value", "old")]
    assert rejects.judge_lines(df.limit(0), catalog).count() == 0


def test_fields_round_trip(spark, catalog):
    df = spark.createDataFrame([(1, "i", "f", 1, "csv", GOOD), (2, "i", "f", 2, "csv", "b.jpg,cat,1,2,3,4,,,\\q and \\b")], LINES)
    got = {r["line_key"]: r["note"] for r in rejects.loaded_objects(rejects.judge_lines(df, catalog)).collect()}
    assert got == {1: 'x, "y" z', 2: "\\q and \\b"}


def test_skipped_counts(spark, catalog):
    df = spark.createDataFrame([(1, "i", "f", 1, "csv", GOOD), (2, "i", "f", 2, "yolo", "1"), (3, None, "f", 2, "yolo", "#")], LINES)
    reports = spark.createDataFrame([(5, "i", 4), (4, "i", None), (6, "i", 7)], "report_key bigint, import_id string, skipped_objects int")
    got = {r["import_id"]: (r["loaded_objects"], r["skipped_objects"], r["stated_skipped"]) for r in rejects.skipped_per_import(rejects.judge_lines(df, catalog), reports).collect()}
    assert got == {"i": (1, 1, 4), None: (0, 0, None)}


def _brute(rows, touch):
    by = defaultdict(list)
    for who, s, e in rows:
        if who is not None and s is not None and e is not None and 0 <= s <= e:
            by[who].append((s, e))
    out = set()
    for who, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1] + touch:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(who, "period", s, e) for s, e in merged}
        out |= {(who, "gap", a[1] + touch, b[0] - touch) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("touch", [0, 1])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intervals_against_brute_force(spark, touch, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(800):
        who = rnd.choice(["hot"] * 6 + ["a", "b", "ä"] + [f"e{rnd.randrange(30)}"])
        s = rnd.randrange(4000)
        rows.append((who, s, s + rnd.choice([0, 0, 1, 3, 8, 400 if rnd.random() < 0.03 else 2])))
    rows += [(None, 1, 2), ("a", None, 2), ("a", 5, None), ("a", -3, 2), ("a", 9, 4), ("long", 0, 3999), ("long", 5, 6), ("hot", 100, 100)] * 2
    df = spark.createDataFrame(rows, "entity string, start_at bigint, end_at bigint")
    got = [tuple(r) for r in intervals.merge_intervals(df, touch).select("entity", "kind", "start_at", "end_at").collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(rows, touch)


def test_intervals_cross_every_partition(spark):
    """One interval spans many partitions, then the run goes on in the last of them."""
    rows = [("x", i * 10, i * 10 + 1) for i in range(500)] + [("x", 0, 3005), ("x", 3006, 3011)]
    df = spark.createDataFrame(rows, "entity string, start_at bigint, end_at bigint")
    got = {tuple(r) for r in intervals.merge_intervals(df, 1).select("entity", "kind", "start_at", "end_at").collect()}
    assert got == _brute(rows, 1)


def test_interval_map_insertions():
    state = intervals.IntervalMap(1)
    for s, e in [(10, 12), (20, 22), (14, 18), (13, 13), (1, 2)]:
        state.insert(s, e)
    assert state.periods() == [(1, 2), (10, 18), (20, 22)] and state.gaps() == [(3, 9), (19, 19)]


def test_intervals_empty(spark):
    df = spark.createDataFrame([], "entity string, start_at bigint, end_at bigint")
    assert intervals.merge_intervals(df, 1).count() == 0


def _doc(**x):
    return json.dumps(x)


def test_nested_forms(spark):
    ring, flat, tile, origin = [[0, 0], [1, 1], [2, 0]], [0, 0, 1, 1, 2, 0], {"x": 0, "y": 0, "counts": [1, 16383]}, {"source": "s", "name": "n"}
    bodies = [
        _doc(objects=[{"id": 0, "kind": "polygon", "polygons": [ring, flat], "mask": None, "provenance": ""}]),
        _doc(objects={"a": {"kind": "mask", "mask": {"tiles": tile}, "provenance": {"imports": origin, "video": {"track": {"imports": [origin]}}}}}),
        _doc(objects={"id": "solo", "kind": "polygon", "label": "x", "polygons": json.dumps([ring]), "mask": {"tiles": [tile, tile]}}),
        _doc(image={"objects": [{"id": "i", "x_extra": {"polygons": [ring]}, "provenance": json.dumps({"imports": [origin, origin]})}]}),
        _doc(objects=[{"id": "s", "polygons": ring}, None, 5, {"id": "m", "mask": json.dumps({"tiles": [tile]})}]),
        "[]", "null", "", None, '{"objects": [', _doc(objects=None), _doc(), "{" * 100000,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_key bigint, body string")
    got = {tuple(r) for r in nested.link_children(nested.node_table(df)).select("doc_key", "object_id", "child", "ordinal").collect()}
    assert got == {
        (0, "0", "ring", 0), (0, "0", "ring", 1), (1, "a", "tile", 0), (1, "a", "origin", 0), (2, "solo", "ring", 0), (2, "solo", "tile", 0),
        (2, "solo", "tile", 1), (3, "i", "origin", 0), (3, "i", "origin", 1), (4, "s", "ring", 0), (4, "m", "tile", 0),
    }


def test_nested_labels_are_intervals(spark, sf):
    nodes = nested.walk_document(1, _doc(objects=[{"id": 1, "polygons": [[[0, 0], [1, 1], [2, 0]]]}, {"id": 2}]))
    spans = sorted((n[2], n[3]) for n in nodes)
    assert len({x for s in spans for x in s}) == 2 * len(nodes)
    for a in spans:
        for b in spans:
            assert a == b or a[1] < b[0] or b[1] < a[0] or (a[0] < b[0]) == (b[1] < a[1])


def test_flat_tables_keep_links(spark, sf):
    docs = spark.read.parquet(f"{sf}/annotation_docs.parquet")
    tables = nested.flat_tables(docs)
    objects = {(r["doc_key"], r["pre"]) for r in tables["objects"].collect()}
    for name in ("rings", "tiles", "origins"):
        rows = tables[name].collect()
        assert rows and all((r["doc_key"], r["parent_pre"]) in objects for r in rows)


@pytest.mark.parametrize("name", sorted(data_quality.ORACLES))
def test_against_sql(spark, sf, oracle, name):
    from compare import rows_of_spark, rows_of_sql

    assert rows_of_spark(data_quality.QUERIES[name](spark, sf)) == rows_of_sql(oracle, data_quality.ORACLES[name])
