"""Problems 1 and 2 against brute force."""

from collections import defaultdict
from itertools import combinations

import pytest

from framelore.llm import keys, overlap, survivors
from framelore.llm.graph import components

IMAGES = "image_key bigint, path string, source_id string, source_path string, width int, height int, split string, status string, sha256 string, provenance string, imported_at timestamp_ntz, updated_at timestamp_ntz, extra string, class_id string"
A, B, ZERO = "a" * 64, "b" * 64, "0" * 64


def _row(key, path, split="train", sha=None, status="unreviewed", at=None):
    from datetime import datetime

    day = datetime(2024, 1, at) if at else None
    return (key, path, path.split("/")[0] if path else None, path, None, None, split, status, sha, None, day, day, "x", "clash")


ROWS = [
    _row(1, "s/lab_cam001_2023-01-02_03.04.05_00007.jpg"),
    _row(2, "t/sel/old-lab-cam001-2023-01-02-03.04.05-00007_copy.webp", "VAL "),
    _row(3, "s/lab_cam001_2023-01-02_03.04.05_00008.jpg", "test"),
    _row(4, "s/lab_cam002_2023-01-02_03.04.05_00007.jpg", "test"),
    _row(5, "s/CAM-001/2023-01-02/small/03-04-05-7.png", "unspecified", A),
    _row(6, "u/x.jpg", "testing", "SHA256:" + A.upper()),
    _row(7, "u/q.jpg", "Train", ZERO),
    _row(8, "u/r.jpg", "val", ZERO),
    _row(9, "s/roll/DSC000000123.JPG", "train", B),
    _row(10, "v/review/x_DSC000000123.bmp", "test", None),
    _row(11, "s/video-" + "c" * 24 + "-frame-00000012.jpg", "train"),
    _row(12, "s/a/video_" + "c" * 24 + "_frame_00000012.png", "validation"),
    _row(13, "s/video-" + "c" * 24 + "-frame-00000013.jpg", "val"),
    _row(14, None, "train", None),
    _row(15, None, "val", None),
    _row(16, "w/A b.jpg", "train"),
    _row(17, "w/tmp/..//.\\a%20B.JPG \n", "test"),
    _row(17, "w/tmp/..//.\\a%20B.JPG \n", "test"),
    _row(18, "", "train", ""),
    _row(19, "p/" + "long/" * 2000 + "e.jpg", "train"),
    _row(20, "p/" + "long/" * 2000 + "E.jpg", "val"),
    _row(None, "w/a b.jpg", "val"),
]
PAIRS = {(1, 2), (1, 6), (9, 10), (11, 12), (16, 17), (19, 20)}


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame(ROWS, IMAGES)


def test_pairs(images):
    got = [tuple(r) for r in overlap.overlap_pairs(images).collect()]
    assert sorted(p for p in got if None not in p) == sorted(PAIRS)


def test_empty(images):
    assert overlap.overlap_pairs(images.limit(0)).count() == 0
    assert overlap.coverage(images.limit(0)).count() == 0


def test_coverage_and_report(images):
    cover = {r["image_key"]: r["share"] for r in overlap.coverage(images.where("image_key is not null").dropDuplicates(["image_key"])).collect()}
    assert cover[17] == 1.0 and cover[3] == 0.0 and 0 < cover[2] < 1 and cover[15] == 0.0
    report = {(r["split"], r["source"]): (r["records"], r["overlapping"]) for r in overlap.overlap_report(images).collect()}
    assert report[("val", "t")] == (1, 1) and report[("val", "u")] == (1, 0)


def test_coverage_links_as_the_pairs_do(images):
    """Row 6 meets train only through row 5, of no split: no part of its own is covered, but it is linked."""
    rows = images.where("image_key is not null").dropDuplicates(["image_key"])
    cover = {r["image_key"]: r for r in overlap.coverage(rows).collect()}
    assert cover[6]["linked"] and cover[6]["covered"] == 0
    paired = {k for r in overlap.overlap_pairs(rows).collect() for k in r}
    assert {k for k, r in cover.items() if r["linked"]} == paired & set(cover)
    assert sum(r["overlapping"] for r in overlap.overlap_report(rows).collect()) == sum(r["linked"] for r in cover.values())


def test_components_against_union_find(spark):
    import random

    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(300):03d}", f"n{rnd.randrange(300):03d}") for _ in range(170)] + [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(120)] + [("hub", f"leaf{i}") for i in range(50)]
    edges += [(None, "x"), ("self", "self")] + edges[:5]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_same_file_pairs(spark, images):
    sources = spark.createDataFrame([("w", "keep_existing", True)], "source_id string, duplicate_policy string, trust_reviewed boolean")
    got = sorted(tuple(r) for r in survivors.same_file_pairs(images, sources).collect())
    assert got == [(16, 17), (19, 20)]


def test_survivor_fields(spark):
    sources = spark.createDataFrame([("k", " Keep_Existing", False), ("n", None, True)], "source_id string, duplicate_policy string, trust_reviewed boolean")
    rows = [
        _row(1, "n/a.jpg", "", None, "human_reviewed", 2), _row(2, "n/A.jpg", "val", B, "imported_coarse", 3), _row(3, "n/./a.jpg", "test", A, "unreviewed", 9),
        _row(4, "k/a.jpg", "train", A, None, 2), _row(5, "k/a.jpg", "val", B, None, 5), _row(6, None, None, None, None), _row(7, None, None, None, None),
    ]
    got = {r["image_key"]: r for r in survivors.surviving_records(spark.createDataFrame(rows, IMAGES), sources).collect()}
    assert len(got) == 4 and {6, 7} <= set(got)
    n = got[2]
    assert (n["status"], n["status_from"], n["split"], n["split_from"], n["sha256"], n["records"]) == ("human_reviewed", 1, "val", 2, B, 3)
    assert got[4]["sha256"] == A and got[4]["split"] == "train"
    assert survivors.surviving_records(spark.createDataFrame([], IMAGES), sources).count() == 0


def test_large_groups_are_ranked_in_parts(spark):
    """The same survivors and fields whether a group is one part or many."""
    rows = [_row(i, "n/a.jpg" if i % 3 else f"n/{i % 7}.jpg", ["train", "val", ""][i % 3], [A, B, None][i % 3], ["unreviewed", "human_reviewed", None][i % 3], 1 + i % 20) for i in range(120)] + [_row(None, "n/a.jpg")] * 9
    sources = spark.createDataFrame([("n", None, True)], "source_id string, duplicate_policy string, trust_reviewed boolean")
    images = spark.createDataFrame(rows, IMAGES)
    whole = sorted(map(str, survivors.surviving_records(images, sources).collect()))
    assert sorted(map(str, survivors.surviving_records(images, sources, per_part=5).collect())) == whole
    members = survivors.group_members(images, sources, per_part=5).collect()
    assert len(members) == len(rows) and {r["survivor"] for r in members} == {str(r["image_key"]) for r in survivors.surviving_records(images, sources).collect()}
    assert survivors.ranked_records(images, sources, per_part=5).where("group_key = 'n/a.jpg'").groupBy("salt").count().count() > 5


def test_links_come_from_the_automata(images, monkeypatch):
    monkeypatch.setattr(overlap, "scan", lambda wanted, texts, hot, shards: texts.sparkSession.createDataFrame([], overlap.HIT_SCHEMA))
    assert overlap.overlap_pairs(images).count() == 0


def test_hot_words_are_spread_over_shards(images):
    assert sorted(map(str, overlap.overlap_pairs(images, per_shard=1).collect())) == sorted(map(str, overlap.overlap_pairs(images).collect()))


def _scanned(passage, text):
    import pandas as pd

    rows = pd.DataFrame({"kind": [0, 1], "id": [b"p", b"t"], "text": [passage, "name:" + text]})
    return [(a, b) for out in overlap._scan(iter([rows])) for a, b in zip(out["start"], out["stop"])]


def test_intervals():
    text = "_9_cam070_q90_20230109_072820_1836_2_"
    assert [text[a:b] for a, b in _scanned("shot:cam070 20230109 072820_1836", text)] == ["_cam070_", "_20230109_072820_1836_"]
    for other in ("_cam070_5_20230109_072820_1836_", "_cam070_cam071_20230109_072820_1836_", "_20230109_072820_1836_", "_cam070_20230109_072820_18360_", "_20230109_cam070_072820_1836_", "_cam0701_20230109_072820_1836_"):
        assert _scanned("shot:cam070 20230109 072820_1836", other) == []


def test_names_written_in_other_ways(spark):
    """Names that the patterns of the SQL twin do not know: recall of true pairs, and none between different shots."""
    import random

    rnd = random.Random(6)
    rows, want = [], set()
    for i in range(150):
        camera, day, clock, n = rnd.randrange(10, 99), f"{rnd.randrange(1, 28):02d}", f"{rnd.randrange(24):02d}{rnd.randrange(60):02d}{rnd.randrange(60):02d}", rnd.randrange(1, 9999)
        hexes = "".join(rnd.choice("0123456789abcdef") for _ in range(24))
        a, b = [
            (f"s/Kamera-{camera}/2024-05-{day}/{clock[:2]}.{clock[2:4]}.{clock[4:]}.{n:05d}.png", f"t/klein/camera_{camera}_202405{day}T{clock}_{n}-kopie.webp"),
            (f"s/vid-{hexes}-fr-{n:06d}.jpg", f"t/auswahl/clip_{hexes}_frame_{n}.png"),
            (f"s/x/DSCN{100000 + i}.JPG", f"t/y/final DSCF-000{100000 + i} (2).tif"),
            (f"s/caméra {camera}/small/2024_05_{day}/w640/{clock}_{n}.jpg", f"t/CAM{camera}_2024.05.{day}_{clock}_{n:04d}_v2.jpg"),
        ][i % 4]
        rows += [_row(10 * i, a), _row(10 * i + 1, b, "val"), _row(10 * i + 2, a.replace(f"{n:05d}", f"{n + 1:05d}").replace(str(100000 + i), str(300000 + i)).replace(hexes, hexes[::-1]).replace(f"caméra {camera}", f"caméra {camera}0"), "test")]
        want.add((10 * i, 10 * i + 1))
    got = {tuple(r) for r in overlap.overlap_pairs(spark.createDataFrame(rows, IMAGES)).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_class_rows(images):
    rows = images.where("image_key is not null").dropDuplicates(["image_key"])
    links = {r["image_key"]: r["links"] for r in overlap.overlap_classes(rows).collect()}
    pairs = [tuple(r) for r in overlap.overlap_pairs(rows).collect()]
    assert links == {k: sum(k in p for p in pairs) for p in pairs for k in p}
    assert overlap.overlap_classes(images.limit(0)).count() == 0


def test_found_on_tables(spark, sf):
    """All pairs of the test tables against union-find over keys cut out by one pattern each."""
    import re

    from pyspark.sql import functions as F

    from framelore.llm.oracles import SHOT_PATTERNS

    def shot(path):
        spelled = re.sub(r"[\W_]+", "_", path or "")
        for kind, pattern in SHOT_PATTERNS:
            m = re.search(pattern.replace(r"[\p{L}]", r"[^\W\d_]"), spelled)
            if m:
                return kind, m.groups()
        return None

    images = spark.read.parquet(f"{sf}/images.parquet")
    rows = [{**r.asDict(), "h": shot(r["f"])} for r in images.select("image_key", keys.canonical_split(F.col("split")).alias("s"), keys.file_key(F.col("path")).alias("f"), keys.digest(F.col("sha256")).alias("d")).collect()]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in rows:
        for k in (("f", r["f"]), ("h", r["h"]), ("d", r["d"])):
            if k[1]:
                parent[find(k)] = find(r["image_key"])
    groups = defaultdict(list)
    for r in rows:
        groups[find(r["image_key"])].append(r)
    want = {(min(a["image_key"], b["image_key"]), max(a["image_key"], b["image_key"])) for g in groups.values() for a, b in combinations(g, 2) if (a["s"] == "train") != (b["s"] == "train") and {a["s"], b["s"]} <= {"train", "val", "test"}}
    assert {tuple(r) for r in overlap.overlap_pairs(images).collect()} == want
