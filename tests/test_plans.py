"""What the physical plans must show: pruned scans, pushed filters, no cartesian products."""

import re

import pytest

from framelore.plans import ALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _query(name):
    return next(p.QUERIES[name] for p in ALL if name in p.QUERIES)


def test_scans_read_what_they_need(spark, sf):
    plan = _plan(_query("route_summary")(spark, sf))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all("path" not in r and "sha256" not in r for r in read)
    plan = _plan(_query("polygon_metrics")(spark, sf))
    assert all("label" not in r and "confidence" not in r for r in re.findall(r"ReadSchema: struct<(.*)>", plan))


def test_filters_reach_the_scan(spark, sf):
    assert "GreaterThanOrEqual(image_key,100)" in _plan(_query("keyset_page")(spark, sf))
    assert "EqualTo(split,train)" in _plan(_query("path_search_page")(spark, sf))


@pytest.mark.parametrize("name", ["iou_pairs", "hit_test", "frame_state", "suggestion_filter", "box_rejects", "effective_status", "import_merge_update", "mask_union", "track_split", "p4_found", "p7_found", "polygon_faults", "frame_nearest"])
def test_no_products(spark, sf, name):
    """Neither kind of product; ``suggestion_filter`` and ``frame_state`` meet the few sizes of their ranges in one."""
    df = _query(name)(spark, sf)
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]  # as it was run
    assert "CartesianProduct" not in plan
    assert plan.count("BroadcastNestedLoopJoin") <= (1 if name in ("suggestion_filter", "frame_state") else 0)


@pytest.mark.parametrize("name", ["box_clean", "coco_boxes", "mask_metrics", "path_validity", "redact_text", "coco_rle_round_trip"])
def test_expressions_stay_in_the_jvm(spark, sf, name):
    assert not re.search(r"Python|Pandas|Arrow", _plan(_query(name)(spark, sf)))


def test_masks_are_not_folded_run_by_run(spark, sf):
    """Pixels of drawn tiles come with the tiles; a fold over their runs took most of the query."""
    plan = _plan(_query("mask_raster")(spark, sf))
    assert not re.search(r"\baggregate\(", plan) and "MapInArrow" in plan
