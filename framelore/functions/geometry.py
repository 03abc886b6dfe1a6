"""Box, ring and mask expressions.  Rings are array<struct<x, y>>, boxes four columns in pixel edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 128
MASK_PIXELS = TILE * TILE


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes; 0 where they do not overlap."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def next_points(ring: Column) -> Column:
    """The ring turned by one: each vertex's successor."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area2(ring: Column) -> Column:
    """Twice the signed area (shoelace)."""
    terms = F.zip_with(ring, next_points(ring), lambda p, q: p.x * q.y - q.x * p.y)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def cross(a: Column, b: Column, c: Column) -> Column:
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Segments ab and cd share a point, touching included; the boxes are compared first."""
    apart = (
        (F.greatest(a.x, b.x) < F.least(c.x, d.x)) | (F.greatest(c.x, d.x) < F.least(a.x, b.x)) | (F.greatest(a.y, b.y) < F.least(c.y, d.y)) | (F.greatest(c.y, d.y) < F.least(a.y, b.y))
    )
    return ~apart & (cross(a, b, c) * cross(a, b, d) <= 0) & (cross(c, d, a) * cross(c, d, b) <= 0)


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, half-open in y."""
    hits = F.zip_with(
        ring,
        next_points(ring),
        lambda a, b: F.when((a.y > y) != (b.y > y), F.when(x < (b.x - a.x) * (y - a.y) / F.nullif(b.y - a.y, F.lit(0.0)) + a.x, 1).otherwise(0)).otherwise(0),
    )
    return F.aggregate(hits, F.lit(0), lambda s, t: s + t) % 2 == 1


def ring_extent(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def rle_is_valid(x: Column, y: Column, counts: Column) -> Column:
    """Aligned tile, positive runs except the first, all pixels covered, some of them foreground."""
    runs = F.coalesce(counts, F.array().cast("array<int>"))
    total = F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, n: s + n)
    inner = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    return (
        (x >= 0) & (y >= 0) & (x % TILE == 0) & (y % TILE == 0) & (F.size(runs) >= 2) & (F.get(runs, F.lit(0)) >= 0)
        & F.forall(inner, lambda n: n > 0) & (total == MASK_PIXELS)
    )


def decode_coco_counts(text: Column) -> Column:
    """Runs of a compressed COCO mask: five-bit groups, sign in the last, each value a difference to the run two before.

    A fold over the characters carrying the runs so far and the open number.
    Null where a character is outside the alphabet or a number is left open.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.array().cast("array<bigint>").alias("runs"), zero.alias("value"), F.lit(0).alias("shift"), F.lit(True).alias("ok"))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)

    def step(s: Column, c: Column) -> Column:
        value = s.value + F.call_function("shiftleft", c.bitwiseAND(31).cast("bigint"), s.shift)
        last = c.bitwiseAND(32) == 0
        signed = F.when(c.bitwiseAND(16) != 0, value - F.call_function("shiftleft", F.lit(1).cast("bigint"), s.shift + 5)).otherwise(value)
        before = F.when(F.size(s.runs) > 2, F.element_at(s.runs, -2)).otherwise(zero)
        return F.struct(
            F.when(last, F.array_append(s.runs, signed + before)).otherwise(s.runs).alias("runs"),
            F.when(last, zero).otherwise(value).alias("value"),
            F.when(last, 0).otherwise(s.shift + 5).alias("shift"),
            (s.ok & c.between(0, 63) & (s.shift <= 35)).alias("ok"),
        )

    done = F.aggregate(codes, start, step)
    return F.when(done.ok & (done.shift == 0) & (F.length(text) > 0), done.runs)


def encode_coco_counts(counts: Column) -> Column:
    """The compressed form of runs; the inverse of ``decode_coco_counts``.

    A value needs at most eight groups of five bits (runs are below 2^32 and
    differences keep a sign).
    """
    runs = F.transform(counts, lambda n: n.cast("bigint"))
    back = F.concat(F.array_repeat(F.lit(0).cast("bigint"), 3), F.slice(runs, 2, F.greatest(F.size(runs) - 3, F.lit(0))))
    values = F.zip_with(runs, F.slice(back, 1, F.size(runs)), lambda n, b: n - b)

    def groups(v: Column) -> Column:
        def rest(k):
            return F.call_function("shiftright", v, k * 5)

        def closed(k):  # nothing but the sign is left after group k
            return F.call_function("shiftright", v, k * 5 + 4).isin(0, -1)

        need = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(7)), closed), True)
        return F.concat_ws(
            "",
            F.transform(
                F.sequence(F.lit(0), F.lit(7)),
                lambda k: F.when(k < need, F.chr(rest(k).bitwiseAND(31) + F.when(k + 1 < need, 32).otherwise(0) + 48)),
            ),
        )

    return F.concat_ws("", F.transform(values, groups))


def multiply_of(value: Column, step: int) -> Column:
    """Floored to a multiple of ``step``."""
    return (F.floor(value / step) * step).cast("bigint")
