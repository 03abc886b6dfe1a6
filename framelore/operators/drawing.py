"""Rings to tile runs, many objects at a time: crossings per row, spans per tile, runs; no pixel block is ever made.

Same pixels as ``masks.rasterize``: centres inside, even-odd per ring, the
union over the rings of an object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from framelore.functions.geometry import MASK_PIXELS, TILE

AT_ONCE = 1 << 18  # crossings and tile spans drawn together, unless a single object has more
COLUMN_BITS, LENGTH_BITS = 23, 8  # a window is at most 2^22 pixels wide, a span of a tile 128
TILE_BITS, PIXEL_BITS = TILE.bit_length() - 1, MASK_PIXELS.bit_length() - 1


def _numbers(column: pa.Array) -> np.ndarray:
    """As doubles, nulls as NaN."""
    return column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def _sizes(column: pa.Array) -> np.ndarray:
    """Whole numbers, nulls as 0."""
    return np.trunc(np.nan_to_num(_numbers(column)))


def _first(counts: np.ndarray) -> np.ndarray:
    """Where each group begins, groups of ``counts`` lying one after another."""
    return np.cumsum(counts) - counts


def _each(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each group."""
    return np.arange(counts.sum()) - np.repeat(_first(counts), counts)


def _points(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(object of each ring, points of each ring, x, y) of the rings with three points or more."""
    per_object = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ring = rings.flatten()
    size = ring.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    point = ring.flatten()
    x, y = (_numbers(point.flatten()[point.type.get_field_index(n)]) for n in ("x", "y"))
    kept = size >= 3
    inside = np.repeat(kept, size)
    return np.repeat(np.arange(len(rings)), per_object)[kept], size[kept], x[inside], y[inside]


def draw(width: pa.Array, height: pa.Array, rings: pa.ListArray, largest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray] | tuple[np.ndarray, np.ndarray]]:
    """(object, x, y, counts, pixels) of the tiles with foreground, in stretches; at the end (object, fault) of the objects without.

    ``largest`` is the number of pixels that the extent of an object may have.
    """
    n = len(rings)
    w, h = _sizes(width), _sizes(height)
    owner, size, x, y = _points(rings)
    held = np.bincount(owner, size, n).astype(np.int64)
    some = held > 0
    finite = np.bincount(np.repeat(owner, size), ~(np.isfinite(x) & np.isfinite(y)), n) == 0
    x1, y1, x2, y2 = np.zeros((4, n))
    if some.any():
        at = _first(held)[some]
        x1[some], y1[some] = np.minimum.reduceat(x, at), np.minimum.reduceat(y, at)
        x2[some], y2[some] = np.maximum.reduceat(x, at), np.maximum.reduceat(y, at)
    left, top = np.maximum(0, np.floor(x1)), np.maximum(0, np.floor(y1))
    right, bottom = np.minimum(w, np.ceil(x2)), np.minimum(h, np.ceil(y2))
    with np.errstate(over="ignore", invalid="ignore"):
        too_large = (right - left) * (bottom - top) > largest
    fault = np.select(
        [(w <= 0) | (h <= 0), ~some, ~finite, (right <= left) | (bottom <= top), too_large],
        ["no_size", "no_ring", "not_finite", "outside_picture", "window_too_large"],
        "no_pixel",  # until a pixel is found
    )

    good = fault == "no_pixel"
    number = np.cumsum(good) - 1
    left, top, wide, high = (np.where(good, v, 0).astype(np.int64)[good] for v in (left, top, right - left, bottom - top))
    inside = np.repeat(good[owner], size)
    x, y = x[inside], y[inside]
    size, owner = size[good[owner]], number[owner[good[owner]]]
    of = np.repeat(owner, size)
    x, y = x - left[of], y - top[of]
    level = np.clip(np.ceil(y - 0.5), 0, high[of]).astype(np.int64)  # the first row whose centre is not above the point
    after = np.arange(1, len(x) + 1)
    after[np.cumsum(size) - 1] = _first(size)
    crossings = np.abs(level[after] - level)

    # As many objects as there is work for at once.
    work = np.bincount(of, crossings, len(left)) * (1 + wide // TILE)
    stretch = np.cumsum(work) // AT_ONCE
    starts = np.flatnonzero(np.diff(stretch, prepend=-1))
    ring_at, point_at = np.searchsorted(owner, starts), np.searchsorted(of, starts)
    names = np.flatnonzero(good)
    for o, r, p, o2, r2, p2 in zip(starts, ring_at, point_at, [*starts[1:], len(left)], [*ring_at[1:], len(owner)], [*point_at[1:], len(of)]):
        found = _stretch(left[o:o2], top[o:o2], wide[o:o2], high[o:o2], owner[r:r2] - o, size[r:r2], x[p:p2], y[p:p2], level[p:p2])
        if found is not None:
            tiled = names[found[0] + o]
            fault[tiled] = ""
            yield tiled, *found[1:]
    rest = np.flatnonzero(fault != "")
    yield rest, fault[rest]


def _stretch(left, top, wide, high, owner, size, x, y, level):
    """(object, x, y, counts, pixels) of the tiles of a few objects, or None; ``owner`` and ``size`` are per ring, ``x``, ``y`` and ``level`` per point."""
    ring_start = _first(size)
    # Rows of all rings are numbered one after another, from the first to the last row of each.
    lowest = np.minimum.reduceat(level, ring_start)
    rows = np.maximum.reduceat(level, ring_start) - lowest
    row_base = _first(rows) - lowest
    after = np.arange(1, len(x) + 1)
    after[ring_start + size - 1] = ring_start
    first, stop = np.minimum(level, level[after]), np.maximum(level, level[after])
    edge = np.flatnonzero(stop > first)
    if not len(edge):
        return None
    first, count, after = first[edge], (stop - first)[edge], after[edge]
    ring = np.repeat(np.arange(len(size)), size)[edge]
    to_x, to_y, x, y = x[after], y[after], x[edge], y[edge]
    row = _each(count)
    row += np.repeat(first, count)
    if (to_x != x).any():
        with np.errstate(over="ignore", invalid="ignore"):
            across = row + 0.5
            across -= np.repeat(y, count)
            across *= np.repeat(to_x - x, count)
            across /= np.repeat(to_y - y, count)
            across += np.repeat(x, count)
        wild = np.flatnonzero(~np.isfinite(across))  # coordinates whose product is no double any more
        if len(wild):
            e = np.repeat(np.arange(len(edge)), count)[wild]
            part = (row[wild] / 2 - y[e] / 2) / (to_y[e] / 2 - y[e] / 2)
            across[wild] = x[e] * (1 - part) + to_x[e] * part
        across = np.clip(np.ceil(across - 0.5), 0, np.repeat(wide[owner[ring]], count)).astype(np.int64)
    else:  # upright edges only
        across = np.repeat(np.clip(np.ceil(x - 0.5), 0, wide[owner[ring]]).astype(np.int64), count)
    row += np.repeat(row_base[ring], count)
    row <<= COLUMN_BITS
    row |= across
    row.sort()  # a closed ring crosses a row an even number of times

    begin, end = row[::2], row[1::2]
    filled = end > begin
    if not filled.all():
        begin, end = begin[filled], end[filled]
    if not len(begin):
        return None
    ring = np.repeat(np.arange(len(size)), rows)[begin >> COLUMN_BITS]
    own = owner[ring]
    low = (1 << COLUMN_BITS) - 1
    a, b = (begin & low) + left[own], (end & low) + left[own]
    y = (begin >> COLUMN_BITS) + (top[owner] - row_base)[ring]

    # Tiles of all windows are numbered one after another, row by row.
    tx, ty = left >> TILE_BITS, top >> TILE_BITS
    across = ((left + wide - 1) >> TILE_BITS) - tx + 1
    base = _first(across * (((top + high - 1) >> TILE_BITS) - ty + 1))
    t = a >> TILE_BITS
    count = ((b - 1) >> TILE_BITS) - t + 1
    tile = (base - ty * across - tx)[own] + (y >> TILE_BITS) * across[own] + t
    step = _each(count)
    t = (np.repeat(t, count) + step) << TILE_BITS
    begin = np.maximum(np.repeat(a, count) - t, 0)
    end = np.minimum(np.repeat(b, count) - t, TILE)
    key = np.repeat(tile, count)
    key += step
    key <<= PIXEL_BITS
    key += np.repeat((y & TILE - 1) << TILE_BITS, count)
    key += begin
    key <<= LENGTH_BITS
    key |= end - begin
    key.sort()

    # Spans that overlap or touch within a tile are one run.
    start = key >> LENGTH_BITS
    key &= (1 << LENGTH_BITS) - 1
    key += start
    reach = np.maximum.accumulate(key)
    fresh = np.empty(len(start), dtype=bool)
    fresh[0] = True
    np.greater(start[1:], reach[:-1], out=fresh[1:])
    fresh[1:] |= (start[1:] >> PIXEL_BITS) != (start[:-1] >> PIXEL_BITS)
    at = np.flatnonzero(fresh)
    start, stop = start[at], reach[np.append(at[1:], len(reach)) - 1]

    tile = start >> PIXEL_BITS
    head = np.flatnonzero(np.diff(tile, prepend=-1))
    runs = np.diff(head, append=len(tile))
    tile = tile[head]
    length = stop - start
    gap = start.copy()
    gap[1:] -= stop[:-1]
    gap[head] = start[head] & MASK_PIXELS - 1
    rest = ((tile + 1) << PIXEL_BITS) - stop[head + runs - 1]
    ends = np.cumsum(2 * runs + (rest > 0))
    counts = np.empty(ends[-1], dtype=np.int32)
    place = 2 * np.arange(len(start)) + np.repeat(_first((rest > 0).astype(np.int64)), runs)
    counts[place], counts[place + 1] = gap, length
    counts[ends[rest > 0] - 1] = rest[rest > 0]

    own = np.searchsorted(base, tile, "right") - 1
    ty, tx = np.divmod(tile - base[own], across[own])
    x, y = ((left[own] >> TILE_BITS) + tx) << TILE_BITS, ((top[own] >> TILE_BITS) + ty) << TILE_BITS
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(counts))
    return own, x.astype(np.int32), y.astype(np.int32), listed, np.add.reduceat(length, head)
