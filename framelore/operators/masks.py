"""Sparse tile masks: 128-pixel tiles, row-major runs, background first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelore.functions.geometry import MASK_PIXELS, TILE, rle_is_valid
from framelore.operators.drawing import draw

MAX_TILES, MAX_RUNS, MAX_PIXELS = 4096, 1_000_000, 2**32 - 1


def foreground_runs(counts: Column) -> Column:
    """array<struct<start, length>> of the foreground runs of a tile, in order.

    A fold carries the offset; odd positions are foreground.
    """
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("runs"))
    numbered = F.transform(counts, lambda n, i: F.struct(n.cast("int").alias("n"), i.alias("i")))
    done = F.aggregate(
        numbered,
        first,
        lambda s, r: F.struct(
            (s.at + r.n).alias("at"), F.when((r.i % 2 == 1) & (r.n > 0), F.array_append(s.runs, F.struct(s.at.alias("start"), r.n.alias("length")))).otherwise(s.runs).alias("runs")
        ),
    )
    return done.runs


def run_rows(tiles: DataFrame, key: list[str]) -> DataFrame:
    """One row per foreground run: key, tile x and y, start, length."""
    return tiles.select(*key, "x", "y", F.explode(foreground_runs(F.col("counts"))).alias("r")).select(*key, "x", "y", F.col("r.start").alias("start"), F.col("r.length").alias("length"))


def metrics(tiles: DataFrame, key: list[str]) -> DataFrame:
    """Extent and pixels per mask; a run that goes over a row's end spans the whole width of its tile."""
    runs = run_rows(tiles, key)
    y0, y1 = F.floor(F.col("start") / TILE), F.floor((F.col("start") + F.col("length") - 1) / TILE)
    one = y0 == y1
    left = F.col("x") + F.when(one, F.col("start") % TILE).otherwise(0)
    right = F.col("x") + F.when(one, (F.col("start") + F.col("length") - 1) % TILE + 1).otherwise(TILE)
    return runs.groupBy(*key).agg(
        F.min(left).cast("bigint").alias("x1"), F.min(F.col("y") + y0).cast("bigint").alias("y1"), F.max(right).cast("bigint").alias("x2"), F.max(F.col("y") + y1 + 1).cast("bigint").alias("y2"), F.sum("length").alias("area")
    )


def faults(tiles: DataFrame, key: list[str]) -> DataFrame:
    """Masks with ``fault``: an invalid tile, a tile twice, too many tiles or runs; null if valid."""
    per = tiles.groupBy(*key, "x", "y").agg(F.count("*").alias("_n"), F.min(F.coalesce(rle_is_valid(F.col("x"), F.col("y"), F.col("counts")), F.lit(False)).cast("int")).alias("_ok"), F.sum(F.size("counts")).alias("_runs"))
    whole = per.groupBy(*key).agg(F.min("_ok").alias("ok"), F.max("_n").alias("twice"), F.sum("_n").alias("tiles"), F.sum("_runs").alias("runs"))
    fault = F.when(F.col("ok") == 0, "invalid_tile").when(F.col("twice") > 1, "duplicate_tile").when((F.col("tiles") > MAX_TILES) | (F.col("runs") > MAX_RUNS), "too_large")
    return whole.select(*key, fault.alias("fault"))


def merge_runs(runs: DataFrame, key: list[str]) -> DataFrame:
    """Foreground runs of the union: overlapping and touching runs of a tile become one.

    A tile has at most 16,384 pixels, so the ordered group is bounded after
    runs that start together are reduced to their longest.
    """
    tile = [*key, "x", "y"]
    runs = runs.groupBy(*tile, "start").agg(F.max("length").alias("length")).withColumn("stop", F.col("start") + F.col("length"))
    w = Window.partitionBy(*tile).orderBy("start")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*tile, "_island").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length")).drop("_island")


def encode_tiles(runs: DataFrame, key: list[str]) -> DataFrame:
    """Tiles of disjoint, non-touching foreground runs: counts of all runs, background first, ending with the rest."""
    tile = [*key, "x", "y"]
    grouped = runs.groupBy(*tile).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("counts"))
    folded = F.aggregate(
        "runs",
        first,
        lambda s, r: F.struct((r.start + r.length).cast("int").alias("at"), F.array_append(F.array_append(s.counts, (r.start - s.at).cast("int")), r.length.cast("int")).alias("counts")),
    )
    rest = F.lit(MASK_PIXELS) - F.col("f.at")
    return grouped.withColumn("f", folded).select(*tile, F.when(rest > 0, F.array_append("f.counts", rest.cast("int"))).otherwise(F.col("f.counts")).alias("counts"))


def union_masks(tiles: DataFrame, key: list[str]) -> DataFrame:
    """The union of all masks of a key, tile by tile."""
    return encode_tiles(merge_runs(run_rows(tiles, key), key), key)


def pixel_lookup(points: DataFrame, tiles: DataFrame, key: list[str]) -> DataFrame:
    """``points`` (key, px, py, ...) with ``inside``: whether a foreground run of their tile holds the pixel."""
    at = points.withColumn("x", (F.floor(F.col("px") / TILE) * TILE).cast("int")).withColumn("y", (F.floor(F.col("py") / TILE) * TILE).cast("int"))
    offset = (F.floor("py") % TILE * TILE + F.floor("px") % TILE).cast("int")
    runs = tiles.select(*key, "x", "y", foreground_runs(F.col("counts")).alias("_runs"))
    joined = at.withColumn("_o", offset).join(runs, [*key, "x", "y"], "left")
    hit = F.exists("_runs", lambda r: (F.col("_o") >= r.start) & (F.col("_o") < r.start + r.length))
    return joined.select(*points.columns, F.coalesce(hit, F.lit(False)).alias("inside"))


# --- whole-picture column-major runs ------------------------------------------


def tiles_from_counts(counts, width: int, height: int) -> list[tuple[int, int, list[int]]]:
    """(x, y, counts) of the tiles that a column-major picture mask occupies; never allocates the picture.

    Raises ``ValueError`` with the code of what is wrong; the table operators
    turn it into a rejected row.
    """
    if width <= 0 or height <= 0 or width * height > MAX_PIXELS:
        raise ValueError("picture_too_large" if width > 0 and height > 0 else "no_size")
    if len(counts) == 0 or min(counts) < 0 or sum(counts) != width * height:
        raise ValueError("runs_do_not_cover_picture")
    stops = np.cumsum(np.asarray(counts, dtype=np.int64))
    starts = stops - np.asarray(counts, dtype=np.int64)
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for start, stop in zip(starts[1::2].tolist(), stops[1::2].tolist()):
        while start < stop:
            column, row = divmod(start, height)
            bottom = min(row + stop - start, height, (row // TILE + 1) * TILE)
            at = (column // TILE * TILE, row // TILE * TILE)
            pixels = tiles.get(at)
            if pixels is None:
                pixels = tiles[at] = np.zeros((TILE, TILE), dtype=bool)
                if len(tiles) > MAX_TILES:
                    raise ValueError("too_many_tiles")
            pixels[row - at[1] : bottom - at[1], column - at[0]] = True
            start += bottom - row
    return [(x, y, runs_of(tiles[x, y])) for y, x in sorted((y, x) for x, y in tiles)]


def runs_of(pixels: np.ndarray) -> list[int]:
    """Runs of a pixel block in row order, background first."""
    flat = pixels.ravel()
    turns = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate(([0], turns, [flat.size]))).tolist()
    return [0, *runs] if flat[0] else runs


def pixels_of(counts) -> np.ndarray:
    """The pixel block of a tile's runs."""
    return np.repeat(np.arange(len(counts)) % 2 == 1, np.asarray(counts)).reshape(TILE, TILE)


def counts_from_tiles(tiles: list[tuple[int, int, list[int]]], width: int, height: int) -> list[int]:
    """Column-major runs of the whole picture; columns without tiles cost nothing.  Raises ``ValueError`` with a code."""
    if width <= 0 or height <= 0 or width * height > MAX_PIXELS:
        raise ValueError("picture_too_large" if width > 0 and height > 0 else "no_size")
    if any(min(c) < 0 or sum(c) != MASK_PIXELS for _, _, c in tiles):
        raise ValueError("invalid_tile")
    spans: list[np.ndarray] = []
    for x, y, counts in tiles:
        block = pixels_of(counts)[: max(0, height - y), : max(0, width - x)].T  # columns first
        if not block.any():
            continue
        padded = np.zeros((block.shape[0], block.shape[1] + 2), dtype=np.int8)
        padded[:, 1:-1] = block
        column, edge = np.nonzero(np.diff(padded, axis=1))
        ends = ((x + column) * height + y + edge).reshape(-1, 2)
        spans.append(ends)
    if not spans:
        return [width * height]
    ends = np.concatenate(spans)
    ends = ends[np.argsort(ends[:, 0])]
    touching = np.concatenate(([False], ends[1:, 0] == ends[:-1, 1]))
    first = ends[~touching, 0]
    last = ends[np.concatenate((~touching[1:], [True])), 1]
    edges = np.column_stack((first, last)).ravel()
    runs = np.diff(np.concatenate(([0], edges, [width * height]))).tolist()
    return runs[:-1] if runs[-1] == 0 else runs


def _whole_number(value) -> int:
    return 0 if pd.isna(value) else int(value)


def _by_object(tiles: DataFrame, result: str, done) -> DataFrame:
    """``done(object_id, width, height, tiles or None)`` for each object of (object_id, width, height, x, y, counts), as rows of ``result``.

    Objects stream through their partition in order; one object's tiles are
    held at a time, and none of one that has more than ``MAX_TILES``: it gets
    None for its tiles.  Rows without an object are left out.
    """
    names = ["object_id", "width", "height", "x", "y", "counts"]
    columns = ["object_id", *(c.split()[0] for c in result.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, size, held, seen = None, (0, 0), [], 0
        out: list[tuple] = []

        def finish():
            if seen:
                out.extend(done(current, *size, held if seen <= MAX_TILES else None))

        for b in batches:
            for o, w, h, x, y, c in zip(*[b[n].tolist() for n in names]):
                if o != current:
                    finish()
                    current, size, held, seen = o, (_whole_number(w), _whole_number(h)), [], 0
                seen += 1
                if seen <= MAX_TILES:
                    held.append((x, y, c))
                else:
                    held = []
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        finish()
        if out:
            yield pd.DataFrame(out, columns=columns)

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tiles.where("object_id is not null").select(*names).repartition(parts, "object_id").sortWithinPartitions("object_id", "y", "x")
    return placed.mapInPandas(run, f"object_id {dict(tiles.dtypes)['object_id']}, {result}")


def to_column_major(tiles: DataFrame) -> DataFrame:
    """(object_id, counts, fault) from (object_id, width, height, x, y, counts).

    ``fault`` is null for a good mask; a picture beyond 2^32 - 1 pixels or
    without a size, a mask of more than 4,096 tiles and a broken tile give a
    row with null counts and the reason.
    """

    def done(key, width, height, held):
        try:
            if held is None or any(c is None for _, _, c in held):
                raise ValueError("too_many_tiles" if held is None else "invalid_tile")
            return [(key, counts_from_tiles(held, width, height), None)]
        except ValueError as e:
            return [(key, None, str(e))]

    return _by_object(tiles, "counts array<bigint>, fault string", done)


def from_column_major(masks: DataFrame) -> DataFrame:
    """(object_id, x, y, counts, fault) from (object_id, width, height, counts), in batches without a shuffle.

    A mask that cannot be read (no or too large a picture, runs that do not
    cover it, more than 4,096 tiles) gives one row without a tile and the
    reason in ``fault``.  A mask without foreground has no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for o, w, h, runs in zip(b["object_id"], b["width"], b["height"], b["counts"]):
                try:
                    out += [(o, x, y, c, None) for x, y, c in tiles_from_counts([] if runs is None else runs, _whole_number(w), _whole_number(h))]
                except ValueError as e:
                    out.append((o, None, None, None, str(e)))
            rows = pd.DataFrame(out, columns=["object_id", "x", "y", "counts", "fault"])
            yield rows.astype({"x": "Int32", "y": "Int32"})

    return masks.select("object_id", "width", "height", "counts").mapInPandas(run, f"object_id {dict(masks.dtypes)['object_id']}, x int, y int, counts array<int>, fault string")


# --- editing pixels of one instance ---------------------------------------------


def disk(radius: int) -> np.ndarray:
    """The pixels whose centre lies within ``radius``."""
    y, x = np.ogrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def dilate(pixels: np.ndarray, radius: int) -> np.ndarray:
    """Grown by a disk; pixels outside count as background."""
    out = pixels.copy()
    for dy, dx in np.argwhere(disk(radius)) - radius:
        ys, xs = slice(max(0, dy), pixels.shape[0] + min(0, dy)), slice(max(0, dx), pixels.shape[1] + min(0, dx))
        yt, xt = slice(max(0, -dy), pixels.shape[0] + min(0, -dy)), slice(max(0, -dx), pixels.shape[1] + min(0, -dx))
        out[ys, xs] |= pixels[yt, xt]
    return out


def erode(pixels: np.ndarray, radius: int) -> np.ndarray:
    """Shrunk by a disk; outside the block counts as foreground, so borders of the picture are kept."""
    return ~dilate(~pixels, radius)


def smooth(pixels: np.ndarray, radius: int) -> np.ndarray:
    """Majority in a square around each pixel (a binary median)."""
    size = 2 * radius + 1
    sums = np.pad(pixels.astype(np.int32), ((radius + 1, radius), (radius + 1, radius)))
    total = sums.cumsum(0).cumsum(1)
    window = total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
    return window * 2 > size * size


def components(pixels: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels of the 8-connected parts and their number, by merging runs of neighbouring rows."""
    labels = np.zeros(pixels.shape, dtype=np.int32)
    parent = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(pixels.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], pixels[y].astype(np.int8), [0]))))
        here = []
        for a, b in edge.reshape(-1, 2).tolist():
            touching = [find(k) for s, e, k in above if s <= b and e >= a]
            if touching:
                k = min(touching)
                for t in touching:
                    parent[t] = k
            else:
                k = len(parent)
                parent.append(k)
            labels[y, a:b] = k
            here.append((a, b, k))
        above = here
    roots = np.array([find(i) for i in range(len(parent))])
    names = np.unique(roots[1:])
    lookup = np.zeros(len(parent), dtype=np.int32)
    lookup[1:] = np.searchsorted(names, roots[1:]) + 1 if len(names) else 0
    return lookup[labels], len(names)


def holes(pixels: np.ndarray) -> int:
    """Background parts that do not reach the border, 4-connected as the complement of 8-connected foreground."""
    outside = np.pad(~pixels, 1, constant_values=True)
    seen = np.zeros_like(outside)
    count = -1
    for y, x in np.argwhere(outside):
        if seen[y, x]:
            continue
        count += 1
        stack = [(int(y), int(x))]
        seen[y, x] = True
        while stack:
            i, j = stack.pop()
            for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= a < outside.shape[0] and 0 <= b < outside.shape[1] and outside[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    stack.append((a, b))
    return count


def edit(pixels: np.ndarray, operation: str, radius: int) -> np.ndarray:
    """smooth, shrink or expand; an edit that would close a hole or lose all pixels is refused."""
    done = {"smooth": smooth, "shrink": erode, "expand": dilate}[operation](pixels, radius)
    if not done.any():
        raise ValueError("the edit leaves no pixels")
    if holes(done) < holes(pixels):
        raise ValueError("the edit would close a hole")
    return done


def nearest_parts(pixels: np.ndarray, keep: int = 2) -> list[np.ndarray]:
    """The ``keep`` largest connected parts; every smaller part goes to the one whose pixels are nearest (the first of equally near)."""
    labels, count = components(pixels)
    if count <= 1:
        return [pixels] if count else []
    sizes = np.bincount(labels.ravel())[1:]
    order = sorted(range(1, count + 1), key=lambda k: (-sizes[k - 1], k))
    chosen, strays = sorted(order[:keep]), order[keep:]
    parts = [labels == k for k in chosen]
    spots = [np.argwhere(p) for p in parts]
    for k in strays:
        mine = np.argwhere(labels == k)
        # Distances in blocks of rows, so memory stays at the size of the window.
        far = [min(int(((mine[i : i + 64, None, :] - s[None, :, :]) ** 2).sum(2).min()) for i in range(0, len(mine), 64)) for s in spots]
        parts[int(np.argmin(far))] |= labels == k
    return parts


def split_by_line(pixels: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> list[np.ndarray]:
    """The parts on either side of a cut line; every pixel goes to exactly one part, strays to the nearest."""
    y, x = np.indices(pixels.shape)
    side = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    parts = [pixels & side, pixels & ~side]
    return [p for p in parts if p.any()]


def rasterize(rings: list[list[tuple[float, float]]], width: int, height: int) -> np.ndarray:
    """Pixels whose centre lies in any ring (even-odd per ring).

    Each edge turns the parity of its rows from its crossing on; the running
    parity along a row tells inside from outside.
    """
    out = np.zeros((height, width), dtype=bool)
    for ring in rings:
        p = np.asarray(ring, dtype=float)
        q = np.roll(p, -1, axis=0)
        first = np.clip(np.ceil(np.minimum(p[:, 1], q[:, 1]) - 0.5), 0, height).astype(np.int64)
        stop = np.clip(np.ceil(np.maximum(p[:, 1], q[:, 1]) - 0.5), 0, height).astype(np.int64)
        count = stop - first
        if not count.any():
            continue
        edge = np.repeat(np.arange(len(p)), count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[edge]
        x = p[edge, 0] + (row + 0.5 - p[edge, 1]) * (q[edge, 0] - p[edge, 0]) / (q[edge, 1] - p[edge, 1])
        column = np.clip(np.ceil(x - 0.5), 0, width).astype(np.int64)
        top, bottom, left, right = row.min(), row.max() + 1, column.min(), column.max()
        turns = np.zeros((bottom - top, right - left + 1), dtype=np.uint8)
        np.bitwise_xor.at(turns, (row - top, column - left), 1)
        out[top:bottom, left:right] |= np.bitwise_xor.accumulate(turns, axis=1)[:, :-1].astype(bool)
    return out


def stroke(pixels: np.ndarray, a: tuple[float, float], b: tuple[float, float], radius: float, erase: bool = False) -> np.ndarray:
    """A brush from a to b: pixels whose centre is within ``radius`` of the segment are set or cleared."""
    y, x = np.indices(pixels.shape) + 0.5
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = np.clip(((x - a[0]) * dx + (y - a[1]) * dy) / ((dx * dx + dy * dy) or 1.0), 0, 1)
    hit = (x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2 <= radius * radius
    return pixels & ~hit if erase else pixels | hit


# --- editing tables of masks --------------------------------------------------------

WINDOW_PIXELS = 4_194_304  # the largest stretch of a picture that is edited at once


def _window(held: list[tuple[int, int, list[int]]], width: int, height: int, margin: int) -> tuple[int, int, np.ndarray]:
    """(left, top, pixels) of the tiles with ``margin`` pixels around, inside the picture."""
    left, top = max(0, min(x for x, _, _ in held) - margin), max(0, min(y for _, y, _ in held) - margin)
    right, bottom = min(width, max(x for x, _, _ in held) + TILE + margin), min(height, max(y for _, y, _ in held) + TILE + margin)
    if right <= left or bottom <= top:
        raise ValueError("outside_picture")
    if (right - left) * (bottom - top) > WINDOW_PIXELS:
        raise ValueError("window_too_large")
    pixels = np.zeros((bottom - top, right - left), dtype=bool)
    for x, y, counts in held:
        if min(counts) < 0 or sum(counts) != MASK_PIXELS:
            raise ValueError("invalid_tile")
        block = pixels_of(counts)[: max(0, min(TILE, bottom - y)), : max(0, min(TILE, right - x))]
        pixels[y - top : y - top + block.shape[0], x - left : x - left + block.shape[1]] |= block
    return left, top, pixels


def window_tiles(pixels: np.ndarray, left: int, top: int) -> list[tuple[int, int, list[int]]]:
    """Tiles with foreground of a stretch of a picture that begins at (left, top)."""
    out = []
    for y in range(top // TILE * TILE, top + pixels.shape[0], TILE):
        for x in range(left // TILE * TILE, left + pixels.shape[1], TILE):
            tile = np.zeros((TILE, TILE), dtype=bool)
            part = pixels[max(0, y - top) : max(0, y - top + TILE), max(0, x - left) : max(0, x - left + TILE)]
            tile[max(0, top - y) : max(0, top - y) + part.shape[0], max(0, left - x) : max(0, left - x) + part.shape[1]] = part
            if tile.any():
                out.append((x, y, runs_of(tile)))
    return out


def _reshaped(tiles: DataFrame, margin: int, change) -> DataFrame:
    """(object_id, part, x, y, counts, fault): ``change(pixels, left, top)`` gives the parts an object becomes."""

    def done(key, width, height, held):
        try:
            if held is None or any(c is None for _, _, c in held):
                raise ValueError("too_many_tiles" if held is None else "invalid_tile")
            left, top, pixels = _window(held, width, height, margin)
            return [(key, n, x, y, c, None) for n, part in enumerate(change(pixels, left, top)) for x, y, c in window_tiles(part, left, top)]
        except ValueError as e:
            return [(key, None, None, None, None, str(e))]

    return _by_object(tiles, "part int, x int, y int, counts array<int>, fault string", done)


def edit_masks(tiles: DataFrame, operation: str, radius: int) -> DataFrame:
    """Masks smoothed, shrunk or expanded by ``radius``: (object_id, part, x, y, counts, fault) from (object_id, width, height, x, y, counts).

    An edit that would close a hole or lose all pixels, a broken tile and a
    mask over the limits give one row with the reason in ``fault``; the mask
    then stays as it was.
    """
    return _reshaped(tiles, radius, lambda pixels, left, top: [edit(pixels, operation, radius)])


def split_masks(tiles: DataFrame, line: tuple[float, float, float, float] | None = None, parts: int = 2) -> DataFrame:
    """Masks split along a line (x1, y1, x2, y2 in pixels of the picture) or, without one, into their ``parts`` largest connected parts.

    Smaller parts go to the nearest of these, so every pixel is in exactly one
    part; a mask in one piece stays part 0.
    """
    if line is None:
        return _reshaped(tiles, 0, lambda pixels, left, top: nearest_parts(pixels, parts))
    x1, y1, x2, y2 = line
    return _reshaped(tiles, 0, lambda pixels, left, top: split_by_line(pixels, (x1 - left, y1 - top), (x2 - left, y2 - top)))


def paint_masks(tiles: DataFrame, a: tuple[float, float], b: tuple[float, float], radius: float, erase: bool = False) -> DataFrame:
    """Masks with a brush stroke from ``a`` to ``b`` set or, with ``erase``, cleared; a mask left without pixels has no row.

    A stroke paints within the mask's own tiles and as far around them as it
    is wide.
    """
    return _reshaped(tiles, int(np.ceil(radius)) + 1, lambda pixels, left, top: [stroke(pixels, (a[0] - left, a[1] - top), (b[0] - left, b[1] - top), radius, erase)])


def shape_counts(tiles: DataFrame) -> DataFrame:
    """(object_id, pixels, parts, holes, fault): size, connected parts and holes of each mask."""

    def done(key, width, height, held):
        try:
            if held is None or any(c is None for _, _, c in held):
                raise ValueError("too_many_tiles" if held is None else "invalid_tile")
            pixels = _window(held, width, height, 0)[2]
            return [(key, int(pixels.sum()), components(pixels)[1], holes(pixels), None)]
        except ValueError as e:
            return [(key, None, None, None, str(e))]

    return _by_object(tiles, "pixels bigint, parts bigint, holes bigint, fault string", done)


def rasterize_rings(shapes: DataFrame) -> DataFrame:
    """(object_id, x, y, counts, fault, pixels): tiles of the pixels whose centres lie in the rings, from (object_id, width, height, rings).

    Rings may cross themselves or leave the picture: the part inside it is
    kept; ``pixels`` is the foreground of a tile.  Objects are drawn many at a
    time by the crossings of their rows, so an object costs the rows and tiles
    it covers; an extent over 4,194,304 pixels, rings without a finite
    coordinate and shapes without a pixel give one row with the reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owner, *found in draw(b.column("width"), b.column("height"), b.column("rings"), WINDOW_PIXELS):
                n, key = len(owner), b.column("object_id").take(pa.array(owner))
                if len(found) == 1:
                    cells = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.array(found[0], pa.string()), pa.nulls(n, pa.int64())]
                else:
                    x, y, counts, pixels = found
                    cells = [pa.array(x), pa.array(y), counts, pa.nulls(n, pa.string()), pa.array(pixels)]
                yield pa.RecordBatch.from_arrays([key, *cells], ["object_id", "x", "y", "counts", "fault", "pixels"])

    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # drawing costs more than moving the rings
    placed = shapes.select("object_id", "width", "height", "rings").repartition(parts, "object_id")
    return placed.mapInArrow(run, f"object_id {dict(shapes.dtypes)['object_id']}, x int, y int, counts array<int>, fault string, pixels bigint")
