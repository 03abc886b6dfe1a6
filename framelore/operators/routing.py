"""Routing pictures by resolution, tile grids and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.functions.geometry import multiply_of

# Limits of the routes.
DIRECT_PIXELS = 8_000_000
RESIZE_PIXELS = 20_000_000
RESIZE_SIDES = 3
OVERLAP = 0.2
ALIGN = 16


def stride_of(tile: int, overlap: float = OVERLAP) -> int:
    """Distance of neighbouring tiles; Python's half-even rounding."""
    return max(1, round(tile * (1 - overlap)))


def route(width: Column, height: Column, has_coarse: Column, tile: int = 1536) -> Column:
    """direct, annotation_crops, resize_whole or overlap_tiles; null without a valid size."""
    side, pixels = F.greatest(width, height), width.cast("bigint") * height
    return (
        F.when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), F.lit(None).cast("string"))
        .when((side <= tile) & (pixels <= DIRECT_PIXELS), "direct")
        .when(F.coalesce(has_coarse, F.lit(False)), "annotation_crops")
        .when((pixels <= RESIZE_PIXELS) & (side <= tile * RESIZE_SIDES), "resize_whole")
        .otherwise("overlap_tiles")
    )


def axis_tiles(length: Column, tile: int = 1536) -> Column:
    """Tiles along one axis as the router estimates them."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), length - tile) / stride_of(tile)) + 1).cast("int")


def route_images(images: DataFrame, coarse_keys: DataFrame, tile: int = 1536) -> DataFrame:
    """``images`` (image_key, width, height) with strategy and estimated_tiles; ``coarse_keys`` holds pictures with coarse regions."""
    flagged = images.join(coarse_keys.select("image_key").distinct().withColumn("_coarse", F.lit(True)), "image_key", "left")
    strategy = route(F.col("width"), F.col("height"), F.col("_coarse"), tile)
    tiles = F.when(F.col("strategy") == "overlap_tiles", axis_tiles(F.col("width"), tile) * axis_tiles(F.col("height"), tile)).when(F.col("strategy").isNotNull(), 1)
    return flagged.withColumn("strategy", strategy).withColumn("estimated_tiles", tiles).drop("_coarse")


def axis_starts(length: Column, tile: int, overlap: float = OVERLAP) -> Column:
    """Aligned origins along one axis: every stride, the last clamped to the end, doubles dropped."""
    last = F.greatest(length - tile, F.lit(0))
    starts = F.concat(F.sequence(F.lit(0), last, F.lit(stride_of(tile, overlap))), F.array(last))
    return F.array_distinct(F.transform(starts, lambda s: multiply_of(s, ALIGN)))


def tile_grid(images: DataFrame, tile: int = 1536, overlap: float = OVERLAP) -> DataFrame:
    """One row per tile of ``images`` (image_key, width, height), numbered by row then column."""
    xs, ys = axis_starts(F.col("width"), tile, overlap), axis_starts(F.col("height"), tile, overlap)
    slack = tile + ALIGN - 1
    return (
        images.where("width > 0 and height > 0")
        .select("image_key", "width", "height", xs.alias("xs"), F.posexplode(ys).alias("row", "y"))
        .select("image_key", "width", "height", "row", "y", F.size("xs").alias("columns"), F.posexplode("xs").alias("column", "x"))
        .select(
            "image_key",
            (F.col("row") * F.col("columns") + F.col("column")).alias("tile_index"),
            "x",
            "y",
            F.least(F.lit(slack), F.col("width") - F.col("x")).cast("int").alias("tile_width"),
            F.least(F.lit(slack), F.col("height") - F.col("y")).cast("int").alias("tile_height"),
        )
    )


def crop_window(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> list[Column]:
    """A requested crop brought into the picture: size within 64 to 4096 and the picture, origin inside and aligned."""
    w = F.greatest(F.lit(64), F.least(F.lit(4096), width, image_width))
    h = F.greatest(F.lit(64), F.least(F.lit(4096), height, image_height))
    return [multiply_of(F.greatest(F.lit(0), F.least(image_width - w, x)), ALIGN), multiply_of(F.greatest(F.lit(0), F.least(image_height - h, y)), ALIGN), w, h]


def center_crop(width: Column, height: Column, size: int = 1024) -> list[Column]:
    """The aligned crop around the middle."""
    w, h = F.least(width, F.lit(size)), F.least(height, F.lit(size))
    half = lambda n: F.greatest(F.lit(0), multiply_of(F.floor(n / 2), ALIGN))
    return [half(width - w), half(height - h), w, h]
