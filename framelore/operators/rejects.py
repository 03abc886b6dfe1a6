"""Separating label lines that cannot be loaded from those that can.

Method: each distinct value of a column kind is judged once; the invalid ones
form a dictionary with reasons, which is joined back to the lines beside the
structural checks (quoting, column count, corner order).  All of it stays in
JVM expressions.

Scale: the values are reduced to distinct ones with map-side combine before
they are judged, so a value that fills a third of all lines is judged once.
The dictionary holds invalid values only; whether it is broadcast is left to
AQE, which decides on its measured size and splits a skewed value otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.tables import stage

# The formats, their column kinds in order, and the reasons.
YOLO_KINDS = ["class", "unit", "unit", "extent", "extent"]
CSV_KINDS = ["path", "label", "number", "number", "number", "number", "confidence", "moment"]
CSV_COLUMNS = 9
REASONS = {
    "class": "class is not an integer of the catalog",
    "unit": "centre is not a finite number in [0, 1]",
    "extent": "size is not a finite number in (0, 1]",
    "path": "image_path is not a portable relative path",
    "label": "label is blank",
    "number": "corner is not a finite number",
    "confidence": "confidence is neither empty nor in [0, 1]",
    "moment": "reviewed_at is neither empty nor a real date",
}
KINDS = list(REASONS)  # a kind travels as its place in this list
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?)?\z"


def finite(value: Column) -> Column:
    """The number a text stands for, null unless it is finite, decimal or scientific."""
    number = value.try_cast("double")
    return F.when(value.rlike(NUMBER) & (F.abs(number) < F.lit(float("inf"))), number)


def portable_path(value: Column) -> Column:
    """Relative, not empty, no outer blanks, backslash, colon, leading slash or '..' segment."""
    return (
        (F.length(value) > 0)
        & ~value.rlike(r"(?U)^\s|\s$")
        & ~value.rlike(r"[\\:]|^/")
        & ~value.rlike(r"(^|/)[.][.](/|$)")
    )


def clean_line(raw: Column) -> Column:
    """Without a byte order mark in front and blanks or carriage returns at the end; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "^﻿", ""), r"(?U)\s+$", "")


def _parts(line: Column) -> Column:
    """The line between two commas, cut at its quotes: parts outside and inside quotes in turn.

    The added commas make the first and the last outer part like all others, so
    no expression over the parts needs their number (which would cut the line
    again for each part).
    """
    return F.split(F.concat(F.lit(","), line, F.lit(",")), '"', -1)


def quoting_is_sound(line: Column) -> Column:
    """Every quote is closed, doubled, or at the border of its field.

    An outer part must be empty (a doubled quote) or touch its neighbours with
    commas, and the number of quotes must be even.  Linear in the line.
    """
    good = F.transform(_parts(line), lambda part, i: (i % 2 == 1) | (part == "") | (part.startswith(",") & part.endswith(",")))
    return (F.size(_parts(line)) % 2 == 1) & F.forall(good, lambda x: x)


def csv_fields(line: Column) -> Column:
    """Fields of a line whose quoting is sound.

    Outer commas become the cutting mark; a quote cannot remain, so it serves
    as that mark.  Doubled quotes travel as an escape.
    """
    joined = F.concat_ws(
        "",
        F.transform(
            _parts(F.replace(line, F.lit("\\"), F.lit("\\b"))),
            lambda part, i: F.when(i % 2 == 1, part).when(part == "", F.lit("\\q")).otherwise(F.replace(part, F.lit(","), F.lit('"'))),
        ),
    )
    inner = F.regexp_replace(joined, '^"|"$', "")
    return F.transform(
        F.split(inner, '"', -1),
        lambda x: F.replace(F.replace(x, F.lit("\\q"), F.lit('"')), F.lit("\\b"), F.lit("\\")),
    )


def value_is_valid(kind: Column, value: Column) -> Column:
    """Judges one value by its column kind; a class is judged by joining the catalog."""
    number = finite(value)
    of = lambda name: kind == KINDS.index(name)
    return (
        F.when(of("unit"), number.between(0, 1))
        .when(of("extent"), (number > 0) & (number <= 1))
        .when(of("path"), portable_path(value))
        .when(of("label"), value.rlike(r"(?U)\S"))
        .when(of("number"), number.isNotNull())
        .when(of("confidence"), (value == "") | number.between(0, 1))
        .when(of("moment"), (value == "") | value.rlike(MOMENT) & F.left(value, F.lit(10)).try_cast("date").isNotNull())
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (line_key, line_format, raw_line, ...) with ``_line``, ``_sound``, ``_fields``, ``_skip``."""
    line = F.col("_line")
    csv = F.lower(F.trim("line_format")) == "csv"
    yolo = F.lower(F.trim("line_format")) == "yolo"
    return (
        lines.withColumn("_line", clean_line(F.col("raw_line")))
        .withColumn("_skip", (line == "") | line.startswith("#"))
        .withColumn("_format", F.when(csv, "csv").when(yolo, "yolo"))
        .withColumn("_sound", F.when(csv, quoting_is_sound(line)).otherwise(F.lit(True)))
        .withColumn(
            "_fields",
            F.when(csv & F.col("_sound"), csv_fields(line)).when(yolo, F.split(F.regexp_replace(line, r"(?U)^\s+", ""), r"(?U)\s+", -1)),
        )
        .withColumn("_count", F.when(F.col("_format") == "csv", F.lit(CSV_COLUMNS)).otherwise(F.lit(len(YOLO_KINDS))))
        .withColumn("_shaped", ~F.col("_skip") & F.col("_sound") & (F.size("_fields") == F.col("_count")))
    )


def invalid_values(parsed: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values of all well-shaped lines in long form, and the dictionary of the invalid ones.

    Long rows are narrow: the line's key and a hash of its content (which only
    tells lines of one key apart), the kind's number and the value.
    """
    places = lambda names: F.array(*[F.lit(KINDS.index(n)).cast("tinyint") for n in names])
    kinds = F.when(F.col("_format") == "csv", places(CSV_KINDS)).otherwise(places(YOLO_KINDS))
    long = (
        parsed.where("_shaped")
        .select("line_key", F.xxhash64("raw_line").alias("_content"), F.explode(F.arrays_zip(kinds.alias("kind"), F.slice("_fields", 1, 8).alias("value"))).alias("v"))
        .select("line_key", "_content", F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))
        .where(F.col("kind").isNotNull())
    )
    known = catalog.where(F.col("category_id").isNotNull()).select(F.col("category_id").cast("bigint").alias("_id"), F.lit(True).alias("_known")).distinct()
    judged = (
        long.select("kind", "value")
        .distinct()
        .withColumn("_id", F.when((F.col("kind") == KINDS.index("class")) & F.col("value").rlike(r"^[+-]?[0-9]+$"), F.col("value").try_cast("bigint")))
        .join(known, "_id", "left")
        .withColumn("_ok", F.when(F.col("kind") == KINDS.index("class"), F.coalesce("_known", F.lit(False))).otherwise(value_is_valid(F.col("kind"), F.col("value"))))
    )
    reasons = F.array(*map(F.lit, REASONS.values()))
    dictionary = judged.where(~F.coalesce("_ok", F.lit(False))).select("kind", "value", F.get(reasons, F.col("kind").cast("int")).alias("reason"))
    return long, dictionary


def judge_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every line with ``code`` and ``message``; both null where the line can be loaded or is skipped.

    ``lines`` needs line_key, line_format and raw_line; all its columns are
    kept, ``fields`` holds the parsed values, ``skipped`` marks blank lines and
    comments.  Codes: broken_quoting, else column_count, else invalid_value;
    unknown_format for a format that is neither yolo nor csv (null included).
    Defined results: a null or empty line is skipped; a repeated line or key
    is judged by its own content; no input gives no rows; very long lines are
    handled without backtracking; of several reasons the alphabetically first
    is given.  Columns of ``lines`` named like the results are replaced.
    """
    results = {"code", "message", "fields", "skipped"}
    lines = lines.select(*[c for c in lines.columns if c not in results and not c.startswith("_")])
    parsed = stage(parse_lines(lines), "rejects-lines")  # read three times: for the dictionary, the join and the result
    long, dictionary = invalid_values(parsed, catalog)
    bad = (
        long.join(dictionary, ["kind", "value"])
        .groupBy(F.col("line_key").alias("_key"), "_content")
        .agg(F.min("reason").alias("_reason"))
    )
    x = lambda i: finite(F.get("_fields", F.lit(i)))
    reversed_box = (F.col("_format") == "csv") & F.col("_shaped") & ~((x(2) < x(4)) & (x(3) < x(5)))
    joined = parsed.join(bad, F.col("line_key").eqNullSafe(F.col("_key")) & (F.xxhash64("raw_line") == F.col("_content")), "left")
    code = (
        F.when(F.col("_skip"), F.lit(None).cast("string"))
        .when(F.col("_format").isNull(), "unknown_format")
        .when(~F.col("_sound"), "broken_quoting")
        .when(~F.col("_shaped"), "column_count")
        .when(F.col("_reason").isNotNull() | reversed_box, "invalid_value")
    )
    message = (
        F.when(F.col("_skip"), F.lit(None).cast("string"))
        .when(F.col("_format").isNull(), "the format is unknown")
        .when(~F.col("_sound"), "a quote is not closed, not doubled or inside its field")
        .when(~F.col("_shaped"), F.concat(F.size("_fields").cast("string"), F.lit(" columns instead of "), F.col("_count").cast("string")))
        .when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(reversed_box, "the corners are not in order")
    )
    return joined.select(*lines.columns, code.alias("code"), message.alias("message"), F.col("_skip").alias("skipped"), F.col("_fields").alias("fields"), F.col("_format").alias("_fmt")).withColumnRenamed("_fmt", "format")


def loaded_objects(judged: DataFrame) -> DataFrame:
    """The valid lines as objects: one row per line, columns of both formats."""
    f = lambda i: F.get("fields", F.lit(i))
    csv, yolo = F.col("format") == "csv", F.col("format") == "yolo"
    num = lambda i: f(i).try_cast("double")
    return judged.where(F.col("code").isNull() & ~F.col("skipped")).select(
        "line_key",
        "import_id",
        "format",
        F.when(yolo, f(0).try_cast("int")).alias("category_id"),
        F.when(csv, f(1)).alias("label"),
        F.when(csv, f(0)).alias("image_path"),
        F.when(csv, num(2)).when(yolo, num(1) - num(3) / 2).alias("x1"),
        F.when(csv, num(3)).when(yolo, num(2) - num(4) / 2).alias("y1"),
        F.when(csv, num(4)).when(yolo, num(1) + num(3) / 2).alias("x2"),
        F.when(csv, num(5)).when(yolo, num(2) + num(4) / 2).alias("y2"),
        F.when(csv, num(6)).alias("confidence"),
        F.when(csv & (f(7) != ""), F.left(f(7), F.lit(10)).try_cast("date")).alias("reviewed_on"),
        F.when(csv, f(8)).alias("note"),
    )


def skipped_per_import(judged: DataFrame, reports: DataFrame) -> DataFrame:
    """Per import of ``judged``: loaded and skipped objects and the issues, beside the report's own count.

    A report may come twice under another key; the one with the smallest key
    that states a count is taken.  Lines without an import form a group of
    their own.
    """
    per = judged.groupBy("import_id").agg(
        F.count_if(F.col("code").isNull() & ~F.col("skipped")).alias("loaded_objects"),
        F.count_if(F.col("code").isNotNull()).alias("skipped_objects"),
        F.count_if(F.col("code") == "broken_quoting").alias("broken_quoting"),
        F.count_if(F.col("code") == "column_count").alias("column_count"),
        F.count_if(F.col("code") == "invalid_value").alias("invalid_value"),
    )
    stated = reports.groupBy("import_id").agg(F.min_by("skipped_objects", F.when(F.col("skipped_objects").isNotNull(), F.col("report_key"))).alias("stated_skipped"))
    return per.join(stated, "import_id", "left")
