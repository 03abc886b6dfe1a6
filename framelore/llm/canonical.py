"""Mapping freely typed values to a reference list.  Spark SQL expressions only.

Method: partition-based pigeonhole join.  A reference string that must be
found within k edits is cut into k + 1 segments; a value within k edits holds
one of them unchanged, shifted by no more than the edits allow.  Segments meet
the value's substrings by equality join on length, place and letters, built-in
levenshtein verifies, and an anti-join reports what stays unmatched.

Scale: values are made distinct before anything else, so the work follows the
number of different spellings.  Nothing pairs all values with all references,
and the list is never broadcast by a hint: AQE does so where it measures it as
small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelore.tables import stage

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = ("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοαεικνρτυ", "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHoaeiknptu")
# Letters with marks, and the bare letter.
MARKED = ("äàáâãåāăçćčèéêëēìíîïīñńňòóôõöøōřśšßùúûüūýÿžźż", "aaaaaaaaccceeeeeiiiiinnnooooooorsssuuuuuyyzzz")
# Digits typed for letters.
LEET = ("0134578", "oieastb")
# Words and marks that annotators put around a label, as patterns over the folded value.
DECORATION = [
    r"^(class|label|cls|category)\s*[=:]\s*",
    r"^cls\s*\d+\s+",
    r"^\[\s*\d+\s*\]\s*",
    r"^#?\d+\s*[:._)-]\s*(?=\p{L})",
    r"\s*#\s*\d+$",
    r"[\s_-]+v\d+$",
    r"\s*\((new|old|copy|\d+)\)$",
    r"\s*[/,;-]\s*(partial|occluded|truncated|check|unsure)$",
    r"\s+-\s+(check|todo)$",
    r"^(the|a|an)\s+",
    r"\s+(object|instance)$",
]
MAX_EDITS = 4


def fold(value: Column) -> Column:
    """Uniform letters: full-width forms, homoglyphs, marks, case; invisible characters and outer marks removed."""
    wide = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F))
    plain = "".join(chr(i) for i in range(0x21, 0x7F))
    v = F.regexp_replace(value, r"[\x{200b}-\x{200f}\x{feff}\x{ad}\p{Mn}]", "")
    v = F.regexp_replace(v, r"(\p{javaLowerCase})(\p{javaUpperCase})(?=\p{javaLowerCase})", "$1 $2")  # camelCase
    v = F.translate(F.translate(v, wide + "　", plain + " "), *HOMOGLYPHS)
    v = F.translate(F.lower(v), *MARKED)
    return F.regexp_replace(v, r"(?U)^[\s'\"<>*!?]+|[\s'\"<>*!?]+$", "")


def strip_decoration(folded: Column) -> Column:
    for _ in range(2):
        for pattern in DECORATION:
            folded = F.regexp_replace(folded, pattern, "")
    return folded


def words(folded: Column) -> Column:
    """Words with single blanks; every other separator counts as a blank."""
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def allowed_edits(length: Column) -> Column:
    """Edits within which ``pigeonhole`` looks unless told otherwise: 2 up to 7 letters, 3 up to 10, then 4."""
    return F.when(length <= 7, 2).when(length <= 10, 3).otherwise(MAX_EDITS)


def slip_edits(length: Column) -> Column:
    """The most edits that the rule of two slips in ``resolve_values`` accepts: 2 up to 5 letters, then 4 (two swaps)."""
    return F.when(length <= 5, 2).otherwise(MAX_EDITS)


def reference_forms(catalog: DataFrame) -> DataFrame:
    """(category_id, form, name): names and aliases as words; a form of two entries goes to the smaller id."""
    names = catalog.select("category_id", F.explode(F.array_union(F.array("category_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return (
        names.where("category_id is not null and name is not null")
        .select("category_id", words(fold(F.col("name"))).alias("form"), F.lower("name").alias("name"))
        .where("form <> ''")
        .groupBy("form")
        .agg(F.min(F.struct("category_id", "name")).alias("m"))
        .select("form", "m.category_id", "m.name")
    )


def _cut(rows: DataFrame, edits: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with a ``len`` to a row for each of the k + 1 nearly equal segments of a text that long: k, i, pos (from 1), size."""
    border = lambda i: F.floor(i * F.col("len") / (F.col("k") + 1)).cast("int")
    return (
        rows.withColumn("k", edits(F.col("len")))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("pos", border(F.col("i")) + 1)
        .withColumn("size", border(F.col("i") + 1) - F.col("pos") + 1)
    )


def pigeonhole(values: DataFrame, refs: DataFrame, allowed: Callable[[Column], Column] = allowed_edits, gap: int = MAX_EDITS) -> DataFrame:
    """``values`` (text) and ``refs`` (form, category_id) within the edits ``allowed`` for the form's length: text, form, category_id, edits.

    A form lies under (its length, number of the segment, segment).  A value
    asks for each length within ``gap`` (and the edits) of its own that a form
    has, with its substrings at the places where the segment can stand: with
    x letters shifted before it, x and what is left of the difference in
    length must fit into k edits together.  So the join is on length, place
    and letters, and the number of questions of a value does not depend on its
    length or on the list.  A form with fewer letters than segments has an
    empty one, which every value of about its length asks for.
    """
    forms = _cut(refs.select("form", "category_id", F.length("form").alias("len")), allowed)
    forms = forms.select("len", "i", F.substring(F.col("form"), F.col("pos"), F.col("size")).alias("seg"), "form", "category_id", "k")
    lengths = refs.select(F.length("form").alias("len")).distinct()
    near = (
        values.select("text", F.length("text").alias("tlen"))
        .withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("tlen") - gap), F.greatest(F.lit(1), F.col("tlen") + gap))))
        .join(lengths, "len", "left_semi")
    )
    longer = F.col("tlen") - F.col("len")
    first = F.greatest(F.lit(1), F.col("pos") - F.floor((F.col("k") - longer) / 2).cast("int"))
    last = F.least(F.col("tlen") - F.col("size") + 1, F.col("pos") + F.floor((F.col("k") + longer) / 2).cast("int"))
    asked = _cut(near, allowed).where(F.abs(longer) <= F.col("k")).withColumn("first", first).withColumn("last", last).where("first <= last")
    asked = asked.select("text", "len", "i", "size", F.explode(F.sequence("first", "last")).alias("at")).select("text", "len", "i", F.substring(F.col("text"), F.col("at"), F.col("size")).alias("seg")).distinct()
    return (
        asked.join(forms, ["len", "i", "seg"])
        .select("text", "form", "category_id", "k")
        .distinct()
        .withColumn("edits", F.levenshtein("text", "form"))
        .where(F.col("edits") <= F.col("k"))
        .select("text", "form", "category_id", "edits")
    )


def _forms_of_values(values: DataFrame) -> DataFrame:
    """Every way to read a value, most faithful first: (value, way, text)."""
    folded = fold(F.col("value"))
    bare = strip_decoration(folded)
    leet = lambda v: F.when(v.rlike(r"\d") & v.rlike(r"\p{L}") & v.rlike(r"\p{L}\d|\d\p{L}"), F.translate(v, *LEET))
    ways = [words(folded), words(bare), leet(words(bare)), leet(words(folded))]
    return (
        values.select("value", F.posexplode(F.array(*ways)).alias("way", "text"))
        .where("text is not null and text <> ''")
        .groupBy("value", "text")
        .agg(F.min("way").alias("way"))
    )


def resolve_values(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct ``value`` to ``category_id`` (-1: no entry) with ``how`` it was found and ``edits``.

    In this order: the same words; the same words in another order or without
    blanks; a beginning that only one entry has (at least four letters and
    half of it); the fewest edits of at most two slips (up to five letters: one),
    if one entry has them.  Between entries at equal distance the one whose
    letters are closer is taken, then the one that is closer with its marks;
    if none is, the value stays unmatched.
    Null and blank values are unmatched; an empty catalog matches nothing.
    """
    # Written once: every way to match reads them, and each read as a plan of its own would fold all values anew.
    distinct = stage(values.select("value").where("value is not null").distinct(), "canonical-values")
    refs = stage(reference_forms(catalog), "canonical-refs")
    read = stage(_forms_of_values(distinct), "canonical-forms")
    bag = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")

    exact = read.join(refs.select(F.col("form").alias("text"), "category_id"), "text").select("value", "category_id", F.lit("words").alias("how"), F.col("way").alias("cost"), F.lit(0).alias("edits"))
    order = (
        read.withColumn("bag", bag(F.col("text")))
        .join(refs.select(bag(F.col("form")).alias("bag"), "category_id"), "bag")
        .select("value", "category_id", F.lit("order").alias("how"), (F.col("way") + 10).alias("cost"), F.lit(0).alias("edits"))
    )
    joined = (
        read.withColumn("tight", tight(F.col("text")))
        .join(refs.select(tight(F.col("form")).alias("tight"), "category_id"), "tight")
        .select("value", "category_id", F.lit("blanks").alias("how"), (F.col("way") + 20).alias("cost"), F.lit(0).alias("edits"))
    )
    # Beginnings: every proper prefix of a form that only one entry has.
    n = F.length("form")
    prefixes = (
        refs.select("category_id", "form", F.explode(F.sequence(F.greatest(F.lit(4), F.ceil(n / 2).cast("int")), F.greatest(F.lit(4), n))).alias("m"))
        .where(F.col("m") < F.length("form"))
        .select("category_id", F.trim(F.substring(F.col("form"), F.lit(1), F.col("m"))).alias("text"))
        .groupBy("text")
        .agg(F.min("category_id").alias("category_id"), F.max("category_id").alias("other"))
        .where("category_id = other")
    )
    cut = read.join(prefixes.drop("other"), "text").select("value", "category_id", F.lit("beginning").alias("how"), (F.col("way") + 30).alias("cost"), F.lit(0).alias("edits"))
    sure = exact.unionByName(order).unionByName(joined).unionByName(cut).groupBy("value").agg(F.min(F.struct("cost", "category_id", "how", "edits")).alias("best"))
    settled = stage(sure.select("value", "best.category_id", "best.how", "best.edits"), "canonical-settled")

    open_values = stage(read.join(settled.select("value"), "value", "left_anti"), "canonical-open")
    # Two slips change the length by two at most.
    near = open_values.join(pigeonhole(open_values.select("text").distinct(), refs, slip_edits, gap=2), "text").withColumn("swap", F.levenshtein(letters(F.col("text")), letters(F.col("form"))))
    # At most two slips, of which a swap of neighbours is one but costs two edits: what
    # swaps leave is seen from the letters in order, where another letter costs two.
    # ``slip_edits`` lets every pair through that this rule can accept, so the rule alone decides.
    near = near.where(
        F.when(F.length("form") <= 5, (F.col("edits") <= 1) | (F.col("edits") == 2) & (F.col("swap") == 0))
        .otherwise((F.col("edits") <= 2) | (F.col("edits") == 3) & (F.col("swap") <= 2) | (F.col("edits") == 4) & (F.col("swap") == 0))
    )
    # What the folding made equal may still tell entries apart: marks count last.
    near = near.join(refs.select("form", "name"), "form").withColumn("marks", F.levenshtein(F.lower("value"), F.col("name")))
    per_entry = near.groupBy("value", "category_id").agg(F.min(F.struct("edits", "swap", "marks")).alias("d"))
    by_value = Window.partitionBy("value").orderBy("d")
    ranked = per_entry.withColumn("place", F.rank().over(by_value)).where("place = 1").groupBy("value").agg(F.min("category_id").alias("category_id"), F.count("*").alias("ties"), F.min("d.edits").alias("edits"))
    fuzzy = ranked.where("ties = 1").select("value", "category_id", F.lit("edits").alias("how"), "edits")
    found = stage(settled.unionByName(fuzzy.select("value", "category_id", "how", "edits")), "canonical-found")
    missing = distinct.join(found.select("value"), "value", "left_anti").select("value", F.lit(-1).alias("category_id"), F.lit("unmatched").alias("how"), F.lit(None).cast("int").alias("edits"))
    return found.select("value", F.col("category_id").cast("int").alias("category_id"), "how", F.col("edits").cast("int").alias("edits")).unionByName(missing)


def meant_values(annotations: DataFrame, sources: DataFrame) -> DataFrame:
    """``annotations`` (ann_key, label, import_source_id) with ``value``: the mapping's target where the label is one of its source's keys, else the label."""
    mapping = (
        sources.where("source_id is not null and category_mapping is not null")
        .select(F.col("source_id").alias("import_source_id"), F.explode("category_mapping").alias("_key", "_target"))
        .groupBy("import_source_id", "_key")
        .agg(F.min("_target").alias("_target"))
    )
    return (
        annotations.withColumn("_key", F.trim("label"))
        .join(mapping, ["import_source_id", "_key"], "left")
        .withColumn("value", F.coalesce("_target", "label"))
        .drop("_key", "_target")
    )


def resolve_labels(annotations: DataFrame, sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """(ann_key, label, value, category_id, how) of every row whose label is neither null nor blank."""
    rows = meant_values(annotations.select("ann_key", "label", "import_source_id").where(F.col("label").rlike(r"(?U)\S")), sources)
    # Map-side combine keeps a label with a third of all rows to one row per task.
    resolved = resolve_values(rows.select("value").distinct(), catalog)
    return rows.join(resolved, "value").select("ann_key", "label", "value", "category_id", "how")


def found_labels(annotations: DataFrame, sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """(ann_key, category_id) of every row whose label is not letter for letter a category name; -1 without entry."""
    exact = catalog.where("category_name is not null").select(F.col("category_name").alias("label")).distinct()
    free = annotations.join(exact, "label", "left_anti")
    return resolve_labels(free, sources, catalog).select("ann_key", "category_id")
