"""Records of the evaluation splits that also lie in the training split.

Method: the evaluation records give passages: their file, their digest, and
the words of their name that a shot consists of.  Sharded Aho-Corasick
automata over the words of the passages scan the texts of all records; the
matched intervals are merged, and a text holds a passage where they cover all
of it and nothing but words lies between them.  Rows that hold a passage of
another row are linked; since a case may be linked through other rows, the
passages of rows that were reached scan all texts in turn until no new ones
come.  All links come from the automata; components over them are the classes,
and the intervals that training texts share give the coverage.

Scale: a passage goes to the shard of its last word, a text to the shards of
every word a passage can end with (one or two), so no text goes to all shards.
Texts are made distinct before they are sent: a digest shared by a third of
all rows is one text, and so is a shot in many folders.  Where one word still
has very many texts they are spread over several shards, each with that word's
passages.  The number of shards follows the number of texts.  Pairs are formed
by one equality join at the end, which AQE splits where a class is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelore.llm import keys
from framelore.llm.graph import components
from framelore.tables import blocks_for, stage, stage_counted, unstage

PER_SHARD = 20000
SEP = "\x1f"


def _id(text) -> F.Column:
    """16 bytes that stand for a text in joins."""
    return F.unhex(F.md5(text))


def passages(images: DataFrame) -> DataFrame:
    """Rows with their split (uniform), source, texts and passages.

    ``texts``: up to three (file, name, digest), in which passages of other
    rows are looked for.  ``own``: up to three passages that stand for the
    row: its file, its digest, and the shot its name tells.  A row with none
    of them (no path, no digest) is the same picture as no other row.
    """
    part = lambda name, value: F.concat(F.lit(name + ":"), value)  # noqa: E731  (null where the value is)
    named = images.select(
        "image_key",
        keys.canonical_split(F.col("split")).alias("split"),
        F.coalesce("source_id", F.split_part(F.col("path"), F.lit("/"), F.lit(1))).alias("source"),
        keys.file_key(F.col("path")).alias("_file"),
        keys.digest(F.col("sha256")).alias("_digest"),
    ).withColumn("_name", keys.name_text(F.col("_file")))
    named = named.withColumn("_shot", keys.shot_passage(F.col("_name")))
    text = lambda value, routes: F.when(value.isNotNull(), F.struct(_id(value).alias("id"), value.alias("text"), routes.alias("routes")))
    passage = lambda value, last: F.when(value.isNotNull(), F.struct(_id(value).alias("id"), value.alias("text"), last.alias("route")))
    file, digest, name, shot = part("file", F.col("_file")), part("digest", F.col("_digest")), part("name", F.col("_name")), part("shot", F.col("_shot"))
    anchors = F.transform(F.regexp_extract_all(F.col("_name"), F.lit(keys.ANCHOR), F.lit(0)), lambda word: F.xxhash64(word))
    return named.select(
        "image_key",
        "split",
        "source",
        F.array_compact(F.array(text(file, F.array(F.xxhash64(file))), text(digest, F.array(F.xxhash64(digest))), text(name, anchors))).alias("texts"),
        F.array_compact(F.array(passage(file, F.xxhash64(file)), passage(digest, F.xxhash64(digest)), passage(shot, F.xxhash64(F.element_at(F.split(shot, "[ :]"), -1))))).alias("own"),
    )


HIT_SCHEMA = "passage binary, text binary, start int, stop int, whole int"
_BETWEEN = re.compile(r"(?:_[^\W\d_]+[0-9]*)*")


def _words(passage: str) -> list[str]:
    """The words of a passage as the automaton looks for them, with their borders."""
    kind, _, body = passage.partition(":")
    return [f"_{w}_" for w in body.split(" ")] if kind == "shot" else [SEP + passage + SEP]


def _matched(text: str, words: list[str], ends: dict[str, list[int]]) -> list[tuple[int, int]] | None:
    """Intervals of the words of a passage, the last one first found, each next one closest before; None if one is missing.

    Between two words only words that begin with a letter may lie, and none
    that names another camera, day or moment, so the interval of every word is
    the nearest one.
    """
    for last in ends[words[-1]]:
        spans, ok = [(last - len(words[-1]) + 1, last + 1)], True
        for word in reversed(words[:-1]):
            before = spans[-1][0]  # the border is shared by both words
            near = max((e for e in ends.get(word, ()) if e <= before), default=None)
            if near is None or not _BETWEEN.fullmatch(text[near:before]) or "_cam" in text[near:before]:
                ok = False
                break
            spans.append((near - len(word) + 1, near + 1))
        if ok:
            return spans
    return None


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shard: its passages first, then the texts that can hold them."""
    import ahocorasick

    automaton, by_last, open_for = ahocorasick.Automaton(), {}, True
    out: list[tuple] = []
    for batch in rows:
        for kind, key, text in zip(batch["kind"].tolist(), batch["id"].tolist(), batch["text"].tolist()):
            if kind == 0:
                words = _words(text)
                for w in words:
                    automaton.add_word(w, w)
                by_last.setdefault(words[-1], []).append((key, words))
                continue
            if open_for:
                if len(automaton):
                    automaton.make_automaton()
                open_for = False
            if not len(automaton):
                continue
            name = text[5:] if text.startswith("name:") else SEP + text + SEP
            ends: dict[str, list[int]] = {}
            for end, word in automaton.iter(name):
                ends.setdefault(word, []).append(end)
            for last in ends.keys() & by_last.keys():
                for passage, words in by_last[last]:
                    spans = _matched(name, words, ends)
                    if spans:
                        out += [(passage, key, a, b, len(name)) for a, b in _merged(spans)]
        if len(out) > 20000:
            yield pd.DataFrame(out, columns=["passage", "text", "start", "stop", "whole"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["passage", "text", "start", "stop", "whole"])


def _spread(texts: DataFrame, per_shard: int) -> DataFrame:
    """Words with more texts than a shard should have, and over how many shards these are spread."""
    return texts.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > per_shard).select("route", F.ceil(F.col("n") / per_shard).cast("int").alias("spread"))


def scan(wanted: DataFrame, texts: DataFrame, hot: DataFrame, shards: int) -> DataFrame:
    """``wanted`` (id, text, route) found in ``texts`` (id, text, route): passage, text, and the matched intervals."""
    over = F.coalesce("spread", F.lit(1))
    given = wanted.join(hot, "route", "left").select(F.lit(0).alias("kind"), "id", "text", "route", F.explode(F.sequence(F.lit(0), over - 1)).alias("part"))
    sought = texts.join(hot, "route", "left").select(F.lit(1).alias("kind"), "id", "text", "route", F.pmod(F.hash("id"), over).alias("part"))
    return given.unionByName(sought).repartition(shards, "route", "part").sortWithinPartitions("kind").select("kind", "id", "text").mapInPandas(_scan, HIT_SCHEMA)


def found_passages(records: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """(passage, text, start, stop, whole) of every passage of an evaluation record, or of a row reached from one, in every text that holds it."""
    spark = records.sparkSession
    texts = stage(records.select(F.explode("texts").alias("t")).select("t.*").distinct().select("id", "text", F.explode("routes").alias("route")), "overlap-texts")
    hot = stage(_spread(texts, per_shard), "overlap-hot")
    own = records.select(F.explode("own").alias("p")).select("p.*")
    beside = records.select(F.explode("texts.id").alias("text"), F.col("own.id").alias("own"))
    wanted, count = stage_counted(records.where(F.col("split").isin("val", "test")).select(F.explode("own").alias("p")).select("p.*").distinct(), "overlap-wanted")
    found, seen = None, None
    while count:
        # Only texts that can end a wanted passage move; the number of shards follows them.
        near, size = stage_counted(texts.join(wanted.select("route").distinct(), "route", "left_semi"), "overlap-near")
        shards = blocks_for(size + count, per_shard, int(spark.conf.get("spark.sql.shuffle.partitions")))
        hits = stage(scan(wanted, near, hot, shards), "overlap-hits")
        unstage(near)
        found = hits if found is None else found.unionByName(hits)
        seen = wanted.select("id") if seen is None else seen.unionByName(wanted.select("id"))
        reached = beside.join(hits.select("text").distinct(), "text", "left_semi").select(F.explode("own").alias("id")).distinct().join(seen, "id", "left_anti")
        reached, new = stage_counted(reached, "overlap-reached")
        if not new:
            break
        wanted, count = stage_counted(own.join(reached, "id", "left_semi").distinct(), "overlap-wanted")
    unstage(texts)
    return found if found is not None else spark.createDataFrame([], HIT_SCHEMA)


def classes(records: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that hold a found passage, with ``class_id``: linked by a passage, directly or through other rows.

    A row's first text stands for it: all rows with that text are in its class
    and its passages link it to others.  Only passages beside several first
    texts make edges.
    """
    held = found.select("text", "passage").distinct()
    firsts = records.where(F.size("texts") > 0).select(F.get("texts.id", F.lit(0)).alias("first"), F.explode("texts.id").alias("text"))
    beside = stage(firsts.join(held, "text").select("first", "passage").distinct(), "overlap-held")
    shared = beside.groupBy("passage").agg(F.count("*").alias("n")).where("n > 1").select("passage")
    roots = components(beside.join(shared, "passage", "left_semi").select(F.col("first").alias("a"), F.col("passage").alias("b")), "overlap")
    named = beside.select("first").distinct().join(roots.withColumnRenamed("node", "first"), "first", "left").select("first", F.coalesce("root", "first").alias("class_id"))
    return records.withColumn("first", F.get("texts.id", F.lit(0))).join(named, "first").drop("first")


def cross_split(images: DataFrame, per_shard: int = PER_SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All records, the passages found, and the rows of evaluation classes with their class."""
    records = stage(passages(images), "overlap-records")
    found = found_passages(records, per_shard)
    return records, found, stage(classes(records, found).select("image_key", "split", "source", "class_id"), "overlap-classes")


def overlap_pairs(images: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """Every pair of a training row and a val or test row that hold the same picture, smaller key first.

    Same picture: same file of one source, same shot, same digest, also through
    other rows of any split.  Split names and digests may be spelled in any
    way; digests of no picture, null paths and null digests link nothing.
    Repeated keys give a pair once, null keys none; an empty table gives no rows.
    """
    _, _, members = cross_split(images, per_shard)
    keyed = members.where("image_key is not null").select("image_key", "split", "class_id").distinct()
    train = keyed.where("split = 'train'").select("image_key", "class_id").distinct()
    evaluation = keyed.where(F.col("split").isin("val", "test")).select(F.col("image_key").alias("other"), "class_id").distinct()
    pairs = train.join(evaluation, "class_id").where("image_key <> other").select(F.least("image_key", "other").alias("image_key_a"), F.greatest("image_key", "other").alias("image_key_b"))
    return pairs.distinct() if _repeats(keyed) else pairs


def _repeats(keyed: DataFrame) -> bool:
    """Whether a key has more than one row; only then can a pair come twice."""
    return keyed.groupBy("image_key").count().where("count > 1").limit(1).count() > 0


def overlap_classes(images: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """(image_key, split, source, class_id, links): each training, val and test row of a class that holds both sides, and how many rows of the other side it meets.

    One row per record, however large the class: what ``overlap_pairs`` writes
    out in pairs.
    """
    _, _, members = cross_split(images, per_shard)
    is_train, is_evaluation = F.col("split") == "train", F.col("split").isin("val", "test")
    sizes = members.groupBy("class_id").agg(F.count_if(is_train).alias("_train"), F.count_if(is_evaluation).alias("_evaluation")).where("_train > 0 and _evaluation > 0")
    return members.where(is_train | is_evaluation).join(sizes, "class_id").select("image_key", "split", "source", F.lower(F.hex("class_id")).alias("class_id"), F.when(is_train, F.col("_evaluation")).otherwise(F.col("_train")).alias("links"))


def coverage(images: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """Per evaluation record: length of its texts, characters covered by passages that training texts hold too, their share, and whether it is ``linked`` to train.

    The intervals of all such passages in one text are merged before they are
    added up.  ``linked`` is true where the record's class holds a training
    row, as ``overlap_report`` counts it: a record may meet train only through
    other rows and have nothing of its own covered.
    """
    records, found, members = cross_split(images, per_shard)
    found = stage(found, "overlap-found")
    of_train = records.where("split = 'train'").select(F.explode("texts.id").alias("text")).distinct()
    shared = found.join(of_train, "text", "left_semi").select("passage").distinct()
    spans = found.join(shared, "passage", "left_semi").select("text", "start", "stop").distinct()
    in_text = Window.partitionBy("text").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)  # a text has at most as many spans as letters
    covered = spans.withColumn("done", F.coalesce(F.max("stop").over(in_text), F.lit(0))).groupBy("text").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "done"))).alias("covered"))
    linked = members.where("split = 'train'").select("class_id").distinct().withColumn("linked", F.lit(True))
    of_class = members.where(F.col("split").isin("val", "test")).join(linked, "class_id").select("image_key").distinct().withColumn("linked", F.lit(True))
    rows = records.where(F.col("split").isin("val", "test")).select("image_key", "split", "source", F.explode_outer("texts").alias("t")).select("image_key", "split", "source", F.col("t.id").alias("text"), F.when(F.col("t.text").startswith("name:"), F.length("t.text") - 5).otherwise(F.length("t.text") + 2).alias("n"))
    return (
        rows.join(covered, "text", "left")
        .groupBy("image_key", "split", "source")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
        .join(of_class, "image_key", "left")
        .withColumn("linked", F.coalesce("linked", F.lit(False)))
        .withColumn("share", F.when(F.col("length") > 0, F.col("covered") / F.col("length")).otherwise(F.lit(0.0)))
    )


def overlap_report(images: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """Per evaluation split and source: records, those also in train, and the training records they meet."""
    records, _, members = cross_split(images, per_shard)
    per_class = members.where("split = 'train'").groupBy("class_id").agg(F.count("*").alias("train_rows"))
    met = members.where(F.col("split").isin("val", "test")).join(per_class, "class_id").groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.sum("train_rows").alias("pairs"))
    everyone = records.where(F.col("split").isin("val", "test")).groupBy("split", "source").agg(F.count("*").alias("records"))
    same = everyone["split"].eqNullSafe(met["split"]) & everyone["source"].eqNullSafe(met["source"])
    return everyone.join(met, same, "left").select(everyone["split"], everyone["source"], "records", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
