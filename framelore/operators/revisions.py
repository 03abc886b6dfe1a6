"""Revisions in force, snapshots, merging of imports, histories and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelore.operators.ranges import within

# Layers from the strongest to the weakest, the status each gives, and what a policy accepts.
LAYERS = ["annotations", "suggestions", "revisions"]
LAYER_STATUS = {"annotations": "human_reviewed", "suggestions": "ai_suggestion", "revisions": "ai_suggestion"}
DRAFTS = "ai_drafts"
POLICIES = {
    "reviewed": ["human_reviewed", "final_reviewed"],
    "reviewed_or_ai": ["human_reviewed", "final_reviewed", "ai_suggestion"],
    "all_annotated": ["human_reviewed", "final_reviewed", "ai_suggestion", "imported_coarse"],
}
HUMAN = ["human_reviewed", "final_reviewed"]
SPLITS = ["train", "val", "test", "unspecified"]
TASK_KINDS = {"detection": ["bbox"], "instance_segmentation": ["polygon", "mask"]}


def current_documents(docs: DataFrame) -> DataFrame:
    """The newest document per picture and layer: doc_key, image_key, layer, revision, and digest and base_digest where ``docs`` has them.

    By revision, then save time (unknown is earliest), then key; an aggregate, so a picture with
    very many saves is reduced before it is shuffled.
    """
    extra = [c for c in ("digest", "base_digest") if c in docs.columns]
    newest = F.max(F.struct("revision", "saved_at", "doc_key", *extra))
    return docs.where("image_key is not null and layer is not null").groupBy("image_key", "layer").agg(newest.alias("m")).select("image_key", "layer", "m.revision", "m.doc_key", *[f"m.{c}" for c in extra])


def effective_revisions(images: DataFrame, docs: DataFrame, include_drafts: bool = True) -> DataFrame:
    """What is in force per picture: image_key, layer, doc_key, status.

    Order: a draft whose base is what is in force without it, a human
    document (an empty one too), a suggestion, a pilot revision, the import's
    own status, unreviewed.

    With ``digest`` (of the document, see ``document_digest``) and
    ``base_digest`` (of what a draft was made on) in ``docs`` a draft is valid
    if its base is, letter for letter, what is in force; the digest of an
    import's own state may be given as ``digest`` in ``images``, and a draft
    without a base is never valid.  Without these columns a draft's base is
    the revision before its own.
    """
    now = current_documents(docs)
    by_digest = {"digest", "base_digest"} <= set(docs.columns)
    digest = F.col("digest") if by_digest else F.lit(None).cast("string")
    own = F.col("digest") if by_digest and "digest" in images.columns else F.lit(None).cast("string")
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    base = now.where(F.col("layer").isin(LAYERS)).groupBy("image_key").agg(F.min_by(F.struct("layer", "doc_key", "revision", digest.alias("digest")), rank).alias("b"))
    status = F.create_map(*[F.lit(x) for pair in LAYER_STATUS.items() for x in pair])
    out = images.select("image_key", F.col("status").alias("_import"), own.alias("_own")).join(base, "image_key", "left")
    in_force = F.when(F.col("b").isNotNull(), F.col("b.digest")).otherwise(F.col("_own")).alias("_digest")
    out = out.select("image_key", F.coalesce("b.layer", F.lit("import")).alias("layer"), F.col("b.doc_key").alias("doc_key"), F.coalesce("b.revision", F.lit(0)).alias("revision"), F.coalesce(status[F.col("b.layer")], "_import", F.lit("unreviewed")).alias("status"), in_force)
    if not include_drafts:
        return out.drop("_digest")
    made_on = F.col("base_digest") if by_digest else (F.col("revision") - 1)
    drafts = now.where(F.col("layer") == DRAFTS).select("image_key", F.col("doc_key").alias("_draft"), made_on.alias("_base"))
    valid = F.coalesce(F.col("_draft").isNotNull() & (F.col("_base") == (F.col("_digest") if by_digest else F.col("revision"))), F.lit(False))
    return out.join(drafts, "image_key", "left").select(
        "image_key", F.when(valid, DRAFTS).otherwise(F.col("layer")).alias("layer"), F.when(valid, F.col("_draft")).otherwise(F.col("doc_key")).alias("doc_key"), "revision", F.when(valid, "ai_suggestion").otherwise(F.col("status")).alias("status")
    )


def snapshot(images: DataFrame, docs: DataFrame, policy: str, splits: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, skipped) pictures under a policy and, if given, a list of splits; unreviewed is never selected."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    chosen = images if not splits else images.where(F.col("split").isin(splits))
    state = effective_revisions(chosen, docs, include_drafts=policy != "reviewed")
    taken = F.col("status").isin(POLICIES[policy])
    return state.where(taken), state.where(~F.coalesce(taken, F.lit(False)))


def merge_import(existing: DataFrame, incoming: DataFrame, policy: str | Column) -> DataFrame:
    """The plan of an import: path, action (add, keep_existing, update_coarse, error), split and status after it.

    ``existing`` and ``incoming`` (path, ord, status, split); of incoming rows
    with one path the first is the picture, later ones meet it as existing.
    ``update_coarse`` becomes ``keep_existing`` for unreviewed input and for
    pictures a person or a model has worked on.  The existing split stays.
    """
    head = incoming.groupBy("path").agg(F.min(F.struct("ord", "status", "split")).alias("h"), F.count("*").alias("rows"))
    old = existing.groupBy("path").agg(F.min(F.struct("ord", "status", "split")).alias("e"))
    worked = F.col("e.status").isin(*HUMAN, "ai_suggestion")
    wish = F.lit(policy) if isinstance(policy, str) else policy
    demoted = (wish == "update_coarse") & ((F.col("h.status") == "unreviewed") | F.coalesce(worked, F.lit(False)))
    action = F.when(F.col("h").isNull(), "untouched").when(F.col("e").isNull(), "add").when(demoted, "keep_existing").otherwise(wish)
    joined = old.join(head, "path", "full_outer").withColumn("action", action)
    return joined.select(
        "path", "action", F.coalesce("e.split", "h.split").alias("split"),
        F.when(F.col("action") == "add", F.col("h.status")).when(F.col("action") == "update_coarse", "imported_coarse").otherwise(F.col("e.status")).alias("status"),
    )


def import_summary(plan: DataFrame) -> DataFrame:
    """One row: pictures added, updated and kept, and whether the import may be committed."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(n("add").alias("added"), n("update_coarse").alias("updated"), n("keep_existing").alias("skipped"), (n("error") == 0).alias("commit_allowed"))


def split_counts(images: DataFrame) -> DataFrame:
    """Pictures per split over the fixed splits, zeros included; other names are not counted."""
    names = images.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    per = images.groupBy("split").agg(F.count("*").alias("n"))
    return names.join(per, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("images"))


def violations(images: DataFrame, annotations: DataFrame, names: DataFrame, sources: DataFrame, task: str = "instance_segmentation") -> DataFrame:
    """Counts of broken constraints of a dataset: rule, rows.

    Paths and source ids unique, sources and pictures known, object ids unique
    within their picture, label in the catalog, kind fit for the task, box
    inside the picture.
    """
    from framelore.operators.boxes import box_columns

    count = lambda df, rule: df.agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows")
    x1, y1, x2, y2 = box_columns(F.col("bbox"))
    sized = annotations.join(images.select("image_key", "width", "height"), "image_key")
    outside = (x1 < 0) | (y1 < 0) | (x2 > F.col("width")) | (y2 > F.col("height"))
    parts = [
        count(images.where("path is not null").groupBy("path").count().where("count > 1"), "duplicate_path"),
        count(sources.where("source_id is not null").groupBy("source_id").count().where("count > 1"), "duplicate_source"),
        count(images.where("source_id is not null").join(sources, "source_id", "left_anti"), "unknown_source"),
        count(annotations.where("image_key is not null").join(images, "image_key", "left_anti"), "unknown_image"),
        count(annotations.where("image_key is not null").groupBy("image_key", "object_id").count().where("count > 1"), "duplicate_object"),
        count(annotations.where("label is not null").join(names.withColumnRenamed("category_name", "label"), "label", "left_anti"), "unknown_label"),
        count(annotations.where(~F.col("kind").isin(TASK_KINDS[task])), "kind_not_allowed"),
        count(sized.where(outside), "outside_image"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def revision_chain(docs: DataFrame) -> DataFrame:
    """Documents of a picture and layer as a chain: doc_key, parent (the revision saved before) and depth from the first."""
    w = Window.partitionBy("image_key", "layer").orderBy("revision", "saved_at", "doc_key")
    rows = docs.where("image_key is not null and layer is not null")
    return rows.select("doc_key", F.lag("doc_key").over(w).alias("parent"), (F.row_number().over(w) - 1).alias("depth"))


def new_suggestions(suggestions: DataFrame, points: DataFrame, ranges: DataFrame, names: DataFrame, images: DataFrame) -> DataFrame:
    """Model results that may be shown: known label, box inside the picture, frame neither a protected point nor in a protected range.

    suggestions (key, entity, frame, label, x1, y1, x2, y2), points (entity,
    frame), ranges (entity, first, last), images (entity, width, height).
    """
    known = suggestions.join(names.select(F.col("category_name").alias("label")).distinct(), "label", "left_semi")
    inside = known.join(images, "entity").where("x1 >= 0 and y1 >= 0 and x2 <= width and y2 <= height and x2 > x1 and y2 > y1")
    free = inside.join(points.select("entity", "frame").distinct(), ["entity", "frame"], "left_anti")
    held = within(free, ranges, "entity", "frame", "first", "last").select("key").distinct()
    return free.join(held, "key", "left_anti").select(suggestions.columns)


def review_suggestions(items: DataFrame, decisions: DataFrame, bases: DataFrame) -> DataFrame:
    """Decisions on suggestions applied: every item with its status after it and the ``outcome``.

    ``items`` (entity, item_id, status, base, value digest as ``value``),
    ``decisions`` (entity, item_id, action accept or reject), ``bases`` (entity,
    base, values: the current base and the digests in force).  Outcomes:
    accepted, rejected; unchanged where nothing is decided or the item was
    decided before, so a repeated decision is harmless; already_there where
    the base has moved but holds the value; conflict where it has moved and
    does not (the item stays pending).  Of several decisions on one item
    rejecting wins.  A decision on an item that does not exist is a row with
    the outcome unknown_item.
    """
    asked = decisions.groupBy("entity", "item_id").agg(F.max("action").alias("action"))
    rows = items.withColumn("_here", F.lit(True)).join(asked, ["entity", "item_id"], "full_outer").join(bases.withColumnRenamed("base", "_now").withColumnRenamed("values", "_values"), "entity", "left")
    moved = ~F.col("base").eqNullSafe(F.col("_now"))
    outcome = (
        F.when(F.col("_here").isNull(), "unknown_item").when(F.col("action").isNull() | (F.col("status") != "pending"), "unchanged").when(F.col("action") == "reject", "rejected")
        .when(moved & F.coalesce(F.array_contains("_values", F.col("value")), F.lit(False)), "already_there").when(moved, "conflict").otherwise("accepted")
    )
    done = rows.withColumn("outcome", outcome)
    status = F.when(F.col("outcome").isin("accepted", "already_there"), "accepted").when(F.col("outcome") == "rejected", "rejected").otherwise(F.col("status"))
    return done.select("entity", "item_id", status.alias("status"), "outcome")
