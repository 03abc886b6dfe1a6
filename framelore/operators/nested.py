"""Flat tables from deeply nested annotation documents.

Method: a depth-first walk numbers every node of a document before and after
its children (interval labels); each node goes to the table of its type, and a
child is linked to its parent by containment of the labels.

The walk needs the JSON as written (types and nesting vary between writers),
so it runs as one Arrow-batched pass per document; nothing is shuffled for it.
Linking needs one exchange on the document key, and a document is one row, so
no group is larger than one stored body.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "doc_key bigint, type string, pre bigint, post bigint, depth int, object_id string, ordinal int, value string"
# The node types that have a table of their own.
CHILD_TYPES = ["ring", "tile", "origin"]
FIELD_TYPES = ["attribute", "lineage"]  # entries of an object's attributes, and of its provenance beside the imports
_OBJECT_FIELDS = ("kind", "category_id", "label", "polygons", "mask", "provenance", "bbox")


def _decoded(value):
    """A field may hold its JSON as a string."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _objects(holder: dict) -> list[tuple[object, dict]]:
    """The objects of a document in written order: a list, a map by id, or a single object."""
    found = _decoded(holder.get("objects"))
    if isinstance(found, list):
        return [(x.get("id"), x) for x in map(_decoded, found) if isinstance(x, dict)]
    if isinstance(found, dict):
        if any(f in found and not isinstance(found[f], dict) for f in ("id", "kind", "label", "category_id")):
            return [(found.get("id"), found)]
        return [(x.get("id", k), x) for k, x in ((k, _decoded(v)) for k, v in found.items()) if isinstance(x, dict)]
    return []


def _rings(value) -> list:
    value = _decoded(value)
    if not isinstance(value, list) or not value:
        return []
    if all(isinstance(x, (int, float)) for x in value):
        return [value]  # one ring as flat numbers
    points = [x for x in value if isinstance(x, list) and len(x) == 2 and all(isinstance(y, (int, float)) for y in x)]
    if len(points) == len(value):
        return [value]  # one ring as points
    return [x for x in map(_decoded, value) if isinstance(x, list) and x]


def _records(value, marks: tuple[str, ...]) -> list:
    """A list of records, or one record alone."""
    value = _decoded(value)
    if isinstance(value, list):
        return [x for x in map(_decoded, value) if isinstance(x, dict)]
    if isinstance(value, dict) and value:
        if any(m in value for m in marks):
            return [value]
        inner = [_decoded(x) for x in value.values()]
        return inner if all(isinstance(x, dict) for x in inner) else [value]
    return []


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


def walk_document(doc_key, body: str | None, values: bool = True) -> list[tuple]:
    """Nodes of one body in depth-first order; nothing unless the body is a JSON object."""
    if body is None:
        return []
    try:
        doc = json.loads(body)
    except (ValueError, RecursionError):
        return []
    if not isinstance(doc, dict):
        return []
    out: list[tuple] = []
    clock = [0]

    def emit(kind, depth, object_id, ordinal, value, children=()):
        pre = clock[0]
        clock[0] += 1
        at = len(out)
        out.append(None)
        for child in children:
            child()
        out[at] = (doc_key, kind, pre, clock[0], depth, object_id, ordinal, value)
        clock[0] += 1

    dump = (lambda x: json.dumps(x, ensure_ascii=False)) if values else (lambda x: None)

    def leaf(kind, object_id, ordinal, value):
        return lambda: emit(kind, 2, object_id, ordinal, dump(value))

    def one(object_id, ordinal, x):
        object_id = _text(object_id)
        mask, origin = _decoded(x.get("mask")), _decoded(x.get("provenance"))
        children = [leaf("ring", object_id, i, r) for i, r in enumerate(_rings(x.get("polygons")))]
        if isinstance(mask, dict):
            children += [leaf("tile", object_id, i, t) for i, t in enumerate(_records(mask.get("tiles"), ("counts", "x", "y")))]
        if isinstance(origin, dict):
            children += [leaf("origin", object_id, i, o) for i, o in enumerate(_records(origin.get("imports"), ("source", "name", "source_id")))]
        if values:
            attributes = _decoded(x.get("attributes"))
            if isinstance(attributes, dict):
                children += [leaf("attribute", object_id, i, pair) for i, pair in enumerate(attributes.items())]
            if isinstance(origin, dict):
                children += [leaf("lineage", object_id, i, pair) for i, pair in enumerate((k, v) for k, v in origin.items() if k != "imports")]
        flat = {k: v for k, v in x.items() if k not in ("polygons", "mask", "provenance", "attributes")}
        return lambda: emit("object", 1, object_id, ordinal, dump(flat), children)

    image = _decoded(doc.get("image"))
    holders = [doc] + ([image] if isinstance(image, dict) else [])
    items = [pair for h in holders for pair in _objects(h)]
    emit("document", 0, None, 0, None, [one(i, n, x) for n, (i, x) in enumerate(items)])
    return out


def node_table(docs: DataFrame, values: bool = True) -> DataFrame:
    """Every node of ``docs`` (doc_key, body): type, interval labels pre and post, depth, object_id, ordinal, value (JSON).

    The document is the root, its objects lie in it, and rings, tiles,
    origins, attributes and the other entries of the provenance (video, line)
    lie in their object; these last two are left out without ``values``.  Only an object's own fields count, in
    whatever form they are stored (list, map by id, single record, JSON in a
    string, flat coordinates).  Null, empty and broken bodies, and bodies that
    are not a JSON object, have no nodes; nesting beyond the parser's depth
    counts as broken.  Repeated rows repeat their nodes.  Other columns of
    ``docs`` are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for key, body in zip(batch["doc_key"], batch["body"]):
                out += walk_document(None if pd.isna(key) else int(key), body, values)
                if len(out) > 50000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return docs.select("doc_key", "body").mapInPandas(run, NODE_SCHEMA)


def link_children(nodes: DataFrame, types: list[str] = CHILD_TYPES) -> DataFrame:
    """Children with the object that contains them.

    In order of ``pre`` the containing object is the last one opened, if its
    ``post`` has not passed.  ``doc_key`` must be unique for the labels to be
    those of one body, else repeated bodies interleave.
    """
    upto = Window.partitionBy("doc_key").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("type") == "object", F.struct("pre", "post", "object_id")), ignorenulls=True).over(upto)
    return (
        nodes.where(F.col("type") != "document")
        .withColumn("parent", opened)
        .where(F.col("type").isin(types) & (F.col("parent.pre") < F.col("pre")) & (F.col("post") < F.col("parent.post")))
        .select("doc_key", F.col("parent.object_id").alias("object_id"), F.col("type").alias("child"), "ordinal", "value", "pre", "post", F.col("parent.pre").alias("parent_pre"))
    )


def flat_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables objects, rings, tiles, origins, attributes and lineage with typed columns and their links.

    ``attributes`` and ``lineage`` have a row per entry: its name, and its
    value as JSON, or as it is where it is a text.
    """
    nodes = node_table(docs)
    children = link_children(nodes, CHILD_TYPES + FIELD_TYPES)
    obj = F.from_json("value", "kind string, category_id string, label string, confidence string, source string, bbox array<double>")
    objects = nodes.where("type = 'object'").withColumn("o", obj).select("doc_key", "object_id", "ordinal", "pre", "post", "o.kind", F.col("o.category_id").try_cast("int").alias("category_id"), "o.label", "o.bbox", F.col("o.confidence").try_cast("double").alias("confidence"), "o.source")
    tile = F.from_json("value", "x int, y int, counts array<int>")
    origin = F.from_json("value", "source string, name string, source_id string")
    link = ["doc_key", "object_id", "ordinal", "parent_pre"]
    pair = F.from_json("value", "array<string>")

    def entries(kind: str) -> DataFrame:
        return children.where(F.col("child") == kind).withColumn("p", pair).select(*link, F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("value"))

    return {
        "objects": objects,
        "rings": children.where("child = 'ring'").select(*link, "value"),
        "tiles": children.where("child = 'tile'").withColumn("t", tile).select(*link, "t.x", "t.y", "t.counts"),
        "origins": children.where("child = 'origin'").withColumn("o", origin).select(*link, "o.source", "o.name", "o.source_id"),
        "attributes": entries("attribute"),
        "lineage": entries("lineage"),
    }
