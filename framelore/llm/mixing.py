"""Mixing sources to target weights.

Method: hierarchical budgeting.  Weights are propagated down a tree (domain,
source, language); what a node cannot supply is redistributed among its
siblings before its ancestors; each leaf's budget is met by a token prefix of
seeded epochs over its texts.  A prefix ends at a whole text, so it misses its
budget by part of one; what is left is handed to the source's next leaf.

Scale: the tree has one leaf per (domain, source, language), and only the
leaves' token sums reach the driver; languages and sources are read in uniform
notation, and every language outside ``LANGUAGES`` is one leaf, so their number
does not grow with the corpus.  A leaf's prefix is cut by running sums over hash
buckets, and only the one bucket in which the cut falls is put in order, so a
source with a third of all texts is never sorted in one task.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelore.llm.tokens import VOCABULARY, distinct_texts, with_tokens
from framelore.tables import blocks_for, stage

# Language codes that are leaves of their own.
LANGUAGES = ["en", "de", "es", "fr", "zh"]
# Names of languages as they are typed.
LANGUAGE_NAMES = {
    "en": ["en", "eng", "english"], "de": ["de", "deu", "ger", "german", "deutsch"], "es": ["es", "spa", "spanish", "espanol", "español"],
    "fr": ["fr", "fra", "fre", "french", "francais", "français"], "zh": ["zh", "zho", "chi", "cn", "chinese", "中文"],
}
# The domain of each source with a target; any other source is in "all".
DOMAINS = {
    "tickets": "operations", "field_reports": "operations", "import_logs": "operations", "review_notes": "review", "team_chat": "review",
    "captions": "descriptions", "event_text": "descriptions", "guidelines": "reference",
}
PER_BUCKET = 20000


def canonical_source(source: Column) -> Column:
    """Lower case, words joined by one underscore; null for blank."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(source, r"(?<=\p{Ll})(?=\p{Lu})", "_")), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(F.length(bare) > 0, bare)


def canonical_language(lang: Column) -> Column:
    """The code of a known language, "other" for all else (null included)."""
    bare = F.regexp_extract(F.lower(F.trim(lang)), r"^(\p{L}+)", 1)
    out: Column | None = None
    for code, names in LANGUAGE_NAMES.items():
        out = (F if out is None else out).when(bare.isin(names), code)
    return F.coalesce(out, F.lit("other"))


class Node:
    """A node of the budget tree; ``room`` is the most it can supply."""

    def __init__(self, name: str, weight: float = 0.0, room: float = 0.0, children: list[Node] | None = None):
        self.name, self.weight, self.children = name, weight, children or []
        self.room = sum(c.room for c in self.children) if self.children else room
        self.budget = 0.0

    def allot(self, budget: float) -> float:
        """Hands ``budget`` down; returns what neither this node nor its children can supply."""
        self.budget = min(budget, self.room)
        left, open_children = self.budget, [c for c in self.children if c.room > 0 and c.weight > 0]
        share = {id(c): 0.0 for c in self.children}
        while open_children and left > 1e-9:
            weight = sum(c.weight for c in open_children)
            for c in open_children:
                share[id(c)] += left * c.weight / weight
            left = 0.0
            for c in list(open_children):
                if share[id(c)] >= c.room * (1 - 1e-12):  # a share that is the room but for rounding takes all texts
                    left += max(0.0, share[id(c)] - c.room)
                    share[id(c)] = c.room
                    open_children.remove(c)
        short = sum(c.allot(share[id(c)]) for c in self.children)
        if self.children:
            self.budget = sum(c.budget for c in self.children)
        return max(0.0, budget - self.budget) + 0.0 * short

    def leaves(self, path: tuple = ()) -> list[tuple[tuple, float]]:
        here = (*path, self.name)
        return [(here, self.budget)] if not self.children else [x for c in self.children for x in c.leaves(here)]


def exact_total(targets: dict[str, tuple[float, int]], tokens: dict[str, int]) -> float:
    """The largest total at which every source with a share and with texts meets it."""
    weight = sum(share for s, (share, _) in targets.items() if tokens.get(s, 0) > 0 and share > 0)
    rooms = [tokens[s] * repeats * weight / share for s, (share, repeats) in targets.items() if share > 0 and tokens.get(s, 0) > 0 and repeats > 0]
    return min(rooms, default=0.0)


def budgets(leaf_tokens: dict[tuple[str, str, str], int], targets: dict[str, tuple[float, int]], total: float | None = None) -> list[tuple[str, str, str, float, int]]:
    """(domain, source, lang, budget, max_repeats) for each leaf.

    A source weighs its target share, a domain the sum of its sources, a
    language the tokens its source has in it.  Without ``total`` the largest
    total is taken at which all shares are met exactly; with a larger one,
    shortages go to siblings first, then upwards.
    """
    per_source: dict[str, int] = {}
    for (_, s, _), n in leaf_tokens.items():
        per_source[s] = per_source.get(s, 0) + n
    domains: dict[str, dict[str, list[Node]]] = {}
    for (dom, s, lang), n in sorted(leaf_tokens.items()):
        if s in targets:
            domains.setdefault(dom, {}).setdefault(s, []).append(Node(lang, float(n), float(n * targets[s][1])))
    root = Node("", children=[Node(dom, sum(targets[s][0] for s in sources), children=[Node(s, targets[s][0], children=langs) for s, langs in sources.items()]) for dom, sources in domains.items()])
    root.allot(exact_total(targets, per_source) if total is None else float(total))
    return [(dom, s, lang, b, targets[s][1]) for (_, dom, s, lang), b in root.leaves() if b > 0] if root.children else []


def scarcity(docs: DataFrame, wanted: dict[str, tuple[float, int]]) -> list[str]:
    """The target sources, the one with the fewest letters for its share first.  ``docs``: text, source (uniform)."""
    letters = {r["source"]: r["n"] for r in docs.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    return sorted(wanted, key=lambda s: ((letters.get(s) or 0) * wanted[s][1] / wanted[s][0], s))


def mix_documents(docs: DataFrame, targets: DataFrame, total: float | str | None = None, domains: dict[str, str] | None = None, vocabulary: str = VOCABULARY, seed: int = 5) -> DataFrame:
    """(doc_id, source, lang, epoch, tokens): each text as often as it is used, epochs from 0.

    A text is used at most once in an epoch and at most ``max_repeats`` times,
    whichever rows hold it: copies of one text are one text.  Where several
    sources hold it, it counts for the one that is scarcest for its share, and
    for one with a target before any without; of that source's rows the
    smallest doc_id stands for it.  Sources without a target are not used.
    ``total`` is as in ``budgets``; "all" stands for the tokens of all distinct
    texts of sources with a target.  Within a leaf the first epochs are whole,
    the last is a prefix of its seeded order; what it leaves goes to the
    source's next language, and the last rest to the texts that fit it best
    (``_prefixes``).  Null, empty and token-less texts are not used; no targets
    or no texts give no rows.
    """
    spark = docs.sparkSession
    wanted = {r["source"]: (float(r["share"]), int(r["repeats"])) for r in targets.where("target_share > 0 and max_repeats > 0").groupBy(canonical_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect() if r["source"]}
    uniform = docs.select("doc_id", "text", canonical_source(F.col("source")).alias("source"), canonical_language(F.col("lang")).alias("lang"))
    order = F.array(*[F.lit(s) for s in scarcity(uniform, wanted)]).cast("array<string>")
    place = F.coalesce(F.array_position(order, F.col("source")), F.lit(0))
    texts = stage(distinct_texts(uniform, F.when(place > 0, place).otherwise(len(wanted) + 1)), "mix-texts")
    counted = with_tokens(texts.where(F.col("source").isin(list(wanted))), vocabulary)
    names = domains or {}
    domain = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("source")] if names else F.lit("all")
    items = stage(texts.drop("text").join(counted, "text_id").where("tokens > 0").withColumn("domain", F.coalesce(domain, F.lit("all"))), "mix-items")
    leaf_tokens = {(r["domain"], r["source"], r["lang"]): r["n"] for r in items.groupBy("domain", "source", "lang").agg(F.sum("tokens").alias("n")).collect()}
    plan = budgets(leaf_tokens, wanted, sum(leaf_tokens.values()) if total == "all" else total)
    rows = []
    for dom, s, lang, budget, _ in plan:
        have = leaf_tokens[(dom, s, lang)]
        whole = int(budget // have)
        rows += [(dom, s, lang, e, float(have)) for e in range(whole)]
        if budget - whole * have > 0:
            rows.append((dom, s, lang, whole, float(budget - whole * have)))
    leaf = ["domain", "source", "lang"]
    epochs = spark.createDataFrame(rows, "domain string, source string, lang string, epoch int, quota double")
    buckets = blocks_for(items.count(), PER_BUCKET)
    drawn = (
        items.join(F.broadcast(epochs), leaf)  # leaves times epochs: fixed by the targets
        .withColumn("draw", F.xxhash64(F.lit(seed), "epoch", "text_id"))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 20), F.lit(buckets)))
    )
    by_leaf = [*leaf, "epoch"]
    sums = drawn.groupBy(*by_leaf, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*by_leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.join(sums.withColumn("before", before), [*by_leaf, "bucket"])
    names_out = ["doc_id", "source", "lang", "epoch", "tokens"]
    inside = placed.where(F.col("before") + F.col("in_bucket") <= F.col("quota"))
    border = placed.where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("in_bucket") > F.col("quota")))
    # One bucket of each of a source's leaves: at most as many as there are languages.
    cut = border.groupBy("domain", "source").applyInPandas(_prefixes, "doc_id bigint, source string, lang string, epoch int, tokens bigint")
    return inside.select(names_out).unionByName(cut)


def _prefixes(texts: pd.DataFrame) -> pd.DataFrame:
    """The buckets in which the budgets of a source's leaves end: a prefix of each in seeded order, up to the text that exceeds it.

    What a prefix leaves of its budget is carried to the next leaf; what the
    last one leaves, less than one text, is met by those texts behind the
    prefixes that bring the source closest to its budget, one after another.
    """
    leaves = [part.sort_values(["draw", "text_id"]) for _, part in sorted(texts.groupby(["lang", "epoch"]), key=lambda x: x[0])]
    carry, taken, behind = 0.0, [], []
    for k, part in enumerate(leaves):
        carry += float(part["quota"].iloc[0]) - float(part["before"].iloc[0])
        tokens = part["tokens"].tolist()
        n = 0
        while n < len(tokens) and tokens[n] <= carry:
            carry, n = carry - tokens[n], n + 1
        taken.append(set(range(n)))
        behind += [(tokens[i], k, i) for i in range(n, len(tokens))]
    behind.sort()
    while behind:
        at = bisect.bisect(behind, (carry, -1, -1))
        closest = min(range(max(0, at - 1), min(len(behind), at + 1)), key=lambda j: (abs(carry - behind[j][0]), j))
        tokens, k, i = behind[closest]
        if abs(carry - tokens) >= abs(carry):
            break
        carry -= tokens
        taken[k].add(i)
        del behind[closest]
    return pd.concat([part.iloc[sorted(chosen)] for part, chosen in zip(leaves, taken)])[["doc_id", "source", "lang", "epoch", "tokens"]]


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens used, texts used, most uses of one text, target and reached share."""
    per = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("uses"))
    per = per.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    wanted = targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # one row per target source
    return wanted.join(per, "source", "left").select(
        "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        "max_repeats", "target_share", F.when(total > 0, F.coalesce("tokens", F.lit(0)) / total).otherwise(F.lit(0.0)).alias("reached_share"),
    )
