"""Filling containers of fixed capacity with texts.

Method: grouping genetic algorithm.  A solution is a list of bins; crossover
injects whole well-filled bins of one parent into the other, takes out the
bins that hold a document twice, and fits the displaced documents again: first
by dominance (documents of a bin change places with displaced ones that fill
it better), then by best fit.  Islands evolve apart and their elite migrates
to the next island.

Scale: documents are hashed into blocks of about ``PER_BLOCK`` items, each an
instance of its own; a block fits a task at any corpus size.  A block whose
best-fit-decreasing seed has as few bins as the sum of its sizes allows is
solved, so only the others are sent to the islands, and a block leaves them
once it reaches that bound.  Each block leaves at most a few underfilled bins;
their documents are packed once more across blocks, so that what is lost does
not grow with the number of blocks.
"""

from __future__ import annotations

import bisect
import json
import random
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.llm.tokens import VOCABULARY, with_tokens
from framelore.tables import blocks_for, stage

CAPACITY = 2048
PER_BLOCK = 1500


def best_fit(order: list[int], sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts items into the fullest bin that still takes them, opening bins as needed."""
    loads = [sum(sizes[i] for i in b) for b in bins]
    room = sorted((capacity - load, k) for k, load in enumerate(loads))
    for item in order:
        need = sizes[item]
        at = bisect.bisect_left(room, (need, -1))
        if at == len(room):
            bins.append([item])
            bisect.insort(room, (capacity - need, len(bins) - 1))
        else:
            space, k = room.pop(at)
            bins[k].append(item)
            bisect.insort(room, (space - need, k))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; of equally many, the more uneven filling leaves more usable room."""
    return (-len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins))


def dominate(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int, rnd: random.Random) -> list[int]:
    """Up to two documents of a bin give way to up to two loose ones that fill it better; returns what is loose then.

    What goes in is larger than what comes out, so the loose documents get
    smaller and easier to fit.
    """
    loose = sorted(loose, key=lambda i: sizes[i])
    for k in rnd.sample(range(len(bins)), len(bins)):
        if not loose:
            break
        members = bins[k]
        room = capacity - sum(sizes[i] for i in members)
        if not room:
            continue
        best, swap = 0, None
        outs = [(), *((i,) for i in members), *combinations(members, 2)]
        values = [sizes[i] for i in loose]
        for out in outs:
            gone = sum(sizes[i] for i in out)
            most = gone + room
            at = bisect.bisect_right(values, most) - 1
            if at >= 0 and values[at] - gone > best:
                best, swap = values[at] - gone, (out, (loose[at],))
            low, high = 0, len(loose) - 1
            while low < high:
                both = values[low] + values[high]
                if both > most:
                    high -= 1
                    continue
                if both - gone > best:
                    best, swap = both - gone, (out, (loose[low], loose[high]))
                low += 1
            if best == room:
                break
        if swap:
            out, into = swap
            bins[k] = [i for i in members if i not in out] + list(into)
            loose = sorted([i for i in loose if i not in into] + list(out), key=lambda i: sizes[i])
    return loose


def refit(loose: list[int], bins: list[list[int]], sizes: list[int], capacity: int, rnd: random.Random) -> list[list[int]]:
    """Loose documents into ``bins``: by dominance, then the largest first by best fit."""
    loose = dominate(bins, loose, sizes, capacity, rnd)
    return best_fit(sorted(loose, key=lambda i: -sizes[i]), sizes, bins, capacity)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rnd: random.Random) -> list[list[int]]:
    """Well-filled bins of ``b`` enter ``a``; bins of ``a`` that clash go, and their other documents are fitted again."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x) * rnd.uniform(0.97, 1.0))
    count = max(1, int(len(full) * rnd.uniform(0.2, 0.6)))
    injected = [list(x) for x in full[:count]]
    inside = {i for x in injected for i in x}
    kept, displaced = injected, []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    return refit(displaced, kept, sizes, capacity, rnd)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rnd: random.Random) -> list[list[int]]:
    """The emptiest bin and a few others are taken apart and fitted again."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    out = {order[0], *rnd.sample(range(len(bins)), min(len(bins), max(2, len(bins) // 12)))}
    loose = [i for k in out for i in bins[k]]
    return refit(loose, [list(b) for k, b in enumerate(bins) if k not in out], sizes, capacity, rnd)


def least_bins(sizes: list[int], capacity: int) -> int:
    """The bound that no packing beats."""
    return -(-sum(sizes) // capacity)


def seed_bins(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing."""
    return best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, [], capacity)


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], generations: int, rnd: random.Random, want: int = 10) -> list[list[list[int]]]:
    """One epoch of an island.  The population is filled up by first fit in random order; the epoch ends early at the bound."""
    least = least_bins(sizes, capacity)
    while len(population) < want:
        population.append(best_fit(rnd.sample(range(len(sizes)), len(sizes)), sizes, [], capacity))
    rated = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), reverse=True)
    count = len(rated)
    for _ in range(generations):
        if -rated[0][0][0] <= least:
            break
        a, b = min(rnd.sample(range(len(rated)), 2)), rnd.randrange(len(rated))
        child = crossover(rated[a][2], rated[b][2], sizes, capacity, rnd) if a != b else mutate(rated[a][2], sizes, capacity, rnd)
        if rnd.random() < 0.5:
            child = mutate(child, sizes, capacity, rnd)
        count += 1
        rank = fitness(child, sizes, capacity)
        if any(rank == r[0] for r in rated):  # the same filling again would crowd out the others
            continue
        rated = sorted([*rated, (rank, count, child)], reverse=True)[:want]
    return [p for _, _, p in rated]


ISLAND_SCHEMA = "block bigint, island int, elite string, score double, solved boolean"
PACKED_SCHEMA = "block bigint, item bigint, bin int"


def _elite(block: int, island: int, best: list[list[int]], sizes: list[int], capacity: int) -> pd.DataFrame:
    count, fill = fitness(best, sizes, capacity)
    return pd.DataFrame({"block": [block], "island": [island], "elite": [json.dumps(best)], "score": [count * 1e6 + fill], "solved": [len(best) <= least_bins(sizes, capacity)]})


def _seeds(capacity: int):
    def run(key, items: pd.DataFrame) -> pd.DataFrame:
        sizes = items.sort_values("item")["size"].tolist()
        return _elite(int(key[0]), 0, seed_bins(sizes, capacity), sizes, capacity)

    return run


def _epoch(capacity: int, generations: int, seed: int, epoch: int):
    """One island of one block: its items, its own elite and its neighbour's."""

    def run(key, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame(columns=["block", "island", "elite", "score", "solved"])
        block, island = int(key[0]), int(key[1])
        sizes = items.sort_values("item")["size"].tolist()
        population = [json.loads(x) for x in elites.sort_values("score", ascending=False)["elite"]]
        rnd = random.Random(f"{seed}/{block}/{island}/{epoch}")
        return _elite(block, island, evolve(sizes, capacity, population, generations, rnd)[0], sizes, capacity)

    return run


def _unfold(items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
    if not len(items) or not len(elites):
        return pd.DataFrame(columns=["block", "item", "bin"])
    items = items.sort_values("item")
    keys, block = items["item"].tolist(), int(items["block"].iloc[0])
    best = json.loads(elites["elite"].iloc[0])
    rows = [(block, keys[i], k) for k, members in enumerate(best) for i in members]
    return pd.DataFrame(rows, columns=["block", "item", "bin"])


def pack_items(items: DataFrame, capacity: int, islands: int = 4, epochs: int = 3, generations: int = 40, per_block: int = PER_BLOCK, seed: int = 11, label: str = "pack") -> DataFrame:
    """``items`` (item bigint unique, size <= capacity) to (block, item, bin), bins numbered within their block.

    ``epochs`` = 0 leaves the seeds as they are.
    """
    blocks = blocks_for(items.count(), per_block)
    placed = stage(items.select("item", F.col("size").cast("bigint").alias("size"), F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(blocks)).alias("block")), f"{label}-items")
    elites = stage(placed.repartition(max(1, min(blocks, 10000)), "block").groupBy("block").applyInPandas(_seeds(capacity), ISLAND_SCHEMA), f"{label}-elite")
    for epoch in range(epochs):
        unsolved = elites.groupBy("block").agg(F.bool_or("solved").alias("solved")).where("not solved").select("block")
        still = unsolved.count()
        if not still:
            break
        on_islands = placed.join(unsolved, "block", "left_semi").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition(max(1, min(still * islands, 10000)), "block", "island")
        # Elite migration: each island keeps its best and gets its neighbour's; first the seed goes to the first island.
        moved = elites.join(unsolved, "block", "left_semi")
        if epoch:
            moved = moved.unionByName(moved.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))
        here = stage(on_islands.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(_epoch(capacity, generations, seed, epoch), ISLAND_SCHEMA), f"{label}-elite")
        elites = elites.join(unsolved, "block", "left_anti").unionByName(here)
    best = elites.groupBy("block").agg(F.max_by("elite", F.struct("score", "island")).alias("elite"))
    return placed.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(lambda a, b: _unfold(a, b), PACKED_SCHEMA)


def pieces_of(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start_token, stop_token, size): one piece per text, or several of full capacity and a rest.

    Every row of ``docs`` counts, repeated texts and keys too.  Null and empty
    texts have no tokens and need no container; they have no piece.
    """
    rows = docs.select("doc_id", "text").where("text is not null and length(text) > 0")
    counted = with_tokens(rows, vocabulary, key="doc_id")
    cap = F.lit(capacity)
    return (
        counted.where("tokens > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / cap))))
        .select(
            "doc_id",
            F.col("piece").cast("int").alias("piece"),
            (F.col("piece") * cap).alias("start_token"),
            F.least(F.col("tokens"), (F.col("piece") + 1) * cap).alias("stop_token"),
        )
        .withColumn("size", F.col("stop_token") - F.col("start_token"))
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """(doc_id, piece, start_token, stop_token, size, container): every token of every text in one container.

    A text is cut only when it exceeds the capacity, at multiples of it, and a
    full piece is a container by itself.  No container exceeds the capacity.
    """
    pieces = stage(pieces_of(docs, capacity, vocabulary).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    full = pieces.where(F.col("size") == capacity).withColumn("container", F.concat(F.lit("f-"), F.col("item").cast("string")))
    open_pieces = pieces.where(F.col("size") < capacity)
    first = stage(pack_items(open_pieces.select("item", "size"), capacity, seed=seed, label="pack-first"), "pack-bins")
    sized = open_pieces.join(first, "item")
    loads = sized.groupBy("block", "bin").agg(F.sum("size").alias("load"))
    # Bins that are not well filled are opened and packed again across blocks.
    loose_bins = stage(loads.where(F.col("load") < F.lit(0.97) * capacity), "pack-loose").select("block", "bin")
    kept = sized.join(loose_bins, ["block", "bin"], "left_anti").withColumn("container", F.concat_ws("-", F.lit("a"), F.col("block").cast("string"), F.col("bin").cast("string")))
    loose = sized.join(loose_bins, ["block", "bin"], "left_semi").drop("block", "bin")
    second = stage(pack_items(loose.select("item", "size"), capacity, seed=seed + 1, label="pack-second"), "pack-bins")
    again = loose.join(second, "item").withColumn("container", F.concat_ws("-", F.lit("b"), F.col("block").cast("string"), F.col("bin").cast("string")))
    names = ["doc_id", "piece", "start_token", "stop_token", "size", "container"]
    return full.select(names).unionByName(kept.select(names)).unionByName(again.select(names))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, the least that could hold the tokens, and the share of room used."""
    loads = packed.groupBy("container").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    return loads.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"),
        F.count("*").alias("containers"),
        F.ceil(F.coalesce(F.sum("load"), F.lit(0)) / capacity).alias("least_containers"),
        (F.sum("load") / (F.count("*") * capacity)).alias("filled"),
        F.max("load").alias("fullest"),
    )
