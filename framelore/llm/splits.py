"""Splits that keep related records together.

Method: rows name recordings (their own, their group's, the one they derive
from); parallel hooking and shortcutting over parent tables yields the related
sets.  Subset-sum bitsets over the multiplicities of set sizes then choose
which sets go to which split so that the totals come closest to the targets.

Scale: only the histogram of set sizes reaches the driver.  Sizes add up to
the number of rows N, so there are at most sqrt(2 N) of them, and many sizes
mean small ones, whose totals leave no holes.  Choosing which
of the equally large sets go where is a ranking in hash buckets of bounded
size, not one sort of all sets.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from framelore.llm import keys
from framelore.llm.graph import components
from framelore.tables import blocks_for, stage

# Bits of the bitset in which a run of consecutive totals is looked for, and of the bitsets kept for walking back.
BITS = 1 << 26
HISTORY_BITS = 1 << 31
PER_BUCKET = 20000


def recording(value: Column) -> Column:
    """The recording a value names, as video id; null where it names none."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(value, r"(?U)\s+", "")), "^sha-?256[:=]", "")
    by_digest = F.when(keys.digest(value).isNotNull(), F.concat(F.lit("video-"), F.left(bare, F.lit(24))))
    return F.coalesce(by_digest, F.when(bare.rlike("^video-[0-9a-f]{24}$"), bare))


def related_sets(videos: DataFrame) -> DataFrame:
    """``video_key`` with ``set_id``: rows related directly or through others, listed or not.

    A row whose video_id and digest name nothing is a set of its own (unless a
    group or origin joins it to others).  Repeated rows stay in one set.
    """
    own = F.coalesce(recording(F.col("video_id")), recording(F.col("sha256")), F.concat(F.lit("row-"), F.coalesce(F.col("video_key").cast("string"), F.lit("null"))))
    rows = videos.select("video_key", own.alias("node"), recording(F.col("sha256")).alias("s"), recording(F.col("group_id")).alias("g"), recording(F.col("derived_from")).alias("d"))
    rows = stage(rows, "splits-rows")
    edges = rows.select(F.col("node").alias("a"), F.explode(F.array_compact(F.array("s", "g", "d"))).alias("b"))
    roots = components(edges, "splits")
    return rows.select("video_key", "node").join(roots, "node", "left").select("video_key", F.coalesce("root", "node").alias("set_id"))


def related_rows(videos: DataFrame) -> DataFrame:
    """(video_key_a, video_key_b): the smallest key of a set and each other row of it."""
    sets = stage(related_sets(videos).where("video_key is not null").distinct(), "splits-sets")
    first = sets.groupBy("set_id").agg(F.min("video_key").alias("video_key_a"))
    return sets.join(first, "set_id").where("video_key > video_key_a").select("video_key_a", F.col("video_key").alias("video_key_b"))


def _copies(sizes: list[int], histogram: dict[int, int], limit: int) -> list[int]:
    """Sets of each size that can matter below ``limit``."""
    return [min(histogram[s], limit // s) for s in sizes]


def _with_copies(reach: int, size: int, copies: int, mask: int) -> int:
    """``reach`` with up to ``copies`` sets of ``size`` added: 1, 2, 4, ... and the rest."""
    step = 1
    while copies > 0:
        take = min(step, copies)
        reach |= (reach << (take * size)) & mask
        copies, step = copies - take, step * 2
    return reach


def _walk_back(sizes: list[int], copies: list[int], total: int, history_bits: int) -> dict[int, int]:
    """Counts whose sizes add up to ``total``, which can be reached; large sets only where smaller ones cannot reach it.

    The bitsets before each size are needed from the last to the first.  As
    many are kept as fit in ``history_bits``; those between are made again.
    """
    mask = (1 << (total + 1)) - 1
    stride = max(1, -(-len(sizes) * (total + 1) // max(1, history_bits)))
    kept, reach = [], 1
    for i, (s, n) in enumerate(zip(sizes, copies)):
        if i % stride == 0:
            kept.append(reach)
        reach = _with_copies(reach, s, min(n, total // s), mask)
    counts: dict[int, int] = {}
    for block in range(len(kept) - 1, -1, -1):
        at = range(block * stride, min(len(sizes), (block + 1) * stride))
        before = [kept[block]]
        for i in at[:-1]:
            before.append(_with_copies(before[-1], sizes[i], min(copies[i], total // sizes[i]), mask))
        for i, reached in zip(reversed(at), reversed(before)):
            while not (reached >> total) & 1:
                total -= sizes[i]
                counts[sizes[i]] = counts.get(sizes[i], 0) + 1
    return counts


def _longest_run(reach: int, length: int, want: int) -> tuple[int, int] | None:
    """(first, last) of the first ``want`` or more consecutive totals in ``reach``, or None."""
    runs, have = reach, 1
    while have < want and runs:
        step = min(have, want - have)
        runs &= runs >> step
        have += step
    if not runs:
        return None
    first = (runs & -runs).bit_length() - 1
    hole = ~(reach >> first) & ((1 << (length - first + 1)) - 1)
    return first, first + (hole & -hole).bit_length() - 2 if hole else length


def choose_sizes(histogram: dict[int, int], target: int, bits: int = BITS, history_bits: int = HISTORY_BITS) -> dict[int, int]:
    """How many sets of each size to take so that their sizes add up as close to ``target`` as can be; of two equally close totals the smaller.

    ``histogram``: size to number of sets.  Exact at any size:

    1. Sizes are divided by their common divisor.
    2. A bitset of the totals that the smaller sizes reach grows size by size.
       A run of as many consecutive totals as the next size is lengthened by
       each of its sets, and so on while the next size is no longer than the
       run; if the run gets to the target, larger sets are taken until the
       rest lies in the bitset's own run.  This bitset is at most ``bits``
       long, with only so many copies of a size as it can hold; further copies
       lengthen the run like larger sizes.
    3. Where no such run appears, the bitset of all totals up to the target
       (and one set beyond it) decides; it has as many bits as the target.

    Walking back over the bitsets gives the counts; large sets are taken only
    where smaller ones cannot reach the total, so a small split holds many sets.
    """
    sizes = sorted(s for s, n in histogram.items() if s > 0 and n > 0)
    total = sum(s * histogram[s] for s in sizes)
    target = max(0, min(target, total))
    if not sizes or not target:
        return {}
    unit = math.gcd(*sizes)
    scaled = {s // unit: histogram[s] for s in sizes}
    low = target // unit
    goal = low if target - low * unit <= (low + 1) * unit - target else low + 1  # the closest multiple
    counts = _by_run(scaled, goal, bits, history_bits)
    if counts is None:
        counts = _by_bitset(scaled, target / unit if target % unit else low, history_bits)
    return {s * unit: n for s, n in counts.items() if n}


def _by_run(histogram: dict[int, int], goal: int, bits: int, history_bits: int) -> dict[int, int] | None:
    """Counts that add up to ``goal`` exactly, by a run of consecutive totals; None where no bitset of ``bits`` shows one that leads to it."""
    sizes = sorted(histogram)
    reach, length = 1, 0
    used: list[int] = []
    budget = min(bits, max(goal, 4 * sizes[-1]))
    for i in range(len(sizes) + 1):
        run = _longest_run(reach, length, sizes[min(i, len(sizes) - 1)])
        if run and run[0] <= goal:
            first, last = run
            steps, end = [], last
            for j, s in enumerate(sizes):
                n = histogram[s] - (used[j] if j < i else 0)
                if end >= goal or s > end - first + 1:
                    break
                steps.append((s, n, end))
                end += s * n
            if end >= goal:
                counts, left = _lengthened(steps, goal)
                for s, n in _walk_back(sizes[:i], used, left, history_bits).items():
                    counts[s] = counts.get(s, 0) + n
                return counts
        if i == len(sizes):
            return None
        n = min(histogram[sizes[i]], (budget - length) // sizes[i])
        if n < 1:
            return None
        used.append(n)
        length += n * sizes[i]
        reach = _with_copies(reach, sizes[i], n, (1 << (length + 1)) - 1)
    return None


def _lengthened(steps: list[tuple[int, int, int]], goal: int) -> tuple[dict[int, int], int]:
    """As few sets as needed of each size, the largest first, and what is left for the run.

    ``steps``: size, copies, and the end of the run before that size.  The run
    is at least as long as the size, so taking sets until the rest is at most
    the end cannot step over it.
    """
    counts, left = {}, goal
    for s, n, end in reversed(steps):
        take = min(n, max(0, -(-(left - end) // s)))
        if take:
            counts[s], left = take, left - take * s
    return counts, left


def _by_bitset(histogram: dict[int, int], target: float, history_bits: int) -> dict[int, int]:
    """Counts whose total is closest to ``target``, over all totals up to one that is at or above it."""
    sizes = sorted(histogram)
    limit = 0  # some total at or above the target; the closest one is no larger
    for s in sizes:
        limit += s * min(histogram[s], max(0, -(-(math.ceil(target) - limit) // s)))
    limit = min([limit, *(s for s in sizes if s >= target)])
    mask, reach = (1 << (limit + 1)) - 1, 1
    copies = _copies(sizes, histogram, limit)
    for s, n in zip(sizes, copies):
        reach = _with_copies(reach, s, n, mask)
    goal = math.floor(target)
    best = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    if above:
        over = goal + (above & -above).bit_length()
        best = over if over - target < target - best else best
    return _walk_back(sizes, copies, best, history_bits)


def plan_splits(histogram: dict[int, int], shares: list[tuple[str, float]], bits: int = BITS, history_bits: int = HISTORY_BITS) -> dict[str, dict[int, int]]:
    """Counts by size for each split.

    Splits are filled one after another and the last takes the rest; what one
    takes another lacks, so every order of up to four splits is tried (small
    shares first where there are more) and the plan kept whose totals are
    closest to the targets together.
    """
    total = sum(s * n for s, n in histogram.items())
    weight = sum(w for _, w in shares) or 1.0
    wanted = {name: total * share / weight for name, share in shares}
    by_share = sorted(shares, key=lambda x: (x[1], x[0]))
    best: tuple[float, dict[str, dict[int, int]]] | None = None
    for order in permutations(by_share) if len(shares) <= 4 else [by_share]:
        left, plan = dict(histogram), {}
        for name, _ in order[:-1]:
            plan[name] = choose_sizes({s: n for s, n in left.items() if n}, round(wanted[name]), bits, history_bits)
            for s, n in plan[name].items():
                left[s] -= n
        if order:
            plan[order[-1][0]] = {s: n for s, n in left.items() if n}
        off = sum(abs(sum(s * n for s, n in plan[name].items()) - wanted[name]) for name in wanted)
        if best is None or off < best[0] - 1e-9:
            best = off, plan
        if off <= len(shares):  # rounding alone: no order can be closer
            break
    return best[1] if best else {}


def assign_splits(videos: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Every row with its set and split: (video_key, set_id, assigned).

    ``targets`` (split, target_share) is read whole; it has one row per split.
    Which of the equally large sets a split gets follows a seeded hash.  With
    no targets the split is null; with no rows there are no rows.
    """
    spark = videos.sparkSession
    sets = stage(related_sets(videos), "splits-sets")
    sized = stage(sets.groupBy("set_id").agg(F.count("*").alias("size")), "splits-sizes")
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    shares = [(r[0], float(r[1])) for r in targets.where("split is not null and target_share > 0").groupBy("split").agg(F.max("target_share")).collect()]
    plan = plan_splits(histogram, shares)
    ranges = []
    taken: dict[int, int] = {}
    for name, counts in plan.items():
        for s, n in sorted(counts.items()):
            ranges.append((s, taken.get(s, 0), taken.get(s, 0) + n, name))
            taken[s] = taken.get(s, 0) + n
    cuts = spark.createDataFrame(ranges or [(0, 0, 0, "")], "size bigint, lo bigint, hi bigint, assigned string")
    # Rank within size: a bucket's sets are ranked, the buckets before it are added up.
    most = max(histogram.values(), default=1)
    buckets = blocks_for(most, PER_BUCKET)
    drawn = sized.withColumn("draw", F.xxhash64(F.lit(seed), "set_id")).withColumn("bucket", F.pmod(F.col("draw"), F.lit(buckets)))
    counts_by = drawn.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = counts_by.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("draw", "set_id")) - 1).join(before, ["size", "bucket"])
    place = ranked.select("set_id", "size", (F.col("r") + F.col("offset")).alias("place"))
    chosen = place.join(cuts, "size", "left").where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("set_id", "assigned") if ranges else place.select("set_id", F.lit(None).cast("string").alias("assigned"))
    return sets.join(chosen, "set_id", "left").select("video_key", "set_id", "assigned")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows, sets, reached and target share per split, zeros included."""
    per = assigned.groupBy(F.col("assigned").alias("split")).agg(F.count("*").alias("rows"), F.count_distinct("set_id").alias("sets"))
    total = assigned.agg(F.count("*").alias("total"))
    return (
        targets.select("split", "target_share").join(per, "split", "left").crossJoin(F.broadcast(total))  # one row
        .select("split", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("sets", F.lit(0)).alias("sets"), "target_share",
                F.when(F.col("total") > 0, F.coalesce("rows", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0)).alias("reached_share"))
    )
