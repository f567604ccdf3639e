"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

A length is a whole number from 1 to the capacity, so the histogram has at most `capacity` rows however many pieces
there are. The plan treats equal lengths alike and says which ranks of a length go where; pieces then look their
place up by their rank. Pieces over a third of the capacity fit at most twice in a sequence and are matched greedily,
the longest with the longest that still fits; the rest go, longest first, to the smallest gap that holds them.

Defined results: every piece gets one place; repeated rows are packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows that one rank bucket of a length should hold: keeps a frequent length out of a single task.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 64


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, pieces a sequence): where the ranks of a length go."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    plan, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first sequence, how many)
    sizes: list[int] = []  # gaps that have runs, ascending

    def place(length: int, first: int, bins: int, offset: int, each: int) -> None:
        plan.append((length, used[length], used[length] + bins * each, first, offset, each))
        used[length] += bins * each
        left[length] -= bins * each

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        if not left[longest]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - longest) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at >= 0 and large[at] == longest and left[longest] == 1:  # no second one: the next length that is left
            at -= 1
            while at >= 0 and not left[large[at]]:
                large.pop(at)
                at -= 1
        partner = large[at] if at >= 0 else 0
        if partner == longest and left[longest] > 1:
            bins, each = left[longest] // 2, 2
        elif partner and partner != longest:
            bins, each = min(left[longest], left[partner]), 1
        else:
            partner, bins, each = 0, left[longest], 1
        place(longest, sequences, bins, 0, each)
        if partner and partner != longest:
            place(partner, sequences, bins, longest, 1)
        leave(capacity - longest - partner, sequences, bins)
        sequences += bins
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at < len(sizes):
                gap = sizes[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                gap, first, bins = capacity, sequences, -(-left[n] // (capacity // n))
                sequences += bins
            each = min(gap // n, left[n])
            taken = min(bins, left[n] // each)
            place(n, first, taken, capacity - gap, each)
            leave(gap - each * n, first, taken)
            leave(gap, first + taken, bins - taken)
    return plan


def pack_pieces(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Add (sequence_id, offset) to pieces that have `key`, `piece`, `length` and `ids_crc32`."""
    spark = pieces.sparkSession
    names = pieces.columns
    pieces = materialise(pieces.withColumn("_deal", F.monotonically_increasing_id()), "pieces")  # written, so that it stays
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = plan_packing(histogram, capacity)
    buckets = max(LEAST_BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32", "_deal"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32", "_deal"))
    ranked = dealt.withColumn("_row", within).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    places = spark.createDataFrame(plan, "length long, _low long, _high long, _first long, _offset long, _each long")
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    at = F.col("_rank") - F.col("_low")
    return placed.select(
        *[ranked[c] for c in names],
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * ranked["length"]).cast("long").alias("offset"),
    )
