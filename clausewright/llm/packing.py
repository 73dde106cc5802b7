"""Containers of fixed capacity filled with items of varying length (problem 9).

Shortest-pack-first over the length histogram. The histogram has at most `capacity` rows, so the
plan is made on the driver whatever the corpus holds: lengths are placed longest first, each into
the emptiest packs that still take it, and what is kept is how many packs share one pattern. A
length splits at most one pattern and opens at most one, so there are at most `capacity` patterns.
The plan is then joined back to the items by their rank within their length.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import encoded

CAPACITY = 2048
CHUNK = 100_000  # items of one length that are ranked in one task
SLOTS = "size int, first bigint, last bigint, count bigint, base bigint, at int"


@dataclass
class Pattern:
    """`count` packs with the same content: pairs of length and how often it is in each."""

    count: int
    content: tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place every item of the histogram; lengths are 1 to capacity."""
    groups: dict[int, Pattern] = {}
    heap: list[tuple[int, int]] = []  # the emptiest first; ties by age
    made = 0

    def add(space: int, pattern: Pattern) -> None:
        nonlocal made
        groups[made] = pattern
        heapq.heappush(heap, (-space, made))
        made += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0][0] < length:
                add(capacity - length, Pattern(left, ((length, 1),)))
                break
            space, which = heapq.heappop(heap)
            pattern = groups.pop(which)
            taken = min(left, pattern.count)
            if taken < pattern.count:
                add(-space, Pattern(pattern.count - taken, pattern.content))
            *before, (last, times) = pattern.content
            content = (*before, (last, times + 1)) if last == length else (*pattern.content, (length, 1))
            add(-space - length, Pattern(taken, content))
            left -= taken
    return sorted(groups.values(), key=lambda p: (p.content, p.count), reverse=True)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first, last, count, base, at): the items of a size with ranks first to last go, in turn,
    to the `count` containers from `base` on, at position `at` and further on the next time round."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for p in patterns:
        at = 0
        for size, times in p.content:
            first = used.get(size, 0)
            used[size] = first + p.count * times
            rows.append((size, first, used[size] - 1, p.count, base, at))
            at += size * times
        base += p.count
    return rows


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, key, piece_no, first, size, at): every item once, `first` its first unit in the
    whole item and `at` its place in the container.

    An item above the capacity is cut into full pieces and a rest; no other is. Null and zero sizes
    take no place. A null key is an item like others; of repeated rows each is an item."""
    whole = sizes.where(F.col(size) > 0).select(F.col(key).alias("id"), F.col(size).cast("int").alias("n"))
    numbers = F.sequence(F.lit(1), F.ceil(F.col("n") / capacity).cast("int"))
    items = cut(whole.select("id", "n", F.explode(numbers).alias("piece_no")).select("id", "piece_no", F.least(F.lit(capacity), F.col("n") - (F.col("piece_no") - 1) * capacity).alias("size")))
    spark = sizes.sparkSession
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.createDataFrame(slots(plan(histogram, capacity)), SLOTS)
    buckets = spark.createDataFrame([(s, -(-n // CHUNK)) for s, n in histogram.items()], "size int, buckets int")
    spread = items.join(F.broadcast(buckets), "size").withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), "buckets").cast("int")).drop("buckets")
    offsets = spread.groupBy("size", "bucket").agg(F.count("*").alias("n")).select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("offset"))
    numbered = spread.withColumn("row", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "piece_no")))
    ranked = numbered.join(offsets, ["size", "bucket"]).select("id", "piece_no", "size", (F.col("offset") + F.col("row") - 1).alias("rank"))
    # at most `capacity` patterns of at most sqrt(2 * capacity) different lengths: the plan is small by proof
    placed = ranked.join(F.broadcast(places.withColumnRenamed("size", "slot_size")), F.expr("size = slot_size and rank between first and last"))
    turn, which = F.floor((F.col("rank") - F.col("first")) / F.col("count")), (F.col("rank") - F.col("first")) % F.col("count")
    return placed.select((F.col("base") + which).alias("container_id"), F.col("id").alias(key), "piece_no", ((F.col("piece_no") - 1) * capacity).alias("first"), "size", (F.col("at") + turn * F.col("size")).cast("int").alias("at"))


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents by their number of tokens in containers of `capacity` tokens."""
    return pack(encoded(documents, "doc_id", "text", vocabulary, counts_only=True), "doc_id", "tokens", capacity)
