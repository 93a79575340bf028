"""Filling fixed-capacity containers with messages: shortest-pack-first on the length histogram.

Only the histogram (at most ``capacity`` rows, whatever the corpus) reaches the
driver. There lengths are placed longest first, each into the container with
the most room left, for all containers of the same filling pattern at once.
The patterns become rank intervals per length; documents find their container
by their length's intervals and their rank in it, one lookup an item. Ranks
are counted in slices of each length, as many as its items need, so a length
that a third of the corpus shares isn't ranked in one task.

Defined results: null texts have only the end token; a message longer than the
capacity is divided into full containers and one remainder, which is packed
like any item; a repeated doc_id is one message (its longest text counts);
null doc_ids are left out; an empty table gives no containers.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Pattern = tuple[tuple[int, int], ...]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(containers, ((length, items of it), ...)) so that every item is placed.

    Each length splits at most one group of equal containers and opens at most
    one, so there are at most two groups per length.
    """
    groups: dict[int, dict[Pattern, int]] = defaultdict(dict)  # room left -> pattern -> containers
    rooms: list[int] = []  # negated, for the largest first

    def put(room: int, pattern: Pattern, count: int) -> None:
        if not groups[room]:
            heapq.heappush(rooms, -room)
        groups[room][pattern] = groups[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not groups[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else -1
            if room < length:
                fit = capacity // length
                if left >= fit:
                    put(capacity - fit * length, ((length, fit),), left // fit)
                if left % fit:
                    put(capacity - left % fit * length, ((length, left % fit),), 1)
                break
            pattern, count = groups[room].popitem()
            taken = min(count, left)
            if count > taken:
                groups[room][pattern] = count - taken
            last, items = pattern[-1]
            grown = (*pattern[:-1], (last, items + 1)) if last == length else (*pattern, (length, 1))
            put(room - length, grown, taken)
            left -= taken
    return [(count, pattern) for at in groups.values() for pattern, count in at.items()]


def rank_intervals(patterns: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, items a container) for each pattern and length."""
    used: dict[int, int] = defaultdict(int)
    rows, container = [], 0
    for count, pattern in sorted(patterns, key=lambda p: p[1], reverse=True):
        for length, items in pattern:
            rows.append((length, used[length], used[length] + count * items, container, items))
            used[length] += count * items
        container += count
    return rows


def pieces(documents: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, length: messages in tokens (UTF-8 bytes and one end token), long ones divided."""
    tokens = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    sizes = documents.where("doc_id is not null").select("doc_id", tokens.alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    cut = F.floor((F.col("tokens") - 1) / capacity)
    return sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), cut))).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("length")
    )


#: Items of one length that are ranked in one task.
_SLICE = 500_000


def pack(documents: DataFrame, capacity: int = 8192, salts: int | None = None) -> DataFrame:
    """container, doc_id, piece, length: every piece of every message in exactly one container.

    ``salts`` slices of each length are ranked apart; without it their number
    follows from the most frequent length, so that a slice has about ``_SLICE`` items.
    """
    spark = documents.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces(documents, capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    if salts is None:
        salts = max(32, -(-max(histogram.values(), default=0) // _SLICE))
    items = pieces(documents, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    slices = items.groupBy("length", "salt").agg(F.count("*").alias("n"))
    plan: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, first, _, container, each in sorted(rank_intervals(pack_histogram(histogram, capacity))):
        plan[length].append((first, container, each))
    intervals = spark.createDataFrame(list(plan.items()), "length int, intervals array<struct<first:bigint,container:bigint,each:bigint>>")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = slices.select("length", "salt", before.alias("offset"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("offset"))
    # one row per length (at most ``capacity``), its intervals in order: each item finds the last that begins at its rank or before
    found = ranked.join(F.broadcast(intervals), "length").withColumn("at", F.get("intervals", F.size(F.filter("intervals", lambda i: i["first"] <= F.col("rank"))) - 1))
    return found.select((F.col("at.container") + F.floor((F.col("rank") - F.col("at.first")) / F.col("at.each"))).alias("container"), "doc_id", "piece", "length")


def containers(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("length").alias("tokens")).withColumn("room", F.lit(capacity) - F.col("tokens"))
