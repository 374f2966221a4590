"""Filling containers of fixed capacity by minimum bin slack.

How well items fit depends only on how many there are of each length, and there
are at most ``capacity`` lengths after splitting. So the rows are counted by
length (the one thing the driver gets: at most ``capacity`` numbers, at any
data size), the driver plans patterns ("one container: two of 700, one of 648")
with repeat counts, and the rows find their containers by length and rank.

Planning: each window starts with the longest length left; a bitset over
0..capacity tells which sums the remaining lengths can reach (bounded subset
sum, counts by binary splitting), the sum closest to capacity is traced back to
counts, and the pattern is repeated as often as the remaining counts allow.
Every pattern uses up at least one length or all of it but a few items, so the
number of patterns follows the number of lengths, not of rows.

Ranks come without a global sort: rows of one length are spread over
``RANK_BUCKETS`` buckets by a hash, counted by bucket, and numbered inside the
bucket from the bucket's offset. A length that holds a third of all rows is
still many tasks.

Defined results: an item longer than the capacity is split into full containers
and one remainder, no other is split; items of size 0 take no room and lie in a
container chosen by hash; every row of the input comes out once for each of its
pieces; rows without an id are still items; repeated ids are separate items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Ranks within one length are made in so many parts at least, and in more where a part would have more than ``BUCKET_ROWS`` rows.
RANK_BUCKETS = 64
BUCKET_ROWS = 1_000_000
MAX_CAPACITY = 1 << 20


def fill_window(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that fits ``room``.

    ``lengths`` descend; bit ``s`` of ``reach`` says that some choice sums to
    ``s``. The search ends early when the window is exactly full.
    """
    full = 1 << room
    mask = (full << 1) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length], room // length)
        batch = 1
        while left > 0:
            take = min(batch, left)
            grown = (reach | reach << take * length) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
                if reach & full:
                    break
            left -= take
            batch *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, earlier in reversed(steps):
        if not earlier >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan_patterns(histogram: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns (length -> count) and how many containers are filled by each."""
    counts = {x: n for x, n in histogram.items() if n > 0 and 0 < x <= capacity}
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = fill_window([x for x in lengths if x <= capacity - first and counts[x]], counts, capacity - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
        yield chosen, times
        lengths = [x for x in lengths if counts[x]]


def plan_ranges(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Rows (size, from_rank, to_rank, each, first): ranks [from, to) of a size go ``each`` to a container from ``first`` on."""
    used, rows, bins = {}, [], 0
    for chosen, times in plan_patterns(histogram, capacity):
        for size, n in chosen.items():
            at = used.get(size, 0)
            rows.append((size, at, at + n * times, n, bins))
            used[size] = at + n * times
        bins += times
    return pd.DataFrame(rows, columns=["size", "from_rank", "to_rank", "each", "first"], dtype="int64")


def ranked(items: DataFrame, by: str, salt: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """``items`` with ``rank``, 0-based within each value of ``by``, skew or not."""
    spread = items.withColumn("rank_bucket", F.pmod(F.xxhash64(salt), F.lit(buckets)))
    counts = spread.groupBy(by, "rank_bucket").count()
    offsets = counts.select(by, "rank_bucket", (F.sum("count").over(Window.partitionBy(by).orderBy("rank_bucket")) - F.col("count")).alias("offset"))
    inside = spread.withColumn("inside", F.row_number().over(Window.partitionBy(by, "rank_bucket").orderBy(salt)) - 1)
    return inside.join(offsets, [by, "rank_bucket"]).withColumn("rank", F.col("offset") + F.col("inside")).drop("rank_bucket", "offset", "inside")


def pieces_of(items: DataFrame, size: str, capacity: int) -> DataFrame:
    """One row for each piece: ``piece`` from 0 and ``piece_size``."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity))).cast("int")
    return items.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("piece_size", F.least(F.lit(capacity).cast("long"), F.col(size) - F.col("piece").cast("long") * capacity))


def sized(items: DataFrame, key: str, size: str) -> DataFrame:
    return items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))


def histograms(items: DataFrame, key: str, size: str, capacities: list[int]) -> dict[int, dict[int, int]]:
    """Pieces by size for each capacity, from one job; at most ``capacity`` numbers each, however many items."""
    each = sized(items, key, size).withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities]))).filter("size > 0")
    whole, rest = F.floor(F.col("size") / F.col("capacity")), F.col("size") % F.col("capacity")
    parts = each.select("capacity", F.explode(F.array(F.struct(F.col("capacity").cast("long").alias("piece"), whole.cast("long").alias("n")), F.struct(rest.alias("piece"), F.lit(1).cast("long").alias("n")))).alias("x")).select("capacity", "x.*")
    made: dict[int, dict[int, int]] = {c: {} for c in capacities}
    for r in parts.filter("piece > 0 AND n > 0").groupBy("capacity", "piece").agg(F.sum("n").alias("n")).collect():
        made[r["capacity"]][int(r["piece"])] = int(r["n"])
    return made


def pack(spark: SparkSession, items: DataFrame, key: str, size: str, capacity: int, histogram: dict[int, int] | None = None) -> DataFrame:
    """Rows (key, piece, piece_size, container) for every piece of every item.

    ``items`` is read several times; pass a stored table or a persisted frame.
    ``histogram`` has the pieces by size where they were counted already.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must lie between 1 and {MAX_CAPACITY}")
    cut = pieces_of(sized(items, key, size), "size", capacity)
    if histogram is None:
        histogram = histograms(items, key, size, [capacity])[capacity]
    buckets = max(RANK_BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    ranges = plan_ranges(histogram, capacity)
    bins = max(1, int(((ranges["to_rank"] - ranges["from_rank"]) // ranges["each"] + ranges["first"]).max()) if len(ranges) else 1)
    table = spark.createDataFrame(ranges, "size long, from_rank long, to_rank long, each long, first long")
    placed = ranked(cut.filter("piece_size > 0").withColumn("salt", F.xxhash64("key", "piece")), "piece_size", "salt", buckets).withColumnRenamed("rank", "rank_")
    #: ranges of a size do not overlap: each row meets one, found by equality on (size, block of ranks)
    step = 4096
    blocks = table.withColumn("block", F.explode(F.sequence(F.floor(F.col("from_rank") / step), F.floor((F.col("to_rank") - 1) / step))))
    met = placed.withColumn("block", F.floor(F.col("rank_") / step)).alias("p").join(
        blocks.alias("r"),
        (F.col("p.piece_size") == F.col("r.size")) & (F.col("p.block") == F.col("r.block")) & (F.col("p.rank_") >= F.col("r.from_rank")) & (F.col("p.rank_") < F.col("r.to_rank")),
    )
    full = met.select(F.col("p.key").alias(key), "piece", "piece_size", (F.col("first") + F.floor((F.col("rank_") - F.col("from_rank")) / F.col("each"))).alias("container"))
    empty = cut.filter("piece_size <= 0").select(F.col("key").alias(key), "piece", "piece_size", F.pmod(F.xxhash64("key"), F.lit(bins)).alias("container"))
    return full.unionByName(empty)


def pack_all(spark: SparkSession, items: DataFrame, key: str, size: str, budgets: dict[str, int]) -> DataFrame:
    """``pack`` for each named capacity, with a column ``budget_name``."""
    made = None
    known = histograms(items, key, size, sorted({c for c in budgets.values() if 0 < c <= MAX_CAPACITY})) if budgets else {}
    for name, capacity in sorted(budgets.items()):
        one = pack(spark, items, key, size, capacity, known.get(capacity)).select(F.lit(name).alias("budget_name"), F.lit(capacity).alias("capacity_tokens"), key, "piece", "piece_size", "container")
        made = one if made is None else made.unionByName(one)
    if made is None:
        raise ValueError("no capacity is given")
    return made


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of room left for each capacity."""
    bins = packed.groupBy("budget_name", "capacity_tokens", "container").agg(F.sum("piece_size").alias("filled"), F.count("*").alias("pieces"))
    return bins.groupBy("budget_name", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("filled").alias("tokens"),
        F.sum("pieces").alias("pieces"),
        F.max("filled").alias("fullest"),
        (1 - F.sum("filled") / (F.count("*") * F.first("capacity_tokens"))).alias("slack_share"),
    )


def slack_bound(histogram: dict[int, int], capacity: int) -> int:
    """Fewest containers that could hold the items: total size over capacity, rounded up."""
    return int(np.ceil(sum(x * n for x, n in histogram.items()) / capacity))
