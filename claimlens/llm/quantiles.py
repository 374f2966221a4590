"""Percentiles of very large numeric columns by relative-rank compactors.

A sketch is a stack of compactors. Level ``h`` holds values that each stand for
``2**h`` input values. A full compactor sorts its buffer, keeps the largest
values untouched and promotes every other one of the smaller values, so the
upper tail stays almost exact: the rank error of quantile ``q`` is at most
``error_bound(k) * (1 - q) * n`` (three standard deviations), which is a
multiplicative bound on the distance from the top. Sketches of partitions,
files or days merge by joining levels, with the same bound for the union.

Shape of the plan: one shuffle, on (day, bucket of the record id), removes
redelivered rows; each task then holds few days and sketches its rows before
anything else moves, so only sketches are shuffled afterwards. A generator or
instance that holds a third of the rows is spread over all buckets.

Defined results: null, NaN, infinite and negative values are failed
measurements and do not count; of rows with the same ``record_id`` the last
received counts (ties: the larger values); a cell that ``cells`` lacks gives the
group ``null``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 32
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
FAN_IN = 256
SKETCH = "n long, low double, high double, weights array<int>, counts array<int>, states array<long>, items array<double>"


#: Relative standard error of a relative-rank sketch times k, as published with the compactors
DEVIATION = 0.1306


def error_bound(k: int = K) -> float:
    """Three standard deviations of the rank error, as a share of ``(1 - q) * n``."""
    return 3 * DEVIATION / k + 1e-12


@dataclass
class Level:
    """One compactor: ``parts`` arrays not yet joined, a counter of compactions, the coin owed to the last one."""

    parts: list[np.ndarray] = field(default_factory=list)
    state: int = 0
    owed: int | None = None

    def size(self) -> int:
        return sum(map(len, self.parts))

    def geometry(self, k: int) -> tuple[int, int]:
        """Sections and their even size; sections double as compactions go on."""
        sections, width = 3, float(k)
        while self.state >= 1 << (sections - 1) and width / 2**0.5 >= 4:
            sections, width = sections * 2, width / 2**0.5
        return sections, 2 * round(width / 2)

    def reach(self) -> int:
        """Sections to compact: one more than the trailing ones of ``state``, which holds for joined states as well."""
        return (~self.state & (self.state + 1)).bit_length()

    def toss(self, coin: np.random.Generator) -> int:
        """Every second coin is the opposite of the one before, as ``DEVIATION`` takes for granted."""
        made = int(coin.integers(2)) if self.owed is None else self.owed
        self.owed = 1 - made if self.owed is None else None
        return made


class Sketch:
    """Mergeable quantile sketch that protects the upper tail."""

    def __init__(self, k: int = K, seed: int | tuple[int, ...] = 0):
        self.k, self.n, self.low, self.high = k, 0, np.inf, -np.inf
        self.levels = [Level()]
        self.coin = np.random.default_rng(seed)

    def update(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self.levels[0].parts.append(values)
            self._compress()

    def merge(self, other: Sketch) -> None:
        self.n, self.low, self.high = self.n + other.n, min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(Level())
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine.parts += theirs.parts
            mine.state |= theirs.state
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            sections, width = level.geometry(self.k)
            if level.size() > 2 * sections * width:
                keep = 2 * sections * width - min(level.reach(), sections) * width
                items = np.sort(np.concatenate(level.parts))
                cut = len(items) - keep
                cut -= cut % 2
                if h + 1 == len(self.levels):
                    self.levels.append(Level())
                self.levels[h + 1].parts.append(items[level.toss(self.coin) : cut : 2])
                level.parts, level.state = [items[cut:]], level.state + 1
            h += 1

    def quantiles(self, qs: tuple[float, ...]) -> list[float | None]:
        if not self.n:
            return [None] * len(qs)
        values = np.concatenate([p for x in self.levels for p in x.parts])
        weights = np.concatenate([np.full(len(p), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels) for p in x.parts])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.ceil(np.array(qs) * self.n), side="left")
        found = np.clip(values[np.minimum(at, len(values) - 1)], self.low, self.high)
        return [self.low if q <= 0 else self.high if q >= 1 else float(v) for q, v in zip(qs, found, strict=True)]

    def row(self) -> tuple:
        kept = [(h, np.concatenate(x.parts) if x.parts else np.empty(0), x.state) for h, x in enumerate(self.levels)]
        return (self.n, float(self.low), float(self.high), [h for h, _, _ in kept], [len(v) for _, v, _ in kept], [s for _, _, s in kept], np.concatenate([v for _, v, _ in kept]))

    @classmethod
    def of(cls, k: int, seed: int, n: int, low: float, high: float, weights: list[int], counts: list[int], states: list[int], items: np.ndarray) -> Sketch:
        made = cls(k, seed)
        made.n, made.low, made.high = int(n), low, high
        made.levels = [Level() for _ in range(max([0, *map(int, weights)]) + 1)]
        at = 0
        for h, count, state in zip(weights, counts, states, strict=True):
            made.levels[int(h)] = Level([np.asarray(items[at : at + int(count)], dtype=float)], int(state))
            at += int(count)
        return made


FIELDS = [x.split()[0] for x in SKETCH.split(", ")]


def _typed(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + SKETCH


def sketch_partitions(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch for each partition and combination of ``keys``; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Sketch] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False)[value]:
                key = tuple(None if x is None or x is pd.NaT or x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                if key not in held:
                    held[key] = Sketch(k, (TaskContext.get().partitionId(), len(held)))
                held[key].update(rows.to_numpy(dtype=float))
        if held:
            yield pd.DataFrame([(*key, *x.row()) for key, x in held.items()], columns=[*keys, *FIELDS])

    return df.select(*keys, F.col(value).cast("double")).mapInPandas(run, _typed(df, keys))


def _rows(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple]:
    """Rows as (keys, fields of the sketch); a missing key is ``None``."""
    named = [[None if x is None or x is pd.NaT or x != x else x for x in batch[c]] for c in keys]
    yield from zip(*named, *[batch[c].to_numpy() for c in FIELDS], strict=True)


def merge_sketches(df: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch for each combination of ``keys`` out of many, over sorted rows, so that no group is gathered."""
    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, made = None, None, 0
        for batch in batches:
            out = []
            for row in _rows(batch, keys):
                if total is None or row[:width] != key:
                    if total is not None:
                        out.append((*key, *total.row()))
                    key, total, made = row[:width], Sketch(k, (TaskContext.get().partitionId(), made, 1)), made + 1
                total.merge(Sketch.of(k, 0, *row[width:]))
            if out:
                yield pd.DataFrame(out, columns=[*keys, *FIELDS])
        if total is not None:
            yield pd.DataFrame([(*key, *total.row())], columns=[*keys, *FIELDS])

    ordered = df.select(*keys, *FIELDS).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInPandas(run, _typed(df, keys))


def merge_tree(df: DataFrame, keys: list[str], k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """Merges in two steps, so that no task gets more than about ``fan_in`` sketches or 1 / ``fan_in`` of them."""
    salted = df.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    return merge_sketches(merge_sketches(salted, [*keys, "salt"], k), keys, k)


def read_quantiles(df: DataFrame, keys: list[str], qs: tuple[float, ...] = QUANTILES, k: int = K) -> DataFrame:
    """Rows (keys, q, value, n, rank_error): the value whose rank is ``q * n`` up to ``rank_error * n``."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in _rows(batch, keys):
                made = Sketch.of(k, 0, *row[len(keys) :])
                rows += [(*row[: len(keys)], q, v, made.n, error_bound(k) * (1 - q)) for q, v in zip(qs, made.quantiles(qs), strict=True)]
            yield pd.DataFrame(rows, columns=[*keys, "q", "value", "n", "rank_error"])

    return df.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", q double, value double, n long, rank_error double")


def sound(value: Column) -> Column:
    """Neither null, NaN, infinite nor negative."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))


def measurements(cost: DataFrame, cells: DataFrame, buckets: int | None = None) -> DataFrame:
    """Long rows (generator, day, metric, value) without redeliveries.

    ``cells`` is joined by Spark's own choice, which broadcasts only under the
    session's size threshold. Rows without ``record_id`` cannot be redeliveries
    and all count. A day is cut into ``buckets`` by record id, as many more as the
    session has shuffle partitions, so that no day is one task on a large input.
    """
    buckets = buckets or max(2, int(cost.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    last = F.max(F.struct("received_utc", "latency_ms", "tokens_per_explanation", "cell_id"))
    rows = cost.select(
        "record_id",
        "cell_id",
        F.to_date("measured_utc").alias("day"),
        "received_utc",
        F.col("latency_ms").cast("double").alias("latency_ms"),
        F.col("tokens_per_explanation").cast("double").alias("tokens_per_explanation"),
        F.pmod(F.xxhash64("record_id"), F.lit(buckets)).alias("bucket"),
        F.when(F.col("record_id").isNull(), F.monotonically_increasing_id()).alias("own"),
    ).withColumn("bucket", F.when(F.col("own").isNull(), F.col("bucket")).otherwise(F.pmod("own", F.lit(buckets))))
    once = rows.repartition("day", "bucket").groupBy("day", "bucket", "record_id", "own").agg(last.alias("x"))
    named = once.select("day", "x.*").join(cells.groupBy("cell_id").agg(F.max("generator").alias("generator")), "cell_id", "left")
    return named.select(
        "generator",
        "day",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("latency_ms", "tokens_per_explanation")])),
    ).filter(sound(F.col("value")))


def percentiles(cost: DataFrame, cells: DataFrame, qs: tuple[float, ...] = QUANTILES, k: int = K) -> DataFrame:
    """Percentiles for each generator and metric over all days."""
    keys = ["generator", "metric"]
    return read_quantiles(merge_tree(sketch_partitions(measurements(cost, cells), keys, "value", k), keys, k), keys, qs, k)


def daily_sketches(cost: DataFrame, cells: DataFrame, k: int = K) -> DataFrame:
    """One sketch for each generator, metric and day, to be kept and merged later."""
    keys = ["generator", "metric", "day"]
    return merge_sketches(sketch_partitions(measurements(cost, cells), keys, "value", k), keys, k)


def combine_days(sketches: DataFrame, k: int = K) -> DataFrame:
    """Sketches of days made into one for each generator and metric, by way of months."""
    months = sketches.withColumn("month", F.trunc("day", "month"))
    return merge_sketches(merge_sketches(months, ["generator", "metric", "month"], k), ["generator", "metric"], k)


def rank_check(values: DataFrame, answers: DataFrame) -> DataFrame:
    """For each answer, whether the true rank of its value lies within the bound.

    ``answers`` has one row for each generator, metric and quantile, a size fixed
    by the number of generators; ranks come from one aggregation pass.
    """
    wanted = answers.groupBy("generator", "metric").agg(F.collect_list(F.struct("q", "value", "rank_error")).alias("wanted"))
    counted = (
        values.alias("v")
        .join(F.broadcast(wanted).alias("w"), F.col("v.generator").eqNullSafe(F.col("w.generator")) & (F.col("v.metric") == F.col("w.metric")))
        .select("v.generator", "v.metric", F.col("v.value").alias("x"), F.inline("wanted"))
        .groupBy("generator", "metric", "q", "value", "rank_error")
        .agg(F.count("*").alias("n_values"), F.count_if(F.col("x") <= F.col("value")).alias("upto"), F.count_if(F.col("x") < F.col("value")).alias("below"))
    )
    slack = F.col("rank_error") * F.col("n_values") + 1
    target = F.col("q") * F.col("n_values")
    return counted.select("generator", "metric", "q", "n_values", ((F.col("below") <= target + slack) & (F.col("upto") >= target - slack)).alias("within_bound"))
