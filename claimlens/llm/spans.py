"""Long exact spans shared between records, by seed and extend.

Seeds: the hashes of all ``SEED``-grams of a text are winnowed with a window of
``LENGTH - SEED + 1``, so that two texts sharing a run of ``LENGTH`` code points
share at least one anchor inside it, at known places. Extend: texts that share an
anchor are laid side by side at those places, the match is carried to both sides
as far as the characters agree, and it is kept if it has ``LENGTH`` code points;
anchors inside a match that was carried already are passed over.

The table is read twice: once for hashes and anchors, once for the texts that
share an anchor.

Against quadratic work:
* Exact copies become one class (``class_id``, the least id), and only class
  representatives are compared; copies are expanded where a query asks for pairs.
* Anchors of one class only are dropped before texts move.
* A run of ``LENGTH`` holds ``SEED`` code points of the anchor, so half of the rest
  or more lies on one side of it: two places meet only if the hashes of so many
  code points before or after the anchor agree.
* Anchors that stand at more than ``HOT`` places (boilerplate that a third of the
  rows may carry, or periodic texts) produce no candidate pairs. Their exact way: each text emits the
  digests of the at most ``LENGTH - SEED + 1`` windows of length ``LENGTH`` that hold
  the anchor, and only texts that agree on a whole window are brought together.
  Windows that the same classes have are reduced to one before pairs are made.
* Pairs within a hot group, and those of a class of many copies, are dealt out
  over tasks by blocks of ``BLOCK_ROWS`` members.

Cold pairs are compared character by character; windows of the hot way are equal
by a 128-bit cryptographic digest of their characters.

Defined results: null texts and texts shorter than ``LENGTH`` share nothing;
characters are compared as they stand, in Unicode code points; equal texts of at
least ``LENGTH`` are shared as a whole; a text repeating a passage within itself
only shares nothing; texts that stand under one id count together.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.plans.parallel import deal_out
from claimlens.sources import shared_dir

LENGTH = 200
SEED = 128
HOT = 24
BLOCK_CHARS = 1_000_000
BLOCK_ROWS = 1_000
#: Odd multiplier of the rolling hash, which has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xFF51AFD7ED558CCD)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Hashes of all windows of fixed lengths over one array of code points."""

    def __init__(self, points: np.ndarray, base: int = BASE):
        n = len(points)
        self.inverse = _powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(base, n)[:-1], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        h = (self.sums[k:] - self.sums[:-k]) * self.inverse[:n]
        h ^= h >> np.uint64(33)
        h *= MIX
        return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each window of ``w``, by doubling."""
    span = 1
    while span * 2 <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def winnow(points: np.ndarray, seed: int = SEED, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: every window minimum, all ties."""
    w = length - seed + 1
    h = Roller(points).windows(seed)
    if len(h) < w:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    least = _sliding(h, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, dtype=np.uint64), least, np.zeros(w - 1, dtype=np.uint64)])
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    return at, h[at]


def _blocks(batch: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    sizes = batch[text].str.len().to_numpy().cumsum()
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_CHARS, side="right")))
        yield batch.iloc[at:end]
        at = end


def digest(data: bytes) -> tuple[int, int]:
    made = blake2b(data, digest_size=16).digest()
    return int.from_bytes(made[:8], "little", signed=True), int.from_bytes(made[8:], "little", signed=True)


def signs(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Rows (id, h1, h2, n, anchors, at, beside) of each text: its digest, its length, its anchors and their places.

    ``beside`` holds 31 bits of the hash of the ``(length - seed + 1) // 2`` code points
    before the anchor and 32 of those after it, 0 where there are fewer.
    """
    side = (length - seed + 1) // 2
    low = np.uint64(0x7FFFFFFE)

    def found(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, h = winnow(points, seed, length)
        if not len(at):
            return at, h.view(np.int64), at
        near = (Roller(points).windows(side) & low) | np.uint64(1)
        padded = np.concatenate([np.zeros(side, dtype=np.uint64), near, np.zeros(side, dtype=np.uint64)])
        beside = (padded[at] << np.uint64(32)) | padded[at + seed + side]
        return at, h.view(np.int64), beside.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= BLOCK_CHARS):
                    chars += len(texts[end])
                    end += 1
                marks = [digest(t.encode("utf-8", "surrogatepass")) for t in texts[start:end]]
                made = [found(code_points(t)) for t in texts[start:end]]
                ends = np.concatenate([[0], np.cumsum([len(m[0]) for m in made])]).astype(np.int32)
                flat = [np.concatenate(x) for x in zip(*made, strict=True)]
                listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(kind)))  # noqa: B023, E731
                columns = [ids.slice(start, end - start), pa.array([m[0] for m in marks]), pa.array([m[1] for m in marks]), pa.array([len(t) for t in texts[start:end]], pa.int64()), listed(flat[1], np.int64), listed(flat[0], np.int32), listed(flat[2], np.int64)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "h2", "n", "anchors", "at", "beside"])
                start = end

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, h1 long, h2 long, n long, anchors array<long>, at array<int>, beside array<long>")


def windows_around(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Rows (class_id, w1, w2, at) for all windows holding one of the anchors in ``hot`` (array of longs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _blocks(batch, "text"):
                made = []
                for key, copies, text, hot in zip(part["class_id"], part["copies"], part["text"], part["hot"], strict=True):
                    points = code_points(text)
                    at, h = winnow(points, seed, length)
                    at = at[np.isin(h.view(np.int64), np.asarray(hot, dtype=np.int64))]
                    near = np.unique((at[:, None] + np.arange(-(length - seed), 1)).ravel())
                    near = near[(near >= 0) & (near <= len(points) - length)]
                    made.extend((key, copies, *digest(points[i : i + length].tobytes()), i) for i in near.tolist())
                yield pd.DataFrame(made, columns=["class_id", "copies", "w1", "w2", "at"])

    return docs.mapInPandas(run, "class_id long, copies long, w1 long, w2 long, at long")


def agreeing(a: str, b: str, i: int, j: int) -> int:
    """How many characters of ``a`` from ``i`` on equal those of ``b`` from ``j`` on."""
    most, done, step = min(len(a) - i, len(b) - j), 0, 256
    while done < most:
        m = min(step, most - done)
        if a[i + done : i + done + m] == b[j + done : j + done + m]:
            done, step = done + m, step * 2
        elif m == 1:
            break
        else:
            most, step = done + m, max(1, m // 2)
    return done


def agreeing_back(a: str, b: str, i: int, j: int) -> int:
    """How many characters of ``a`` before ``i`` equal those of ``b`` before ``j``."""
    most, done, step = min(i, j), 0, 64
    while done < most:
        m = min(step, most - done)
        if a[i - done - m : i - done] == b[j - done - m : j - done]:
            done, step = done + m, step * 2
        elif m == 1:
            break
        else:
            most, step = done + m, max(1, m // 2)
    return done


def extended(a: str, b: str, seeds: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Maximal matches (from in ``a``, from in ``b``, size) of ``length`` or more through the seeds (place in ``a``, in ``b``)."""
    out, reached = [], {}
    for i, j in sorted(seeds):
        if reached.get(i - j, -1) > i:
            continue
        after = agreeing(a, b, i, j)
        before = agreeing_back(a, b, i, j)
        reached[i - j] = i + after
        if before + after >= length:
            out.append((i - before, j - before, before + after))
    return out


def blocks(copies: str) -> Column:
    """Number of blocks over which a group of that size is dealt out."""
    return F.ceil(F.col(copies) / BLOCK_ROWS).cast("int")


def pairs_within(members: DataFrame, by: list[str], key: str, size: str) -> DataFrame:
    """Pairs (x, y), x < y, of the members of each group; a large group is joined block by block."""
    one = members.select(*by, F.col(key).alias("x"), F.pmod(F.xxhash64(key), blocks(size)).cast("int").alias("block"))
    two = members.select(*by, F.col(key).alias("y"), F.explode(F.sequence(F.lit(0), blocks(size) - 1)).alias("block"))
    return one.join(two, [*by, "block"]).filter("x < y").select("x", "y")


class SharedSpans:
    """The steps for one table; ``members`` and ``touched`` are stored once in the shared folder."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT):
        if not 0 < seed < length:
            raise ValueError("the seed must be shorter than the span")
        shared_dir(docs.sparkSession)
        self.length, self.seed, self.hot = length, seed, hot
        long_enough = deal_out(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).filter(F.length("text") >= length)
        made = signs(long_enough, length, seed).checkpoint()
        hashed = made.select("id", "h1", "h2", "n").distinct()
        least = hashed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
        #: rows (id, class_id, copies, n) of the texts long enough
        self.members = hashed.join(least, ["h1", "h2"]).select("id", "class_id", "copies", "n").checkpoint()
        firsts = self.members.filter("id = class_id").select("id", "copies")
        found = made.join(firsts, "id").select(F.col("id").alias("class_id"), "copies", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), "at", "beside")).alias("x")).select("class_id", "copies", "x.*")
        # counts are summed before they move
        sizes = found.groupBy("anchor").agg(F.count("*").alias("places"), F.min("class_id").alias("x"), F.max("class_id").alias("y")).filter("x < y")
        #: rows (class_id, copies, anchor, at, beside, hot) of the places of anchors of several classes
        self.touched = found.join(sizes.select("anchor", (F.col("places") > hot).alias("hot")), "anchor").select("class_id", "copies", "anchor", "at", "beside", "hot").checkpoint()
        needed = self.touched.select("class_id").distinct()
        texts = docs.select(F.col(key).alias("class_id"), F.col(text).alias("text")).filter(F.length("text") >= length)
        self.texts = texts.join(needed, "class_id", "left_semi")

    def seeds(self) -> DataFrame:
        """Rows (a, b, copies_a, copies_b, seeds) of pairs of classes that share anchors of few classes, with the places."""
        cold = self.touched.filter("NOT hot").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("class_id", "at", "copies", "beside"))).alias("in"))
        agree = "(x.beside >> 32 = y.beside >> 32 AND x.beside >> 32 <> 0 OR x.beside & 4294967295L = y.beside & 4294967295L AND x.beside & 4294967295L <> 0)"
        later = f"filter(slice(in, n + 2, size(in)), y -> y.class_id > x.class_id AND {agree})"
        every = f"flatten(transform(in, (x, n) -> transform({later}, y -> struct(x.class_id AS a, y.class_id AS b, x.copies AS copies_a, y.copies AS copies_b, x.at AS i, y.at AS j))))"
        pairs = cold.select(F.explode(F.expr(every)).alias("p")).select("p.*")
        return pairs.groupBy("a", "b", "copies_a", "copies_b").agg(F.collect_list(F.struct("i", "j")).alias("seeds"))

    def spans(self) -> DataFrame:
        """Rows (a, b, copies_a, copies_b, spans) of pairs of classes and their maximal matches, from cold anchors."""
        length = self.length
        texts = self.texts
        both = self.seeds().join(texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b")), "b")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["a", "b", "copies_a", "copies_b", "spans"]
            for batch in batches:
                rows = []
                for a, b, m, n, x, y, seeds in zip(batch["a"], batch["b"], batch["copies_a"], batch["copies_b"], batch["text_a"], batch["text_b"], batch["seeds"], strict=True):
                    found = extended(x, y, [(s["i"], s["j"]) for s in seeds], length)
                    if found:
                        rows.append((a, b, m, n, [{"a": i, "b": j, "size": size} for i, j, size in found]))
                yield pd.DataFrame(rows, columns=names)


        return both.mapInPandas(run, "a long, b long, copies_a long, copies_b long, spans array<struct<a: long, b: long, size: long>>")

    def hot_windows(self) -> DataFrame:
        """Rows (w1, w2, class_id, copies, at) of windows around hot anchors that two classes or more have."""
        wanted = self.touched.filter("hot").groupBy("class_id", "copies").agg(F.collect_set("anchor").alias("hot"))
        made = windows_around(self.texts.join(wanted, "class_id"), self.length, self.seed)
        several = made.groupBy("w1", "w2").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).filter("x < y").select("w1", "w2")
        return made.join(several, ["w1", "w2"])

    def hot_pairs(self) -> DataFrame:
        """Pairs (a, b, copies_a, copies_b) of classes that agree on a window around a hot anchor, each set of classes once."""
        near = self.hot_windows().select("w1", "w2", "class_id", "copies").distinct()
        marks = [F.sum(F.xxhash64("class_id", F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}") for i in (1, 2)]
        kinds = near.groupBy("w1", "w2").agg(F.count("*").alias("size"), *marks)
        # windows that the same classes have: one of them stands for all
        chosen = kinds.groupBy("size", "m1", "m2").agg(F.min(F.struct("w1", "w2")).alias("w")).select("w.w1", "w.w2", "size")
        members = near.join(chosen, ["w1", "w2"]).withColumn("of", F.struct("class_id", "copies"))
        one = members.select("w1", "w2", F.col("of").alias("x"), F.pmod(F.xxhash64("class_id"), blocks("size")).cast("int").alias("block"))
        two = members.select("w1", "w2", F.col("of").alias("y"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("block"))
        met = one.join(two, ["w1", "w2", "block"]).filter("x.class_id < y.class_id")
        return met.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"), F.col("x.copies").alias("copies_a"), F.col("y.copies").alias("copies_b"))

    def class_pairs(self) -> DataFrame:
        """Pairs (a, b, copies_a, copies_b) of classes, a < b, that share a run of ``length``."""
        return self.spans().select("a", "b", "copies_a", "copies_b").unionByName(self.hot_pairs()).distinct()

    def pairs(self) -> DataFrame:
        """All pairs (doc_a, doc_b) of documents, copies expanded as p8_found is defined."""
        m = self.members
        inside = pairs_within(m.filter("copies > 1"), ["class_id"], "id", "copies")
        dealt = m.select("class_id", F.col("id"), F.pmod(F.xxhash64("id"), blocks("copies")).cast("int").alias("block"))
        wide = self.class_pairs()
        for side in ("a", "b"):
            split = wide.withColumn("block", F.explode(F.sequence(F.lit(0), blocks(f"copies_{side}") - 1)))
            wide = split.join(dealt.select(F.col("class_id").alias(side), F.col("id").alias(f"id_{side}"), "block"), [side, "block"]).drop("block")
        across = wide.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"))
        return inside.select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b")).unionByName(across).distinct()

    def links(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row for each document: its class, copies of its text, and with how many other texts it shares a run."""
        pairs = self.class_pairs()
        ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
        known = self.members.dropDuplicates(["id"]).join(ends.groupBy("class_id").agg(F.count("*").alias("links")), "class_id", "left")
        every = docs.select(F.col(key).alias("id")).join(known, "id", "left")
        return every.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))

    def parts(self) -> DataFrame:
        """Rows (class_id, lo, hi) of stretches of a class that other classes have too, from cold and hot anchors."""
        ends = F.explode(F.flatten(F.transform("spans", lambda s: F.array(F.struct(F.col("a").alias("class_id"), s["a"].alias("lo"), (s["a"] + s["size"]).alias("hi")), F.struct(F.col("b").alias("class_id"), s["b"].alias("lo"), (s["b"] + s["size"]).alias("hi"))))))
        cold = self.spans().select(ends.alias("x")).select("x.*")
        return cold.unionByName(self.hot_windows().select("class_id", F.col("at").alias("lo"), (F.col("at") + self.length).alias("hi"))).distinct()

    def found(self) -> DataFrame:
        """Rows (doc_id, class_id, from, to) of the maximal shared spans of each document, in code points from 0, ``to`` left out.

        A span is a longest run of neighbouring places at each of which a run of
        ``length`` starts that stands in another document too; a text with an exact
        copy is one span. Texts that overlap by less are spans of their own.
        """
        whole = self.members.filter("copies > 1").select("class_id", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")).distinct()
        spans = merged(self.parts().unionByName(whole), "class_id", self.length)
        ids = self.members.select("class_id", F.col("id").alias("doc_id")).distinct()
        return spans.join(ids, "class_id").select("doc_id", "class_id", F.col("lo").alias("from"), F.col("hi").alias("to"))

    def shares(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """For each row of ``docs``: its class, copies, characters and how many of them stand elsewhere too."""
        covered = cover(self.parts(), "class_id")
        rows = docs.select(F.col(key).alias("id"), F.length(text).cast("long").alias("n_chars"))
        known = self.members.drop("n").dropDuplicates(["id"]).join(covered, "class_id", "left")
        full = F.when(F.coalesce("copies", F.lit(1)) > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0)))
        shared = F.when(F.col("n_chars") >= self.length, full).otherwise(F.lit(0)).cast("long")
        return rows.join(known, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).alias("shared_share"))


def merged(parts: DataFrame, key: str, length: int) -> DataFrame:
    """Rows (key, lo, hi): intervals joined where the places at which their runs of ``length`` start are neighbours."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("lo") > F.col("reach") - length + 1, F.lit(True)).cast("int")
    numbered = parts.withColumn("reach", reach).withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def cover(parts: DataFrame, key: str) -> DataFrame:
    """Length of the union of the intervals [lo, hi) of each key, without collecting them."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.col("reach"), F.col("lo"))))
    return parts.withColumn("reach", reach).groupBy(key).agg(F.sum(gain).alias("shared"))
