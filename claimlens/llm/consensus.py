"""Consensus labels from annotators who disagree: a community confusion model.

Each annotator belongs to one of ``TYPES`` communities, each with a confusion
matrix (label asserted by the text -> label given) shared by its members; the
annotator's own matrix has a Dirichlet prior centred on the communities' mean,
so few labels leave an annotator at what their type does and many let the own
record speak. Variational updates alternate between the labels of the units and
the matrices.

Shape of the plan: the posterior of a unit depends on who gave which label only, so
units with the same votes are reduced to one pattern with their number (told by
two sums of hashes, which are summed before they move). Rounds run over the
patterns, kept hash-partitioned and sorted in memory and released after the fit: a
round is one pass without a shuffle of votes, in which parameters are looked up
by annotator, log-likelihoods summed over the pattern by a window, and 20 sums for
each annotator shuffled. Up to ``BROADCAST_ANNOTATORS`` annotators (counted first)
the sums come to the driver and the parameters are broadcast. Beyond that they stay
a distributed table, updated where it is by numpy on batches of annotators and
joined over ``SALTS`` copies, so that an annotator of a third of all votes is many
tasks; the driver then sees the communities only, ``TYPES`` x 17 numbers from each
task. Rounds end when no parameter of the communities moves by ``TOLERANCE``.

Defined results: one row for each item and candidate, also without any vote (the
most frequent label then); repeated rows count once; of an annotator's exports
for a feature the last counts (ties: the larger row id); a null or unreadable
label is no vote; candidates that a model pass leaves out are its votes for
``absent``; null items or features are no units; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimlens.llm.mapping import map_rows
from claimlens.sources import shared_dir

#: The labels and other spellings of them, lower case.
LABELS = ("+", "-", "unclear", "absent")
SPELLINGS = {"+": ("+", "＋", "pos", "positive", "plus", "up", "increase", "raises"), "-": ("-", "−", "–", "—", "﹣", "－", "neg", "negative", "minus", "down", "decrease", "lowers"), "unclear": ("unclear", "?", "unsure", "unknown", "ambiguous"), "absent": ("absent", "none", "missing", "not mentioned", "not_mentioned", "n/a")}
TYPES = 4
ROUNDS = 60
TOLERANCE = 1e-3
STRENGTH = 12.0
BROADCAST_ANNOTATORS = 20_000
SALTS = 16
J = len(LABELS)
SUMS = [f"n{v}_{z}" for v in range(J) for z in range(J)]
SHARES = [f"s{z}" for z in range(J)]
LOGS = [f"e{v}_{z}" for v in range(J) for z in range(J)]


def label_index(raw: Column) -> Column:
    """Index in ``LABELS`` of a label however spelt, else null."""
    bare = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}\p{Cf}\"'`*.]+|[\s\p{Z}\p{Cf}\"'`*.]+$", ""))
    return F.coalesce(*[F.when(bare.isin(*SPELLINGS[x]), F.lit(i)) for i, x in enumerate(LABELS)])


def units_of(items: DataFrame) -> DataFrame:
    """Rows (item_id, feature) of all candidates."""
    return items.filter("item_id IS NOT NULL").select("item_id", F.explode("candidates").alias("feature")).filter("feature IS NOT NULL").distinct()


def human_votes(annotations: DataFrame) -> DataFrame:
    last = F.max(F.struct("exported_utc", "row_id", "text_asserts_direction")).alias("x")
    kept = annotations.filter(~F.coalesce("added", F.lit(False))).groupBy("item_id", "feature", "annotator").agg(last)
    return kept.select("item_id", "feature", "annotator", label_index(F.col("x.text_asserts_direction")).alias("vote"))


def pass_votes(passes: DataFrame, units: DataFrame, catalog: DataFrame) -> DataFrame:
    """Votes of model passes; names they typed are mapped to the list of names."""
    last = passes.groupBy("item_id", "annotator").agg(F.max(F.struct("exported_utc", "pass_row_id")).alias("x"))
    kept = passes.join(last.select("item_id", "annotator", F.col("x.pass_row_id").alias("pass_row_id")), ["item_id", "annotator", "pass_row_id"]).dropDuplicates(["item_id", "annotator"])
    said = kept.select("item_id", "annotator", F.posexplode("claims").alias("pos", "c")).select("item_id", "annotator", "pos", F.col("c.feature").alias("value"), F.col("c.dir").alias("dir"))
    names = catalog.select(F.col("feature_id").alias("entry"), F.col("feature").alias("name")).filter("name IS NOT NULL")
    typed = map_rows(said, catalog).join(names, "entry").select("item_id", "annotator", "pos", F.col("name").alias("feature"), "dir")
    exact = said.join(names.select(F.col("name").alias("value")), "value", "left_semi").select("item_id", "annotator", "pos", F.col("value").alias("feature"), "dir")
    first = exact.unionByName(typed).groupBy("item_id", "annotator", "feature").agg(F.min(F.struct("pos", "dir")).alias("x"))
    every = units.join(kept.select("item_id", "annotator"), "item_id").join(first, ["item_id", "annotator", "feature"], "left")
    vote = F.when(F.col("x").isNull(), F.lit(LABELS.index("absent"))).otherwise(label_index(F.col("x.dir")))
    return every.select("item_id", "feature", "annotator", vote.alias("vote"))


def all_votes(items: DataFrame, annotations: DataFrame, passes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (item_id, feature, annotator, vote) of votes on candidates."""
    units = units_of(items)
    human = human_votes(annotations).join(units, ["item_id", "feature"], "left_semi")
    return human.unionByName(pass_votes(passes, units, catalog)).filter("vote IS NOT NULL AND annotator IS NOT NULL")


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


class Communities:
    """Dirichlet parameters of the types' matrices (type, true, given) and of their sizes."""

    def __init__(self, types: int = TYPES):
        right = np.linspace(0.92, 0.45, types)
        self.prior = np.array([np.full((J, J), (1 - r) / (J - 1)) + np.eye(J) * (r - (1 - r) / (J - 1)) for r in right]) * 4 + 0.1
        self.matrix, self.size, self.share = self.prior.copy(), np.ones(types), np.ones(J)

    def belonging(self, counts: np.ndarray) -> np.ndarray:
        """Share of each annotator (a, true, given) in each type."""
        logs = digamma(self.matrix) - digamma(self.matrix.sum(-1, keepdims=True))
        score = np.tensordot(counts, logs, axes=([1, 2], [1, 2])) + digamma(self.size)
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def own(self, counts: np.ndarray) -> np.ndarray:
        """Dirichlet parameters of each annotator's matrix."""
        mean = self.matrix / self.matrix.sum(-1, keepdims=True)
        return STRENGTH * np.tensordot(self.belonging(counts), mean, axes=1) + counts

    def renew(self, belonging: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> None:
        """New parameters from sums over annotators: (types,), (types, true, given), (J,)."""
        self.matrix, self.size, self.share = self.prior + counts, 1 + belonging, 1 + shares

    def means(self) -> np.ndarray:
        """All expected probabilities in one row, to see whether they still move."""
        return np.concatenate([(self.matrix / self.matrix.sum(-1, keepdims=True)).ravel(), self.size / self.size.sum(), self.share / self.share.sum()])

    def log_share(self) -> np.ndarray:
        return digamma(self.share) - digamma(self.share.sum())


def _counts(batch: pd.DataFrame) -> np.ndarray:
    """(annotator, true, given) from the columns ``SUMS``, which run over (given, true)."""
    return batch[SUMS].to_numpy(dtype=float).reshape(-1, J, J).transpose(0, 2, 1)


def _own_logs(counts: np.ndarray, model: Communities) -> np.ndarray:
    """Expected log probability of each vote under each true label, as the columns ``LOGS``."""
    own = model.own(counts)
    logs = digamma(own) - digamma(own.sum(-1, keepdims=True))
    return logs.transpose(0, 2, 1).reshape(-1, J * J)


def _sums(batch: pd.DataFrame, model: Communities) -> np.ndarray:
    """What the communities need from these annotators."""
    counts = _counts(batch)
    b = model.belonging(counts)
    return np.concatenate([b.sum(0), np.tensordot(b.T, counts, axes=1).ravel(), batch[SHARES].to_numpy(dtype=float).sum(0)])


def _rated(batch: pd.DataFrame, model: Communities) -> pd.DataFrame:
    share = model.share / model.share.sum()
    counts = _counts(batch)
    own, b = model.own(counts), model.belonging(counts)
    total = own.sum(-1)
    right = np.einsum("ajj->aj", own) / total
    spread = np.sqrt(((share**2) * right * (1 - right) / (total + 1)).sum(1))
    return pd.DataFrame({"annotator": batch["annotator"].to_numpy(), "votes": counts.sum((1, 2)).round().astype(int), "reliability": (right * share).sum(1), "deviation": spread, "community": b.argmax(1), "belonging": b.max(1)})


RATED = "annotator string, votes long, reliability double, deviation double, community long, belonging double"
#: Two sums of 40-bit hashes over (annotator, vote).
PATTERN = ["p1", "p2"]
BASES = [f"b{z}" for z in range(J)]


class Consensus:
    """A fitted model over ``votes`` (item_id, feature, annotator, vote)."""

    def __init__(self, votes: DataFrame, rounds: int = ROUNDS, types: int = TYPES, most: int = BROADCAST_ANNOTATORS):
        shared_dir(votes.sparkSession)
        self.spark, self.model = votes.sparkSession, Communities(types)
        mark = lambda i: F.sum(F.pmod(F.xxhash64("annotator", "vote", F.lit(i)), F.lit(1 << 40)))
        counts = [F.count_if(F.col("vote") == v).alias(f"c{v}") for v in range(J)]
        #: rows (item_id, feature, PATTERN, m votes, c0.. votes for each label)
        self.units = votes.groupBy("item_id", "feature").agg(mark(1).alias("p1"), mark(2).alias("p2"), F.count("*").alias("m"), *counts).checkpoint()
        kinds = self.units.groupBy(*PATTERN).agg(F.min(F.struct("item_id", "feature")).alias("u"), F.max("m").alias("m"), F.count("*").alias("times"))
        of = votes.join(kinds.select("u.*", *PATTERN, "m", "times"), ["item_id", "feature"])
        self.patterns = of.select(*PATTERN, "m", "times", "annotator", "vote").repartition(*PATTERN).sortWithinPartitions(*PATTERN).persist()
        names = self.patterns.select("annotator").distinct()
        self.few = names.count() <= most
        nothing = names.select("annotator", *[F.lit(0.0).alias(c) for c in (*SUMS, *SHARES)])
        self.stats = nothing.toPandas() if self.few else nothing.checkpoint()
        for _ in range(rounds):
            before = self.model.means()
            made = self._round()
            self.stats = made.toPandas() if self.few else made.checkpoint()
            self.model.renew(*self._community_sums())
            if np.abs(self.model.means() - before).max() < TOLERANCE:
                break
        self.posteriors = self._scored().select(*PATTERN, *[f"q{z}" for z in range(J)]).dropDuplicates(PATTERN).checkpoint()
        self.patterns.unpersist()

    def _community_sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        model, types = self.model, len(self.model.size)
        total = np.zeros(types * (1 + J * J) + J)
        if self.few:
            total += _sums(self.stats, model) if len(self.stats) else 0
        else:

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield pd.DataFrame({"sums": [_sums(batch, model)]})

            for row in self.stats.mapInPandas(run, "sums array<double>").collect():
                total += np.array(row["sums"])
        return total[:types], total[types : types * (1 + J * J)].reshape(types, J, J), total[types * (1 + J * J) :]

    def _with_logs(self) -> DataFrame:
        """``patterns`` with the columns ``LOGS`` of each vote's annotator and ``BASES``, the log shares of the labels.

        The shares come as columns, since as constants they would have the code of every round compiled anew.
        """
        model, base = self.model, self.model.log_share()
        kind = "annotator string, " + ", ".join(f"{c} double" for c in (*LOGS, *BASES))

        def table(batch: pd.DataFrame) -> pd.DataFrame:
            logs = pd.DataFrame(_own_logs(_counts(batch), model), columns=LOGS)
            logs.insert(0, "annotator", batch["annotator"].to_numpy())
            return logs.assign(**dict(zip(BASES, base.tolist(), strict=True)))

        if self.few:
            return self.patterns.join(F.broadcast(self.spark.createDataFrame(table(self.stats), kind)), "annotator")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield table(batch)

        logs = self.stats.mapInPandas(run, kind).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return self.patterns.withColumn("salt", F.pmod("p1", F.lit(SALTS)).cast("int")).join(logs, ["annotator", "salt"]).drop("salt")

    def _scored(self) -> DataFrame:
        """Votes of the patterns with the posterior ``q0..`` of their unit."""
        met = self._with_logs()
        unit = Window.partitionBy(*PATTERN)
        for z in range(J):
            given = F.coalesce(*[F.when(F.col("vote") == v, F.col(f"e{v}_{z}")) for v in range(J)])
            met = met.withColumn(f"g{z}", given + F.col(f"b{z}") / F.col("m"))
        kept = [*PATTERN, "m", "times", "annotator", "vote"]
        scored = met.select(*kept, *[F.sum(f"g{z}").over(unit).alias(f"l{z}") for z in range(J)])
        top = F.greatest(*[f"l{z}" for z in range(J)])
        raised = scored.select(*kept, *[F.exp(F.col(f"l{z}") - top).alias(f"x{z}") for z in range(J)])
        total = sum((F.col(f"x{z}") for z in range(1, J)), F.col("x0"))
        return raised.select(*kept, *[(F.col(f"x{z}") / total).alias(f"q{z}") for z in range(J)])

    def _round(self) -> DataFrame:
        sums = [F.sum(F.when(F.col("vote") == v, F.col(f"q{z}") * F.col("times")).otherwise(0.0)).alias(f"n{v}_{z}") for v in range(J) for z in range(J)]
        shares = [F.sum(F.col(f"q{z}") * F.col("times") / F.col("m")).alias(f"s{z}") for z in range(J)]
        return self._scored().groupBy("annotator").agg(*sums, *shares)

    def labels(self, units: DataFrame) -> DataFrame:
        """One row for each unit: label, its probability, votes and the share of pairs of votes that agree."""
        one = self.units.join(self.posteriors, PATTERN).withColumnRenamed("m", "votes")
        best = F.array_max(F.array(*[F.struct(F.col(f"q{z}").alias("q"), F.lit(-z).alias("at")) for z in range(J)]))
        names = F.array(*[F.lit(x) for x in LABELS])
        pairs = sum((F.col(f"c{v}") * (F.col(f"c{v}") - 1) for v in range(1, J)), F.col("c0") * (F.col("c0") - 1))
        done = one.withColumn("best", best).select("item_id", "feature", F.get(names, -F.col("best.at")).alias("label"), F.col("best.q").alias("probability"), "votes", F.when(F.col("votes") > 1, pairs / (F.col("votes") * (F.col("votes") - 1))).alias("agreement"))
        usual = int(np.argmax(self.model.share))
        filled = units.join(done, ["item_id", "feature"], "left")
        return filled.select("item_id", "feature", F.coalesce("label", F.lit(LABELS[usual])).alias("label"), F.coalesce("probability", F.lit(float(self.model.share[usual] / self.model.share.sum()))).alias("probability"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), "agreement")

    def annotators(self) -> DataFrame:
        """For each annotator: votes, expected accuracy with its deviation, and type."""
        model = self.model
        if self.few:
            return self.spark.createDataFrame(_rated(self.stats, model), RATED)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _rated(batch, model)

        return self.stats.mapInPandas(run, RATED)


def alpha(votes: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels over units of two votes or more, and raw agreement."""
    per = votes.groupBy("item_id", "feature").agg(F.count("*").alias("m"), *[F.count_if(F.col("vote") == v).alias(f"c{v}") for v in range(J)]).filter("m > 1")
    same = sum((F.col(f"c{v}") * (F.col(f"c{v}") - 1) for v in range(1, J)), F.col("c0") * (F.col("c0") - 1))
    sums = per.agg(F.count("*").alias("units"), F.sum("m").alias("n"), F.sum(same / (F.col("m") - 1)).alias("same"), *[F.sum(f"c{v}").alias(f"t{v}") for v in range(J)])
    chance = sum((F.col(f"t{v}") * (F.col(f"t{v}") - 1) for v in range(1, J)), F.col("t0") * (F.col("t0") - 1))
    observed = 1 - F.try_divide("same", "n")
    expected = 1 - F.try_divide(chance, F.col("n") * (F.col("n") - 1))
    return sums.select("units", F.col("n").alias("votes"), (1 - observed).alias("agreement"), (1 - F.try_divide(observed, expected)).alias("alpha"))
