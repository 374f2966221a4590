"""Texts that were cut before their end.

Two kinds of evidence. (1) A self-join by prefix: the different texts (without
a trace of the cut) are range-partitioned and sorted, so a text that is a strict
prefix of a longer copy stands right before the first such copy; the character
that follows in the copy tells whether the text stops inside a word, number or
sentence. Sorting is linear however many texts share a beginning, where a bucket
of equal prefixes would make one task of a boilerplate that a third of the rows
open with. (2) Most cut texts have no longer copy anywhere; for those the shape
of the ending decides (:mod:`claimlens.llm.endings`).

Equal texts are reduced to one before they move; what comes back to the rows is
a 64-bit hash with one flag. Ends of partitions meet the beginning of the next by
a table of two rows for each partition.

Defined results: null, blank and content-free texts and copies of the prompt are
no cases; a text that ends whole where its longer copy goes on with a new line or
sentence is none; replays and redeliveries count each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimlens.llm import pairs
from claimlens.llm.endings import body, has_trace, with_ending, without_trace


def longer_copies(values: DataFrame) -> DataFrame:
    """Rows (h, longer, follows) for each different ``v`` that a longer one starts with.

    ``h`` and ``longer`` are hashes of the text and of the shortest such copy,
    ``follows`` is the character with which the copy goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a column of hashes with nulls would turn to floats, which hold 53 bits only
        number, last, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            out = []
            for v, h in zip(batch["v"], batch["h"], strict=True):
                if first:
                    out.append((number, 0, v, h, pd.NA, None))
                    first = False
                elif v.startswith(last[0]) and len(v) > len(last[0]):
                    out.append((number, 1, None, last[1], h, v[len(last[0])]))
                last = (v, h)
            yield pd.DataFrame(out, columns=["part", "kind", "v", "h", "longer", "follows"]).astype({"longer": "Int64"})
        if last is not None:
            yield pd.DataFrame([(number, 2, last[0], last[1], pd.NA, None)], columns=["part", "kind", "v", "h", "longer", "follows"]).astype({"longer": "Int64"})

    ordered = values.select("v").distinct().select("v", F.xxhash64("v").alias("h")).repartitionByRange("v").sortWithinPartitions("v")
    found = ordered.mapInPandas(run, "part int, kind int, v string, h long, longer long, follows string").checkpoint()
    inside = found.filter("kind = 1").select("h", "longer", "follows")
    # two rows of each partition; a single-rowed one has equal texts in both
    edge = Window.orderBy("part", "kind")
    ends = found.filter("kind <> 1").select("*", F.lead("kind").over(edge).alias("kind_"), F.lead("v").over(edge).alias("v_"), F.lead("h").over(edge).alias("h_"))
    met = ends.filter((F.col("kind") == 2) & (F.col("kind_") == 0) & F.startswith("v_", "v") & (F.length("v_") > F.length("v")))
    return inside.unionByName(met.select("h", F.col("h_").alias("longer"), F.expr("substring(v_, length(v) + 1, 1)").alias("follows")))


def texts_of(calls: DataFrame, explanations: DataFrame) -> DataFrame:
    """Rows (src, row_id, text, prompt) of both tables."""
    one = calls.select(F.lit("llm_calls").alias("src"), F.col("call_id").alias("row_id"), "text", "prompt")
    two = explanations.select(F.lit("explanations").alias("src"), F.col("explanation_id").alias("row_id"), "text", F.lit(None).cast("string").alias("prompt"))
    return one.unionByName(two).filter("text IS NOT NULL")


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (src, row_id, text, prompt) with ``cut`` and ``copy_found`` (a longer copy exists)."""
    base = rows.select("src", "row_id", "text", F.coalesce("prompt", F.lit("")).alias("p"), F.regexp_replace(without_trace(F.col("text")), r"\s+$", "").alias("v"))
    copies = longer_copies(base.filter("v <> ''"))
    shape = with_ending(base, "text", "shape").withColumn("trace", F.col("shape") & has_trace(F.col("text")))
    # only endings that look cut need to be told from answers that give back the prompt
    told = shape.withColumn("told", F.when(F.col("shape"), pairs.instructions(F.col("p")))).withColumn("offered", F.coalesce(pairs.offered(F.col("text"), F.col("told")), F.lit(False)))
    shares = pairs.with_copied_share(told, "text", "p", F.col("shape") & ~F.col("offered") & ~pairs.json_like(F.col("text")), "share")
    bare = F.col("offered") & F.regexp_like(body(F.col("text")), F.lit(r"^[\W_]*\p{L}+[\W_]*$"))
    copied = F.col("share") >= pairs.COPIED_SHARE
    fair = F.col("shape") & (F.length(pairs.left_over(F.col("text"))) > 0) & ~bare & ~copied
    shaped = shares.select("src", "row_id", F.xxhash64("v").alias("h"), "shape", "trace", fair.alias("fair"), copied.alias("copied")).checkpoint()
    echoes = shaped.filter("copied").select("h").distinct()
    near = copies.join(echoes.select(F.col("h").alias("longer"), F.lit(True).alias("echo")), "longer", "left")
    known = near.join(echoes.withColumn("echo_", F.lit(True)), "h", "full").select("h", "longer", "follows", F.coalesce("echo", "echo_").alias("echo"))
    met = shaped.join(known, "h", "left")
    goes_on = F.col("follows").isNotNull() & ~F.regexp_like("follows", F.lit(r"[\s\p{P}]"))
    cut = (F.col("fair") | (~F.col("shape") & F.coalesce(goes_on, F.lit(False)))) & F.col("echo").isNull()
    return met.select("src", "row_id", F.coalesce(cut, F.lit(False)).alias("cut"), F.col("longer").isNotNull().alias("copy_found"), "trace")


def rates(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of cut texts for each source; ``sources`` has (src, row_id, source_kind, source)."""
    met = sources.join(found.select("src", "row_id", "cut", "copy_found"), ["src", "row_id"], "left")
    sums = met.groupBy("source_kind", "source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("copy_found")).alias("with_longer_copy"))
    return sums.withColumn("cut_share", F.col("cut") / F.col("texts"))
