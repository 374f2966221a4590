"""Queries of the training-data problems; each reads whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import consensus, encode, mapping, packing, pairs, quantiles, spans, truncation
from claimlens.plans.parallel import deal_out
from claimlens.sources import load, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every day and, with ``day`` null, of all days joined from the sketches of the days."""
    shared_dir(spark)
    daily = quantiles.daily_sketches(load(spark, sf_dir, "cost_metrics"), load(spark, sf_dir, "cells")).checkpoint()
    joined = quantiles.combine_days(daily).withColumn("day", F.lit(None).cast("date"))
    return quantiles.read_quantiles(daily.unionByName(joined), ["generator", "metric", "day"])


def p1_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days at once, with the least that can be moved."""
    return quantiles.percentiles(load(spark, sf_dir, "cost_metrics"), load(spark, sf_dir, "cells"))


def p1_days_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether percentiles made by joining the sketches of days keep the bound; the ranks are exact."""
    cost, cells = load(spark, sf_dir, "cost_metrics"), load(spark, sf_dir, "cells")
    joined = quantiles.combine_days(quantiles.daily_sketches(cost, cells))
    answers = quantiles.read_quantiles(joined, ["generator", "metric"])
    return quantiles.rank_check(quantiles.measurements(cost, cells), answers)


def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.occurrences(load(spark, sf_dir, "claims"), load(spark, sf_dir, "annotations"), load(spark, sf_dir, "llm_passes"))
    return mapping.map_rows(rows, load(spark, sf_dir, "feature_catalog"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_names(spark, sf_dir).select("src", "row_id", "pos", F.col("entry").alias("feature_id"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with how often and where they were typed."""
    rows = mapping.occurrences(load(spark, sf_dir, "claims"), load(spark, sf_dir, "annotations"), load(spark, sf_dir, "llm_passes"))
    catalog = load(spark, sf_dir, "feature_catalog")
    typed = mapping.cases(rows, catalog).groupBy("value", "src").agg(F.count("*").alias("times"))
    named = mapping.map_values(typed.select("value"), catalog).filter("entry > 0")
    return typed.join(named, "value", "left_anti").select("src", "value", "times")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first defect of each defective answer.

    A filter on ``defect`` itself would be pushed below the rules and work them all
    out a second time, nested; the position that a generator gives stays above it.
    """
    every = pairs.checked(deal_out(load(spark, sf_dir, "llm_calls").select("call_id", "prompt", "text"))).select("call_id", F.posexplode_outer("defects").alias("at", "defect"))
    return every.filter("at = 0").select("call_id", "defect")


def p3_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered type by model snapshot, with how often a fallback was taken."""
    calls = pairs.checked(deal_out(load(spark, sf_dir, "llm_calls"))).select("call_id", "request_hash", "snapshot_id", "defects")
    used = pairs.fallbacks(load(spark, sf_dir, "explanations"))
    each = calls.join(used, "request_hash", "left").select("snapshot_id", "fallback", F.explode_outer("defects").alias("defect"))
    return each.groupBy("snapshot_id", F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count("*").alias("answers"), F.count_if("fallback").alias("fallbacks"))


def fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, consensus.Consensus]:
    shared_dir(spark)
    items = load(spark, sf_dir, "probe_items")
    votes = consensus.all_votes(items, load(spark, sf_dir, "annotations"), load(spark, sf_dir, "llm_passes"), load(spark, sf_dir, "feature_catalog")).checkpoint()
    return items, votes, consensus.Consensus(votes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, model = fitted(spark, sf_dir)
    return model.labels(consensus.units_of(items)).select("item_id", "feature", "label")


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, model = fitted(spark, sf_dir)
    return model.labels(consensus.units_of(items))


def p4_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[2].annotators()


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = consensus.all_votes(load(spark, sf_dir, "probe_items"), load(spark, sf_dir, "annotations"), load(spark, sf_dir, "llm_passes"), load(spark, sf_dir, "feature_catalog"))
    return consensus.alpha(votes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    rows = truncation.texts_of(load(spark, sf_dir, "llm_calls"), load(spark, sf_dir, "explanations"))
    return truncation.judged(rows).filter("cut").select("src", "row_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts for each model snapshot and generator."""
    shared_dir(spark)
    calls, texts = load(spark, sf_dir, "llm_calls"), load(spark, sf_dir, "explanations")
    found = truncation.judged(truncation.texts_of(calls, texts))
    one = calls.select(F.lit("llm_calls").alias("src"), F.col("call_id").alias("row_id"), F.lit("snapshot").alias("source_kind"), F.col("snapshot_id").alias("source"))
    two = texts.select(F.lit("explanations").alias("src"), F.col("explanation_id").alias("row_id"), F.lit("generator").alias("source_kind"), F.col("generator_id").alias("source"))
    return truncation.rates(found, one.unionByName(two))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(load(spark, sf_dir, "documents"), keep=("doc_id",))


def p6_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters by stated language; the ratio shows what the vocabulary costs a language."""
    docs = load(spark, sf_dir, "documents").withColumn("code_points", F.coalesce(F.length("text"), F.lit(0)))
    sizes = encode.encode(docs, out="tokens", sizes_only=True, keep=("lang", "code_points"))
    sums = sizes.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("code_points").alias("chars"))
    return sums.withColumn("tokens_per_char", F.when(F.col("chars") > 0, F.col("tokens") / F.col("chars")))


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of every document, stored once as packing reads it several times."""
    shared_dir(spark)
    return encode.encode(load(spark, sf_dir, "documents"), out="tokens", sizes_only=True, keep=("doc_id",)).checkpoint()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = {r["budget_name"]: r["capacity_tokens"] for r in load(spark, sf_dir, "pack_budgets").collect()}
    return packing.pack_all(spark, token_sizes(spark, sf_dir), "doc_id", "tokens", budgets)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(load(spark, sf_dir, "documents")).pairs()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared passages themselves, as places in each document that has them."""
    return spans.SharedSpans(load(spark, sf_dir, "documents")).found()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return spans.SharedSpans(docs).shares(docs)


def p8_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts that share a run, by the least id of each; copies are in ``p8_links``."""
    return spans.SharedSpans(load(spark, sf_dir, "documents")).class_pairs().select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "copies_a", "copies_b")


def p8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class, copies and number of other texts that share a run with it."""
    docs = load(spark, sf_dir, "documents")
    return spans.SharedSpans(docs).links(docs)


QUERIES: dict[str, Query] = {
    "p1_percentiles": p1_percentiles,
    "p1_overall": p1_overall,
    "p1_days_joined": p1_days_joined,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p3_defects": p3_defects,
    "p4_found": p4_found,
    "p4_labels": p4_labels,
    "p4_annotators": p4_annotators,
    "p4_agreement": p4_agreement,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_ids": p6_ids,
    "p6_by_language": p6_by_language,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_shares": p8_shares,
    "p8_class_pairs": p8_class_pairs,
    "p8_links": p8_links,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
