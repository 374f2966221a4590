"""Seeded sampling and splitting: order by a hash of seed and key, quotas by rank in the stratum.

A rank inside a stratum is taken in two steps (buckets of the hash, offsets of the
buckets), so that a stratum that holds most rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimlens.operators.flow import FLOW_SQL, flow
from claimlens.plans.parallel import in_order
from claimlens.registry import Registry
from claimlens.sources import load

registry = Registry()


def order_hash(seed: str, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), key))


def stratum_rank(df: DataFrame, strata: list[str], order: str) -> DataFrame:
    """``rn``, 1-based by ``order`` (a hex hash) within the strata, and ``n``, their sizes.

    The first two hex digits cut a stratum into up to 256 buckets in order, so
    bucket offsets plus the rank inside a bucket are the rank.
    """
    cut = df.withColumn("b_", F.substring(order, 1, 2))
    counts = cut.groupBy(*strata, "b_").agg(F.count("*").alias("c_"))
    whole = Window.partitionBy(*strata)
    known = counts.select(*strata, "b_", (F.sum("c_").over(whole.orderBy("b_")) - F.col("c_")).alias("before_"), F.sum("c_").over(whole).alias("n"))
    inside = cut.withColumn("i_", F.row_number().over(Window.partitionBy(*strata, "b_").orderBy(order)))
    return inside.join(known, [*strata, "b_"]).withColumn("rn", F.col("before_") + F.col("i_")).drop("b_", "before_", "i_")


HASHED_SQL = FLOW_SQL + ", h AS (SELECT instance_id, class, md5('7:' || instance_id) AS o FROM flow), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY o) AS rn, count(*) OVER (PARTITION BY class) AS n FROM h)"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow(spark, sf_dir).select("instance_id", "class")
    return stratum_rank(rows.withColumn("o", order_hash("7", F.col("instance_id"))), ["class"], "o")


@registry.add("sp_02_stride_sample", "WITH r AS (SELECT call_id, snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY call_id) AS rn, count(*) OVER (PARTITION BY snapshot_id) AS n FROM llm_calls), s AS (SELECT *, CASE WHEN n > 50 THEN CAST(ceil(n / 50.0) AS BIGINT) ELSE 1 END AS stride FROM r) SELECT snapshot_id, call_id FROM s WHERE (rn - 1) % stride = 0 AND (rn - 1) // stride < 50")
def sp_02_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stride-th row of a source, at most 50; a short source is taken whole."""
    r = in_order(load(spark, sf_dir, "llm_calls").select("call_id", "snapshot_id"), ["snapshot_id"], ["call_id"])
    stride = F.when(F.col("n") > 50, F.ceil(F.col("n") / 50.0)).otherwise(1)
    at = F.col("rn") - 1
    return r.filter((at % stride == 0) & (F.floor(at / stride) < 50)).select("snapshot_id", "call_id")


@registry.add("sp_01_global_cap", "WITH c AS (SELECT snapshot_id, count(*) AS n FROM llm_calls GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY snapshot_id) - n AS before FROM c) SELECT snapshot_id, greatest(0, least(n, (SELECT count(*) // 2 FROM llm_calls) - before))::BIGINT AS taken FROM s WHERE before < (SELECT count(*) // 2 FROM llm_calls)")
def sp_01_global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources in name order until half of all rows are taken; the last one is cut."""
    c = load(spark, sf_dir, "llm_calls").groupBy("snapshot_id").agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))
    s = c.select("snapshot_id", "n", (F.sum("n").over(one.orderBy("snapshot_id")) - F.col("n")).alias("before"), F.floor(F.sum("n").over(one) / 2).alias("cap"))
    return s.filter("before < cap").select("snapshot_id", F.greatest(F.lit(0), F.least("n", F.col("cap") - F.col("before"))).alias("taken"))


_Q = "q AS (SELECT *, least(n, greatest(300 // 3, least(50, n))) AS quota FROM r)"


@registry.add("sp_03_stratified_sample", f"WITH {HASHED_SQL}, {_Q} SELECT class, count(*) FILTER (WHERE rn <= quota) AS picked, count(*) FILTER (WHERE rn > quota) AS competence FROM q GROUP BY 1")
def sp_03_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota min(n, max(N / K, min(floor, n))) for each class; the rest is the competence frame (JN-07)."""
    quota = F.least("n", F.greatest(F.lit(300 // 3), F.least(F.lit(50), "n")))
    picked = F.col("rn") <= quota
    return hashed(spark, sf_dir).groupBy("class").agg(F.count_if(picked).alias("picked"), F.count_if(~picked).alias("competence"))


_SPLIT = "CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train' WHEN rn <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'dev' ELSE 'test' END"


@registry.add("sp_04_stratified_split", f"WITH {HASHED_SQL} SELECT instance_id, {_SPLIT} AS split FROM r")
def sp_04_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir).select("instance_id", "split")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 / 15 / rest in each class, sizes rounded half to even."""
    train, dev = F.rint(F.col("n") * 0.7), F.rint(F.col("n") * 0.15)
    return hashed(spark, sf_dir).withColumn("split", F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + dev, "dev").otherwise("test"))


@registry.add("sp_05_split_counts", f"WITH {HASHED_SQL} SELECT {_SPLIT} AS split, class, count(*) AS n FROM r GROUP BY 1, 2")
def sp_05_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir).groupBy("split", "class").agg(F.count("*").alias("n"))


_AUDIT = "a AS (SELECT explanation_id, generator_id, row_number() OVER (PARTITION BY generator_id ORDER BY md5('11:' || explanation_id)) AS rn FROM explanations)"


def audit_sample(spark: SparkSession, sf_dir: str, quota: int = 40) -> DataFrame:
    """SP-06: ``quota`` explanations of each generator, all where there are fewer."""
    rows = load(spark, sf_dir, "explanations").select("explanation_id", "generator_id")
    return stratum_rank(rows.withColumn("o", order_hash("11", F.col("explanation_id"))), ["generator_id"], "o").filter(F.col("rn") <= quota)


@registry.add("sp_06_audit_sample", f"WITH {_AUDIT} SELECT explanation_id, generator_id FROM a WHERE rn <= 40")
def sp_06_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sample(spark, sf_dir).select("explanation_id", "generator_id")


@registry.add("sp_07_decoys", "WITH c AS (SELECT item_id, feature, row_number() OVER (PARTITION BY item_id ORDER BY md5('13:' || item_id || ':' || feature)) AS rn FROM probe_items, feature_catalog WHERE NOT list_contains(candidates, feature)) SELECT item_id, feature FROM c WHERE rn <= 2")
def sp_07_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unmentioned features for each item, from the fixed list of names, without leaving the row."""
    names = load(spark, sf_dir, "feature_catalog").agg(F.collect_set("feature").alias("all"))
    rows = load(spark, sf_dir, "probe_items").select("item_id", "candidates").crossJoin(F.broadcast(names))
    free = F.array_except("all", "candidates")
    keyed = F.array_sort(F.transform(free, lambda f: F.struct(F.md5(F.concat_ws(":", F.lit("13"), F.col("item_id"), f)).alias("o"), f.alias("f"))))
    return rows.select("item_id", F.explode_outer(F.transform(F.slice(keyed, 1, 2), lambda x: x["f"])).alias("feature")).filter("feature IS NOT NULL")


@registry.add("sp_08_holdout_exclusion", f"WITH {_AUDIT}, k AS (SELECT DISTINCT e.instance_id, e.generator_id FROM explanations e JOIN a USING (explanation_id) WHERE rn <= 40) SELECT e.generator_id, count(*) AS fresh FROM explanations e ANTI JOIN k ON k.instance_id = e.instance_id AND k.generator_id = e.generator_id GROUP BY 1")
def sp_08_holdout_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations whose (instance, generator) no earlier audit used."""
    rows = load(spark, sf_dir, "explanations").select("explanation_id", "instance_id", "generator_id")
    used = rows.join(audit_sample(spark, sf_dir).select("explanation_id"), "explanation_id").select("instance_id", "generator_id").distinct()
    return rows.join(used, ["instance_id", "generator_id"], "left_anti").groupBy("generator_id").agg(F.count("*").alias("fresh"))
