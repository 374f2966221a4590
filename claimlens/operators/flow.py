"""The flow table and what is derived from it row by row: scores, attributions, claims.

Flows are order lines: four scaled measures, a linear detector, the attribution
``weight * (x - background)``, and claims that deviate from the attribution in
known ways, so that every claim metric takes more than one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import attribution as A
from claimlens.plans.parallel import deal_out
from claimlens.sources import load

FEATURES = ("quantity", "price", "discount", "tax")
WEIGHTS = {"quantity": 0.4, "price": -0.3, "discount": 0.25, "tax": 0.15}
BIAS = 0.2
BACKGROUND = 0.5
TOP_K = 3

#: The same derivation in SQL: one row for each instance, then long forms.
FLOW_SQL = """flow AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS instance_id,
    l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'A' THEN 'DoS' ELSE 'Probe' END AS class,
    l_quantity / 50.0 AS x0, l_extendedprice / 100000.0 AS x1, l_discount * 10.0 AS x2, l_tax * 12.5 AS x3 FROM lineitem),
scored AS (SELECT *, greatest(0.0, least(1.0, 0.2 + 0.4 * x0 + -0.3 * x1 + 0.25 * x2 + 0.15 * x3)) AS p FROM flow)"""
PHI_SQL = FLOW_SQL + """,
phi AS (
  SELECT instance_id, class, l_orderkey, l_linenumber, p, 0 AS idx, 'quantity' AS feature, x0 AS x, 0.4 * (x0 - 0.5) AS phi FROM scored
  UNION ALL SELECT instance_id, class, l_orderkey, l_linenumber, p, 1, 'price', x1, -0.3 * (x1 - 0.5) FROM scored
  UNION ALL SELECT instance_id, class, l_orderkey, l_linenumber, p, 2, 'discount', x2, 0.25 * (x2 - 0.5) FROM scored
  UNION ALL SELECT instance_id, class, l_orderkey, l_linenumber, p, 3, 'tax', x3, 0.15 * (x3 - 0.5) FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY abs(phi) DESC, idx) AS rank,
  CASE WHEN phi >= 0 THEN '+' ELSE '-' END AS direction FROM phi)"""
CLAIMS_SQL = PHI_SQL + """,
topk AS (SELECT * FROM ranked WHERE rank <= 3),
claims_ AS (
  SELECT instance_id, class, rank AS pos,
    CASE WHEN m = 2 THEN 'ghost' ELSE feature END AS feature,
    CASE WHEN m = 3 THEN NULL WHEN m = 1 THEN CASE direction WHEN '+' THEN '-' ELSE '+' END ELSE direction END AS direction,
    CASE WHEN m = 7 THEN NULL WHEN m = 6 THEN 5 - rank ELSE rank END AS rank,
    abs(phi) AS magnitude,
    CASE WHEN m = 3 THEN 'default' WHEN m = 4 THEN NULL WHEN m = 5 THEN 'number' ELSE 'word' END AS direction_evidence
  FROM (SELECT *, (l_orderkey * 7 + l_linenumber * 3 + rank) % 11 AS m FROM ranked) WHERE m <> 0),
inst AS (SELECT instance_id, class, p, l_orderkey FROM scored)"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM-01: instance_id, class, names and values, with the score ``p``."""
    line = load(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd"))
    kind = F.when(F.col("l_returnflag") == "N", "BENIGN").when(F.col("l_returnflag") == "A", "DoS").otherwise("Probe")
    x = F.array(F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 100000.0, F.col("l_discount") * 10.0, F.col("l_tax") * 12.5)
    return line.select(key.alias("instance_id"), kind.alias("class"), "l_orderkey", "l_linenumber", x.alias("x")).withColumn("p", score(F.col("x")))


def names() -> Column:
    return F.array(*[F.lit(n) for n in FEATURES])


def background() -> Column:
    return F.array(*[F.lit(BACKGROUND) for _ in FEATURES])


def score(x: Column) -> Column:
    return A.linear_score(FEATURES, x, WEIGHTS, BIAS)


def with_attribution(df: DataFrame) -> DataFrame:
    """``phi`` in the order of the names and ``ranked`` by size."""
    weights = F.array(*[F.lit(WEIGHTS[n]) for n in FEATURES])
    phi = F.zip_with(weights, "x", lambda w, v: w * (v - BACKGROUND))
    return df.withColumn("phi", phi).withColumn("ranked", A.ranked(names(), F.col("phi")))


def with_claims(df: DataFrame) -> DataFrame:
    """``claims`` made from the ranking, and ``top``, the first ``TOP_K`` of it."""
    seed = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3

    def said(r: Column) -> Column:
        m = r["m"]
        return F.struct(
            F.when(m == 2, "ghost").otherwise(r["feature"]).alias("feature"),
            F.when(m == 3, None).when(m == 1, A.flipped(r["direction"])).otherwise(r["direction"]).alias("direction"),
            F.when(m == 7, None).when(m == 6, 5 - r["rank"]).otherwise(r["rank"]).cast("int").alias("rank"),
            F.abs(r["value"]).alias("magnitude"),
            F.when(m == 3, "default").when(m == 4, None).when(m == 5, "number").otherwise("word").alias("direction_evidence"),
        )

    # the kind of deviation is made once for each feature
    marked = F.transform("ranked", lambda r: F.struct(r["feature"].alias("feature"), r["value"].alias("value"), r["direction"].alias("direction"), r["rank"].alias("rank"), ((F.col("seed_") + r["rank"]) % 11).alias("m")))
    kept = F.filter(marked, lambda r: r["m"] != 0)
    return df.withColumn("seed_", seed).withColumn("claims", F.transform(kept, said)).withColumn("top", F.slice("ranked", 1, TOP_K)).drop("seed_")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with attribution and claims."""
    return with_claims(with_attribution(deal_out(flow(spark, sf_dir))))
