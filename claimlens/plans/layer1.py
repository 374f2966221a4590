"""Claim metrics against the attribution, averaged by decision class.

Metrics are functions of one row, so the only shuffle is the final group by of
a handful of partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import attribution as A
from claimlens.operators.flow import CLAIMS_SQL, FEATURES, PHI_SQL, audited, names
from claimlens.registry import Registry

registry = Registry()


def metric_columns(claims: Column, top: Column, known: Column) -> dict[str, Column]:
    """L1-12: all nine metrics by name."""
    pairs = A.arc_pairs(claims, top)
    return {
        "mention_precision": A.mention_precision(claims, top),
        "mention_recall": A.mention_recall(claims, top),
        "mention_f1": A.mention_f1(claims, top),
        "dsa": A.dsa(claims, top),
        "dsa_asserted": A.dsa_asserted(claims, top),
        "direction_assertion_rate": A.direction_assertion_rate(claims, top),
        "hfr": A.hfr(claims, known),
        "arc": A.ordinal_spearman(pairs),
        "arc_n_pairs": F.size(pairs).cast("double"),
    }


def measured(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each flow with its metrics as columns; only those asked for are made.

    What several metrics read (the claims on listed features, those of them with a
    stated direction, the pairs of ranks) is a column of its own. A claim on a listed
    feature stays one when only such claims are looked at, so the metrics may start there.
    """
    wanted = [m for m in METRICS if only is None or m in only]
    there, said, pairs, known = F.col("there_"), F.col("said_"), F.col("pairs_"), F.size("there_")
    rows = audited(spark, sf_dir)
    if {"mention_precision", "mention_f1", "dsa", "dsa_asserted", "direction_assertion_rate"} & {*wanted}:
        rows = rows.withColumn("there_", A.present(F.col("claims"), F.col("top")))
    if {"dsa_asserted", "direction_assertion_rate"} & {*wanted}:
        rows = rows.withColumn("said_", A.asserted(there))
    if {"arc", "arc_n_pairs"} & {*wanted}:
        rows = rows.withColumn("pairs_", A.arc_pairs(F.col("claims"), F.col("top")))
    if "mention_f1" in wanted:
        rows = rows.withColumn("mention_precision", A.share(known, F.size("claims"))).withColumn("mention_recall", A.mention_recall(F.col("claims"), F.col("top")))
    p, r = F.col("mention_precision"), F.col("mention_recall")
    made = metric_columns(F.col("claims"), F.col("top"), names()) | {
        "mention_precision": A.share(known, F.size("claims")),
        "mention_f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)),
        "dsa": A.share(F.size(A.agreeing(there, F.col("top"))), known),
        "dsa_asserted": A.share(F.size(A.agreeing(said, F.col("top"))), F.size(said)),
        "direction_assertion_rate": A.share(F.size(said), known),
        "arc": A.ordinal_spearman(pairs),
        "arc_n_pairs": F.size(pairs).cast("double"),
    }
    if "mention_f1" in wanted:
        made |= {"mention_precision": p, "mention_recall": r}
    return rows.select("instance_id", "class", "l_orderkey", *[made[m].alias(m) for m in wanted])


#: Every metric in long SQL form: joins and windows where the engine uses arrays.
MEASURED_SQL = CLAIMS_SQL + """,
j AS (SELECT c.*, t.rank AS ref_rank, t.direction AS ref_direction FROM claims_ c LEFT JOIN topk t ON t.instance_id = c.instance_id AND t.feature = c.feature),
pairs AS (SELECT instance_id, pos, rank AS x, ref_rank AS y, row_number() OVER (PARTITION BY instance_id ORDER BY rank, pos) AS rx,
  row_number() OVER (PARTITION BY instance_id ORDER BY ref_rank, pos) AS ry FROM j WHERE rank IS NOT NULL AND ref_rank IS NOT NULL),
arc AS (SELECT instance_id, count(*) AS n, sum((rx - ry) * (rx - ry)) AS d2 FROM pairs GROUP BY 1),
agg AS (SELECT instance_id, count(*) AS n, count(ref_rank) AS hits, count(DISTINCT CASE WHEN ref_rank IS NOT NULL THEN feature END) AS found,
  count(*) FILTER (WHERE ref_rank IS NOT NULL AND direction = ref_direction) AS agree,
  count(*) FILTER (WHERE ref_rank IS NOT NULL AND direction_evidence IS DISTINCT FROM 'default') AS said,
  count(*) FILTER (WHERE ref_rank IS NOT NULL AND direction_evidence IS DISTINCT FROM 'default' AND direction = ref_direction) AS said_right,
  count(*) FILTER (WHERE feature NOT IN ('quantity', 'price', 'discount', 'tax')) AS strange FROM j GROUP BY 1),
m0 AS (SELECT i.instance_id, i.class, i.l_orderkey,
  CASE WHEN coalesce(a.n, 0) > 0 THEN a.hits / a.n::DOUBLE ELSE 0.0 END AS mention_precision, coalesce(a.found, 0) / 3.0 AS mention_recall,
  CASE WHEN coalesce(a.hits, 0) > 0 THEN a.agree / a.hits::DOUBLE ELSE 0.0 END AS dsa,
  CASE WHEN coalesce(a.said, 0) > 0 THEN a.said_right / a.said::DOUBLE ELSE 0.0 END AS dsa_asserted,
  CASE WHEN coalesce(a.hits, 0) > 0 THEN a.said / a.hits::DOUBLE ELSE 0.0 END AS direction_assertion_rate,
  CASE WHEN coalesce(a.n, 0) > 0 THEN a.strange / a.n::DOUBLE ELSE 0.0 END AS hfr,
  CASE WHEN coalesce(r.n, 0) >= 2 THEN 1 - 6.0 * r.d2 / (r.n * (r.n * r.n - 1)) ELSE 0.0 END AS arc, coalesce(r.n, 0)::DOUBLE AS arc_n_pairs
  FROM inst i LEFT JOIN agg a ON a.instance_id = i.instance_id LEFT JOIN arc r ON r.instance_id = i.instance_id),
m AS (SELECT *, CASE WHEN mention_precision + mention_recall > 0 THEN 2 * mention_precision * mention_recall / (mention_precision + mention_recall) ELSE 0.0 END AS mention_f1 FROM m0)"""

METRICS = ("mention_precision", "mention_recall", "mention_f1", "dsa", "dsa_asserted", "direction_assertion_rate", "hfr", "arc", "arc_n_pairs")
IDS = {"mention_precision": "l1_01", "mention_recall": "l1_02", "mention_f1": "l1_03", "dsa": "l1_04", "dsa_asserted": "l1_06", "direction_assertion_rate": "l1_07", "hfr": "l1_08", "arc": "l1_10", "arc_n_pairs": "l1_11"}


def _by_class(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = measured(spark, sf_dir, (metric,))
        return rows.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias(metric))

    return query


for _metric in METRICS:
    registry.add(f"{IDS[_metric]}_{_metric}", f"WITH {MEASURED_SQL} SELECT class, count(*) AS n, round(avg({_metric}), 6) AS {_metric} FROM m GROUP BY 1")(_by_class(_metric))


@registry.add(
    "l1_05_asserted",
    f"WITH {CLAIMS_SQL} SELECT class, count(*) AS claims, count(*) FILTER (WHERE direction_evidence IS DISTINCT FROM 'default') AS asserted FROM claims_ GROUP BY 1",
)
def l1_05_asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select("class", F.size("claims").alias("n"), F.size(A.asserted(F.col("claims"))).alias("a"))
    return rows.groupBy("class").agg(F.sum("n").alias("claims"), F.sum("a").alias("asserted"))


@registry.add("l1_09_arc_pairs", f"WITH {MEASURED_SQL} SELECT x AS claimed_rank, y AS reference_rank, count(*) AS pairs FROM pairs GROUP BY 1, 2")
def l1_09_arc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = audited(spark, sf_dir).select(F.inline_outer(A.arc_pairs(F.col("claims"), F.col("top")))).filter("x IS NOT NULL")
    return pairs.groupBy(F.col("x").alias("claimed_rank"), F.col("y").alias("reference_rank")).agg(F.count("*").alias("pairs"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM-11: the metric fact table (instance_id, class, metric, value)."""
    return measured(spark, sf_dir).unpivot(["instance_id", "class"], list(METRICS), "metric", "value")


@registry.add(
    "l1_12_compute_all",
    f"WITH {MEASURED_SQL} SELECT class, metric, count(*) AS n, round(avg(value), 6) AS mean FROM (UNPIVOT (SELECT instance_id, class, {', '.join(METRICS)} FROM m) ON {', '.join(METRICS)} INTO NAME metric VALUE value) GROUP BY 1, 2",
)
def l1_12_compute_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages first, then one row for each metric, so that no flow is opened nine times."""
    wide = measured(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])
    return wide.unpivot(["class", "n"], list(METRICS), "metric", "mean")


@registry.add(
    "l1_13_gated_mean",
    f"""WITH {MEASURED_SQL} SELECT 'dsa_asserted' AS metric, class, count(*) AS n, round(avg(dsa_asserted), 6) AS gated_mean FROM m WHERE direction_assertion_rate > 0 GROUP BY 2
    UNION ALL SELECT 'arc', class, count(*), round(avg(arc), 6) FROM m WHERE arc_n_pairs >= 2 GROUP BY 2""",
)
def l1_13_gated_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural zeros are left out, not averaged: each metric has the gate that says it is defined (PF-12)."""
    m = measured(spark, sf_dir, ("dsa_asserted", "direction_assertion_rate", "arc", "arc_n_pairs"))
    gated = m.select("class", F.inline_outer(F.array(F.struct(F.lit("dsa_asserted").alias("metric"), F.col("dsa_asserted").alias("value"), (F.col("direction_assertion_rate") > 0).alias("kept")), F.struct(F.lit("arc").alias("metric"), F.col("arc").alias("value"), (F.col("arc_n_pairs") >= 2).alias("kept")))))
    return gated.filter("kept").groupBy("metric", "class").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("gated_mean"))


@registry.add("wn_01_ranked_features", f"WITH {PHI_SQL} SELECT class, rank, feature, direction, count(*) AS n FROM ranked GROUP BY ALL")
def wn_01_ranked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select("class", F.inline_outer("ranked"))
    return rows.groupBy("class", "rank", "feature", "direction").agg(F.count("*").alias("n"))


@registry.add("wn_02_ranked_topk", f"WITH {PHI_SQL} SELECT class, rank, count(*) AS n, round(sum(abs(phi)), 4) AS weight FROM ranked WHERE rank <= 2 GROUP BY 1, 2")
def wn_02_ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select("class", F.inline_outer(F.slice("ranked", 1, 2)))
    return rows.groupBy("class", "rank").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("value")), 4).alias("weight"))


@registry.add("jn_05_semi_join", f"WITH {CLAIMS_SQL} SELECT c.feature, count(*) AS claims FROM claims_ c SEMI JOIN topk t ON t.instance_id = c.instance_id AND t.feature = c.feature GROUP BY 1")
def jn_05_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``present`` over long rows: claims on a feature of the reference list."""
    rows = audited(spark, sf_dir)
    claims = rows.select("instance_id", F.inline_outer("claims")).filter("feature IS NOT NULL")
    return claims.join(rows.select("instance_id", F.inline_outer("top")).select("instance_id", "feature"), ["instance_id", "feature"], "left_semi").groupBy("feature").agg(F.count("*").alias("claims"))


@registry.add("jn_06_anti_join", f"WITH {CLAIMS_SQL} SELECT class, feature, count(*) AS claims FROM claims_ c ANTI JOIN (SELECT DISTINCT feature FROM phi) k ON k.feature = c.feature GROUP BY 1, 2")
def jn_06_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir)
    known = spark.createDataFrame([(n,) for n in FEATURES], "feature string")
    return rows.select("class", F.inline_outer("claims")).filter("feature IS NOT NULL").join(known, "feature", "left_anti").groupBy("class", "feature").agg(F.count("*").alias("claims"))
