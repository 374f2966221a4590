"""Detectors, their probabilities and margins, exact attribution of trees, and gates on metric rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import attribution as A
from claimlens.functions import corruption as C
from claimlens.operators import models as M
from claimlens.operators import trees as T
from claimlens.operators.flow import CLAIMS_SQL, FLOW_SQL, PHI_SQL, audited, flow
from claimlens.plans.generation import judge_scores
from claimlens.plans.layer1 import MEASURED_SQL, metric_rows
from claimlens.registry import Registry
from claimlens.sources import load, shared_dir

registry = Registry()

#: A fixed tree over quantity and discount with known covers.
TREE = [T.Node(100, 0.0, 0, 0.5, 1, 2), T.Node(60, 0.0, 1, 0.5, 3, 4), T.Node(40, 0.0, 1, 0.3, 5, 6), T.Node(36, 0.1), T.Node(24, 0.4), T.Node(10, 0.5), T.Node(30, 0.9)]
_TREE_SQL = (
    FLOW_SQL
    + """, t0 AS (SELECT class, instance_id, 0.6 * (0.6 * 0.1 + 0.4 * 0.4) + 0.4 * (0.25 * 0.5 + 0.75 * 0.9) AS f,
  CASE WHEN x0 <= 0.5 THEN 0.6 * 0.1 + 0.4 * 0.4 ELSE 0.25 * 0.5 + 0.75 * 0.9 END AS fa,
  0.6 * (CASE WHEN x2 <= 0.5 THEN 0.1 ELSE 0.4 END) + 0.4 * (CASE WHEN x2 <= 0.3 THEN 0.5 ELSE 0.9 END) AS fb,
  CASE WHEN x0 <= 0.5 THEN CASE WHEN x2 <= 0.5 THEN 0.1 ELSE 0.4 END ELSE CASE WHEN x2 <= 0.3 THEN 0.5 ELSE 0.9 END END AS fab FROM flow),
  tree AS (SELECT class, instance_id, fab AS margin, ((fa - f) + (fab - fb)) / 2 AS phi_a, ((fb - f) + (fab - fa)) / 2 AS phi_b FROM t0)"""
)


def columns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the measures of the tree as columns."""
    return flow(spark, sf_dir).select("instance_id", "class", F.get("x", F.lit(0)).alias("quantity"), F.get("x", F.lit(2)).alias("discount"))


@registry.add("ml_07_tree_attribution", f"WITH {_TREE_SQL} SELECT class, count(*) AS n, round(avg(phi_a), 6) AS quantity, round(avg(phi_b), 6) AS discount, round(avg(margin), 6) AS margin, 0 AS not_additive FROM tree GROUP BY 1")
def ml_07_tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley values of a tree; with the base they must sum to the margin in every row."""
    rows = T.with_shapley(columns_of(spark, sf_dir).select("class", "quantity", "discount"), T.ensemble([TREE], 2), ["quantity", "discount"])
    a, b = F.get("phi", F.lit(0)), F.get("phi", F.lit(1))
    apart = F.abs(a + b + F.col("base") - F.col("margin")) > 1e-9
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg(a), 6).alias("quantity"), F.round(F.avg(b), 6).alias("discount"), F.round(F.avg("margin"), 6).alias("margin"), F.count_if(apart).cast("int").alias("not_additive"))


@registry.add("ml_04_boosting", None)
def ml_04_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees trained on the flows, stored, loaded and attributed: mean size by class, and rows whose parts miss the model's own margin."""
    names = ["quantity", "price", "discount", "tax"]
    rows = flow(spark, sf_dir).select("class", (F.col("class") != "BENIGN").cast("double").alias("label"), *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    model = T.train_boosting(rows, names, rounds=5, depth=3)
    path = f"{shared_dir(spark)}/boosting-{model.uid}"
    T.save_frozen(model, names, path)
    stored, known = T.load_frozen(spark, path)
    made = T.with_shapley(rows, T.boosted(spark, f"{path}/model", len(known), stored.treeWeights), known)
    own = M.predict(stored, made, known)
    apart = F.abs(T.probability(F.aggregate("phi", F.col("base"), lambda s, p: s + p)) - F.get("proba", F.lit(1))) > 1e-9
    sizes = [F.round(F.avg(F.abs(F.get("phi", F.lit(i)))), 6).alias(n) for i, n in enumerate(known)]
    return own.groupBy("class").agg(F.count("*").alias("n"), *sizes, F.count_if(apart).alias("not_additive"))


_P = f"WITH {FLOW_SQL}"
_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))"


@registry.add("ml_01_attack_probability", f"{_P} SELECT class, round(avg(1 - (1 - p)), 6) AS attack FROM scored GROUP BY 1")
def ml_01_attack_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    proba = M.both_classes(F.col("p"))
    return flow(spark, sf_dir).groupBy("class").agg(F.round(F.avg(M.attack_probability(proba, 0)), 6).alias("attack"))


@registry.add("ml_02_frozen_detector", f"{_P} SELECT class, 2 AS width, count(*) AS n, round(avg(1 - p), 6) AS first FROM scored GROUP BY 1")
def ml_02_frozen_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar score as one probability for each class; another width is an error."""
    rows = flow(spark, sf_dir).select("class", M.checked_width(M.both_classes(F.col("p")), 2).alias("proba"))
    return rows.groupBy("class", F.size("proba").alias("width")).agg(F.count("*").alias("n"), F.round(F.avg(F.get("proba", F.lit(0))), 6).alias("first"))


@registry.add("ml_03_predict_margin", f"{_P} SELECT class, round(avg({_LOGIT}), 6) AS margin, 0.0::DOUBLE AS skew FROM scored GROUP BY 1")
def ml_03_predict_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log odds of the last class; those of the first are their negative."""
    rows = flow(spark, sf_dir).select("class", M.log_margin(M.both_classes(F.col("p"))).alias("m"))
    return rows.groupBy("class").agg(F.round(F.avg(F.get("m", F.lit(1))), 6).alias("margin"), F.max(F.abs(F.get("m", F.lit(0)) + F.get("m", F.lit(1)))).alias("skew"))


@registry.add("ml_08_predicted_class_attribution", f"WITH {PHI_SQL} SELECT feature, round(sum(CASE WHEN p > 0.5 THEN phi ELSE -phi END), 3) AS weight FROM ranked GROUP BY 1")
def ml_08_predicted_class_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of the predicted class out of those of each class; the first of equal probabilities is predicted."""
    rows = audited(spark, sf_dir).select(F.posexplode("phi").alias("at", "v"), A.first_argmax(M.both_classes(F.col("p"))).alias("c"))
    picked = rows.select("at", M.select_class(F.array(-F.col("v"), F.col("v")), F.col("c")).alias("v"))
    names = F.array(*[F.lit(n) for n in ("quantity", "price", "discount", "tax")])
    return picked.groupBy(F.get(names, F.col("at")).alias("feature")).agg(F.round(F.sum("v"), 3).alias("weight"))


@registry.add("ml_10_toy_attribution", f"WITH {PHI_SQL} SELECT class, feature, round(avg(phi), 6) AS phi FROM phi GROUP BY 1, 2")
def ml_10_toy_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select("class", F.posexplode("phi").alias("at", "v")).groupBy("class", "at").agg(F.round(F.avg("v"), 6).alias("phi"))
    names = F.array(*[F.lit(n) for n in ("quantity", "price", "discount", "tax")])
    return rows.select("class", F.get(names, F.col("at")).alias("feature"), "phi")


@registry.add("ml_11_prediction_view", f"{_P} SELECT CASE WHEN p >= 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS label, count(*) AS n, round(avg(p), 6) AS p FROM scored GROUP BY 1")
def ml_11_prediction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = M.prediction_view(M.both_classes(F.col("p")), ["BENIGN", "ATTACK"])
    return flow(spark, sf_dir).select(view.alias("v")).groupBy("v.label").agg(F.count("*").alias("n"), F.round(F.avg("v.p"), 6).alias("p"))


@registry.add("ml_12_competence_view", f"WITH {_TREE_SQL} SELECT class, CASE WHEN margin >= 0.45 THEN 'ATTACK' ELSE 'BENIGN' END AS predicted, count(*) AS n FROM tree GROUP BY 1, 2")
def ml_12_competence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted classes; the model works on the batches that Arrow hands over."""
    model = T.ensemble([TREE], 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"class": batch["class"], "margin": model.predict(batch[["quantity", "discount"]].to_numpy(dtype=float))})

    scored = columns_of(spark, sf_dir).select("class", "quantity", "discount").mapInPandas(run, "class string, margin double")
    return scored.groupBy("class", F.when(F.col("margin") >= 0.45, "ATTACK").otherwise("BENIGN").alias("predicted")).agg(F.count("*").alias("n"))


CLASSES = ("BENIGN", "DoS", "Probe")


@registry.add("pf_09_class_index_map", f"{_P}, c AS (SELECT unnest(['BENIGN', 'DoS', 'Probe']) AS class, unnest([0, 1, 2]) AS idx) SELECT c.idx, c.class, count(flow.class) AS n FROM c LEFT JOIN flow ON flow.class = c.class GROUP BY 1, 2")
def pf_09_class_index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of the classes in their stated order, with how many flows have each."""
    index = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in CLASSES])).alias("idx", "class"))
    sizes = flow(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))
    return index.join(sizes, "class", "left").select("idx", "class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@registry.add("pf_13_attack_family", f"{_P} SELECT class <> 'BENIGN' AS is_attack, count(*) AS n FROM flow GROUP BY 1")
def pf_13_attack_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir).groupBy((F.col("class") != "BENIGN").alias("is_attack")).agg(F.count("*").alias("n"))


@registry.add("pf_12_gate_filter", f"WITH {MEASURED_SQL} SELECT class, count(*) AS n, round(avg(dsa), 6) AS mean FROM m WHERE (CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE direction_assertion_rate END) >= 0.5 GROUP BY 1")
def pf_12_gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows kept where the gate's row of the instance reaches its least; a missing gate row counts as 0."""
    rows = metric_rows(spark, sf_dir)
    gate = rows.filter("metric = 'direction_assertion_rate'").filter(F.split("instance_id", "-")[0].cast("long") % 3 != 0).select("instance_id", F.col("value").alias("gate"))
    kept = rows.filter("metric = 'dsa'").join(gate, "instance_id", "left").filter(F.coalesce("gate", F.lit(0.0)) >= 0.5)
    return kept.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@registry.add("wn_04_ordinal_spearman", f"WITH {PHI_SQL}, s AS (SELECT instance_id, class, 1 - 6.0 * sum((rank - idx - 1) * (rank - idx - 1)) / 60 AS rho FROM ranked GROUP BY 1, 2) SELECT class, round(avg(rho), 6) AS rho FROM s GROUP BY 1")
def wn_04_ordinal_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the features by size against their order in the table."""
    names = F.array(*[F.lit(n) for n in ("quantity", "price", "discount", "tax")])
    pairs = F.transform("ranked", lambda r: F.struct(r["rank"].cast("int").alias("x"), F.array_position(names, r["feature"]).cast("int").alias("y")))
    rows = audited(spark, sf_dir).select("class", A.ordinal_spearman(pairs).alias("rho"))
    return rows.groupBy("class").agg(F.round(F.avg("rho"), 6).alias("rho"))


@registry.add("jn_02_left_join_default", "SELECT c.cell_id, coalesce(e.n, 0) AS explanations, coalesce(e.abstained, 0.0) AS abstained FROM cells c LEFT JOIN (SELECT cell_id, count(*) AS n, avg(abstained::INT) AS abstained FROM explanations GROUP BY 1) e ON e.cell_id = c.cell_id")
def jn_02_left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load(spark, sf_dir, "explanations").groupBy("cell_id").agg(F.count("*").alias("n"), F.avg(F.col("abstained").cast("int")).alias("share"))
    return load(spark, sf_dir, "cells").join(made, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).cast("long").alias("explanations"), F.coalesce("share", F.lit(0.0)).alias("abstained"))


@registry.add(
    "co_07_apply_operator",
    f"WITH {CLAIMS_SQL}, n AS (SELECT i.instance_id, count(c.pos) AS n FROM inst i LEFT JOIN claims_ c ON c.instance_id = i.instance_id GROUP BY 1) SELECT unnest(['fabricated_feature', 'sign_flip', 'rank_inversion', 'omission', 'magnitude_inflation', 'vague_substitution']) AS operator, unnest([sum(n + 1), sum(n), sum(n), sum(greatest(n - 1, 0)), sum(n), sum(n)])::BIGINT AS claims FROM n",
)
def co_07_apply_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corruption by its name: how many claims there are afterwards."""
    rows = audited(spark, sf_dir).select("claims")
    sums = rows.agg(*[F.sum(F.size(C.apply_operator(name, F.col("claims"))["claims"])).alias(name) for name in C.OPERATORS])
    return sums.unpivot([], list(C.OPERATORS), "operator", "claims")


@registry.add("tx_09_judge_scores", "SELECT sum(CASE WHEN explanation_id % 7 = 0 THEN 0 ELSE 1 END)::BIGINT AS read, sum(CASE WHEN explanation_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS unread, round(avg(CASE WHEN explanation_id % 7 > 0 THEN (explanation_id % 5)::DOUBLE END), 6) AS clarity FROM explanations")
def tx_09_judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read out of a judge's answer with words around the object; an answer without all dimensions is unread."""
    key = F.col("explanation_id")
    last = F.when(key % 7 == 0, "").otherwise(', "usefulness": 2.5')
    answer = F.concat(F.lit('Scores follow. {"clarity": '), (key % 5).cast("string"), F.lit(', "plausibility": 3'), last, F.lit("} Done."))
    rows = load(spark, sf_dir, "explanations").select(judge_scores(answer).alias("s"))
    return rows.agg(F.count("s").alias("read"), F.count_if(F.col("s").isNull()).alias("unread"), F.round(F.avg("s.clarity"), 6).alias("clarity"))


@registry.add("sp_09_seeded_order", "SELECT cell_id, row_number() OVER (ORDER BY md5('17:' || cell_id)) AS place FROM cells")
def sp_09_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation that depends on seed and key only: places by the hash of both, from counts of hash prefixes and ranks within."""
    keyed = load(spark, sf_dir, "cells").select("cell_id", F.md5(F.concat(F.lit("17:"), "cell_id")).alias("h"))
    bucketed = keyed.withColumn("bucket", F.substring("h", 1, 2))
    from pyspark.sql import Window

    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    # at most 256 buckets
    offsets = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    placed = bucketed.join(F.broadcast(offsets), "bucket")
    return placed.select("cell_id", (F.row_number().over(Window.partitionBy("bucket").orderBy("h")) + F.col("before")).alias("place"))


@registry.add("wn_13_head", "SELECT request_hash, count(*) AS n FROM llm_calls GROUP BY 1 ORDER BY n DESC, request_hash LIMIT 10")
def wn_13_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten requests most often made, ties by hash: a top-k report."""
    return load(spark, sf_dir, "llm_calls").groupBy("request_hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "request_hash").limit(10)
