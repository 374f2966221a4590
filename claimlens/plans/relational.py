"""Joins, set operations, aggregates, windows and cleaning over the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimlens.operators.flow import FLOW_SQL, flow
from claimlens.plans.parallel import in_order
from claimlens.registry import Registry
from claimlens.sources import load

registry = Registry()

# Joins


@registry.add("jn_03_lookup_join", "SELECT c.generator, c.llm, count(*) AS calls FROM llm_calls l LEFT JOIN cells c ON c.cell_id = l.cell_id GROUP BY 1, 2")
def jn_03_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, cells = load(spark, sf_dir, "llm_calls"), load(spark, sf_dir, "cells").select("cell_id", "generator", "llm")
    return calls.groupBy("cell_id").agg(F.count("*").alias("n")).join(cells, "cell_id", "left").groupBy("generator", "llm").agg(F.sum("n").alias("calls"))


@registry.add(
    "jn_04_gate_join",
    "WITH g AS (SELECT explanation_id, count(*) FILTER (WHERE direction IS NOT NULL) AS gate FROM claims GROUP BY 1) SELECT generator_id, count(*) AS kept FROM explanations e LEFT JOIN g ON g.explanation_id = e.explanation_id WHERE coalesce(gate, 0) > 0 GROUP BY 1",
)
def jn_04_gate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations whose gate is passed; a missing gate counts as 0 (PF-12)."""
    gate = load(spark, sf_dir, "claims").groupBy("explanation_id").agg(F.count_if(F.col("direction").isNotNull()).alias("gate"))
    met = load(spark, sf_dir, "explanations").select("explanation_id", "generator_id").join(gate, "explanation_id", "left")
    return met.filter(F.coalesce("gate", F.lit(0)) > 0).groupBy("generator_id").agg(F.count("*").alias("kept"))


@registry.add("jn_07_anti_join", "SELECT generator_id, count(*) AS without_claims FROM explanations e ANTI JOIN claims c ON c.explanation_id = e.explanation_id GROUP BY 1")
def jn_07_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load(spark, sf_dir, "claims").select("explanation_id")
    return load(spark, sf_dir, "explanations").join(claims, "explanation_id", "left_anti").groupBy("generator_id").agg(F.count("*").alias("without_claims"))


@registry.add(
    "jn_08_factorial_cells",
    "WITH g AS (SELECT DISTINCT generator, llm IS NOT NULL AS needs FROM cells), f AS (SELECT d.dataset, t.detector, g.generator, g.needs FROM (SELECT DISTINCT dataset FROM cells) d, (SELECT DISTINCT detector FROM cells) t, g) SELECT dataset, detector, generator, l.llm FROM f JOIN (SELECT DISTINCT llm FROM cells WHERE llm IS NOT NULL) l ON needs UNION ALL SELECT dataset, detector, generator, NULL FROM f WHERE NOT needs",
)
def jn_08_factorial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM-19: dataset x detector x generator, x model for generators that use one. Factors are short lists."""
    cells = load(spark, sf_dir, "cells")
    base = cells.select("dataset").distinct().crossJoin(cells.select("detector").distinct()).crossJoin(cells.select("generator", F.col("llm").isNotNull().alias("needs")).distinct())
    models = cells.select("llm").filter("llm IS NOT NULL").distinct()
    with_model = base.filter("needs").crossJoin(models)
    return with_model.select("dataset", "detector", "generator", "llm").unionByName(base.filter("NOT needs").select("dataset", "detector", "generator", F.lit(None).cast("string").alias("llm")))


@registry.add(
    "jn_09_anchored_cells",
    "WITH a AS (SELECT min(dataset) AS dataset, min(detector) AS detector FROM cells), s AS (SELECT DISTINCT dataset AS override FROM cells WHERE dataset <> (SELECT dataset FROM a)), e AS (SELECT dataset, detector, 'anchor' AS kind FROM a UNION ALL SELECT override, detector, 'spoke' FROM s, a) SELECT e.kind, e.dataset, e.detector, count(*) AS n FROM e JOIN cells c ON c.dataset = e.dataset AND c.detector = e.detector GROUP BY 1, 2, 3",
)
def jn_09_anchored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the anchor and of spokes that override one factor and keep the anchor's others."""
    cells = load(spark, sf_dir, "cells")
    anchor = cells.agg(F.min("dataset").alias("a_dataset"), F.min("detector").alias("a_detector"))
    overrides = cells.select(F.col("dataset").alias("override")).distinct()
    spokes = overrides.crossJoin(anchor).select(F.when(F.col("override") == F.col("a_dataset"), "anchor").otherwise("spoke").alias("kind"), F.coalesce("override", "a_dataset").alias("dataset"), F.col("a_detector").alias("detector"))
    return spokes.join(cells, ["dataset", "detector"]).groupBy("kind", "dataset", "detector").agg(F.count("*").alias("n"))


def nearest(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """JN-10: the ``k`` nearest vectors of each query, exact, by (distance, id).

    Queries are a stated set against all rows. They meet the base in blocks: each
    base row goes to one block, each block keeps ``k`` for every query, and only
    those are ranked, so what is sorted is queries x blocks x k.
    """
    blocks = 32
    b = base.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    q = queries.select(F.col("id").alias("query"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    apart = F.aggregate(F.zip_with("qv", "v", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    met = q.join(b, "block").filter("query <> id").select("query", "id", "block", F.round(apart, 6).alias("distance"))
    near = met.withColumn("rn", F.row_number().over(Window.partitionBy("query", "block").orderBy("distance", "id"))).filter(F.col("rn") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).filter(F.col("rank") <= k).select("query", "id", "rank", "distance")


@registry.add(
    "jn_10_nearest_neighbours",
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, b.vec_id AS id, round(list_sum([(x - y) * (x - y) for x, y in zip_(q.embedding, b.embedding)]), 6) AS distance FROM q JOIN embeddings b ON q.vec_id <> b.vec_id) SELECT * FROM p""".replace(
        "list_sum([(x - y) * (x - y) for x, y in zip_(q.embedding, b.embedding)])", "list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
    ).replace("SELECT * FROM p", "SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM p) WHERE rank <= 5"),
)
def jn_10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(e.filter("id % 20 = 0"), e, 5).select("query", "id", "rank")


@registry.add(
    "l2_02_conditional_imputer",
    """WITH p AS (SELECT q.vec_id AS query, b.vec_id AS id, b.embedding[1]::DOUBLE AS v, round(list_sum(list_transform(list_zip(q.embedding[2:], b.embedding[2:]), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query, round(avg(v), 6) AS imputed FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM p) WHERE rank <= 5 GROUP BY 1""",
)
def l2_02_conditional_imputer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first dimension erased and filled with its mean over the 5 rows nearest on the others."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rest = e.select("id", F.slice("embedding", 2, 100000).alias("v"))
    near = nearest(rest.filter("id % 20 = 0"), rest, 5)
    values = e.select("id", F.col("embedding")[0].cast("double").alias("x"))
    return near.join(values, "id").groupBy("query").agg(F.round(F.avg("x"), 6).alias("imputed"))


# Set operations


@registry.add("so_01_union_by_name", "SELECT kind, count(*) AS n FROM (SELECT 'call' AS kind, instance_id FROM llm_calls UNION ALL SELECT 'explanation', instance_id FROM explanations UNION ALL SELECT 'claim', instance_id FROM claims) GROUP BY 1")
def so_01_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, t).select("instance_id", F.lit(k).alias("kind")) for t, k in (("llm_calls", "call"), ("explanations", "explanation"), ("claims", "claim"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"))


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "annotations").select("item_id", "annotator"), load(spark, sf_dir, "llm_passes").select("item_id", "annotator")


@registry.add("so_02_union_distinct", "SELECT item_id, feature FROM annotations WHERE NOT added UNION SELECT item_id, unnest(candidates) FROM probe_items")
def so_02_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = load(spark, sf_dir, "annotations").filter("NOT added").select("item_id", "feature")
    return one.union(load(spark, sf_dir, "probe_items").select("item_id", F.explode("candidates"))).distinct()


@registry.add("so_03_intersect", "SELECT item_id FROM llm_passes GROUP BY 1 HAVING count(DISTINCT annotator) = (SELECT count(DISTINCT annotator) FROM llm_passes) INTERSECT SELECT item_id FROM annotations")
def so_03_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that every pass answered and a human as well."""
    human, passes = _answered(spark, sf_dir)
    n = passes.agg(F.count_distinct("annotator").alias("all"))
    full = passes.groupBy("item_id").agg(F.count_distinct("annotator").alias("n")).join(F.broadcast(n), F.col("n") == F.col("all")).select("item_id")
    return full.intersect(human.select("item_id"))


@registry.add("so_04_except", "SELECT DISTINCT item_id FROM probe_items EXCEPT SELECT item_id FROM llm_passes WHERE annotator = 'PASS_A_V1'")
def so_04_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, passes = _answered(spark, sf_dir)
    return load(spark, sf_dir, "probe_items").select("item_id").distinct().join(passes.filter("annotator = 'PASS_A_V1'"), "item_id", "left_anti")


@registry.add("so_05_ordered_distinct", "SELECT feature, min(pos) AS first_pos FROM claims WHERE feature IS NOT NULL GROUP BY 1")
def so_05_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names with the first position each was seen at."""
    return load(spark, sf_dir, "claims").filter("feature IS NOT NULL").groupBy("feature").agg(F.min("pos").alias("first_pos"))


# Aggregates


@registry.add("ag_01_mean", "SELECT direction_evidence, count(*) AS n, round(avg(magnitude), 6) AS mean FROM claims GROUP BY 1")
def ag_01_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "claims").groupBy("direction_evidence").agg(F.count("*").alias("n"), F.round(F.avg("magnitude"), 6).alias("mean"))


@registry.add(
    "ag_02_instance_values",
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY instance_id, generator_id ORDER BY ingested_utc DESC, explanation_id DESC) AS rn FROM explanations) SELECT generator_id, count(*) AS instances, count(*) FILTER (WHERE abstained) AS abstained FROM o WHERE rn = 1 GROUP BY 1",
)
def ag_02_instance_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each instance and generator, the last row winning; a hot instance is reduced before it moves."""
    last = F.max(F.struct("ingested_utc", "explanation_id", "abstained")).alias("x")
    one = load(spark, sf_dir, "explanations").groupBy("instance_id", "generator_id").agg(last)
    return one.groupBy("generator_id").agg(F.count("*").alias("instances"), F.count_if("x.abstained").alias("abstained"))


_COST = "count(*) AS n, sum(coalesce(tokens, 0))::BIGINT AS tokens, round(avg(latency_ms) FILTER (WHERE NOT isnan(latency_ms)), 4) AS mean_latency_ms"


@registry.add("ag_05_cost_accounting", f"SELECT model_id, {_COST}, round(count(*) FILTER (WHERE text IS NOT NULL AND text <> '') / count(*)::DOUBLE, 6) AS coverage FROM llm_calls GROUP BY 1")
def ag_05_cost_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (null as 0), mean of known latencies, share of answers; nothing is divided by an empty group."""
    calls = load(spark, sf_dir, "llm_calls")
    return calls.groupBy("model_id").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
        F.round(F.avg(F.when(~F.isnan("latency_ms"), F.col("latency_ms"))), 4).alias("mean_latency_ms"),
        F.round(F.count_if(F.col("text") != "") / F.count("*"), 6).alias("coverage"),
    )


@registry.add("ag_06_scoped_cost", "SELECT count(*) AS explanations, count(*) FILTER (WHERE generator_id IN (SELECT generator_id FROM explanations WHERE abstained)) AS capable, round(count(*) FILTER (WHERE abstained) / nullif(count(*) FILTER (WHERE generator_id IN (SELECT generator_id FROM explanations WHERE abstained)), 0)::DOUBLE, 6) AS abstention FROM explanations")
def ag_06_scoped_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstention over the generators that can abstain only."""
    per = load(spark, sf_dir, "explanations").groupBy("generator_id").agg(F.count("*").alias("n"), F.count_if("abstained").alias("a"))
    return per.agg(F.sum("n").alias("explanations"), F.sum(F.when(F.col("a") > 0, F.col("n")).otherwise(0)).alias("capable"), F.round(F.try_divide(F.sum("a"), F.sum(F.when(F.col("a") > 0, F.col("n")).otherwise(0))), 6).alias("abstention"))


@registry.add("ag_07_cost_summary_pivot", "SELECT snapshot_id, count(*) FILTER (WHERE cached)::BIGINT AS cached, count(*) FILTER (WHERE NOT cached)::BIGINT AS live FROM llm_calls GROUP BY 1")
def ag_07_cost_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("cached"), "cached").otherwise("live").alias("kind")
    return load(spark, sf_dir, "llm_calls").select("snapshot_id", kind).groupBy("snapshot_id").pivot("kind", ["cached", "live"]).count().na.fill(0)


@registry.add(
    "ag_08_capability_summary",
    "SELECT c.llm, count(DISTINCT c.generator) AS generators, round(avg(m.tokens_per_explanation), 4) AS tokens, bool_and(m.tokens_per_explanation IS NOT NULL) AS populated FROM cost_metrics m JOIN cells c ON c.cell_id = m.cell_id GROUP BY 1",
)
def ag_08_capability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "cells").select("cell_id", "llm", "generator")
    per = load(spark, sf_dir, "cost_metrics").groupBy("cell_id").agg(F.sum("tokens_per_explanation").alias("s"), F.count("tokens_per_explanation").alias("k"), F.count("*").alias("n"))
    return per.join(cells, "cell_id").groupBy("llm").agg(F.count_distinct("generator").alias("generators"), F.round(F.sum("s") / F.sum("k"), 4).alias("tokens"), F.bool_and(F.col("k") == F.col("n")).alias("populated"))


@registry.add("ag_09_class_support", f"WITH {FLOW_SQL} SELECT class, count(*) AS support FROM flow GROUP BY 1")
def ag_09_class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir).groupBy("class").agg(F.count("*").alias("support"))


@registry.add("ag_10_class_semantics", "SELECT units, string_agg(description, ' | ' ORDER BY feature_id) AS text FROM feature_catalog GROUP BY 1")
def ag_10_class_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions joined in file order; the catalog is a fixed list."""
    ordered = F.array_sort(F.collect_list(F.struct("feature_id", "description")))
    return load(spark, sf_dir, "feature_catalog").groupBy("units").agg(F.array_join(F.transform(ordered, lambda x: x["description"]), " | ").alias("text"))


@registry.add("ag_11_model_by_generator", "WITH v AS (SELECT generator, llm, tokens_per_explanation AS t FROM cost_metrics JOIN cells USING (cell_id)) SELECT generator, round(avg(t) FILTER (WHERE llm = 'kesh-3b'), 4) AS \"kesh-3b\", round(avg(t) FILTER (WHERE llm = 'orin-7b-it'), 4) AS \"orin-7b-it\" FROM v GROUP BY 1")
def ag_11_model_by_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "cells").select("cell_id", "generator", "llm")
    rows = load(spark, sf_dir, "cost_metrics").select("cell_id", "tokens_per_explanation").join(cells, "cell_id")
    return rows.groupBy("generator").pivot("llm", ["kesh-3b", "orin-7b-it"]).agg(F.round(F.avg("tokens_per_explanation"), 4))


@registry.add(
    "ag_12_ranking_moved",
    "WITH m AS (SELECT detector, generator, avg(tokens_per_explanation) AS v FROM cost_metrics JOIN cells USING (cell_id) GROUP BY 1, 2), o AS (SELECT detector, string_agg(generator, ',' ORDER BY v DESC, generator) AS ranking FROM m GROUP BY 1) SELECT detector, ranking, CASE WHEN (SELECT count(DISTINCT ranking) FROM o) = 1 THEN 'INVARIANT' ELSE 'RANKING MOVED' END AS verdict FROM o",
)
def ag_12_ranking_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "cells").select("cell_id", "detector", "generator")
    means = load(spark, sf_dir, "cost_metrics").join(cells, "cell_id").groupBy("detector", "generator").agg(F.avg("tokens_per_explanation").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("key"), "generator")))
    o = means.groupBy("detector").agg(F.array_join(F.transform(ordered, lambda x: x["generator"]), ",").alias("ranking"))
    n = o.agg(F.count_distinct("ranking").alias("n"))
    return o.crossJoin(n).select("detector", "ranking", F.when(F.col("n") == 1, "INVARIANT").otherwise("RANKING MOVED").alias("verdict"))


_LABEL = "CASE WHEN lower(trim(text_asserts_direction)) IN ('+', '-', 'unclear', 'absent') THEN lower(trim(text_asserts_direction)) ELSE 'other' END"


@registry.add("ag_13_label_distribution", f"SELECT annotator, " + ", ".join(f"count(*) FILTER (WHERE {_LABEL} = '{k}') AS {n}" for k, n in (("+", "raises"), ("-", "lowers"), ("unclear", "unclear"), ("absent", "absent"), ("other", "other"))) + " FROM annotations GROUP BY 1")
def ag_13_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.lower(F.trim("text_asserts_direction"))
    rows = load(spark, sf_dir, "annotations").select("annotator", F.when(bare.isin("+", "-", "unclear", "absent"), bare).otherwise("other").alias("label"))
    made = rows.groupBy("annotator").pivot("label", ["+", "-", "unclear", "absent", "other"]).count().na.fill(0)
    return made.withColumnsRenamed({"+": "raises", "-": "lowers"})


@registry.add("ag_14_evidence_counter", "SELECT coalesce(direction_evidence, '(null)') AS evidence, count(*) AS n, round(count(*) / (SELECT count(*) FROM claims)::DOUBLE, 6) AS share FROM claims GROUP BY 1")
def ag_14_evidence_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "claims").groupBy(F.coalesce("direction_evidence", F.lit("(null)")).alias("evidence")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(total).select("evidence", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@registry.add("ag_16_single_version", "SELECT extractor_id, count(DISTINCT coalesce(extractor_version, '(none)')) AS versions, count(DISTINCT coalesce(extractor_version, '(none)')) > 1 AS refused FROM claims GROUP BY 1")
def ag_16_single_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed versions are refused; a missing version is a version (AG-15 reads them all instead of the first)."""
    v = F.count_distinct(F.coalesce("extractor_version", F.lit("(none)")))
    return load(spark, sf_dir, "claims").groupBy("extractor_id").agg(v.alias("versions"), (v > 1).alias("refused"))


def assert_single_version(rows: DataFrame, column: str = "extractor_version") -> DataFrame:
    """``rows`` unchanged, or an error if they mix versions."""
    found = rows.select(F.coalesce(column, F.lit("(none)"))).distinct().limit(2).count()
    if found > 1:
        raise ValueError(f"the rows mix values of {column}")
    return rows


# Windows


@registry.add(
    "wn_09_cited_topk",
    "WITH c AS (SELECT explanation_id, feature, coalesce(rank, 2147483647) AS r, pos, extractor_version FROM claims WHERE feature IN (SELECT feature FROM feature_catalog)), d AS (SELECT explanation_id, feature, min((r::BIGINT * 1000 + pos)) AS spot FROM c GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY explanation_id ORDER BY spot, feature) AS rn FROM d) SELECT feature, count(*) AS cited FROM n WHERE rn <= 3 GROUP BY 1",
)
def wn_09_cited_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three different known features of an explanation by (rank, nulls last, position)."""
    known = load(spark, sf_dir, "feature_catalog").select("feature")
    c = load(spark, sf_dir, "claims").join(known, "feature", "left_semi")
    at = F.coalesce("rank", F.lit(2147483647)).cast("long") * 1000 + F.col("pos")
    d = c.groupBy("explanation_id", "feature").agg(F.min(at).alias("at"))
    n = d.withColumn("rn", F.row_number().over(Window.partitionBy("explanation_id").orderBy("at", "feature")))
    return n.filter("rn <= 3").groupBy("feature").agg(F.count("*").alias("cited"))


@registry.add(
    "wn_10_highest_magnitude",
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY explanation_id ORDER BY coalesce(magnitude, 0) DESC, pos, claim_id) AS rn FROM claims) SELECT direction_evidence, count(*) AS n FROM o WHERE rn = 1 GROUP BY 1",
)
def wn_10_highest_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min(F.struct((-F.coalesce("magnitude", F.lit(0.0))).alias("key"), "pos", "claim_id", "direction_evidence")).alias("x")
    return load(spark, sf_dir, "claims").groupBy("explanation_id").agg(best).groupBy(F.col("x.direction_evidence").alias("direction_evidence")).agg(F.count("*").alias("n"))


@registry.add("wn_11_predicted_class", f"WITH {FLOW_SQL}, q AS (SELECT [1 - p, p * 0.6, p * 0.4] AS pr FROM scored) SELECT list_position(pr, list_max(pr)) - 1 AS predicted, count(*) AS n FROM q GROUP BY 1")
def wn_11_predicted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlens.functions.attribution import first_argmax

    p = F.col("p")
    return flow(spark, sf_dir).select(first_argmax(F.array(1 - p, p * 0.6, p * 0.4)).alias("predicted")).groupBy("predicted").agg(F.count("*").alias("n"))


@registry.add("wn_12_latest_run", "SELECT cell_id, max(strftime(timestamp_utc, '%Y%m%dT%H%M%S') || '__' || request_hash) AS latest FROM llm_calls GROUP BY 1")
def wn_12_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.concat_ws("__", F.date_format("timestamp_utc", "yyyyMMdd'T'HHmmss"), "request_hash")
    return load(spark, sf_dir, "llm_calls").groupBy("cell_id").agg(F.max(run).alias("latest"))


@registry.add("wn_14_chunk_index", "SELECT (row_number() OVER (PARTITION BY batch_id ORDER BY row_id) - 1) // 25 AS chunk, batch_id, row_id FROM annotations")
def wn_14_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-19: rows of a batch in chunks of 25."""
    rows = in_order(load(spark, sf_dir, "annotations").select("batch_id", "row_id"), ["batch_id"], ["row_id"])
    return rows.select(F.floor((F.col("rn") - 1) / 25).alias("chunk"), "batch_id", "row_id")


# Cleaning and predicates


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


@registry.add("pf_02_numeric_coercion", "SELECT count(*) AS n, count(TRY_CAST(regexp_extract(text, '([0-9]+\\.[0-9]+)', 1) AS DOUBLE)) AS numeric FROM llm_calls")
def pf_02_numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("text", r"([0-9]+\.[0-9]+)", 1).try_cast("double")
    return load(spark, sf_dir, "llm_calls").agg(F.count("*").alias("n"), F.count(number).alias("numeric"))


@registry.add("pf_03_finite_rows", "SELECT count(*) AS kept FROM cost_metrics WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND NOT isinf(latency_ms) AND tokens_per_explanation IS NOT NULL AND dollars_per_explanation IS NOT NULL AND NOT isnan(dollars_per_explanation)")
def pf_03_finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cost_metrics").select(finite(F.col("latency_ms")).alias("a"), "tokens_per_explanation", finite(F.col("dollars_per_explanation")).alias("c"))
    return rows.na.drop().agg(F.count("*").alias("kept"))


@registry.add("pf_04_binary_label", f"WITH {FLOW_SQL} SELECT class, CASE WHEN upper(trim(class)) <> 'BENIGN' THEN 1 ELSE 0 END AS label, count(*) AS n FROM flow GROUP BY 1, 2")
def pf_04_binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir).groupBy("class", (F.upper(F.trim("class")) != "BENIGN").cast("int").alias("label")).agg(F.count("*").alias("n"))


def norm_label(text: Column) -> Column:
    """PF-05: lower case, runs of other signs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


@registry.add("pf_05_norm_label", "SELECT trim(regexp_replace(lower(feature), '[^a-z0-9]+', ' ', 'g')) AS label, count(*) AS n FROM claims WHERE feature IS NOT NULL GROUP BY 1")
def pf_05_norm_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "claims").filter("feature IS NOT NULL").groupBy(norm_label(F.col("feature")).alias("label")).agg(F.count("*").alias("n"))


@registry.add("pf_06_canonical_class", "SELECT f.feature AS canonical, count(*) AS n FROM claims c LEFT JOIN feature_catalog f ON trim(regexp_replace(lower(c.feature), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(f.feature), '[^a-z0-9]+', ' ', 'g')) GROUP BY 1")
def pf_06_canonical_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical name by normalised label, null for unknown ones; rows are counted by label before the join."""
    known = load(spark, sf_dir, "feature_catalog").select(norm_label(F.col("feature")).alias("label"), F.col("feature").alias("canonical"))
    rows = load(spark, sf_dir, "claims").groupBy(norm_label(F.col("feature")).alias("label")).agg(F.count("*").alias("n"))
    return rows.join(known, "label", "left").groupBy("canonical").agg(F.sum("n").alias("n"))


@registry.add("pf_08_present_classes", f"WITH {FLOW_SQL}, v AS (SELECT unnest(['BENIGN', 'Bot', 'DoS', 'Probe']) AS class, unnest([0, 1, 2, 3]) AS pos), s AS (SELECT v.class, v.pos FROM v SEMI JOIN flow f ON f.class = v.class), r AS (SELECT class, row_number() OVER (ORDER BY pos) - 1 AS idx FROM s) SELECT r.class, r.idx, count(*) AS n FROM flow f JOIN r ON r.class = f.class GROUP BY 1, 2")
def pf_08_present_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of known classes; only classes that occur are indexed, in the vocabulary's order."""
    vocabulary = spark.createDataFrame([(c, i) for i, c in enumerate(("BENIGN", "Bot", "DoS", "Probe"))], "class string, pos int")
    rows = flow(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))
    met = vocabulary.join(rows, "class")
    return met.select("class", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("pos")) - 1).alias("idx"), "n")


@registry.add("pf_10_parents", "SELECT units AS parent, min(feature_id) AS first_pos, count(*) AS members FROM feature_catalog GROUP BY 1")
def pf_10_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "feature_catalog").groupBy(F.col("units").alias("parent")).agg(F.min("feature_id").alias("first_pos"), F.count("*").alias("members"))


@registry.add("pf_11_metric_predicates", "SELECT cell_id, count(*) AS n FROM llm_calls WHERE NOT cached AND tokens > 20 AND latency_ms > 0 AND NOT isnan(latency_ms) GROUP BY 1")
def pf_11_metric_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "llm_calls").filter((~F.col("cached")) & (F.col("tokens") > 20) & (F.col("latency_ms") > 0) & ~F.isnan("latency_ms"))
    return kept.groupBy("cell_id").agg(F.count("*").alias("n"))


@registry.add(
    "pf_16_claim_validation",
    "SELECT 'blank feature' AS violation, count(*) AS n FROM claims WHERE coalesce(trim(feature), '') = '' UNION ALL SELECT 'rank below 1', count(*) FROM claims WHERE rank < 1 UNION ALL SELECT 'magnitude not finite', count(*) FROM claims WHERE isnan(magnitude) OR isinf(magnitude) UNION ALL SELECT 'direction and evidence disagree', count(*) FROM claims WHERE (direction IS NULL) <> (coalesce(direction_evidence, '') = 'default')",
)
def pf_16_claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM-04: counts of claims that break each rule, in one pass."""
    rules = {
        "blank feature": F.coalesce(F.trim("feature"), F.lit("")) == "",
        "rank below 1": F.col("rank") < 1,
        "magnitude not finite": F.isnan("magnitude") | (F.abs("magnitude") == float("inf")),
        "direction and evidence disagree": F.col("direction").isNull() != F.coalesce(F.col("direction_evidence") == "default", F.lit(False)),
    }
    one = load(spark, sf_dir, "claims").agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(f"`{n}`").alias("n")) for n in rules])))
