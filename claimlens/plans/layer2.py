"""Erasure metrics of a linear detector in probability and margin space, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import attribution as A
from claimlens.operators.flow import CLAIMS_SQL, FEATURES, audited, background, names, score
from claimlens.registry import Registry

registry = Registry()
KS = (1, 3)
#: the whole sweep of L2-13; the queries named ``_k135`` run it, the others the two that their SQL has
SWEEP = (1, 3, 5)
SPACES = ("prob", "margin")
THRESHOLD = 0.1


def _space(p: Column, space: str) -> Column:
    return p if space == "prob" else A.margin(p)


def delta(x: Column, removed: Column, space: str) -> Column:
    """Score of the full row less the score with ``removed`` features erased."""
    return _space(score(x), space) - _space(score(A.erased(FEATURES, x, background(), removed)), space)


def comprehensiveness(x: Column, chosen: Column, space: str) -> Column:
    """L2-06, L2-08: 0 where nothing is chosen."""
    return F.when(F.size(chosen) > 0, delta(x, chosen, space)).otherwise(F.lit(0.0))


def sufficiency(x: Column, chosen: Column, space: str) -> Column:
    """L2-07, L2-09: everything but the chosen features is erased."""
    return delta(x, F.array_except(names(), chosen), space)


def per_feature(value: Column, chosen: Column) -> Column:
    """L2-10, L2-11: by number of chosen features, 0 for none."""
    return F.when(F.size(chosen) > 0, value / F.size(chosen)).otherwise(F.lit(0.0))


PARTS = {"comprehensiveness": ("without", "top"), "sufficiency": ("only", "top"), "comprehensiveness_cited": ("without", "said"), "sufficiency_cited": ("only", "said")}


def wide(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = KS, metrics: tuple[str, ...] | None = None, spaces: tuple[str, ...] = SPACES) -> DataFrame:
    """L2-13, one row for each flow: instance_id, class and a column ``metric|k|space`` for each metric asked for, which alone are made."""
    metrics = METRICS if metrics is None else metrics
    bases = {m.removesuffix("_per_feature") for m in metrics}
    families = {PARTS[m][1] for m in bases}
    rows = audited(spark, sf_dir).select("instance_id", "class", "x", "ranked", "claims", F.col("p").alias("full"))
    # each score is made once and read in both spaces
    for k in ks:
        if "top" in families:
            rows = rows.withColumn(f"top{k}", A.features(F.slice("ranked", 1, k)))
        if "said" in families:
            rows = rows.withColumn(f"said{k}", A.cited(F.col("claims"), names(), k))
    scores = []
    for k in ks:
        for kind, family in (PARTS[m] for m in sorted(bases)):
            chosen = F.col(f"{family}{k}") if kind == "without" else F.array_except(names(), F.col(f"{family}{k}"))
            scores.append(score(A.erased(FEATURES, F.col("x"), background(), chosen)).alias(f"{kind}_{family}{k}"))
    counts = [F.size(f"said{k}").alias(f"n{k}") for k in ks] if "said" in families else []
    rows = rows.select("instance_id", "class", "full", *counts, *scores)
    made = []
    for k in ks:
        for space in spaces:
            for metric in metrics:
                base = metric.removesuffix("_per_feature")
                kind, family = PARTS[base]
                value = _space(F.col("full"), space) - _space(F.col(f"{kind}_{family}{k}"), space)
                if base == "comprehensiveness_cited":
                    value = F.when(F.col(f"n{k}") > 0, value).otherwise(F.lit(0.0))
                if metric != base:
                    value = F.when(F.col(f"n{k}") > 0, value / F.col(f"n{k}")).otherwise(F.lit(0.0))
                made.append(value.alias(f"{metric}|{k}|{space}"))
    return rows.select("instance_id", "class", *made)


def long_form(df: DataFrame, by: list[str], ks: tuple[int, ...], columns: list[str], spaces: tuple[str, ...] = SPACES) -> DataFrame:
    """Rows (by, k, space, columns) out of the columns ``name|k|space``."""
    parts = [F.struct(F.lit(k).alias("k"), F.lit(s).alias("space"), *[F.col(f"`{c}|{k}|{s}`").alias(c) for c in columns]) for k in ks for s in spaces]
    return df.select(*by, F.inline_outer(F.array(*parts)))


def swept(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = KS, metrics: tuple[str, ...] | None = None, spaces: tuple[str, ...] = SPACES) -> DataFrame:
    """L2-13: rows (instance_id, class, k, space, metric values), both families in one pass."""
    metrics = METRICS if metrics is None else metrics
    return long_form(wide(spark, sf_dir, ks, metrics, spaces), ["instance_id", "class"], ks, list(metrics), spaces)


METRICS = ("comprehensiveness", "sufficiency", "comprehensiveness_cited", "sufficiency_cited", "comprehensiveness_cited_per_feature", "sufficiency_cited_per_feature")
IDS = dict(zip(METRICS, ("l2_06", "l2_07", "l2_08", "l2_09", "l2_10", "l2_11"), strict=True))

_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0}))))"


def _erased_sql(mask: str, keep: bool) -> str:
    """Sum of the linear score with the features of ``mask`` erased, or all but those."""
    parts = []
    for i, (n, w) in enumerate((("quantity", "0.4"), ("price", "-0.3"), ("discount", "0.25"), ("tax", "0.15"))):
        inside, outside = ("x" + str(i), "0.5") if keep else ("0.5", "x" + str(i))
        parts.append(f"{w} * (CASE WHEN list_contains({mask}, '{n}') THEN {inside} ELSE {outside} END)")
    return "greatest(0.0, least(1.0, 0.2 + " + " + ".join(parts) + "))"


SWEPT_SQL = CLAIMS_SQL + f""",
cited0 AS (SELECT instance_id, feature, row_number() OVER (PARTITION BY instance_id, feature ORDER BY coalesce(rank, 2147483647), pos) AS dup,
  coalesce(rank, 2147483647) AS r, pos FROM claims_ WHERE feature IN ('quantity', 'price', 'discount', 'tax')),
cited1 AS (SELECT instance_id, feature, row_number() OVER (PARTITION BY instance_id ORDER BY r, pos) AS rn FROM cited0 WHERE dup = 1),
ks AS (SELECT unnest([1, 3]) AS k),
tops AS (SELECT instance_id, k, list(feature) AS f FROM ranked, ks WHERE rank <= k GROUP BY 1, 2),
cites AS (SELECT instance_id, k, list(feature) AS f FROM cited1, ks WHERE rn <= k GROUP BY 1, 2),
sets AS (SELECT s.*, t.k, t.f AS top, coalesce(c.f, []::VARCHAR[]) AS said FROM scored s JOIN tops t ON t.instance_id = s.instance_id
  LEFT JOIN cites c ON c.instance_id = s.instance_id AND c.k = t.k),
ps AS (SELECT instance_id, class, k, len(said) AS n_cited, p, {_erased_sql('top', False)} AS pc, {_erased_sql('top', True)} AS ps, {_erased_sql('said', False)} AS pcc, {_erased_sql('said', True)} AS psc FROM sets),
sp AS (SELECT instance_id, class, k, n_cited, 'prob' AS space, p, pc, ps, pcc, psc FROM ps UNION ALL
  SELECT instance_id, class, k, n_cited, 'margin', {_LOGIT.format('p')}, {_LOGIT.format('pc')}, {_LOGIT.format('ps')}, {_LOGIT.format('pcc')}, {_LOGIT.format('psc')} FROM ps),
sw0 AS (SELECT instance_id, class, k, n_cited, space, p - pc AS comprehensiveness, p - ps AS sufficiency,
  CASE WHEN n_cited > 0 THEN p - pcc ELSE 0.0 END AS comprehensiveness_cited, p - psc AS sufficiency_cited FROM sp),
sw AS (SELECT *, CASE WHEN n_cited > 0 THEN comprehensiveness_cited / n_cited ELSE 0.0 END AS comprehensiveness_cited_per_feature,
  CASE WHEN n_cited > 0 THEN sufficiency_cited / n_cited ELSE 0.0 END AS sufficiency_cited_per_feature FROM sw0)"""


SWEPT_ALL_SQL = SWEPT_SQL.replace("unnest([1, 3])", "unnest([1, 3, 5])")


def _by_sweep(metric: str, ks: tuple[int, ...] = KS):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Averages of the wide rows first, then one row for each k and space."""
        rows = wide(spark, sf_dir, ks, (metric,))
        means = rows.groupBy("class").agg(F.count("*").alias("n"), *[F.round(F.avg(f"`{c}`"), 6).alias(c) for c in rows.columns[2:]])
        return long_form(means, ["class", "n"], ks, [metric]).select("class", "k", "space", "n", metric)

    return query


for _metric in METRICS:
    registry.add(f"{IDS[_metric]}_{_metric}", f"WITH {SWEPT_SQL} SELECT class, k, space, count(*) AS n, round(avg({_metric}), 6) AS {_metric} FROM sw GROUP BY 1, 2, 3")(_by_sweep(_metric))
    registry.add(f"{IDS[_metric]}_{_metric}_k135", f"WITH {SWEPT_ALL_SQL} SELECT class, k, space, count(*) AS n, round(avg({_metric}), 6) AS {_metric} FROM sw GROUP BY 1, 2, 3")(_by_sweep(_metric, SWEEP))


@registry.add(
    "l2_01_background_erasure",
    f"WITH {SWEPT_SQL} SELECT class, k, round(avg(p), 6) AS p_full, round(avg(pc), 6) AS p_erased FROM ps GROUP BY 1, 2",
)
def l2_01_background_erasure(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = KS) -> DataFrame:
    rows = audited(spark, sf_dir)
    made = F.array(*[F.struct(F.lit(k).alias("k"), score(A.erased(FEATURES, F.col("x"), background(), A.features(F.slice("ranked", 1, k)))).alias("q")) for k in ks])
    return rows.select("class", "p", F.inline_outer(made)).groupBy("class", "k").agg(F.round(F.avg("p"), 6).alias("p_full"), F.round(F.avg("q"), 6).alias("p_erased"))


@registry.add("l2_01_background_erasure_k135", f"WITH {SWEPT_ALL_SQL} SELECT class, k, round(avg(p), 6) AS p_full, round(avg(pc), 6) AS p_erased FROM ps GROUP BY 1, 2")
def l2_01_background_erasure_k135(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l2_01_background_erasure(spark, sf_dir, SWEEP)


@registry.add("l2_04_detector_score", f"WITH {SWEPT_SQL} SELECT class, round(avg(p), 6) AS prob, round(avg({_LOGIT.format('p')}), 6) AS margin FROM scored GROUP BY 1")
def l2_04_detector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir)
    return rows.groupBy("class").agg(F.round(F.avg("p"), 6).alias("prob"), F.round(F.avg(A.margin(F.col("p"))), 6).alias("margin"))


def target_class(classes: list[str], explained: Column, predicted: Column) -> Column:
    """L2-05: the last class of two, else the explained one or the one predicted for the full row."""
    return F.lit(classes[-1]) if len(classes) == 2 else F.coalesce(explained, predicted)


@registry.add("l2_05_target_class", f"WITH {CLAIMS_SQL} SELECT coalesce(CASE WHEN l_linenumber % 2 = 0 THEN class END, CASE WHEN p >= 0.5 THEN 'DoS' ELSE 'BENIGN' END) AS target, count(*) AS n FROM scored GROUP BY 1")
def l2_05_target_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir)
    predicted = F.when(F.col("p") >= 0.5, "DoS").otherwise("BENIGN")
    return rows.groupBy(target_class(["BENIGN", "DoS", "Probe"], F.when(F.col("l_linenumber") % 2 == 0, F.col("class")), predicted).alias("target")).agg(F.count("*").alias("n"))


_ALL = f"SELECT k, space, metric, round(avg(value), 6) AS mean FROM (UNPIVOT (SELECT instance_id, k, space, {', '.join(METRICS)} FROM sw) ON {', '.join(METRICS)} INTO NAME metric VALUE value) GROUP BY 1, 2, 3"


@registry.add("l2_12_compute_all", f"WITH {SWEPT_SQL} {_ALL}")
def l2_12_compute_all(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = KS) -> DataFrame:
    rows = wide(spark, sf_dir, ks)
    means = rows.agg(*[F.round(F.avg(f"`{c}`"), 6).alias(c) for c in rows.columns[2:]])
    return long_form(means, [], ks, list(METRICS)).unpivot(["k", "space"], list(METRICS), "metric", "mean")


@registry.add("l2_12_compute_all_k135", f"WITH {SWEPT_ALL_SQL} {_ALL}")
def l2_12_compute_all_k135(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l2_12_compute_all(spark, sf_dir, SWEEP)


@registry.add("l2_13_sweep", f"WITH {SWEPT_SQL} SELECT k, space, count(*) AS n, count(DISTINCT class) AS classes FROM sw GROUP BY 1, 2")
def l2_13_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir).groupBy("k", "space").agg(F.count("*").alias("n"), F.count_distinct("class").alias("classes"))


@registry.add("l2_13_sweep_k135", f"WITH {SWEPT_ALL_SQL} SELECT k, space, count(*) AS n, count(DISTINCT class) AS classes, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM sw GROUP BY 1, 2")
def l2_13_sweep_k135(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sweep with the mean of every metric in it."""
    rows = wide(spark, sf_dir, SWEEP)
    sums = rows.groupBy("class").agg(F.count("*").alias("n"), *[F.sum(f"`{c}`").alias(c) for c in rows.columns[2:]])
    return long_form(sums, ["class", "n"], SWEEP, list(METRICS)).groupBy("k", "space").agg(F.sum("n").alias("n"), F.count("class").alias("classes"), *[F.round(F.sum(m) / F.sum("n"), 6).alias(m) for m in METRICS])


_WIDE = "SELECT k, metric, avg(abs(value)) FILTER (WHERE space = 'prob') AS a, avg(abs(value)) FILTER (WHERE space = 'margin') AS b, avg(CASE WHEN abs(value) <= 1e-9 THEN 1.0 ELSE 0.0 END) FILTER (WHERE space = 'prob') AS flat FROM (UNPIVOT (SELECT instance_id, k, space, comprehensiveness, sufficiency FROM sw) ON comprehensiveness, sufficiency INTO NAME metric VALUE value) GROUP BY 1, 2"


@registry.add("l2_14_saturation_report", f"WITH {SWEPT_SQL} SELECT k, metric, round(a, 6) AS mean_abs_prob, round(b, 6) AS mean_abs_margin, round(flat, 6) AS flat_share, CASE WHEN a > 0 THEN round(b / a, 4) END AS ratio FROM ({_WIDE})")
def l2_14_saturation_report(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Mean absolute delta in both spaces, share of flat ones, ratio (null if all are flat)."""
    long = swept(spark, sf_dir, ks, ("comprehensiveness", "sufficiency")).unpivot(["instance_id", "k", "space"], ["comprehensiveness", "sufficiency"], "metric", "value")
    size = F.abs("value")
    one = long.groupBy("k", "metric").agg(
        F.avg(F.when(F.col("space") == "prob", size)).alias("a"),
        F.avg(F.when(F.col("space") == "margin", size)).alias("b"),
        F.avg(F.when(F.col("space") == "prob", F.when(size <= 1e-9, 1.0).otherwise(0.0))).alias("flat"),
    )
    return one.select("k", "metric", F.round("a", 6).alias("mean_abs_prob"), F.round("b", 6).alias("mean_abs_margin"), F.round("flat", 6).alias("flat_share"), F.when(F.col("a") > 0, F.round(F.col("b") / F.col("a"), 4)).alias("ratio"))


@registry.add("l2_14_saturation_report_k135", f"WITH {SWEPT_ALL_SQL} SELECT k, metric, round(a, 6) AS mean_abs_prob, round(b, 6) AS mean_abs_margin, round(flat, 6) AS flat_share, CASE WHEN a > 0 THEN round(b / a, 4) END AS ratio FROM ({_WIDE})")
def l2_14_saturation_report_k135(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l2_14_saturation_report(spark, sf_dir, SWEEP)


_CELL = "CASE WHEN c AND NOT s THEN 'load_bearing' WHEN c AND s THEN 'necessary_not_sufficient' WHEN NOT c AND NOT s THEN 'redundant' ELSE 'irrelevant' END"
_CELLS = f"cells2 AS (SELECT class, {_CELL} AS cell FROM (SELECT class, comprehensiveness >= 0.1 AS c, sufficiency >= 0.1 AS s FROM sw WHERE k = 1 AND space = 'prob'))"
CELLS = ("load_bearing", "redundant", "necessary_not_sufficient", "irrelevant")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = swept(spark, sf_dir, (1,), ("comprehensiveness", "sufficiency"), ("prob",))
    return rows.select("class", A.reliance(F.col("comprehensiveness"), F.col("sufficiency"), THRESHOLD).alias("cell"))


@registry.add("l2_16_classify", f"WITH {SWEPT_SQL}, {_CELLS} SELECT cell, count(*) AS n FROM cells2 GROUP BY 1")
def l2_16_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"))


@registry.add(
    "ag_04_tabulate",
    f"WITH {SWEPT_SQL}, {_CELLS} SELECT coalesce(class, '(all)') AS class, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE cell = '{c}') AS {c}" for c in CELLS)
    + " FROM cells2 GROUP BY GROUPING SETS ((class), ())",
)
def ag_04_tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four cells overall and by class, zeros included, in one pass of grouping sets."""
    rows = classified(spark, sf_dir)
    return rows.rollup("class").agg(F.count("*").alias("n"), *[F.count_if(F.col("cell") == c).alias(c) for c in CELLS]).withColumn("class", F.coalesce("class", F.lit("(all)")))


@registry.add("ag_03_layer2_per_class", f"WITH {SWEPT_SQL} SELECT coalesce(class, '(all)') AS class, space, count(*) AS n, round(avg(comprehensiveness), 6) AS mean FROM sw WHERE k = 3 GROUP BY GROUPING SETS ((space, class), (space))")
def ag_03_layer2_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = swept(spark, sf_dir, (3,), ("comprehensiveness",))
    grouped = rows.groupingSets([["space", "class"], ["space"]], "space", "class").agg(F.count("*").alias("n"), F.round(F.avg("comprehensiveness"), 6).alias("mean"))
    return grouped.withColumn("class", F.coalesce("class", F.lit("(all)")))


def decomposition(nar: Column, att: Column, model: Column, total: Column, slack: float = 0.0) -> dict[str, Column]:
    """L2-17: bound, residual and whether the total stays under the bound."""
    bound = nar + att + model
    return {"bound": bound, "residual": total - bound, "satisfies_bound": total <= bound + slack}


@registry.add(
    "l2_17_decomposition",
    f"WITH {SWEPT_SQL}, e AS (SELECT class, abs(comprehensiveness - comprehensiveness_cited) AS nar, abs(sufficiency) AS att, abs(sufficiency_cited) AS model, abs(comprehensiveness) AS total FROM sw WHERE k = 3 AND space = 'prob') SELECT class, round(avg(nar + att + model), 6) AS bound, round(avg(total - (nar + att + model)), 6) AS residual, count(*) FILTER (WHERE total <= nar + att + model + 1e-9) AS within FROM e GROUP BY 1",
)
def l2_17_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = swept(spark, sf_dir, (3,), tuple(PARTS), ("prob",))
    parts = decomposition(F.abs(F.col("comprehensiveness") - F.col("comprehensiveness_cited")), F.abs("sufficiency"), F.abs("sufficiency_cited"), F.abs("comprehensiveness"), 1e-9)
    rows = s.select("class", *[c.alias(n) for n, c in parts.items()])
    return rows.groupBy("class").agg(F.round(F.avg("bound"), 6).alias("bound"), F.round(F.avg("residual"), 6).alias("residual"), F.count_if("satisfies_bound").alias("within"))


@registry.add(
    "jn_01_inner_equi_join",
    f"WITH {SWEPT_SQL}, a AS (SELECT instance_id, class, comprehensiveness FROM sw WHERE k = 1 AND space = 'prob'), b AS (SELECT instance_id, class, sufficiency FROM sw WHERE k = 1 AND space = 'prob') SELECT a.class, count(*) AS pairs, round(sum(comprehensiveness * sufficiency), 4) AS product FROM a JOIN b ON a.instance_id = b.instance_id AND a.class IS NOT DISTINCT FROM b.class GROUP BY 1",
)
def jn_01_inner_equi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs the two deltas of an instance; the nullable grouping key is compared null-safe."""
    s = swept(spark, sf_dir, (1,), ("comprehensiveness", "sufficiency"), ("prob",))
    a, b = s.select("instance_id", "class", "comprehensiveness").alias("a"), s.select("instance_id", "class", "sufficiency").alias("b")
    met = a.join(b, (F.col("a.instance_id") == F.col("b.instance_id")) & F.col("a.class").eqNullSafe(F.col("b.class")))
    return met.groupBy("a.class").agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("comprehensiveness") * F.col("sufficiency")), 4).alias("product"))
