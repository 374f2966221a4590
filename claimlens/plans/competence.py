"""Detector competence, the class-merging ladder and the calibration battery."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.functions import attribution as A
from claimlens.functions import corruption as C
from claimlens.operators.flow import CLAIMS_SQL, FEATURES, FLOW_SQL, TOP_K, audited, flow, with_attribution
from claimlens.registry import Registry
from claimlens.sources import shared_dir

registry = Registry()
BENIGN = "BENIGN"
#: Floors of the competence gate and of the ladder.
MIN_MACRO_F1, RECALL_FLOOR, MIN_SUPPORT, MERGE_SHARE, MIN_ATTACKS = 0.9, 0.8, 100, 0.5, 3

PREDICTED_SQL = FLOW_SQL + ", pred AS (SELECT class AS truth, CASE WHEN p >= 0.5 THEN 'DoS' WHEN p >= 0.4 THEN 'Probe' ELSE 'BENIGN' END AS guess, p FROM scored), c AS (SELECT truth, guess, count(*) AS n FROM pred GROUP BY 1, 2)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("p") >= 0.5, "DoS").when(F.col("p") >= 0.4, "Probe").otherwise(BENIGN)
    return flow(spark, sf_dir).select(F.col("class").alias("truth"), guess.alias("guess"), "p")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "guess").agg(F.count("*").alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """CP-02: labels are all of truth and guess; recall is null without true rows."""
    one = cells.select("n", F.inline_outer(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g")))), (F.col("truth") == F.col("guess")).alias("hit"))
    s = one.groupBy("label").agg(F.sum(F.col("n") * F.col("t")).alias("support"), F.sum(F.col("n") * F.col("g")).alias("guessed"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("t")).otherwise(0)).alias("tp"))
    return s.select("label", "support", "tp", F.try_divide("tp", "support").alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("guessed")), F.lit(0.0)).alias("f1"), (F.col("label") != BENIGN).alias("is_attack"))


_PER = """l AS (SELECT truth AS label FROM c UNION SELECT guess FROM c), s AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = label) AS support, (SELECT coalesce(sum(n), 0) FROM c WHERE guess = label) AS guessed, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = label AND guess = label) AS tp FROM l),
f AS (SELECT label, support, tp, tp / nullif(support, 0)::DOUBLE AS recall, coalesce(2.0 * tp / nullif(support + guessed, 0), 0) AS f1 FROM s)"""


@registry.add("cp_02_multiclass_table", f"WITH {PREDICTED_SQL}, {_PER} SELECT label, support::BIGINT AS support, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def cp_02_multiclass_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_class(confusion(predicted(spark, sf_dir))).select("label", "support", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@registry.add(
    "cp_01_binary_table",
    f"WITH {PREDICTED_SQL}, b AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE truth <> 'BENIGN' AND p >= 0.5) AS tp, count(*) FILTER (WHERE truth <> 'BENIGN' AND p < 0.5) AS fn, count(*) FILTER (WHERE truth = 'BENIGN' AND p >= 0.5) AS fp, count(*) FILTER (WHERE truth = 'BENIGN' AND p < 0.5) AS tn FROM pred) SELECT tp, fn, fp, tn, round((tp + tn) / n, 6) AS accuracy, round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1 FROM b",
)
def cp_01_binary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, said = F.col("truth") != BENIGN, F.col("p") >= 0.5
    t = predicted(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(bad & said).alias("tp"), F.count_if(bad & ~said).alias("fn"), F.count_if(~bad & said).alias("fp"), F.count_if(~bad & ~said).alias("tn"))
    f1 = lambda hit: F.coalesce(F.try_divide(2.0 * F.col(hit), 2 * F.col(hit) + F.col("fp") + F.col("fn")), F.lit(0.0))
    return t.select("tp", "fn", "fp", "tn", F.round((F.col("tp") + F.col("tn")) / F.col("n"), 6).alias("accuracy"), F.round((f1("tp") + f1("tn")) / 2, 6).alias("macro_f1"))


@registry.add(
    "cp_03_evaluate_competence",
    f"WITH {PREDICTED_SQL}, {_PER} SELECT round(avg(f1), 6) AS macro_f1, count(*) FILTER (WHERE label <> 'BENIGN' AND coalesce(recall, 0) < 0.8) AS below_floor, count(*) FILTER (WHERE label <> 'BENIGN' AND support < 100) AS thin, avg(f1) >= 0.9 AND count(*) FILTER (WHERE label <> 'BENIGN' AND (coalesce(recall, 0) < 0.8 OR support < 100)) = 0 AS competent FROM f",
)
def cp_03_evaluate_competence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = per_class(confusion(predicted(spark, sf_dir)))
    low, thin = F.col("is_attack") & (F.coalesce("recall", F.lit(0.0)) < RECALL_FLOOR), F.col("is_attack") & (F.col("support") < MIN_SUPPORT)
    return t.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count_if(low).alias("below_floor"), F.count_if(thin).alias("thin"), ((F.avg("f1") >= MIN_MACRO_F1) & (F.count_if(low | thin) == 0)).alias("competent"))


@registry.add(
    "cp_04_failing_classes",
    f"WITH {PREDICTED_SQL}, {_PER}, v AS (SELECT unnest(['BENIGN', 'DoS', 'Probe', 'Bot']) AS label) SELECT v.label, coalesce(support, 0)::BIGINT AS support, round(coalesce(recall, 0), 6) AS recall FROM v LEFT JOIN f ON f.label = v.label WHERE v.label <> 'BENIGN' AND (coalesce(support, 0) < 100 OR coalesce(recall, 0) < 0.8)",
)
def cp_04_failing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class of the vocabulary that the table lacks has no support and fails."""
    vocabulary = spark.createDataFrame([(x,) for x in (BENIGN, "DoS", "Probe", "Bot")], "label string")
    t = vocabulary.join(per_class(confusion(predicted(spark, sf_dir))), "label", "left")
    s, r = F.coalesce("support", F.lit(0)), F.coalesce("recall", F.lit(0.0))
    return t.filter((F.col("label") != BENIGN) & ((s < MIN_SUPPORT) | (r < RECALL_FLOOR))).select("label", s.alias("support"), F.round(r, 6).alias("recall"))


@registry.add(
    "cp_05_merge_groups",
    f"WITH {PREDICTED_SQL}, {_PER}, v AS (SELECT unnest(['DoS', 'Probe', 'Bot', 'Worm']) AS label, unnest(['Flood', 'Recon', 'Malware', 'Malware']) AS parent), bad AS (SELECT DISTINCT v.parent FROM v LEFT JOIN f ON f.label = v.label WHERE coalesce(support, 0) < 100 OR coalesce(recall, 0) < 0.8) SELECT v.parent, string_agg(v.label, ',' ORDER BY v.label) AS members FROM v SEMI JOIN bad b ON b.parent = v.parent GROUP BY 1",
)
def cp_05_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lineage group of every failing class."""
    v = spark.createDataFrame([("DoS", "Flood"), ("Probe", "Recon"), ("Bot", "Malware"), ("Worm", "Malware")], "label string, parent string")
    t = v.join(per_class(confusion(predicted(spark, sf_dir))), "label", "left")
    bad = t.filter((F.coalesce("support", F.lit(0)) < MIN_SUPPORT) | (F.coalesce("recall", F.lit(0.0)) < RECALL_FLOOR)).select("parent").distinct()
    return v.join(bad, "parent", "left_semi").groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("members"))


@dataclass(frozen=True)
class Decision:
    """DM-17: what the ladder decided; ``vocabulary`` is what is left to explain."""

    rung: int
    changed: bool
    vocabulary: tuple[str, ...]
    merges: dict[str, str] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()
    failing: tuple[str, ...] = ()
    #: no class fails, but the mean F1 does: the detector is at fault, which no merge repairs
    detector_defect: bool = False


class LadderExhausted(RuntimeError):
    """No rung of the ladder is left."""


def failing_of(table: dict[str, dict], vocabulary: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(c for c in vocabulary if c != BENIGN and (table.get(c, {}).get("n", 0) < MIN_SUPPORT or (table.get(c, {}).get("recall") or 0.0) < RECALL_FLOOR))


def resolve(table: dict[str, dict], vocabulary: tuple[str, ...], parents: dict[str, str], merged: bool = False, macro_f1: float | None = None, least_f1: float = MIN_MACRO_F1) -> Decision:
    """CP-06: stand, merge lineage groups, fall back to two classes, or give up.

    ``table`` maps a class to its ``n`` and ``recall``. Two classes that still
    fail exhaust the ladder. Where no class fails but ``macro_f1`` is under
    ``least_f1``, the vocabulary stands and the detector is at fault.
    """
    attacks = tuple(c for c in vocabulary if c != BENIGN)
    failing = failing_of(table, vocabulary)
    if not failing:
        return Decision(2 if merged else 1, merged, vocabulary, detector_defect=macro_f1 is not None and macro_f1 < least_f1)
    if len(attacks) <= 1:
        raise LadderExhausted("the two-class detector fails as well")
    if len(failing) / len(attacks) >= MERGE_SHARE:
        if merged:
            return Decision(3, True, (BENIGN, "ATTACK"), dict.fromkeys(attacks, "ATTACK"), (), failing)
        names = tuple(dict.fromkeys(c if c == BENIGN else parents.get(c, c) for c in vocabulary))
        return Decision(2, True, names, {c: parents.get(c, c) for c in attacks}, (), failing)
    groups = {parents.get(c, c) for c in failing}
    sizes = {g: [c for c in attacks if parents.get(c, c) == g] for g in groups}
    merges = {c: g for g, members in sizes.items() if len(members) > 1 for c in members}
    gone = tuple(c for c in failing if c not in merges)
    names = tuple(dict.fromkeys(merges.get(c, c) for c in vocabulary if c not in gone))
    if len([c for c in names if c != BENIGN]) < MIN_ATTACKS:
        return Decision(3, True, (BENIGN, "ATTACK"), dict.fromkeys(attacks, "ATTACK"), (), failing)
    return Decision(2, True, names, merges, gone, failing)


def apply_to_taxonomy(canonical: list[str], label_map: dict[str, str], parents: dict[str, str], decision: Decision) -> tuple[list[str], dict[str, str | None], dict[str, str]]:
    """CP-07: renamed classes in first-seen order, retargeted labels (none is dropped), groups of more than one member."""
    rename = {c: decision.merges.get(c, c) for c in canonical}
    names = [n for n in dict.fromkeys(rename[c] for c in canonical if c not in decision.excluded)]
    labels = {k: (None if v in decision.excluded else rename.get(v, v)) for k, v in label_map.items()}
    groups: dict[str, list[str]] = {}
    for c in names:
        groups.setdefault(parents.get(c, c), []).append(c)
    return names, labels, {c: g if len(groups[g]) > 1 else c for g in groups for c in groups[g]}


def parent_map_errors(canonical: list[str], parents: dict[str, str]) -> list[str]:
    """CP-08: the map is total, merges only, and leaves the benign class alone."""
    found = [f"{c} has no parent" for c in canonical if c not in parents]
    found += [f"{c} is no class" for c in parents if c not in canonical]
    if parents.get(BENIGN, BENIGN) != BENIGN:
        found.append("the benign class is merged")
    sizes: dict[str, int] = {}
    for c in canonical:
        sizes[parents.get(c, c)] = sizes.get(parents.get(c, c), 0) + 1
    return found + [f"{p} renames one class" for c, p in parents.items() if c in canonical and p != c and sizes[p] < 2]


# Corruption battery

_CORRUPT_SQL = CLAIMS_SQL + """, n AS (SELECT i.instance_id, i.class, count(c.pos) AS n, coalesce(max(c.rank), 0) AS top, count(*) FILTER (WHERE c.rank = 1) AS ones FROM inst i LEFT JOIN claims_ c ON c.instance_id = i.instance_id GROUP BY 1, 2)"""


@registry.add("co_01_fabricated_feature", f"WITH {_CORRUPT_SQL} SELECT class, sum(n + 1)::BIGINT AS claims, sum(top + 1)::BIGINT AS new_rank FROM n GROUP BY 1")
def co_01_fabricated_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.fabricated_feature(F.col("claims"))
    rows = audited(spark, sf_dir).select("class", made.alias("m"))
    return rows.groupBy("class").agg(F.sum(F.size("m.claims")).alias("claims"), F.sum(F.element_at("m.claims", -1)["rank"]).alias("new_rank"))


_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY magnitude DESC, pos) AS mr, row_number() OVER (PARTITION BY instance_id ORDER BY pos) AS ix, row_number() OVER (PARTITION BY instance_id ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 1 END, pos) AS r1 FROM claims_)"


@registry.add("co_02_sign_flip", f"WITH {_CORRUPT_SQL}, {_TOP} SELECT CASE WHEN direction IS NULL THEN 'skipped' ELSE 'corrupted' END AS label, count(*) AS n, count(*) FILTER (WHERE direction = '-') AS now_raising FROM t WHERE mr = 1 GROUP BY 1")
def co_02_sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).filter(F.size("claims") > 0).select(C.sign_flip(F.col("claims")).alias("m"), C.highest_magnitude(F.col("claims")).alias("i"))
    return rows.groupBy(F.col("m.label").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.get("m.claims", F.col("i"))["direction"] == "+").alias("now_raising"))


@registry.add("co_03_rank_inversion", f"WITH {_CORRUPT_SQL}, {_TOP}, s AS (SELECT instance_id, max(rank) FILTER (WHERE ix = 1) AS r1, max(rank) FILTER (WHERE ix = 2) AS r2, count(*) AS n FROM t GROUP BY 1) SELECT count(*) AS n, sum(CASE WHEN n < 2 THEN r1 ELSE r2 END)::BIGINT AS first_ranks FROM s")
def co_03_rank_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).filter(F.size("claims") > 0).select(C.rank_inversion(F.col("claims")).alias("m"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.get("m.claims", F.lit(0))["rank"]).alias("first_ranks"))


@registry.add("co_04_omission", f"WITH {_CORRUPT_SQL}, {_TOP} SELECT feature, count(*) AS kept FROM t WHERE r1 <> 1 GROUP BY 1")
def co_04_omission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select(C.omission(F.col("claims")).alias("m")).select(F.inline_outer("m.claims")).filter("feature IS NOT NULL")
    return rows.groupBy("feature").agg(F.count("*").alias("kept"))


@registry.add("co_05_magnitude_inflation", f"WITH {_CORRUPT_SQL}, {_TOP} SELECT feature, round(sum(CASE WHEN mr = 1 THEN magnitude * 3.0 ELSE magnitude END), 4) AS weight FROM t GROUP BY 1")
def co_05_magnitude_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select(C.magnitude_inflation(F.col("claims")).alias("m")).select(F.inline_outer("m.claims")).filter("feature IS NOT NULL")
    return rows.groupBy("feature").agg(F.round(F.sum("magnitude"), 4).alias("weight"))


@registry.add("co_06_vague_substitution", f"WITH {_CORRUPT_SQL}, {_TOP} SELECT CASE WHEN r1 = 1 THEN 'some network feature' ELSE feature END AS feature, count(*) AS n FROM t GROUP BY 1")
def co_06_vague_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select(C.vague_substitution(F.col("claims")).alias("m")).select(F.inline_outer("m.claims")).filter("feature IS NOT NULL")
    return rows.groupBy("feature").agg(F.count("*").alias("n"))


#: Metrics that corruption raises instead of lowering.
RISES = ("hfr", "sufficiency_cited", "sufficiency_cited_per_feature")


#: The operators that a metric is designated to detect; an operator that no metric has is a blind spot.
DESIGNATED = {"hfr": ("fabricated_feature", "vague_substitution"), "mention_precision": ("fabricated_feature",), "mention_recall": ("omission", "vague_substitution"), "dsa_asserted": ("sign_flip",), "arc": ("rank_inversion",)}
SENSITIVITY = SPECIFICITY = 0.9


def battery(counts: DataFrame) -> DataFrame:
    """Verdicts from rows (metric, operator, score, n), with operator ``faithful`` for the clean claims.

    The operating point is the largest Youden J of all corrupted against all clean
    scores over the midpoints of neighbouring scores and one beyond each end, ties to
    the lowest threshold; scores strictly on its bad side count as corrupted. AUC is
    0.5 if one side is empty.
    """
    low, faithful = ~F.col("metric").isin(*RISES), F.col("operator") == "faithful"
    h = counts.groupBy("metric", "score").agg(F.sum(F.when(faithful, 0).otherwise(F.col("n"))).alias("pos"), F.sum(F.when(faithful, F.col("n")).otherwise(0)).alias("neg"))
    along, whole = Window.partitionBy("metric").orderBy("score"), Window.partitionBy("metric")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(w).alias(a) for c, w, a in (("pos", upto, "cp"), ("neg", upto, "cn"), ("pos", whole, "tp"), ("neg", whole, "tn"))]
    s = h.select("metric", "score", "pos", "neg", F.lead("score").over(along).alias("up"), F.lag("score").over(along).alias("down"), *sums)

    beyond = F.when(low, F.col("tn") - F.col("cn")).otherwise(F.col("cn") - F.col("neg"))
    wins = F.sum(F.col("pos") * (beyond + F.col("neg") / 2.0)) / (F.max("tp") * F.max("tn"))
    auc = s.groupBy("metric").agg(F.when((F.max("tp") > 0) & (F.max("tn") > 0), F.round(wins, 6)).otherwise(0.5).alias("auc"))

    single = F.col("up").isNull() & F.col("down").isNull()
    above = F.when(single, F.when(low, F.col("score"))).otherwise(F.coalesce((F.col("score") + F.col("up")) / 2, F.col("score") + 1))
    first = F.when(F.col("down").isNull(), F.when(single, F.when(~low, F.col("score"))).otherwise(F.col("score") - 1))
    # at a single score nothing lies on the bad side: below it where low is bad, above it else
    under = F.when(single, F.lit(0)).otherwise(F.col("cp")), F.when(single, F.lit(0)).otherwise(F.col("cn"))
    least = F.when(single, F.col("cp")).otherwise(F.lit(0)), F.when(single, F.col("cn")).otherwise(F.lit(0))
    points = s.select("metric", "tp", "tn", F.inline(F.array(F.struct(above.alias("threshold"), under[0].alias("cp"), under[1].alias("cn")), F.struct(first.alias("threshold"), least[0].alias("cp"), least[1].alias("cn"))))).filter("threshold IS NOT NULL")
    bad, good = F.when(low, F.col("cp")).otherwise(F.col("tp") - F.col("cp")), F.when(low, F.col("tn") - F.col("cn")).otherwise(F.col("cn"))
    rated = points.select("metric", "threshold", F.coalesce(F.try_divide(bad, F.col("tp")), F.lit(0.0)).alias("pooled"), F.coalesce(F.try_divide(good, F.col("tn")), F.lit(0.0)).alias("specificity"))
    j = rated.withColumn("youden", F.col("pooled") + F.col("specificity") - 1)
    best = j.withColumn("rn", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc(F.round("youden", 12)), "threshold"))).filter("rn = 1")

    hit = F.when(low, F.col("score") < F.col("threshold")).otherwise(F.col("score") > F.col("threshold"))
    each = counts.filter(~faithful).join(F.broadcast(best.drop("rn", "pooled")), "metric").groupBy("metric", "operator", "threshold", "youden", "specificity")
    rows = each.agg(F.sum("n").alias("n"), (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("sensitivity"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("mean"))
    mine = F.lit(False)
    for metric, operators in DESIGNATED.items():
        mine = mine | ((F.col("metric") == metric) & F.col("operator").isin(*operators))
    judged = rows.withColumn("designated", mine).withColumn("reached", F.when(mine, (F.col("sensitivity") >= SENSITIVITY) & (F.col("specificity") >= SPECIFICITY)))
    blind_spot = ~F.col("operator").isin(*{o for operators in DESIGNATED.values() for o in operators})
    done = judged.withColumn("admissible", F.min("reached").over(whole)).join(F.broadcast(auc), "metric")
    rounded = [F.round(c, 6).alias(c) for c in ("threshold", "youden", "specificity", "sensitivity")]
    return done.select("metric", "operator", "n", *rounded, "auc", "mean", "designated", "reached", "admissible", (F.col("sensitivity") == 0).alias("blind"), blind_spot.alias("blind_spot"))


def alike(rows: DataFrame) -> DataFrame:
    """Rows (phi, n): how many of ``rows`` have attributions that the battery cannot tell apart.

    Corruptions and metrics read which attributions are larger, equal, zero, NaN or
    null, and their signs, but no size. So each is replaced by its sign times one more
    than the number of smaller ones, which keeps all of that. Four features have at
    most 3393 such patterns, whatever the table; 610 occur at sf0.1.
    """
    phi = [F.get("phi", F.lit(i)) for i in range(len(FEATURES))]

    def place(value: Column) -> Column:
        return F.signum(value) * sum((F.coalesce((F.abs(v) < F.abs(value)).cast("int"), F.lit(0)) for v in phi), F.lit(1))

    placed = rows.select(*[place(v).alias(n) for v, n in zip(phi, FEATURES, strict=True)])
    return placed.groupBy(*FEATURES).agg(F.count("*").alias("n")).select(F.array(*FEATURES).alias("phi"), "n")


def battery_counts(patterns: DataFrame) -> DataFrame:
    """Rows (metric, operator, score, n) of the faithful claims and all their corruptions, from rows (phi, n).

    Faithful claims are the ranking itself; all variants of a row are made beside each other.
    """
    from claimlens.operators.flow import names
    from claimlens.plans.layer1 import METRICS, metric_columns

    rows = patterns.select("n", A.ranked(names(), F.col("phi"), TOP_K).alias("top"))
    faithful = F.transform("top", lambda r: C.claim(r["feature"], r["direction"], r["rank"], F.abs(r["value"]), F.lit("word"))).cast(A.CLAIM)
    base = rows.select("n", "top", faithful.alias("faithful"))
    made = [F.struct(F.lit("faithful").alias("operator"), F.col("faithful").alias("claims")), *[F.struct(F.lit(n).alias("operator"), op(F.col("faithful"))["claims"].alias("claims")) for n, op in C.OPERATORS.items()]]
    variants = base.select("n", "top", F.inline_outer(F.array(*made)))
    values = metric_columns(F.col("claims"), F.col("top"), names())
    long = variants.select("n", "operator", F.inline_outer(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(values[m], 12).alias("score")) for m in METRICS])))
    return long.groupBy("metric", "operator", "score").agg(F.sum("n").alias("n"))


@registry.add("st_03_battery_summary", None)
def st_03_battery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each metric its operating point, AUC, specificity and verdict, and its sensitivity to each corruption at that point.

    Flows are counted by pattern in one scan; only patterns are corrupted and
    measured, and their histogram of few scores is kept once.
    """
    shared_dir(spark)
    return battery(battery_counts(alike(with_attribution(flow(spark, sf_dir)))).checkpoint())
