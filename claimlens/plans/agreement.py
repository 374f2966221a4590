"""Agreement of two passes, audit scores and intervals over annotation units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimlens.registry import Registry
from claimlens.sources import load

registry = Registry()
LABELS = ("+", "-", "unclear", "absent")

_LABEL = "CASE WHEN lower(trim(text_asserts_direction)) IN ('+', '-', 'unclear', 'absent') THEN lower(trim(text_asserts_direction)) END"
UNITS_SQL = f"""h AS (SELECT item_id, feature, annotator, arg_max({_LABEL}, row_id) AS label FROM annotations WHERE NOT added AND {_LABEL} IS NOT NULL GROUP BY 1, 2, 3),
ab AS (SELECT item_id, feature, max(label) FILTER (WHERE annotator = 'wheatear') AS a, max(label) FILTER (WHERE annotator = 'gannet') AS b FROM h GROUP BY 1, 2),
two AS (SELECT * FROM ab WHERE a IS NOT NULL AND b IS NOT NULL)"""


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-09: (item_id, feature, annotator) -> label, the last row winning."""
    bare = F.lower(F.trim("text_asserts_direction"))
    rows = load(spark, sf_dir, "annotations").filter(~F.col("added") & bare.isin(*LABELS))
    return rows.groupBy("item_id", "feature", "annotator").agg(F.max(F.struct("row_id", bare.alias("label"))).alias("x")).select("item_id", "feature", "annotator", F.col("x.label").alias("label"))


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that two annotators labelled: columns a and b."""
    wide = human(spark, sf_dir).filter(F.col("annotator").isin("wheatear", "gannet")).groupBy("item_id", "feature").pivot("annotator", ["wheatear", "gannet"]).agg(F.max("label"))
    return wide.select("item_id", "feature", F.col("wheatear").alias("a"), F.col("gannet").alias("b")).na.drop()


@registry.add(
    "st_12_cohens_kappa",
    f"WITH {UNITS_SQL}, n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = b) AS same FROM two), m AS (SELECT l, (SELECT count(*) FROM two WHERE a = l) AS ca, (SELECT count(*) FROM two WHERE b = l) AS cb FROM (SELECT unnest(['+', '-', 'unclear', 'absent']) AS l)), e AS (SELECT sum(ca * cb) AS s FROM m) SELECT n::BIGINT AS units, round(same / n, 6) AS agreement, round(CASE WHEN s / (n * n) = 1 THEN 1.0 ELSE (same / n - s / (n * n)) / (1 - s / (n * n)) END, 6) AS kappa FROM n, e",
)
def st_12_cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = both(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), *[F.count_if(F.col(c) == x).alias(f"{c}{i}") for c in "ab" for i, x in enumerate(LABELS)])
    n = F.col("n")
    by_chance = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(1, 4)), F.col("a0") * F.col("b0")) / (n * n)
    seen = F.col("same") / n
    return counts.filter("n > 0").select(n.alias("units"), F.round(seen, 6).alias("agreement"), F.round(F.when(by_chance == 1, 1.0).otherwise((seen - by_chance) / (1 - by_chance)), 6).alias("kappa"))


@registry.add(
    "st_13_krippendorff_nominal",
    f"WITH {UNITS_SQL}, c AS (SELECT item_id, feature, label, count(*) AS c FROM h GROUP BY 1, 2, 3), u AS (SELECT item_id, feature, sum(c) AS m, sum(c * (c - 1)) AS same FROM c GROUP BY 1, 2), k AS (SELECT * FROM u WHERE m > 1), t AS (SELECT label, sum(c) AS t FROM c JOIN k USING (item_id, feature) GROUP BY 1), n AS (SELECT sum(m)::DOUBLE AS n, sum(same / (m - 1)::DOUBLE) AS s, count(*) AS units FROM k), e AS (SELECT sum(t * (t - 1))::DOUBLE AS p FROM t) SELECT units, n::BIGINT AS labels, round(1 - (1 - s / n) / (1 - p / (n * (n - 1))), 6) AS alpha FROM n, e",
)
def st_13_krippendorff_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coincidences from label counts of a unit, so no pairs of labels are made."""
    u = human(spark, sf_dir).groupBy("item_id", "feature").agg(F.count("*").alias("m"), *[F.count_if(F.col("label") == x).alias(f"c{i}") for i, x in enumerate(LABELS)]).filter("m > 1")
    pairs = lambda c: c * (c - 1)
    same = sum((pairs(F.col(f"c{i}")) for i in range(1, 4)), pairs(F.col("c0")))
    t = u.agg(F.count("*").alias("units"), F.sum("m").alias("n"), F.sum(same / (F.col("m") - 1)).alias("s"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(4)])
    chance = sum((pairs(F.col(f"t{i}")) for i in range(1, 4)), pairs(F.col("t0")))
    alpha = 1 - (1 - F.col("s") / F.col("n")) / F.nullif(1 - chance / (F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return t.select("units", F.col("n").alias("labels"), F.round(alpha, 6).alias("alpha"))


_GOLD = f"""{UNITS_SQL}, p AS (SELECT item_id, c.feature, max(c.dir) AS dir FROM (SELECT item_id, unnest(claims) AS c FROM llm_passes WHERE annotator = 'PASS_A_V2') WHERE c.dir IN ('+', '-') GROUP BY 1, 2),
u AS (SELECT t.item_id, t.feature, a, b, p.dir FROM two t LEFT JOIN p ON p.item_id = t.item_id AND p.feature = t.feature),
g AS (SELECT 'agreed' AS variant, item_id, feature, dir, CASE WHEN a = b THEN a END AS gold FROM u UNION ALL SELECT 'first', item_id, feature, dir, a FROM u UNION ALL SELECT 'second', item_id, feature, dir, b FROM u),
s AS (SELECT variant, count(*) FILTER (WHERE dir IS NOT NULL AND gold = dir) AS tp, count(*) FILTER (WHERE dir IS NOT NULL) AS predicted, count(*) FILTER (WHERE gold IN ('+', '-')) AS wanted FROM g GROUP BY 1)"""
_PRF = "round(tp / nullif(predicted, 0)::DOUBLE, 6) AS precision, round(tp / nullif(wanted, 0)::DOUBLE, 6) AS recall, round(2.0 * tp / nullif(predicted + wanted, 0), 6) AS f1"


def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-14: sets of predicted and wanted directional units under three ways to settle disputes."""
    p = load(spark, sf_dir, "llm_passes").filter("annotator = 'PASS_A_V2'").select("item_id", F.explode("claims").alias("c"))
    said = p.filter(F.col("c.dir").isin("+", "-")).groupBy("item_id", F.col("c.feature").alias("feature")).agg(F.max("c.dir").alias("dir"))
    u = both(spark, sf_dir).join(said, ["item_id", "feature"], "left")
    gold = F.inline_outer(F.array(F.struct(F.lit("agreed").alias("variant"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("gold")), F.struct(F.lit("first").alias("variant"), F.col("a").alias("gold")), F.struct(F.lit("second").alias("variant"), F.col("b").alias("gold"))))
    g = u.select("dir", gold)
    return g.groupBy("variant").agg(F.count_if(F.col("dir") == F.col("gold")).alias("tp"), F.count("dir").alias("predicted"), F.count_if(F.col("gold").isin("+", "-")).alias("wanted"))


@registry.add("st_14_prf", f"WITH {_GOLD} SELECT variant, tp, {_PRF} FROM s")
def st_14_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gold_scores(spark, sf_dir)
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return s.select("variant", "tp", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("wanted")).alias("recall"), ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("wanted")).alias("f1"))


@registry.add("st_15_audit_verdict", f"WITH {_GOLD}, f AS (SELECT 2.0 * tp / nullif(predicted + wanted, 0) AS f1 FROM s) SELECT round(min(f1), 6) AS least, round(max(f1), 6) AS most, min(f1) >= 0.95 AS passed, min(f1) < 0.95 AND max(f1) >= 0.95 AS straddles FROM f")
def st_15_audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed only if every way to settle disputes passes; straddling if they differ."""
    f = gold_scores(spark, sf_dir).select(F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("wanted")).alias("f1"))
    low, high = F.min("f1"), F.max("f1")
    return f.agg(F.round(low, 6).alias("least"), F.round(high, 6).alias("most"), (low >= 0.95).alias("passed"), ((low < 0.95) & (high >= 0.95)).alias("straddles"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """ST-16: Wilson interval; (0, 1) for no trials."""
    p = F.try_divide(hits, n)
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    whole = 1 + z * z / n
    return F.when(n > 0, (centre - spread) / whole).otherwise(0.0), F.when(n > 0, (centre + spread) / whole).otherwise(1.0)


_W = "(h / n + 1.96 * 1.96 / (2 * n) {0} 1.96 * sqrt((h / n * (1 - h / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)"


@registry.add("st_16_wilson_interval", f"WITH c AS (SELECT generator_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE abstained)::DOUBLE AS h FROM explanations GROUP BY 1) SELECT generator_id, round({_W.format('-')}, 6) AS low, round({_W.format('+')}, 6) AS high FROM c")
def st_16_wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "explanations").groupBy("generator_id").agg(F.count("*").cast("double").alias("n"), F.count_if("abstained").cast("double").alias("h"))
    low, high = wilson(F.col("h"), F.col("n"))
    return c.select("generator_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """ST-17: two-sided, the sum of tables no likelier than the one seen."""
    lg = math.lgamma
    rows, columns, n = (a + b, c + d), (a + c, b + d), a + b + c + d
    fixed = sum(lg(x + 1) for x in (*rows, *columns)) - lg(n + 1)

    def log_p(x: int) -> float:
        return fixed - lg(x + 1) - lg(rows[0] - x + 1) - lg(columns[0] - x + 1) - lg(rows[1] - columns[0] + x + 1)

    seen = log_p(a)
    every = [log_p(x) for x in range(max(0, columns[0] - rows[1]), min(rows[0], columns[0]) + 1)]
    return min(1.0, sum(math.exp(p) for p in every if p <= seen + 1e-7))


def log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series ten places up, brought back by the factors between."""
    z = n.cast("double") + 11
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = n.cast("double") + 1
    for i in range(2, 11):
        product = product * (n.cast("double") + i)
    return series - F.log(product)


@registry.add(
    "st_17_fisher_exact",
    """WITH t AS (SELECT count(*) FILTER (WHERE hedged AND annotator = 'marten') AS a, count(*) FILTER (WHERE NOT hedged AND annotator = 'marten') AS b, count(*) FILTER (WHERE hedged AND annotator = 'kestrel') AS c, count(*) FILTER (WHERE NOT hedged AND annotator = 'kestrel') AS d FROM annotations),
    x AS (SELECT a, b, c, d, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM t),
    l AS (SELECT a, x, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp FROM x)
    SELECT round(least(1.0, sum(exp(lp)) FILTER (WHERE lp <= (SELECT lp FROM l WHERE x = a) + 1e-7)), 6) AS p FROM l""",
)
def st_17_fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hedging of two annotators; one row for each possible table, each with its own log factorials."""
    own = lambda who, yes: F.count_if((F.col("annotator") == who) & (F.col("hedged") if yes else ~F.col("hedged")))
    t = load(spark, sf_dir, "annotations").agg(own("marten", True).alias("a"), own("marten", False).alias("b"), own("kestrel", True).alias("c"), own("kestrel", False).alias("d"))
    size = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    rows = t.withColumn("x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - F.col("d")), F.least(F.col("a") + F.col("b"), F.col("a") + F.col("c")))))
    a, b, c, d, x = (F.col(k) for k in "abcdx")
    lp = F.lit(0.0)
    for count, w in [*((e, 1) for e in (a + b, c + d, a + c, b + d)), *((e, -1) for e in (size, x, a + b - x, a + c - x, d - a + x))]:
        lp = lp + w * log_factorial(count)
    logs = rows.select("a", "x", lp.alias("lp"))
    seen = logs.filter("x = a").select(F.col("lp").alias("seen"))
    return logs.crossJoin(seen).filter("lp <= seen + 1e-7").agg(F.round(F.least(F.lit(1.0), F.sum(F.exp("lp"))), 6).alias("p"))


@registry.add(
    "st_18_group_rates",
    f"SELECT annotator, count(*) AS n, round(count(*) FILTER (WHERE hedged) / count(*)::DOUBLE, 6) AS hedged, round(count(*) FILTER (WHERE {_LABEL} = 'unclear') / count(*)::DOUBLE, 6) AS unclear, round(count(*) FILTER (WHERE {_LABEL} = 'absent') / count(*)::DOUBLE, 6) AS absent FROM annotations GROUP BY 1",
)
def st_18_group_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.lower(F.trim("text_asserts_direction"))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return load(spark, sf_dir, "annotations").groupBy("annotator").agg(F.count("*").alias("n"), rate(F.col("hedged")).alias("hedged"), rate(bare == "unclear").alias("unclear"), rate(bare == "absent").alias("absent"))


@registry.add("dm_20_annotation_cells", f"WITH {UNITS_SQL} SELECT coalesce(h.label, 'absent') AS label, count(*) AS n FROM (SELECT item_id, unnest(candidates) AS feature FROM probe_items) c LEFT JOIN h ON h.item_id = c.item_id AND h.feature = c.feature AND h.annotator = 'osprey' WHERE c.item_id IN (SELECT item_id FROM h WHERE annotator = 'osprey') GROUP BY 1")
def dm_20_annotation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omission is ``absent`` for items the annotator covered."""
    mine = human(spark, sf_dir).filter("annotator = 'osprey'")
    cells = load(spark, sf_dir, "probe_items").select("item_id", F.explode("candidates").alias("feature")).join(mine.select("item_id").distinct(), "item_id", "left_semi")
    return cells.join(mine, ["item_id", "feature"], "left").groupBy(F.coalesce("label", F.lit("absent")).alias("label")).agg(F.count("*").alias("n"))


@registry.add("pv_19_annotation_validation", f"WITH d AS (SELECT item_id, feature, annotator FROM annotations GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT 'repeated' AS finding, count(*) AS n FROM d UNION ALL SELECT 'outside the vocabulary', count(*) FROM annotations WHERE text_asserts_direction IS NOT NULL AND text_asserts_direction NOT IN ('+', '-', 'unclear', 'absent') UNION ALL SELECT 'items without labels', count(*) FROM probe_items p WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.item_id = p.item_id)")
def pv_19_annotation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, items = load(spark, sf_dir, "annotations"), load(spark, sf_dir, "probe_items")
    one = rows.groupBy("item_id", "feature", "annotator").count().filter("count > 1").agg(F.lit("repeated").alias("finding"), F.count("*").alias("n"))
    two = rows.filter(~F.col("text_asserts_direction").isin(*LABELS)).agg(F.lit("outside the vocabulary"), F.count("*"))
    three = items.join(rows.select("item_id"), "item_id", "left_anti").agg(F.lit("items without labels"), F.count("*"))
    return one.union(two).union(three)
