"""Rank statistics, intervals and calibration of metrics over method x block scores.

Scores: method = event type, block = user, value = the user's mean event value.
Every statistic starts from an aggregate by method and block; windows run inside a
block (five methods) or over distinct values of a group, never over raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimlens.operators.flow import FLOW_SQL, audited
from claimlens.plans.parallel import in_order
from claimlens.registry import Registry
from claimlens.sources import load

registry = Registry()

#: Critical values of the Nemenyi test at 0.05 by number of methods.
Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}

SCORES_SQL = "scores AS (SELECT event_type AS method, user_id AS block, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"
RANKS_SQL = SCORES_SQL + """, ranks AS (SELECT method, block, value, rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1) / 2.0 AS rank FROM scores)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("block")).agg(F.round(F.avg("value"), 6).alias("value"))


def block_ranks(df: DataFrame) -> DataFrame:
    """WN-03: rank within the block, largest first, ties averaged."""
    by = Window.partitionBy("block")
    return df.withColumn("rank", F.rank().over(by.orderBy(F.desc("value"))) + (F.count("*").over(Window.partitionBy("block", "value")) - 1) / 2.0)


@registry.add("wn_03_average_ranks", f"WITH {RANKS_SQL} SELECT method, count(*) AS blocks, round(avg(rank), 6) AS mean_rank FROM ranks GROUP BY 1")
def wn_03_average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ranks(scores(spark, sf_dir)).groupBy("method").agg(F.count("*").alias("blocks"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def critical_difference(k: int, n: int) -> float:
    """ST-06: smallest difference of mean ranks that counts."""
    if k not in Q05:
        raise ValueError("the table holds 2 to 10 methods")
    return Q05[k] * math.sqrt(k * (k + 1) / (6 * n))


def friedman(ranks: DataFrame) -> DataFrame:
    """ST-05: tie-corrected chi square, its p for an even number of degrees, critical difference.

    Ties enter by sum(t^3 - t) over groups of equal values in a block.
    """
    per_method = ranks.groupBy("method").agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    total = per_method.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("r2"))
    tied = ranks.groupBy("block", "value").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    k, n = F.col("k"), F.col("n")
    one = total.crossJoin(F.broadcast(tied)).select("k", "n", ((12.0 / (n * k * (k + 1)) * F.col("r2") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * k * (k * k - 1)))).alias("chi2"))
    table = F.create_map(*[F.lit(x) for pair in Q05.items() for x in pair])
    half = F.col("chi2") / 2
    p = F.when(k == 5, F.exp(-half) * (1 + half)).when(k == 3, F.exp(-half))
    return one.select("k", "n", F.round("chi2", 4).alias("chi2"), F.round(p, 6).alias("p"), F.round(table[k.cast("int")] * F.sqrt(k * (k + 1) / (6.0 * n)), 6).alias("critical_difference"))


@registry.add(
    "st_05_friedman_nemenyi",
    f"""WITH {RANKS_SQL}, m AS (SELECT method, sum(rank) AS r, count(*) AS n FROM ranks GROUP BY 1),
    t AS (SELECT count(*)::DOUBLE AS k, max(n)::DOUBLE AS n, sum(r * r) AS r2 FROM m), g AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM ranks GROUP BY block, value)),
    x AS (SELECT k, n, (12 / (n * k * (k + 1)) * r2 - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi2 FROM t, g)
    SELECT k::BIGINT AS k, n::BIGINT AS n, round(chi2, 4) AS chi2, round(CASE k WHEN 5 THEN exp(-chi2 / 2) * (1 + chi2 / 2) WHEN 3 THEN exp(-chi2 / 2) END, 6) AS p, round(2.728 * sqrt(k * (k + 1) / (6 * n)), 6) AS critical_difference FROM x""",
)
def st_05_friedman_nemenyi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return friedman(block_ranks(scores(spark, sf_dir)))


@registry.add("st_06_critical_difference", "SELECT k, n, round(q * sqrt(k * (k + 1) / (6.0 * n)), 6) AS cd FROM (SELECT unnest([2, 3, 4, 5, 6, 7, 8, 9, 10]) AS k, unnest([1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164]::DOUBLE[]) AS q), (SELECT count(DISTINCT user_id) AS n FROM events)")
def st_06_critical_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(list(Q05.items()), "k int, q double")
    n = load(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n"))
    return table.crossJoin(n).select("k", "n", F.round(F.col("q") * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))), 6).alias("cd"))


@registry.add(
    "st_09_cohens_d",
    f"WITH {SCORES_SQL}, d AS (SELECT a.value - b.value AS d FROM scores a JOIN scores b ON a.block = b.block WHERE a.method = 'click' AND b.method = 'view') SELECT count(*) AS n, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) ELSE 0.0 END, 6) AS cohens_d FROM d",
)
def st_09_cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired: mean difference over its standard deviation, 0 if that is 0."""
    pairs = scores(spark, sf_dir).filter(F.col("method").isin("click", "view")).groupBy("block").pivot("method", ["click", "view"]).agg(F.first("value"))
    d = pairs.select((F.col("click") - F.col("view")).alias("d")).filter("d IS NOT NULL")
    return d.agg(F.count("*").alias("n"), F.round(F.when(F.stddev_samp("d") > 0, F.avg("d") / F.stddev_samp("d")).otherwise(0.0), 6).alias("cohens_d"))


@registry.add(
    "st_10_variance_shares",
    f"""WITH {SCORES_SQL}, g AS (SELECT avg(value) AS mean, var_pop(value) AS total, count(*) AS n FROM scores),
    f AS (SELECT 'method' AS factor, avg(value) AS m, count(*) AS c FROM scores GROUP BY method UNION ALL SELECT 'block', avg(value), count(*) FROM scores GROUP BY block),
    s AS (SELECT factor, CASE WHEN any_value(total) > 0 THEN least(1.0, sum(c * (m - mean) * (m - mean)) / any_value(n) / any_value(total)) ELSE 0.0 END AS share FROM f, g GROUP BY 1)
    SELECT factor, round(share, 6) AS share FROM s UNION ALL SELECT 'residual', round(greatest(0.0, 1 - sum(share)), 6) FROM s""",
)
def st_10_variance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted between-group variance over total variance for each factor, and what is left."""
    s = scores(spark, sf_dir)
    whole = s.agg(F.avg("value").alias("mean"), F.var_pop("value").alias("total"), F.count("*").alias("n"))
    groups = [s.groupBy(f).agg(F.avg("value").alias("m"), F.count("*").alias("c")).select(F.lit(f).alias("factor"), "m", "c") for f in ("method", "block")]
    met = groups[0].unionByName(groups[1]).crossJoin(F.broadcast(whole))
    between = F.sum(F.col("c") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))) / F.max("n")
    shares = met.groupBy("factor").agg(F.when(F.max("total") > 0, F.least(F.lit(1.0), between / F.max("total"))).otherwise(0.0).alias("share"))
    rest = shares.agg(F.lit("residual").alias("factor"), F.round(F.greatest(F.lit(0.0), 1 - F.sum("share")), 6).alias("share"))
    return shares.select("factor", F.round("share", 6).alias("share")).unionByName(rest)


@registry.add(
    "wn_05_risk_coverage",
    f"""WITH {SCORES_SQL}, o AS (SELECT method, block, value, row_number() OVER (PARTITION BY method ORDER BY value DESC, block) AS i, count(*) OVER (PARTITION BY method) AS n FROM scores),
    c AS (SELECT method, i / n::DOUBLE AS coverage, avg(1 - value / 1000) OVER (PARTITION BY method ORDER BY i ROWS UNBOUNDED PRECEDING) AS risk FROM o),
    t AS (SELECT method, coverage, risk, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS area FROM c WINDOW w AS (PARTITION BY method ORDER BY coverage))
    SELECT method, count(*) AS points, round(coalesce(sum(area), 0), 6) AS aurc FROM t GROUP BY 1""",
)
def wn_05_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the cumulative mean risk over coverage, most confident first, from the first point on."""
    return risk_coverage(scores(spark, sf_dir).select("method", "block", "value", (1 - F.col("value") / 1000).alias("risk")), "method", "value", "risk", "block")


def risk_coverage(df: DataFrame, group: str, confidence: str, risk: str, order: str) -> DataFrame:
    """Trapezoids between neighbouring points of the curve of (coverage, mean risk so far).

    Two neighbours differ in coverage by 1 / n, so the area is the sum of all risks of the
    curve less half of its first and last, over n; no row has to see the one before it.
    """
    curve = in_order(df.select(group, confidence, order, F.col(risk).alias("risk_")), [group], [F.desc(confidence), order], "risk_").select(group, "rn", "n", (F.col("running") / F.col("rn")).alias("mean"))
    weight = F.when((F.col("rn") == 1) & (F.col("n") == 1), 0.0).when((F.col("rn") == 1) | (F.col("rn") == F.col("n")), 0.5).otherwise(1.0)
    return curve.groupBy(group).agg(F.count("*").alias("points"), F.round(F.sum(F.col("mean") * weight / F.col("n")), 6).alias("aurc"))


@registry.add(
    "wn_08_holm_bonferroni",
    """WITH p AS (SELECT event_type AS hypothesis, round(1 / (1 + avg(value) % 37), 6) AS p FROM events GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY p, hypothesis) AS i, count(*) OVER () AS m FROM p)
    SELECT hypothesis, p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r""",
)
def wn_08_holm_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("hypothesis")).agg(F.round(1 / (1 + F.avg("value") % 37), 6).alias("p"))
    return holm(p)


def holm(p: DataFrame) -> DataFrame:
    """ST: step-down adjustment of (hypothesis, p); a table of hypotheses, not of rows."""
    order = Window.partitionBy(F.lit(1)).orderBy("p", "hypothesis")
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(F.lit(1))) - F.row_number().over(order) + 1) * F.col("p"))
    return p.withColumn("s", step).select("hypothesis", "p", F.round(F.max("s").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("adjusted"))


# Calibration: does a score separate flagged rows from clean ones?

LABELLED_SQL = FLOW_SQL + ", lab AS (SELECT class, l_linenumber AS part, floor(p * 100) AS score, CASE WHEN class = 'BENIGN' THEN 0 ELSE 1 END AS bad FROM scored), h AS (SELECT part, score, sum(bad) AS pos, sum(1 - bad) AS neg FROM lab GROUP BY 1, 2)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir)
    return rows.select("class", F.col("l_linenumber").alias("part"), F.floor(F.col("p") * 100).cast("double").alias("score"), F.when(F.col("class") == "BENIGN", 0).otherwise(1).alias("bad"))


def histogram(rows: DataFrame) -> DataFrame:
    """Counts by group and distinct score: what all rank statistics of a score need."""
    return rows.groupBy("part", "score").agg(F.sum("bad").alias("pos"), F.sum(1 - F.col("bad")).alias("neg"))


@registry.add("st_01_sensitivity_specificity", f"WITH {LABELLED_SQL} SELECT part, round(sum(CASE WHEN score > 50 THEN pos ELSE 0 END) / sum(pos)::DOUBLE, 6) AS sensitivity, round(sum(CASE WHEN score <= 50 THEN neg ELSE 0 END) / sum(neg)::DOUBLE, 6) AS specificity FROM h GROUP BY 1")
def st_01_sensitivity_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a threshold, higher meaning bad; strict on the side of bad."""
    h = histogram(labelled(spark, sf_dir))
    high = F.col("score") > 50
    return h.groupBy("part").agg(F.round(F.try_divide(F.sum(F.when(high, F.col("pos")).otherwise(0)), F.sum("pos")), 6).alias("sensitivity"), F.round(F.try_divide(F.sum(F.when(~high, F.col("neg")).otherwise(0)), F.sum("neg")), 6).alias("specificity"))


@registry.add(
    "wn_07_roc_auc",
    f"WITH {LABELLED_SQL}, c AS (SELECT part, pos, neg, sum(neg) OVER (PARTITION BY part ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM h) SELECT part, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))::DOUBLE, 6) ELSE 0.5 END AS auc FROM c GROUP BY 1",
)
def wn_07_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney over the histogram, ties counting half; 0.5 if one side is empty."""
    along = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    c = histogram(labelled(spark, sf_dir)).withColumn("below", F.sum("neg").over(along) - F.col("neg"))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return c.groupBy("part").agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.round(wins / (F.sum("pos") * F.sum("neg")), 6)).otherwise(0.5).alias("auc"))


@registry.add(
    "wn_06_operating_point",
    f"""WITH {LABELLED_SQL}, s AS (SELECT part, score, pos, neg, lead(score) OVER w AS up, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY part) AS tp, sum(neg) OVER (PARTITION BY part) AS tn FROM h WINDOW w AS (PARTITION BY part ORDER BY score)),
    j AS (SELECT part, round((score + up) / 2, 6) AS threshold, (tp - cp) / tp::DOUBLE + cn / tn::DOUBLE - 1 AS youden FROM s WHERE up IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(youden, 12) DESC, threshold) AS rn FROM j)
    SELECT part, threshold, round(youden, 6) AS youden FROM r WHERE rn = 1""",
)
def wn_06_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest Youden J over midpoints of neighbouring scores; ties go to the lowest threshold."""
    along = Window.partitionBy("part").orderBy("score")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("part")
    s = histogram(labelled(spark, sf_dir)).select("part", "score", F.lead("score").over(along).alias("up"), F.sum("pos").over(upto).alias("cp"), F.sum("neg").over(upto).alias("cn"), F.sum("pos").over(whole).alias("tp"), F.sum("neg").over(whole).alias("tn"))
    j = s.filter("up IS NOT NULL").select("part", F.round((F.col("score") + F.col("up")) / 2, 6).alias("threshold"), ((F.col("tp") - F.col("cp")) / F.col("tp") + F.col("cn") / F.col("tn") - 1).alias("youden"))
    best = j.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(F.desc(F.round("youden", 12)), "threshold"))).filter("rn = 1")
    return best.select("part", "threshold", F.round("youden", 6).alias("youden"))


def _pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """0 for fewer than two points or a constant side."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 2) & (vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy)).otherwise(0.0)


@registry.add(
    "st_02_fluency_correlation",
    f"""WITH {SCORES_SQL}, w AS (SELECT a.block, a.value AS x, b.value AS y FROM scores a JOIN scores b ON a.block = b.block WHERE a.method = 'click' AND b.method = 'view'),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM w),
    s AS (SELECT count(*)::DOUBLE AS n, sum(rx)::DOUBLE AS sx, sum(ry)::DOUBLE AS sy, sum(rx * rx)::DOUBLE AS sxx, sum(ry * ry)::DOUBLE AS syy, sum(rx * ry)::DOUBLE AS sxy FROM r)
    SELECT n::BIGINT AS n, round(CASE WHEN n >= 2 AND n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0 END, 6) AS spearman FROM s""",
)
def st_02_fluency_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman with averaged ranks, from the aggregate of one row for each block."""
    pairs = scores(spark, sf_dir).filter(F.col("method").isin("click", "view")).groupBy("block").pivot("method", ["click", "view"]).agg(F.first("value")).na.drop()
    ranked = pairs
    for column, out in (("click", "rx"), ("view", "ry")):
        counts = pairs.groupBy(column).agg(F.count("*").alias("c"))
        before = in_order(counts, [], [column], "c").select(column, (F.col("running") - F.col("c") + (F.col("c") + 1) / 2.0).alias(out))
        ranked = ranked.join(before, column)
    s = ranked.agg(F.count("*").alias("n"), *[F.sum(e).alias(a) for a, e in (("sx", F.col("rx")), ("sy", F.col("ry")), ("sxx", F.col("rx") * F.col("rx")), ("syy", F.col("ry") * F.col("ry")), ("sxy", F.col("rx") * F.col("ry")))])
    return s.select("n", F.round(_pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]), 6).alias("spearman"))


@registry.add("st_19_validate_judge", f"SELECT n, spearman, spearman >= 0.6 AS valid FROM ({registry.sql['st_02_fluency_correlation']})")
def st_19_validate_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge is valid if its scores rank the blocks as the reference scores do."""
    return st_02_fluency_correlation(spark, sf_dir).select("n", "spearman", (F.col("spearman") >= 0.6).alias("valid"))


#: Fixed value: resamples of a bootstrap.
RESAMPLES = 10_000


def bootstrap_interval(values: np.ndarray, resamples: int, seed: int) -> tuple[float, float, float]:
    """ST-08: mean with the 2.5 % and 97.5 % points of resampled means (multinomial weights)."""
    rng = np.random.default_rng(seed)
    means = np.empty(resamples)
    for at in range(0, resamples, 250):
        weights = rng.multinomial(len(values), np.full(len(values), 1 / len(values)), size=min(250, resamples - at))
        means[at : at + len(weights)] = weights @ values / len(values)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(values.mean()), float(low), float(high)


@registry.add("st_08_bootstrap_mean_ci", None)
def st_08_bootstrap_mean_ci(spark: SparkSession, sf_dir: str, resamples: int = RESAMPLES) -> DataFrame:
    """Interval of the mean by method. Each partition resamples its own rows with Poisson weights and
    sends sums for every resample, so no group is gathered and the result has one row for each method."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for method, part in batch.groupby("method"):
                sums, sizes = np.zeros(resamples), np.zeros(resamples)
                # a row's weights depend on its key only, so the partitioning does not matter
                for block, value in zip(part["key"].to_numpy(), part["value"].to_numpy(), strict=True):
                    weights = np.random.Generator(np.random.Philox(key=int(block) & 0xFFFFFFFFFFFFFFFF)).poisson(1.0, resamples)
                    sums += weights * value
                    sizes += weights
                yield pd.DataFrame({"method": method, "r": np.arange(resamples), "s": sums, "w": sizes, "t": part["value"].sum() / resamples, "n": len(part) / resamples})

    keyed = scores(spark, sf_dir).select("method", "value", F.xxhash64("method", "block").alias("key"))
    parts = keyed.mapInPandas(run, "method string, r int, s double, w double, t double, n double")
    one = parts.groupBy("method", "r").agg((F.sum("s") / F.sum("w")).alias("mean"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    return one.groupBy("method").agg((F.sum("t") / F.sum("n")).alias("mean"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def wilcoxon(differences: list[float]) -> tuple[float, float]:
    """ST-07: signed-rank statistic and two-sided p; exact up to 25 differences without ties, else normal."""
    d = np.array([x for x in differences if x != 0])
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    sizes = np.abs(d)
    values, inverse, counts = np.unique(sizes, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    plus = float(ranks[d > 0].sum())
    stat = min(plus, n * (n + 1) / 2 - plus)
    if n <= 25 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return stat, float(min(1.0, 2 * ways[: int(stat) + 1].sum() / 2**n))
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - (counts**3 - counts).sum() / 2) / 24)
    z = (stat - n * (n + 1) / 4) / spread
    return stat, float(math.erfc(abs(z) / math.sqrt(2)))


#: Coefficients of the rational Chebyshev fit of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal value, to 1.2e-7 of itself."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        series = c + t * series
    return t * F.exp(-x * x + series)


_SERIES = f"{ERFC[-1]}"
for _c in ERFC[-2::-1]:
    _SERIES = f"({_c} + t * {_SERIES})"


@registry.add(
    "st_07_wilcoxon_pair",
    f"""WITH {SCORES_SQL}, w AS (SELECT a.value - b.value AS d FROM scores a JOIN scores b ON a.block = b.block WHERE a.method = 'click' AND b.method = 'view' AND a.value <> b.value),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM w),
    k AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM w GROUP BY abs(d))),
    s AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(rank) FILTER (WHERE d > 0), 0)::DOUBLE AS plus FROM r),
    v AS (SELECT n, least(plus, n * (n + 1) / 2 - plus) AS statistic, ties FROM s, k),
    y AS (SELECT n, statistic, (statistic - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM v),
    q AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + abs(z) / sqrt(2) / 2) AS t FROM y)
    SELECT n::BIGINT AS n, statistic, round(z, 6) AS z, round(t * exp(-x * x + {_SERIES}), 6) AS p FROM q""",
)
def st_07_wilcoxon_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank test of two methods over blocks by the normal approximation with tie correction, all in aggregates."""
    s = scores(spark, sf_dir).filter(F.col("method").isin("click", "view")).groupBy("block").pivot("method", ["click", "view"]).agg(F.first("value"))
    d = s.select((F.col("click") - F.col("view")).alias("d")).filter("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    r = in_order(d, [], ["size"], "c").withColumn("rank", F.col("running") - (F.col("c") - 1) / 2.0)
    t = r.agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n = F.col("n")
    stat = F.least(F.col("plus"), n * (n + 1) / 2 - F.col("plus"))
    z = (stat - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    return t.select("n", stat.cast("double").alias("statistic"), F.round(z, 6).alias("z"), F.round(two_sided(z), 6).alias("p"))


def random_intercept(groups: list[tuple[int, float, float]]) -> dict[str, float]:
    """ST-11: REML variance split from (size, mean, within sum of squares) of each group, by search over the ratio."""
    sizes, means, within = (np.array(x, dtype=float) for x in zip(*groups, strict=True))
    n, k = sizes.sum(), len(sizes)

    def loss(ratio: float) -> tuple[float, float, float]:
        w = sizes / (1 + ratio * sizes)
        mu = (w * means).sum() / w.sum()
        square = (within.sum() + (w * (means - mu) ** 2).sum()) / (n - 1)
        return (n - 1) * math.log(max(square, 1e-300)) + np.log1p(ratio * sizes).sum() + math.log(w.sum()), square, mu

    low, high = -12.0, 12.0
    points = np.linspace(low, high, 97)
    for _ in range(6):
        values = [loss(math.exp(x))[0] for x in points]
        at = int(np.argmin(values))
        points = np.linspace(points[max(0, at - 1)], points[min(len(points) - 1, at + 1)], 25)
    ratio = math.exp(points[len(points) // 2])
    if loss(0.0)[0] <= loss(ratio)[0] or k < 2:
        ratio = 0.0
    _, square, mu = loss(ratio)
    return {"intercept": mu, "residual": square, "between": ratio * square, "icc": ratio / (1 + ratio)}


@registry.add("st_20_layer1_matrix", f"WITH {SCORES_SQL} SELECT m.method, b.block, coalesce(s.value, 0.0) AS value FROM (SELECT DISTINCT event_type AS method FROM events) m CROSS JOIN (SELECT DISTINCT user_id AS block FROM events) b LEFT JOIN scores s ON s.method = m.method AND s.block = b.block")
def st_20_layer1_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02: every method for every block, 0 where it has no value; methods are a list of known names."""
    s = scores(spark, sf_dir)
    methods = s.select("method").distinct()
    every = s.select("block").distinct().crossJoin(F.broadcast(methods))
    return every.join(s, ["method", "block"], "left").select("method", "block", F.coalesce("value", F.lit(0.0)).alias("value"))
