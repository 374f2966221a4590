"""Prompt rendering, knowledge lookup, dispatch tables, and stores keyed by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import attribution as A
from claimlens.functions import text as X
from claimlens.operators.flow import PHI_SQL, audited, background, names
from claimlens.plans import agreement, competence, layer2, statistics
from claimlens.plans import relational
from claimlens.plans.relational import l2_02_conditional_imputer
from claimlens.registry import Registry
from claimlens.sources import load

registry = Registry()
TEMPLATES = {2: "Explain why the flow counts as {label}.\n{evidence}", 3: "Explain why the flow counts as {label} and not as another class.\n{evidence}"}


def ranked_feature_list(ranked: Column) -> Column:
    """GN-03: numbered evidence lines that the verifier reads back."""
    line = lambda r: F.format_string("%d. %s (%s score)", r["rank"], r["feature"], F.when(r["direction"] == "+", "increases").otherwise("decreases"))
    return F.array_join(F.transform(ranked, line), "\n")


def feature_value_table(feature_names: Column, x: Column) -> Column:
    """GN-03: ``name=value`` by name."""
    pairs = F.array_sort(F.zip_with(feature_names, x, lambda n, v: F.struct(n.alias("n"), v.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: F.format_string("%s=%.4f", p["n"], p["v"])), "; ")


def select_template(classes: int) -> str:
    """GN-04: two classes have a wording of their own; more than two need one for many."""
    if classes < 2:
        raise ValueError("a decision has two classes at least")
    return TEMPLATES[min(classes, 3)]


def render_prompt(template: str, label: Column, evidence: Column) -> Column:
    """GN-05."""
    return F.replace(F.replace(F.lit(template), F.lit("{label}"), label), F.lit("{evidence}"), evidence)


_LIST = "string_agg(printf('%d. %s (%s score)', rank, feature, CASE direction WHEN '+' THEN 'increases' ELSE 'decreases' END), chr(10) ORDER BY rank)"


@registry.add("gn_03_ranked_feature_list", f"WITH {PHI_SQL}, t AS (SELECT instance_id, {_LIST} AS evidence FROM ranked WHERE rank <= 3 GROUP BY 1) SELECT evidence, count(*) AS n FROM t GROUP BY 1")
def gn_03_ranked_feature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).groupBy(ranked_feature_list(F.col("top")).alias("evidence")).agg(F.count("*").alias("n"))


@registry.add("gn_05_prompts", f"WITH {PHI_SQL}, t AS (SELECT instance_id, class, 'Explain why the flow counts as ' || class || ' and not as another class.' || chr(10) || {_LIST} AS prompt FROM ranked WHERE rank <= 3 GROUP BY 1, 2) SELECT sha256(prompt) AS prompt_sha256, class, count(*) AS n FROM t GROUP BY 1, 2")
def gn_05_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different prompts by hash; a completion is then a lookup in the ledger (``ll_02_replay``)."""
    prompt = render_prompt(select_template(3), F.col("class"), ranked_feature_list(F.col("top")))
    return audited(spark, sf_dir).groupBy(F.sha2(prompt, 256).alias("prompt_sha256"), "class").agg(F.count("*").alias("n"))


@registry.add("gn_07_knowledge_lookup", "WITH t AS (SELECT c.explanation_id, c.pos, f.description FROM claims c JOIN feature_catalog f ON f.feature = c.feature) SELECT description, count(*) AS used, min(pos) AS first_place FROM t GROUP BY 1")
def gn_07_knowledge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of the names that explanations cite; unknown names are left out."""
    kb = load(spark, sf_dir, "feature_catalog").select("feature", "description")
    cited = load(spark, sf_dir, "claims").groupBy("feature", "pos").agg(F.count("*").alias("n"))
    return cited.join(kb, "feature").groupBy("description").agg(F.sum("n").alias("used"), F.min("pos").alias("first_place"))


def judge_scores(text: Column, dimensions: tuple[str, ...] = ("clarity", "plausibility", "usefulness")) -> Column:
    """TX-09: the object from the first { to the last }, null unless it has all dimensions."""
    first, last = F.position(F.lit("{"), text), F.length(text) - F.position(F.lit("}"), F.reverse(text)) + 1
    parsed = F.from_json(F.when((first > 0) & (last > first), F.substr(text, first, last - first + 1)), ", ".join(f"{d} double" for d in dimensions))
    whole = F.lit(True)
    for d in dimensions:
        whole = whole & parsed[d].isNotNull()
    return F.when(whole, parsed)


def background_erasure(x: Column, removed: Column) -> Column:
    return A.erased(names(), x, background(), removed)


#: L2-03, GN-08, ST-21: what a configuration may name.
ERASURES: dict[str, Callable] = {"background": background_erasure, "conditional": l2_02_conditional_imputer}
GENERATORS: dict[str, Callable[..., Column]] = {"raw_list": X.render_list, "template": X.render_template}
TESTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "friedman_nemenyi": statistics.st_05_friedman_nemenyi,
    "mean_ci": statistics.st_08_bootstrap_mean_ci,
    "coverage_risk": statistics.wn_05_risk_coverage,
    "layer2_per_class": layer2.ag_03_layer2_per_class,
    "layer2_redundancy": layer2.ag_04_tabulate,
    "agreement": agreement.st_13_krippendorff_nominal,
    "competence": competence.cp_03_evaluate_competence,
    "cost_summary": relational.ag_07_cost_summary_pivot,
    "capability_scaling": relational.ag_08_capability_summary,
}


def build_result(spark: SparkSession, sf_dir: str, test: str) -> DataFrame:
    """ST-21: the named test; unknown names raise ``KeyError``."""
    return TESTS[test](spark, sf_dir)


def build_erasure(name: str) -> Callable:
    """L2-03."""
    if name not in ERASURES:
        raise ValueError(f"{name} is no erasure; there are {', '.join(ERASURES)}")
    return ERASURES[name]


def cached_attribution(df: DataFrame, root: str, key: str) -> DataFrame:
    """IO-16: attributions stored once by content key and read from there afterwards."""
    from pyspark.errors import AnalysisException

    path = f"{root}/{key[:2]}/{key}"
    spark = df.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def materialise_splits(splits: DataFrame, path: str) -> DataFrame:
    """IO-13: one folder for each split, written once; returns counts by split for the manifest."""
    splits.write.mode("errorifexists").partitionBy("split").parquet(path)
    return splits.sparkSession.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))
