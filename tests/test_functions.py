"""Goldens of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from claimlens.functions import attribution as A
from claimlens.functions import corruption as C
from claimlens.functions import text as X
from claimlens.plans import agreement, competence, layer1, statistics


def claims_of(spark, rows):
    return spark.createDataFrame([(rows,)], f"claims {A.CLAIM}")


def test_layer1_golden(spark):
    df = claims_of(spark, [("A", "+", 1, 0.5, "word"), ("B", "+", 2, 0.3, "default"), ("Z", "+", 3, 0.1, "word")])
    df = df.withColumn("top", A.ranked(F.array(*map(F.lit, "ABC")), F.array(F.lit(0.5), F.lit(-0.4), F.lit(0.3)), 3))
    m = df.select(*[c.alias(n) for n, c in layer1.metric_columns(F.col("claims"), F.col("top"), F.array(*map(F.lit, "ABC"))).items()]).first().asDict()
    want = {"mention_precision": 2 / 3, "mention_recall": 2 / 3, "mention_f1": 2 / 3, "dsa": 0.5, "dsa_asserted": 1.0, "direction_assertion_rate": 0.5, "hfr": 1 / 3, "arc": 1.0, "arc_n_pairs": 2.0}
    assert m == pytest.approx(want)


def test_layer1_without_claims_is_zero(spark):
    df = claims_of(spark, []).withColumn("top", A.ranked(F.array(F.lit("A")), F.array(F.lit(0.0)), 3))
    m = df.select(*[c.alias(n) for n, c in layer1.metric_columns(F.col("claims"), F.col("top"), F.array(F.lit("A"))).items()]).first()
    assert set(m) == {0.0}


def test_ranking_ties_keep_the_order(spark):
    row = spark.range(1).select(A.ranked(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, (0.0, 0.3, -0.3, 0.0)))).alias("r")).first()
    assert [x["feature"] for x in row["r"]] == list("bcad")
    assert [x["direction"] for x in row["r"]] == ["+", "-", "+", "+"]


def test_null_evidence_counts_as_stated(spark):
    df = claims_of(spark, [("A", "+", 1, None, None), ("B", None, 2, None, "default")])
    assert df.select(F.size(A.asserted(F.col("claims")))).first()[0] == 1


def test_cited_takes_known_features_once(spark):
    df = claims_of(spark, [("ghost", "+", 1, None, None), ("B", "+", None, None, None), ("A", "+", 2, None, None), ("A", "-", 3, None, None)])
    assert df.select(A.cited(F.col("claims"), F.array(F.lit("A"), F.lit("B")), 2)).first()[0] == ["A", "B"]


def test_corruptions(spark):
    base = claims_of(spark, [("A", "+", 2, 0.2, "word"), ("B", "-", 1, 0.9, "word")])
    got = {n: base.select(op(F.col("claims")).alias("m")).select("m.*").first() for n, op in C.OPERATORS.items()}
    assert [c["feature"] for c in got["omission"]["claims"]] == ["A"]
    assert got["sign_flip"]["claims"][1]["direction"] == "+" and got["sign_flip"]["claims"][1]["direction_evidence"] is None
    assert [c["rank"] for c in got["rank_inversion"]["claims"]] == [1, 2]
    assert got["fabricated_feature"]["claims"][2]["rank"] == 3
    assert got["magnitude_inflation"]["claims"][1]["magnitude"] == pytest.approx(2.7)
    assert got["vague_substitution"]["claims"][1]["feature"] == "some network feature"
    with pytest.raises(KeyError):
        C.apply_operator("unknown", F.col("claims"))


def test_sign_flip_skips_a_claim_without_direction(spark):
    row = claims_of(spark, [("A", None, 1, 0.9, "default")]).select(C.sign_flip(F.col("claims")).alias("m")).select("m.*").first()
    assert row["label"] == "skipped" and row["claims"][0]["direction_evidence"] == "default"


def test_extraction_masks_longer_names(spark):
    text = "Fwd Packet Length Mean pushed the score up. Packet Length Mean = -0.5; Other Thing reduced it by 3.5 points."
    variants = [("fwd packet length mean", "Fwd Packet Length Mean"), ("packet length mean", "Packet Length Mean"), ("other thing", "Other Thing")]
    df = spark.createDataFrame([(text, variants)], "text string, variants array<struct<variant:string,feature:string>>")
    got = X.with_claims(X.with_mentions(df, "text", "variants"), "text", "hits").select(F.inline("claims")).collect()
    assert [(r["feature"], r["direction"], r["direction_evidence"]) for r in got] == [("Fwd Packet Length Mean", "+", "word"), ("Packet Length Mean", "-", "number"), ("Other Thing", "-", "word")]
    assert got[1]["magnitude"] == 0.5


def test_json_claims_leave_out_what_has_no_direction(spark):
    df = spark.createDataFrame([('x [{"feature":"A","direction":"+"},{"feature":"B","direction":null}] y',), ("no json",)], "t string")
    got = [r[0] for r in df.select(X.parse_claims(F.col("t"))).collect()]
    assert [c["feature"] for c in got[0]] == ["A"] and not got[1]


def test_verifier_reasons(spark):
    df = spark.createDataFrame([("Gap rose to a higher level", [("Gap", "+")]), ("Gap was reduced", [("Gap", "+")]), ("nothing", [("Gap", "+")]), ("x", [])], "t string, e array<struct<feature:string,direction:string>>")
    assert [r[0] for r in df.select(X.verdict(F.col("t"), F.col("e"))).collect()] == ["supported", "direction_mismatch", "no_cited_feature", "no_evidence"]


def test_reliance_thresholds_are_high(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.1, 0.0), (0.0, 0.0), (0.0, 0.2)], "c double, s double")
    assert [r[0] for r in df.select(A.reliance(F.col("c"), F.col("s"), 0.1)).collect()] == ["necessary_not_sufficient", "load_bearing", "redundant", "irrelevant"]


def test_friedman_golden(spark):
    rows = [("b1", i, v) for i, v in enumerate((0.9, 0.8, 0.9, 0.7, 0.95))] + [("b2", i, v) for i, v in enumerate((0.5, 0.4, 0.3, 0.3, 0.5))] + [("b3", i, v) for i, v in enumerate((0.4, 0.3, 0.4, 0.2, 0.4))]
    ranks = statistics.block_ranks(spark.createDataFrame(rows, "method string, block int, value double"))
    got = statistics.friedman(ranks).first()
    assert got["k"] == 3 and got["n"] == 5 and got["critical_difference"] == pytest.approx(1.481843, abs=1e-5)
    assert got["p"] == pytest.approx(math.exp(-got["chi2"] / 2), abs=1e-4)


def test_small_tests():
    stat, p = statistics.wilcoxon([1, 2, 3, 4, 5])
    assert stat == 0 and p == pytest.approx(0.0625)
    assert agreement.fisher_exact(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-5)
    fit = statistics.random_intercept([(10, 1.0, 9.0), (10, 3.0, 9.0), (10, 5.0, 9.0)])
    assert fit["icc"] == pytest.approx(0.7935, abs=0.02)
    mean, low, high = statistics.bootstrap_interval(__import__("numpy").arange(100.0), 500, 1)
    assert low < mean < high
    with pytest.raises(ValueError):
        statistics.critical_difference(11, 5)


def test_ladder():
    good = {"n": 500, "recall": 0.95}
    vocabulary = ("BENIGN", "A", "B", "C", "D")
    parents = {"A": "P", "B": "P", "C": "C", "D": "D"}
    assert competence.resolve({c: good for c in vocabulary}, vocabulary, parents).rung == 1
    some = competence.resolve({c: good for c in vocabulary} | {"A": {"n": 5, "recall": 0.9}}, vocabulary, parents)
    assert some.vocabulary == ("BENIGN", "P", "C", "D") and some.merges == {"A": "P", "B": "P"}
    none = competence.resolve({}, vocabulary, parents)
    assert none.rung == 2
    assert competence.resolve({}, none.vocabulary, {}, merged=True).vocabulary == ("BENIGN", "ATTACK")
    with pytest.raises(competence.LadderExhausted):
        competence.resolve({}, ("BENIGN", "ATTACK"), {})
    names, labels, groups = competence.apply_to_taxonomy(["BENIGN", "A", "B", "C", "D"], {"a": "A", "d": "D"}, parents, some)
    assert names == ["BENIGN", "P", "C", "D"] and labels == {"a": "P", "d": "D"}
    assert competence.parent_map_errors(["BENIGN", "A"], {"BENIGN": "BENIGN", "A": "X"}) == ["X renames one class"]
