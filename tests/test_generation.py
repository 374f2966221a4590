"""Prompt parts, dispatch and stores."""

import pytest
from pyspark.sql import functions as F

from claimlens.plans import generation as G


def test_templates():
    assert G.select_template(2) != G.select_template(5)
    with pytest.raises(ValueError):
        G.select_template(1)


def test_judge_scores(spark):
    df = spark.createDataFrame([('Well: {"clarity": 4, "plausibility": 3, "usefulness": 5}.',), ('{"clarity": 4}',), ("none",)], "t string")
    assert [r[0] and r[0]["clarity"] for r in df.select(G.judge_scores(F.col("t"))).collect()] == [4.0, None, None]


def test_dispatch():
    assert G.build_erasure("background")
    with pytest.raises(ValueError):
        G.build_erasure("none")
    with pytest.raises(KeyError):
        G.build_result(None, "", "none")


def test_values_by_name(spark):
    row = spark.range(1).select(G.feature_value_table(F.array(F.lit("b"), F.lit("a")), F.array(F.lit(1.0), F.lit(2.0)))).first()
    assert row[0] == "a=2.0000; b=1.0000"


def test_attributions_are_made_once(spark, tmp_path):
    first = G.cached_attribution(spark.range(3).toDF("phi"), str(tmp_path), "abcd")
    again = G.cached_attribution(spark.range(9).toDF("phi"), str(tmp_path), "abcd")
    assert first.count() == again.count() == 3
    counts = G.materialise_splits(spark.createDataFrame([("i", "train"), ("j", "test")], "id string, split string"), str(tmp_path / "s"))
    assert {r["split"]: r["n"] for r in counts.collect()} == {"train": 1, "test": 1}
