"""Readers, run folders, models and declared-only parts."""

import json

import pytest
from pyspark.sql import functions as F

from claimlens import provenance as P
from claimlens.operators import models as M
from claimlens.sources import files as S
from claimlens.streaming import windows as W


def test_csv_flows_are_cleaned(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.csv").write_text(" Flow ID,f0 , f1, Label\nx,1,2.5,BENIGN\nx,inf,1,BENIGN\nx,3,bad,DoS\nx,4,5, DoS \n")
    (tmp_path / "b" / "c.csv").write_text("f1,f0,Label\n" + "".join(f"{i},{i},BENIGN\n" for i in range(10)))
    df = S.load_flow_csv(spark, str(tmp_path))
    assert S.feature_columns(df) == ["f0", "f1"]
    assert df.count() == 12
    got = df.filter("attack_class = 'DoS'").first()
    assert (got["f0"], got["label"]) == (4.0, 1)
    assert S.load_flow_csv(spark, str(tmp_path), rows_per_file=4).filter("label = 0").count() == 1 + 4
    assert S.load_flow_csv(spark, str(tmp_path), max_rows=3).count() == 3
    with pytest.raises(S.DataUnavailable):
        S.load_processed(spark, str(tmp_path), "d")
    with pytest.raises(KeyError):
        S.get_loader("unknown")


def test_annotation_files(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"batch_id": "b", "annotator": "h", "exported_utc": "t", "annotations": [{"item_id": "i", "feature": "A", "text_asserts_direction": "+", "hedged": False, "added": False}]}))
    line = {"item_id": "i", "claims": [{"feature": "A", "dir": "-", "hedged": False}]}
    (tmp_path / "p.jsonl").write_text("﻿```json\n" + json.dumps(line) + "\n" + json.dumps(line) + "\n```\n")
    (tmp_path / "q.jsonl").write_text(json.dumps([line]))
    assert S.load_annotations(spark, str(tmp_path / "h.json")).first()["label"] == "+"
    assert [r["label"] for r in S.load_annotations(spark, str(tmp_path / "p.jsonl")).collect()] == ["-", "-"]
    assert S.load_annotations(spark, str(tmp_path / "q.jsonl")).count() == 1


def test_files_side_by_side(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(9)], "k long, x long").repartition(1)
    b = spark.createDataFrame([(i, str(i)) for i in range(9)], "k long, y string").coalesce(1)
    a = a.orderBy("k")
    assert S.zip_files(a, b, "k").filter("l.x = 2 * r.k").count() == 9
    with pytest.raises(Exception, match="not aligned"):
        S.zip_files(a, b.filter("k < 5"), "k").select("l.x").collect()


def test_runs(spark, tmp_path):
    run = P.mint_run_id("EXP", "abcdef0123")
    assert P.parse_run_id(run)["experiment"] == "EXP"
    with pytest.raises(ValueError):
        P.parse_run_id("nothing")
    out = tmp_path / "run"
    out.mkdir()
    (out / "m.jsonl").write_text("{}\n")
    good = {r["name"]: r["sha256"] for r in P.file_hashes(spark, str(out)).collect()}
    assert P.verify_outputs(spark, str(out), good).count() == 0
    found = {r["name"]: r["finding"] for r in P.verify_outputs(spark, str(out), {"m.jsonl": "0", "x": "1"}).collect()}
    assert found == {"m.jsonl": "differs", "x": "missing"}
    P.write_status(out, P.RUNNING)
    P.write_status(out, P.COMPLETE)
    with pytest.raises(P.StatusError):
        P.write_status(out, P.RUNNING)
    with pytest.raises(ValueError):
        P.write_manifest(out / "manifest.json", {"run_id": run})
    assert P.content_address({"b": 1, "a": 2}) == P.content_address({"a": 2, "b": 1})
    df = spark.range(3)
    S.write_once(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        S.write_once(df, str(tmp_path / "t"))
    assert S.rounded({"a": [0.12345678901234]}) == {"a": [0.123456789]}
    assert S.sorted_lines(spark.createDataFrame([(2, None), (1, "x")], "b int, a string"), ["b"]).first()["value"] == '{"a":"x","b":1}'


def test_models(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y")).withColumn("label", (F.col("x") > 9).cast("int"))
    got = M.predict(M.train_forest(df, ["x", "y"], trees=5), df, ["x", "y"])
    seen = got.select("label", M.prediction_view(F.col("proba"), ["BENIGN", "DoS"]).alias("v"), M.log_margin(F.col("proba")).alias("m"))
    assert seen.filter((F.col("v.label") == "DoS") == (F.col("label") == 1)).count() == 400
    assert seen.filter(F.abs(F.col("m")[0] + F.col("m")[1]) > 1e-9).count() == 0


@pytest.mark.parametrize("part", [M.retrained_erasure, M.transformer_detector, M.deep_attribution])
def test_declared_parts_raise(part):
    with pytest.raises(NotImplementedError):
        part()
    with pytest.raises(KeyError):
        M.apply_correction("unknown", None)
    with pytest.raises(NotImplementedError):
        M.apply_correction("repair_label_leakage", None)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "click", float(i % 5), i * 1200) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, event_type string, value double, s int").select("id", "event_type", "value", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = W.windowed(W.read_stream(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " ")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(spark.table("counts").collect()) == sorted(W.windowed(df).collect())
