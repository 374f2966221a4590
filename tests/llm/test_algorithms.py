"""Sketches, mapping, consensus and packing against brute force and on edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import consensus, mapping, packing, quantiles

COST = "record_id long, cell_id string, instance_id string, latency_ms double, tokens_per_explanation int, measured_utc timestamp_ntz, received_utc timestamp_ntz, generator string"
CELLS = "cell_id string, generator string, day string"
CATALOG = "feature_id int, feature string, aliases array<string>, value string"


def cost(spark, rows):
    day = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, c, "x", v, t, day + dt.timedelta(days=i % 3), day + dt.timedelta(days=5, seconds=s), "clash") for i, c, v, t, s in rows], COST)


def test_sketch_keeps_its_bound_and_merges():
    rng = np.random.default_rng(5)
    values = rng.lognormal(3, 2, 200_000)
    parts = []
    for i, part in enumerate(np.array_split(values, 40)):
        one = quantiles.Sketch(seed=i)
        for block in np.array_split(part, 3):
            one.update(block)
        parts.append(one)
    total = quantiles.Sketch(seed=99)
    for one in parts:
        total.merge(quantiles.Sketch.of(quantiles.K, 0, *one.row()))
    assert total.n == len(values) and sum(map(lambda x: x.size(), total.levels)) < 5000
    ordered = np.sort(values)
    for q in (*quantiles.QUANTILES, 0.9999):
        rank = np.searchsorted(ordered, total.quantiles((q,))[0], side="right") / len(values)
        assert abs(rank - q) <= quantiles.error_bound() * (1 - q) + 1e-5
    assert total.quantiles((0.0, 1.0)) == [values.min(), values.max()]


def test_upper_tail_of_many_merged_sketches():
    parts, size, q = 300, 1000, 0.99
    deviation, errors = quantiles.error_bound() / 3 * (1 - q), []
    for again in range(20):
        values = np.random.default_rng((again, parts)).permutation(parts * size).astype(float)
        total = quantiles.Sketch(seed=(again, 1))
        for i, part in enumerate(np.split(values, parts)):
            one = quantiles.Sketch(seed=(again, i, 0))
            one.update(part)
            total.merge(quantiles.Sketch.of(quantiles.K, 0, *one.row()))
        errors.append(((total.quantiles((q,))[0] + 1) / len(values) - q) / deviation)
    assert np.sqrt(np.mean(np.square(errors))) < 1.3 and np.max(np.abs(errors)) < 3


def test_percentiles_of_odd_rows(spark):
    cells = spark.createDataFrame([("a", "g", "clash"), ("a", "g", "clash")], CELLS)
    rows = [(1, "a", 5.0, None, 0), (1, "a", 7.0, 3, 9), (2, "a", float("nan"), 4, 0), (3, "a", -1.0, 4, 0), (4, "b", 2.0, None, 0), (None, "a", 1.0, None, 0)]
    df = cost(spark, [(r[0] or 0, *r[1:]) for r in rows]).withColumn("record_id", F.when(F.col("record_id") > 0, F.col("record_id")))
    got = {(r["generator"], r["metric"], r["q"]): (r["value"], r["n"]) for r in quantiles.percentiles(df, cells, (0.0, 1.0)).collect()}
    assert got["g", "latency_ms", 1.0] == (7.0, 2) and got["g", "latency_ms", 0.0] == (1.0, 2)
    assert got["g", "tokens_per_explanation", 1.0] == (4.0, 3)
    assert got[None, "latency_ms", 1.0] == (2.0, 1)
    assert quantiles.percentiles(df.limit(0), cells).count() == 0


def test_days_join_to_the_whole(spark):
    rng = random.Random(3)
    rows = [(i, "a", rng.lognormvariate(1, 1), rng.randint(1, 9), 0) for i in range(1, 4000)]
    df, cells = cost(spark, rows), spark.createDataFrame([("a", "g", "x")], CELLS)
    answers = quantiles.read_quantiles(quantiles.combine_days(quantiles.daily_sketches(df, cells)), ["generator", "metric"])
    checked = quantiles.rank_check(quantiles.measurements(df, cells), answers).collect()
    assert len(checked) == 18 and all(r["within_bound"] and r["n_values"] == 3999 for r in checked)


NAMES = ["Uplink Gap Mean", "Uplink Gap Min", "Uplink Gap Max", "Downlink Gap Mean", "Reset Flag Count", "Handshake Delay"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i + 1, n, ["Setup Delay"] if n == "Handshake Delay" else [], "clash") for i, n in enumerate(NAMES)], CATALOG)


def test_typed_names(spark, names):
    want = {
        "UPLINK_GAP-MEAN": 1, "Ｕｐｌｉｎｋ Ｇａｐ Ｍｅａｎ": 1, "Uplink Gаp Mean": 1, "**Uplink Gap Average** (us)": 1, "Gap Mean (Uplink)": 1, "mean of the uplink gap": 1, "Upl Gap Mean": 1,
        "Uplik Gpa Mean": 1, "Uplink Gap Mean = 12.5": 1, "Uplink Gap Men": 0, "Gap Mean (Downlink) = 3.86": 4, "downlinkgapaverage": 4, "Uplink Gap": 0, "Donwlink Gap Maen": 4, "the reset flag counts": 5, "setup dealy": 6, "encrypted file hash": 0, "x" * 5000: 0, "???": 0,
    }
    rows = spark.createDataFrame([(v, i, "clash") for i, v in enumerate([*want, *want, None, " ", "Uplink Gap Mean"])], "value string, row_id int, entry string").drop("entry")
    got = [(r["value"], r["entry"]) for r in mapping.map_rows(rows, names).collect()]
    assert len(got) == 2 * len(want) and dict(got) == want


def test_typos_as_brute_force(spark, names):
    rng = random.Random(7)
    values = set()
    for _ in range(300):
        x = list(rng.choice(NAMES))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice("abcdefgh")
        values.add("".join(x))
    df = spark.createDataFrame([(v,) for v in values], "value string")
    texts = df.select("value", mapping.squeezed(F.col("value")).alias("text"))
    refs = names.select(F.col("feature_id").alias("entry"), mapping.squeezed(F.col("feature")).alias("ref"))
    mine = {(r["value"], r["entry"], r["distance"]) for r in mapping.near(texts, refs).collect()}
    k = 2 * mapping.slips_allowed(F.length("ref"))
    slips = F.greatest(mapping.letters_apart(F.col("text"), F.col("ref")), F.ceil(F.levenshtein("text", "ref") / 2).cast("int"))
    every = texts.crossJoin(refs).filter((F.levenshtein("text", "ref") <= k) & (slips <= mapping.slips_allowed(F.length("ref"))))
    assert mine == {(r["value"], r["entry"], r["d"]) for r in every.select("value", "entry", F.levenshtein("text", "ref").alias("d")).collect()}


def test_mapping_of_nothing(spark, names):
    none = spark.createDataFrame([], "value string, row_id int")
    assert mapping.map_rows(none, names).count() == 0
    some = spark.createDataFrame([("a", 1)], "value string, row_id int")
    assert mapping.map_rows(some, names.limit(0)).first()["entry"] == 0


def test_consensus_finds_truth_and_bad_annotators(spark):
    rng = random.Random(11)
    skill = {f"good{i}": 0.9 for i in range(4)} | {f"bad{i}": 0.1 for i in range(3)} | {"rare": 0.9}
    truth, votes = {}, []
    for u in range(400):
        truth[f"i{u}", "f"] = t = rng.randrange(4)
        for a, s in skill.items():
            if a != "rare" or u < 5:
                votes.append((f"i{u}", "f", a, t if rng.random() < s else (t + 1) % 4, "clash"))
    df = spark.createDataFrame(votes, "item_id string, feature string, annotator string, vote int, label string")
    model = consensus.Consensus(df.drop("label"), rounds=8)
    units = spark.createDataFrame([*truth, ("empty", "f")], "item_id string, feature string")
    got = {(r["item_id"], r["feature"]): r for r in model.labels(units).collect()}
    assert len(got) == 401 and got["empty", "f"]["votes"] == 0
    right = sum(got[u]["label"] == consensus.LABELS[t] for u, t in truth.items())
    assert right >= 390
    rated = {r["annotator"]: r["reliability"] for r in model.annotators().collect()}
    assert min(rated[f"good{i}"] for i in range(4)) > 0.8 > 0.3 > max(rated[f"bad{i}"] for i in range(3))
    assert 0.5 < rated["rare"] < 1


def test_votes_of_odd_rows(spark, names):
    t = dt.datetime(2025, 1, 1)
    later = t + dt.timedelta(days=1)
    items = spark.createDataFrame([("i", ["Uplink Gap Mean", "Uplink Gap Max"])], "item_id string, candidates array<string>")
    rows = [(1, "i", "a", "Uplink Gap Mean", "+", False, t), (2, "i", "a", "Uplink Gap Mean", " NEG ", False, later), (2, "i", "a", "Uplink Gap Mean", " NEG ", False, later), (3, "i", "b", "Uplink Gap Mean", None, False, later), (4, "i", "a", "Other", "+", True, t), (5, "i", "c", "Uplink Gap Max", "？", False, t)]
    human = spark.createDataFrame(rows, "row_id long, item_id string, annotator string, feature string, text_asserts_direction string, added boolean, exported_utc timestamp_ntz")
    passes = spark.createDataFrame([(1, "i", "p", [("uplink gap maen", "−", False)], t), (2, "i", "p", [("uplink gap maen", "+", False)], later)], "pass_row_id long, item_id string, annotator string, claims array<struct<feature:string,dir:string,hedged:boolean>>, exported_utc timestamp_ntz")
    got = {(r["annotator"], r["feature"]): consensus.LABELS[r["vote"]] for r in consensus.all_votes(items, human, passes, names).collect()}
    assert got == {("a", "Uplink Gap Mean"): "-", ("p", "Uplink Gap Mean"): "+", ("p", "Uplink Gap Max"): "absent"}


def test_windows_are_filled_best():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 60)
        chosen = packing.fill_window(sorted(counts, reverse=True), counts, room)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        assert sum(x * n for x, n in chosen.items()) == max(sums)
        assert all(n <= counts[x] for x, n in chosen.items())


def test_packing_keeps_everything(spark):
    rng = random.Random(4)
    sizes = [0, 0, 100, 250, *[rng.randint(1, 90) for _ in range(300)], *[7] * 400]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)] + [(None, 5, "clash"), (1, None, "clash")], "doc_id long, tokens long, container string").persist()
    rows = packing.pack(spark, df, "doc_id", "tokens", 100).collect()
    assert sum(r["piece_size"] for r in rows) == sum(sizes) + 5
    load, pieces = {}, {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["piece_size"]
        pieces.setdefault(r["doc_id"], []).append(r["piece_size"])
    assert max(load.values()) <= 100
    assert sorted(pieces[3]) == [50, 100, 100] and all(len(p) == 1 for i, p in pieces.items() if i not in (1, 3, None))
    assert len(load) <= packing.slack_bound({1: sum(sizes) + 5}, 100) + 1
    assert packing.pack(spark, df.limit(0), "doc_id", "tokens", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark, df, "doc_id", "tokens", 0)
