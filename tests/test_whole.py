"""Queries that must do the whole job: every document, every k, every metric."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from claimlens import catalog
from claimlens.plans import competence
from claimlens.plans.competence import RISES, battery
from claimlens.plans.layer2 import METRICS


def test_content_hash_reads_every_document(spark, tmp_path):
    rows = [(i, "note", "en", f"text {i}") for i in range(20)] + [(20, "note", "en", None)]
    query = catalog.queries()["pv_02_content_hash_all"]

    def digest(name, changed):
        spark.createDataFrame(changed, "doc_id long, kind string, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return [(r["kind"], r["n"], r["digest"]) for r in query(spark, f"{tmp_path}/{name}").collect()]

    whole = digest("whole", rows)
    assert whole == digest("turned", rows[::-1])
    assert whole != digest("last", [*rows[:-2], (19, "note", "en", "text x"), rows[-1]])
    assert whole != digest("empty", [*rows[:-1], (20, "note", "en", "")])
    assert whole != digest("swapped", [(0, "note", "en", "text 1"), (1, "note", "en", "text 0"), *rows[2:]])


def test_the_sweep_holds_every_k_and_its_values(spark):
    rows = catalog.queries()["l2_13_sweep_k135"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["k"], r["space"]) for r in rows} == {(k, s) for k in (1, 3, 5) for s in ("prob", "margin")}
    assert all(r[m] is not None for r in rows for m in METRICS)
    one = catalog.queries()["l2_06_comprehensiveness_k135"](spark, "/root/testdata/sf0.001").collect()
    assert {r["k"] for r in one} == {1, 3, 5}


def test_battery_as_brute_force(spark):
    rng = random.Random(3)
    made = {(m, o): [rng.choice((0.0, 0.25, 0.5, 0.75, 1.0)) - (0.25 if o == "omission" else 0) for _ in range(30)] for m in ("dsa", "hfr", "mention_recall") for o in ("faithful", "omission", "vague_substitution")}
    made |= {("arc", o): [1.0] * 9 for o in ("faithful", "rank_inversion")} | {("mention_precision", "fabricated_feature"): [0.5, 0.75]}
    counts = spark.createDataFrame([(m, o, x, 1) for (m, o), values in made.items() for x in values], "metric string, operator string, score double, n long")
    got = {(r["metric"], r["operator"]): r for r in battery(counts).collect()}
    assert set(got) == {k for k in made if k[1] != "faithful"}
    for (metric, operator), row in got.items():
        clean = made.get((metric, "faithful"), [])
        bad = [x for (m, o), values in made.items() if m == metric and o != "faithful" for x in values]
        hit = (lambda x, t: x > t) if metric in RISES else (lambda x, t: x < t)
        share = lambda values, t: sum(hit(x, t) for x in values) / len(values) if values else 0.0
        good = lambda t: 1 - share(clean, t) if clean else 0.0
        u = sorted({*clean, *bad})
        best = max([u[0] - 1, *[(a + b) / 2 for a, b in itertools.pairwise(u)], u[-1] + 1] if len(u) > 1 else u, key=lambda t: (round(share(bad, t) + good(t), 12), -t))
        auc = sum(1 if hit(b, c) else 0.5 * (b == c) for b in bad for c in clean) / (len(bad) * len(clean)) if bad and clean else 0.5
        want = (best, share(bad, best) + good(best) - 1, auc, good(best), share(made[metric, operator], best))
        assert tuple(row[c] for c in ("threshold", "youden", "auc", "specificity", "sensitivity")) == pytest.approx(want, abs=2e-6)


def test_battery_summary_gives_verdicts(spark):
    rows = {(r["metric"], r["operator"]): r for r in catalog.queries()["st_03_battery_summary"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 9 * 6
    assert rows["hfr", "fabricated_feature"]["admissible"] is True and rows["dsa", "sign_flip"]["admissible"] is None
    assert all(r["blind_spot"] == (o == "magnitude_inflation") for (_, o), r in rows.items())


def test_patterns_stand_for_their_flows(spark):
    """Counting flows by pattern first changes no score: ties, zeros, nulls, NaN and infinity included."""
    values = (None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.25, -0.25, 0.5, -1e-300)
    rng = random.Random(7)
    phi = spark.createDataFrame([([rng.choice(values) for _ in range(4)],) for _ in range(1500)] + [([0.1 * rng.random() - 0.05 for _ in range(4)],) for _ in range(500)], "phi array<double>")
    counted = lambda rows: sorted(((r["metric"], r["operator"], r["score"], r["n"]) for r in competence.battery_counts(rows).collect()), key=str)
    each = counted(phi.withColumn("n", F.lit(1).cast("long")))
    assert sum(n for *_, n in each) == 2000 * 7 * 9
    assert counted(competence.alike(phi)) == each


def test_battery_summary_corrupts_patterns_not_flows(spark, monkeypatch):
    """All flows are counted, but what is corrupted and measured does not grow with them."""
    seen, made = [], competence.battery_counts
    monkeypatch.setattr(competence, "battery_counts", lambda rows: made(seen.append(rows) or rows))
    result = catalog.queries()["st_03_battery_summary"](spark, "/root/testdata/sf0.01").collect()
    n = [r["n"] for r in seen[0].collect()]
    assert {r["n"] for r in result} == {sum(n)} == {60_000}
    assert len(n) < 60_000 / 20
