"""Pair defects, truncation, encoding and shared spans against brute force and on edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import encode, endings, pairs, spans, truncation

ASK = "Explain the verdict Sweep.\nInputs:\nUplink Gap Mean=+0.50000; Reset Flag Count=-0.25000\nWrite a plain explanation that names each ranked input once and gives its direction."
GOOD = "Uplink Gap Mean raised the score by 0.50000. Reset Flag Count lowered it by 0.25000."
CASES = [
    (ASK, GOOD, None), (ASK, None, "empty"), (ASK, "", "empty"), (ASK, "```text\n\n```", "empty"), (ASK, "<answer></answer>", "empty"), (ASK, "Assistant:", "empty"), (ASK, "﻿ ⁠", "empty"),
    (ASK, "I'm sorry, but I can't help with that.", "refusal"), (ASK, "Dabei kann ich leider nicht helfen.", "refusal"), (ASK, "That lies beyond what I cover.", "refusal"),
    (ASK, GOOD[:60], "truncated"), (ASK, GOOD[:42] + " The […]", "truncated"), (ASK, "Uplink Gap Mean raised the score by 0.", "truncated"),
    (ASK, "> " + ASK.splitlines()[-1], "copy"), (ASK, ASK.upper(), "copy"),
    (ASK, "Uplink Gap Mean erhöhte den Wert um 0.50000 und Reset Flag Count senkte ihn um 0.25000, gemessen wurden die Größen bei der Messung.", "language"),
    (ASK + "\nAnswer in German.", GOOD, "language"), (ASK + "\nAnswer in German.", "Uplink Gap Mean erhöhte den Wert um 0.50000, und Reset Flag Count senkte ihn.", None),
    (ASK + " If unsure, reply ABSTAIN.", "ABSTAIN", None), (ASK + " If unsure, reply ABSTAIN.", "abstain - evidence is mixed.", None),
    ("List each input as a JSON list.\nText:\nx\nJSON:", "[]", None), ("List each input as a JSON list.\nText:\nx\nJSON:", '[{"feature": "A", "dire', "truncated"), ("List each input as a JSON list.\nText:\nx\nJSON:", '[{"feature": "A"}]', None),
    (None, GOOD, None), (ASK, GOOD + "\nConfidence: high", None), (ASK, GOOD + "\n-- end of note --", None), (ASK, "- **Uplink Gap Mean** raises the score (0.50000)\n- **Reset Flag Count** lowers the score (0.25000)", None),
]


def test_defects(spark):
    df = spark.createDataFrame([(i, p, t, "clash") for i, (p, t, _) in enumerate(CASES)] * 2, "call_id int, prompt string, text string, share string")
    got = {r["call_id"]: r["defect"] for r in pairs.checked(df).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(CASES)}
    assert pairs.checked(df.limit(0)).count() == 0


def test_long_answers_are_read_whole(spark):
    df = spark.createDataFrame([(1, ASK, GOOD * 2000 + " And the last one was"), (2, ASK, GOOD * 2000)], "call_id int, prompt string, text string")
    assert {r["call_id"]: r["defect"] for r in pairs.checked(df).collect()} == {1: "truncated", 2: None}


def test_endings(spark):
    whole = ["A=+0.1234; B=-0.4321", "SUPPORTED", "Done.", "It is done.**", "(a) one\n(b) two (0.5)", '{"a": [1, "x]"]}', None, "  "]
    cut = ["A=+0.1234; B=-0.43", "It was 37.", "one\n2.", "see (0.5", "**bold", "word…", "x <cut>", "it [truncated]", '{"a": [1', "Confidence: hi", "ends with,"]
    df = spark.createDataFrame([(t, False) for t in whole] + [(t, True) for t in cut], "text string, want boolean")
    assert all(r["cut"] == r["want"] for r in endings.with_ending(df, "text").collect())


def test_longer_copies_as_brute_force(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    df = spark.createDataFrame([(t, "clash") for t in texts] * 2, "v string, h string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    from claimlens.sources import shared_dir

    shared_dir(spark)
    hashed = {r["h"]: r["v"] for r in df.select("v", F.xxhash64("v").alias("h")).distinct().collect()}
    got = {hashed[r["h"]]: (hashed[r["longer"]], r["follows"]) for r in truncation.longer_copies(df.select("v")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for t in texts:
        longer = sorted(x for x in texts if x.startswith(t) and x != t)
        if longer:
            want[t] = (longer[0], longer[0][len(t)])
    assert got == want


def test_cut_texts(spark):
    from claimlens.sources import shared_dir

    shared_dir(spark)
    full = "The first sentence of this note ends. The second one stands at 12.50 in all."
    rows = [(1, full), (2, full[:50]), (3, full[:37]), (4, None), (5, ""), (6, full[:20] + "..."), (7, full), (8, ASK.splitlines()[-1][:60])]
    calls = spark.createDataFrame([(i, t, ASK, "clash") for i, t in rows], "call_id long, text string, prompt string, cut string")
    texts = spark.createDataFrame([(1, full[:50]), (2, None)], "explanation_id long, text string")
    got = {(r["src"], r["row_id"]) for r in truncation.judged(truncation.texts_of(calls, texts)).filter("cut").collect()}
    assert got == {("llm_calls", 2), ("llm_calls", 6), ("explanations", 1)}
    assert truncation.judged(truncation.texts_of(calls.limit(0), texts.limit(0))).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(encode.VOCABULARY)
    made.encode_special_tokens = True
    return made


def test_encoding_equals_the_public_tokenizer(spark, tokenizer):
    rng = random.Random(9)
    parts = ["a", "the ", " ", "  ", "\n", "\r\n", "\xa0", "é", "日本", "́", "🚨", "👩‍💻", "'s", "'LL", "don't", "12", "²", "\x1c", " ", "​", "\x85", "<|endoftext|>", "ß", "_", "-", "　", "ing", "\U0001d54f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["x" * 50_000, " " * 5000, "", None, "aaa", "aaa"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, the_text string")
    got = encode.encode(df).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: (tokenizer.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts)}
    assert all(r["the_text"] == "clash" for r in got)
    sizes = encode.encode(df, out="n", sizes_only=True, keep=("doc_id",)).collect()
    assert {r["doc_id"]: r["n"] for r in sizes} == {r["doc_id"]: len(r["ids"]) for r in got}
    assert encode.encode(df.limit(0)).count() == 0


def true_pairs(docs, length):
    grams = {}
    for i, t in docs:
        for at in range(len(t or "") - length + 1):
            grams.setdefault(t[at : at + length], set()).add(i)
    return {p for g in grams.values() for p in itertools.combinations(sorted(g), 2)}


@pytest.mark.parametrize("hot", [24, 1])
def test_shared_spans_as_brute_force(spark, hot):
    """With ``hot`` 1 every anchor takes the way of the hot ones."""
    rng = random.Random(21)
    pool = ["".join(rng.choice("abc \n🚨") for _ in range(rng.choice((19, 20, 21, 45)))) for _ in range(12)]
    noise = lambda: "".join(rng.choice("defgh") for _ in range(rng.randint(0, 30)))
    docs = [(i, noise() + rng.choice(pool) + noise() + rng.choice(pool) + noise()) for i in range(80)]
    docs += [(100 + i, "z" * 60) for i in range(3)] + [(200, None), (201, ""), (202, pool[3][:19]), (203, docs[0][1])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, class_id string")
    made = spans.SharedSpans(df, length=20, seed=12, hot=hot)
    want = true_pairs(docs, 20)
    assert {(r["doc_a"], r["doc_b"]) for r in made.pairs().collect()} == want
    shares = {r["doc_id"]: r for r in made.shares(df).collect()}
    assert len(shares) == len(docs) and shares[200]["shared_share"] is None and shares[101]["shared_chars"] == 60
    texts = dict(docs)
    for i, t in docs:
        covered = np.zeros(len(t or ""), dtype=bool)
        for at in range(len(covered) - 19):
            if any(j != i and t[at : at + 20] in (texts[j] or "") for j in texts):
                covered[at : at + 20] = True
        assert shares[i]["shared_chars"] == covered.sum()


def test_spans_of_nothing(spark):
    made = spans.SharedSpans(spark.createDataFrame([], "doc_id long, text string"))
    assert made.pairs().count() == 0
