"""Operators that must do the whole job, whatever the skew, script or length."""

import itertools
import random

import pytest

from claimlens.llm import consensus, mapping, pairs, spans


ASK = "Inputs:\nUplink Gap Mean=+0.50000; Reset Flag Count=-0.25000\nWrite a plain explanation that names each ranked input once and gives its direction."


def test_each_defect_rule_is_judged_on_its_own(spark):
    copied = ASK.splitlines()[-1]
    cases = [
        ("Dabei kann ich leider nicht helfen, weil das nicht mit der Aufgabe und dem Wert zu vereinbaren ist.", ["refusal", "language"]),
        ("I'm sorry, but I can't help with th", ["refusal", "truncated"]),
        (copied[:-20], ["copy", "truncated"]),
        (copied, ["copy"]),
        (copied.upper().replace(" ", "  "), ["copy"]),
        ("```text\n\n```", ["empty"]),
    ]
    rows = [(i, ASK, t) for i, (t, _) in enumerate(cases)] + [(len(cases), copied + "\nAnswer in German.", copied)]
    got = {r["call_id"]: (r["defects"], r["defect"]) for r in pairs.checked(spark.createDataFrame(rows, "call_id int, prompt string, text string")).collect()}
    assert got == {i: (d, d[0]) for i, d in enumerate([d for _, d in cases] + [["copy", "language"]])}


def test_answers_in_another_script(spark):
    cases = [
        (ASK, "Среднее значение подняло оценку на 0.5.", ["language"]), (ASK, "Среднее значение подняло оценку.", ["language"]), (ASK, "平均值提高了分数。", ["language"]),
        (ASK + "\nAnswer in Russian.", "Среднее значение Uplink Gap Mean подняло оценку на 0.5.", []), (ASK + "\nAnswer in Russian.", "Uplink Gap Mean raised the score by 0.50000.", ["language"]),
        (ASK, "Uplink Gap Mean (Δ) raised the score by 0.50000.", []),
    ]
    df = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(cases)], "call_id int, prompt string, text string")
    assert {r["call_id"]: r["defects"] for r in pairs.checked(df).collect()} == {i: d for i, (_, _, d) in enumerate(cases)}


@pytest.mark.parametrize("hot", [24, 1])
def test_maximal_shared_spans_as_brute_force(spark, hot):
    """With ``hot`` 1 every anchor takes the way of the hot ones, as boilerplate of many texts does."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("abc \n🚨") for _ in range(rng.choice((19, 20, 21, 45, 70)))) for _ in range(12)]
    noise = lambda: "".join(rng.choice("defgh") for _ in range(rng.randint(0, 30)))
    docs = [(i, noise() + rng.choice(pool)[rng.randint(0, 9) :] + noise() + rng.choice(pool) + noise()) for i in range(80)]
    docs += [(100 + i, "z" * 60) for i in range(3)] + [(200, None), (201, ""), (202, pool[3][:19]), (203, docs[0][1])]
    made = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), length=20, seed=12, hot=hot)
    owners = {}
    for i, t in docs:
        for at in range(len(t or "") - 19):
            owners.setdefault(t[at : at + 20], set()).add(i)
    want = set()
    for i, t in docs:
        starts = [at for at in range(len(t or "") - 19) if len(owners[t[at : at + 20]]) > 1]
        for _, run in itertools.groupby(enumerate(starts), lambda x: x[1] - x[0]):
            run = [at for _, at in run]
            want.add((i, min(j for j, x in docs if x == t), run[0], run[-1] + 20))
    got = [tuple(r) for r in made.found().collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(to - at > 40 for _, _, at, to in got)


@pytest.mark.parametrize("size", [29, 44, 45, 90, 230])
def test_slips_in_long_names_are_found(spark, size):
    rng = random.Random(size)
    name = "".join(rng.choice("abcdefghijklm") for _ in range(size))
    typed = name[: size // 2] + "x" + name[size // 2 + 1 :]
    refs = spark.createDataFrame([(1, name), (2, name[::-1]), (3, "short")], "entry int, ref string")
    got = mapping.near(spark.createDataFrame([("v", typed), ("w", "y" * size)], "value string, text string"), refs).collect()
    assert [(r["value"], r["entry"], r["distance"]) for r in got] == [("v", 1, 1)]
    assert mapping.near(spark.createDataFrame([("v", typed)], "value string, text string"), refs.limit(0)).count() == 0


def test_pigeonhole_finds_every_string_within_reach(spark):
    rng = random.Random(17)

    def edited(s, times):
        for _ in range(times):
            at = rng.randint(0, len(s))
            s = rng.choice((s[:at] + rng.choice("abcx") + s[at:], s[: max(0, at - 1)] + s[at:], s[:at] + "c" + s[at + 1 :]))
        return s

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    names = {"".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 4, 5, 6, 8, 9, 10, 11, 13, 20, 41, 60, 120, 300) for _ in range(3)}
    typed = {edited(x, rng.randint(0, 5)) for x in names for _ in range(6)} - {""}
    refs = spark.createDataFrame([(x,) for x in names], "ref string")
    got = {(r["text"], r["ref"]): r["distance"] for r in mapping.within_reach(spark.createDataFrame([(x,) for x in typed] * 2, "text string"), refs).collect()}
    reach = {x: 0 if len(x) < 5 else 2 if len(x) < 9 else 4 for x in names}
    want = {(t, x): d for t in typed for x in names if abs(len(t) - len(x)) <= reach[x] and (d := apart(t, x)) <= reach[x]}
    assert got == want and len(want) > 100


def test_refusals_are_told_by_phrases_not_by_numbers(spark):
    cases = [
        (ASK, "Sorry, I cannot help with that request, see policy 42.", "refusal"),
        (ASK, "I'm sorry, but I can't discuss these 3 inputs.", "refusal"),
        (ASK, "Lo siento, no puedo ayudar con eso 24.", "refusal"),
        (ASK, "The traffic pattern is bursty and clearly abnormal for this host.", None),
        (ASK, "Nothing stood out, and the two inputs held each other in balance.", None),
        (ASK, "The model cannot explain more than this: Uplink Gap Mean raised the score by 0.50000.", None),
        (ASK, "Η μέση τιμή ανέβασε τη βαθμολογία κατά 0.5.", "language"),
        (ASK, "La señal de la cuenta es la que aumenta la puntuación de 0.5.", "language"),
        (ASK + "\nResponde en español.", "La señal de la cuenta es la que aumenta la puntuación de 0.5.", None),
    ]
    df = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(cases)], "call_id int, prompt string, text string")
    assert {r["call_id"]: r["defect"] for r in pairs.checked(df).collect()} == {i: d for i, (_, _, d) in enumerate(cases)}


@pytest.mark.parametrize("most", [20_000, 0])
def test_consensus_is_the_same_with_few_and_many_annotators(spark, most):
    rng = random.Random(31)
    skill = {f"a{i}": 0.9 - 0.1 * (i % 5) for i in range(9)}
    votes = []
    for u in range(300):
        t = rng.randrange(4)
        votes += [(f"i{u % 150}", f"f{u // 150}", a, t if rng.random() < s else rng.randrange(4)) for a, s in skill.items() if rng.random() < 0.6]
    df = spark.createDataFrame(votes, "item_id string, feature string, annotator string, vote int")
    one, two = consensus.Consensus(df), consensus.Consensus(df.repartition(5), most=most)
    assert two.few == (most > 0)
    units = df.select("item_id", "feature").distinct()
    key = lambda m: {(r["item_id"], r["feature"]): (r["label"], round(r["probability"], 6), r["votes"]) for r in m.labels(units).collect()}
    assert key(one) == key(two)
    rated = lambda m: {r["annotator"]: (round(r["reliability"], 6), r["votes"]) for r in m.annotators().collect()}
    assert rated(one) == rated(two) and len(rated(one)) == 9
    assert consensus.Consensus(df.limit(0), most=most).labels(units).filter("votes = 0").count() == units.count()
