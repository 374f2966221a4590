"""Places and running sums within skewed groups against brute force."""

import random

from pyspark.sql import functions as F

from claimlens.plans.parallel import in_order


def test_places_of_a_hot_group(spark):
    rng = random.Random(8)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 5}", i, float(rng.randint(0, 9)), "clash") for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v double, x string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = in_order(df, ["g"], [F.desc("i")], "v").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for g, i, v, _ in rows:
        groups.setdefault(g, []).append((-i, v))
    want = {}
    for g, members in groups.items():
        total = 0.0
        for rn, (i, v) in enumerate(sorted(members), 1):
            total += v
            want[-i] = (g, rn, len(members), total)
    assert {r["i"]: (r["g"], r["rn"], r["n"], r["running"]) for r in got} == want and len(got) == 900 and got[0]["x"] == "clash"
    assert in_order(df.limit(0), ["g"], ["i"], "v").count() == 0
    assert sorted(r["rn"] for r in in_order(df, [], ["i"]).collect()) == list(range(1, 901))
