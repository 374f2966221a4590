"""Exact attribution of trees against the definition of Shapley values, and boosting from training to storage."""

import itertools
import math
import random

import numpy as np
import pytest

from claimlens import catalog
from claimlens.operators import models
from claimlens.operators import trees as T


def random_tree(rng, depth, features):
    nodes = []

    def grow(cover, left):
        at = len(nodes)
        nodes.append(None)
        if left == 0 or cover < 2 or rng.random() < 0.15:
            nodes[at] = T.Node(cover, rng.uniform(-1, 1))
            return at
        part = rng.randint(1, cover - 1)
        f, t = rng.randrange(features), rng.random()
        a = grow(part, left - 1)
        b = grow(cover - part, left - 1)
        nodes[at] = T.Node(cover, 0.0, f, t, a, b)
        return at

    grow(200, depth)
    return nodes


def expected(nodes, x, known, at=0):
    n = nodes[at]
    if n.feature is None:
        return n.value
    if n.feature in known:
        return expected(nodes, x, known, n.left if x[n.feature] <= n.threshold else n.right)
    return sum(nodes[c].cover / n.cover * expected(nodes, x, known, c) for c in (n.left, n.right))


@pytest.mark.parametrize("seed", range(6))
def test_shapley_as_defined(seed):
    rng = random.Random(seed)
    m = 4
    forest = [random_tree(rng, 4, m) for _ in range(3)]
    weights = [1.0, 0.3, -0.5]
    model = T.ensemble(forest, m, weights, bias=0.25)
    x = np.array([[rng.random() for _ in range(m)] for _ in range(20)])
    got = model.shapley(x)
    value = lambda row, s: sum(w * expected(t, row, s) for t, w in zip(forest, weights, strict=True))
    for row, phi in zip(x, got, strict=True):
        for i in range(m):
            others = [j for j in range(m) if j != i]
            want = sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (value(row, {*s, i}) - value(row, {*s})) for k in range(m) for s in itertools.combinations(others, k))
            assert phi[i] == pytest.approx(want, abs=1e-12)
    assert np.allclose(got.sum(1) + model.base(), model.predict(x)) and np.allclose(model.predict(x), [0.25 + value(r, set(range(m))) for r in x])


def test_odd_inputs(spark):
    leaf = T.ensemble([[T.Node(5, 2.0)]], 2)
    df = spark.createDataFrame([(1.0, None, "x"), (float("nan"), 2.0, "y")] * 2, "a double, b double, phi_name string")
    rows = T.with_shapley(df, leaf, ["a", "b"]).collect()
    assert all(r["phi"] == [0.0, 0.0] and r["base"] == r["margin"] == 2.0 for r in rows) and len(rows) == 4
    split = T.ensemble([[T.Node(4, 0.0, 0, 0.5, 1, 2), T.Node(1, -1.0), T.Node(3, 1.0)]], 2)
    assert sorted(r["margin"] for r in T.with_shapley(df, split, ["a", "b"]).collect()) == [1.0] * 4
    assert T.with_shapley(df.limit(0), split, ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        T.ensemble([[T.Node(1)] * (T.MOST_NODES + 1)], 1)


def test_boosting_is_stored_and_attributed(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(a := rng.random(), b := rng.random(), float(a + b > 1)) for _ in range(400)], "a double, b double, label double")
    model = T.train_boosting(df, ["a", "b"], rounds=4, depth=3)
    T.save_frozen(model, ["a", "b"], str(tmp_path / "m"))
    loaded, names = T.load_frozen(spark, str(tmp_path / "m"))
    assert names == ["a", "b"]
    with pytest.raises(Exception, match="exist"):
        T.save_frozen(model, ["a", "b"], str(tmp_path / "m"))
    made = T.with_shapley(df, T.boosted(spark, str(tmp_path / "m" / "model"), 2, loaded.treeWeights), names)
    rows = models.predict(loaded, made, names).collect()
    assert all(1 / (1 + math.exp(-r["base"] - sum(r["phi"]))) == pytest.approx(r["proba"][1], abs=1e-9) for r in rows)
    assert sum((r["proba"][1] > 0.5) == (r["label"] == 1) for r in rows) > 350


def test_boosting_query_is_additive(spark):
    rows = catalog.queries()["ml_04_boosting"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["not_additive"] == 0 for r in rows)
