"""Tree ensembles: boosting and its margins, and exact attribution by path-dependent Shapley values.

A tree is a small table of nodes. A feature counts as known or not: a known one
follows its split, an unknown one goes both ways by the share of training rows
(``cover``). The value of a tree is then a sum over leaves of ``value`` times one
factor for each feature on the way to the leaf (1 or 0 where it is known, the
product of shares where not), so the Shapley values are sums over leaves too:
for each feature the coefficients of the polynomial of the other factors, weighted
by the sizes of the sets they stand for. Batches of rows are worked out together.

Trees are broadcast with the code of the batch function; ``ensemble`` counts their
nodes first and refuses more than ``MOST_NODES``.

Defined results: a null or NaN value goes to the right, as a value above every
threshold; empty tables give no rows; a single leaf attributes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.models import assembled

MOST_NODES = 200_000


@dataclass(frozen=True)
class Node:
    """A split (``value`` unused) or, without ``feature``, a leaf; rows at most ``threshold`` go left."""

    cover: float
    value: float = 0.0
    feature: int | None = None
    threshold: float = 0.0
    left: int = 0
    right: int = 0


@dataclass(frozen=True)
class Leaf:
    value: float
    #: feature -> (more than, at most, share of rows that go this way)
    ways: dict[int, tuple[float, float, float]] = field(default_factory=dict)


def leaves(nodes: list[Node]) -> list[Leaf]:
    """All leaves of the tree whose root is the first node."""
    out, open_ = [], [(0, {})]
    while open_:
        at, ways = open_.pop()
        node = nodes[at]
        if node.feature is None:
            out.append(Leaf(node.value, ways))
            continue
        low, high, share = ways.get(node.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.left, (low, min(high, node.threshold))), (node.right, (max(low, node.threshold), high))):
            open_.append((child, ways | {node.feature: (*bounds, share * nodes[child].cover / node.cover)}))
    return out


@dataclass(frozen=True)
class Ensemble:
    """Leaves with the weight of their tree already in their value, and what is added to the sum."""

    parts: tuple[Leaf, ...]
    features: int
    bias: float = 0.0

    def base(self) -> float:
        """The value with no feature known."""
        return self.bias + sum(p.value * np.prod([w[2] for w in p.ways.values()]) for p in self.parts)

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), np.inf, x)
        total = np.full(len(x), self.bias)
        for part in self.parts:
            there = np.ones(len(x), dtype=bool)
            for feature, (low, high, _) in part.ways.items():
                there &= _inside(x[:, feature], low, high)
            total += part.value * there
        return total

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """One row of attributions for each row of ``x``; with ``base`` they sum to ``predict``."""
        x = np.where(np.isnan(x), np.inf, x)
        out = np.zeros((len(x), self.features))
        for part in self.parts:
            known = [(f, _inside(x[:, f], low, high).astype(float), share) for f, (low, high, share) in part.ways.items()]
            m = len(known)
            weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]) if m else None
            for feature, one, share in known:
                poly = np.zeros((len(x), m))
                poly[:, 0] = 1.0
                for other, one_, share_ in known:
                    if other != feature:
                        poly[:, 1:] = poly[:, 1:] * share_ + poly[:, :-1] * one_[:, None]
                        poly[:, 0] *= share_
                out[:, feature] += part.value * (one - share) * (poly @ weights)
        return out


def _inside(values: np.ndarray, low: float, high: float) -> np.ndarray:
    return (values > low) & ((values <= high) | np.isposinf(high))


def ensemble(trees: list[list[Node]], features: int, weights: list[float] | None = None, bias: float = 0.0) -> Ensemble:
    """Trees weighted and put together; their size is checked since every task gets them."""
    size = sum(len(t) for t in trees)
    if size > MOST_NODES:
        raise ValueError(f"{size} nodes are too many to send to every task")
    made = []
    for nodes, w in zip(trees, weights or [1.0] * len(trees), strict=True):
        made.extend(Leaf(w * leaf.value, leaf.ways) for leaf in leaves(nodes))
    return Ensemble(tuple(made), features, bias)


def with_shapley(df: DataFrame, model: Ensemble, features: list[str], out: str = "phi") -> DataFrame:
    """ML-07: ``df`` with attributions as an array in the order of ``features``, their base and the margin they sum to."""
    base, width = float(model.base()), len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(dtype=float).reshape(len(batch), width)
            yield batch.assign(**{out: list(model.shapley(x)), "base": base, "margin": model.predict(x)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, {out} array<double>, base double, margin double")


def train_boosting(df: DataFrame, features: list[str], label: str = "label", rounds: int = 20, depth: int = 4, step: float = 0.1, seed: int = 7) -> GBTClassificationModel:
    """ML-04: boosted trees of two classes."""
    return GBTClassifier(featuresCol="features_", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(assembled(df, features))


def save_frozen(model: GBTClassificationModel, features: list[str], path: str) -> None:
    """ML-04: the model with the names of its features beside it; never overwritten."""
    model.save(f"{path}/model")
    names = SparkSession.active().createDataFrame([*enumerate(features)], "at int, feature string")
    names.coalesce(1).write.mode("errorifexists").parquet(f"{path}/features")


def load_frozen(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, list[str]]:
    """The model and the names it was trained on."""
    names = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("at").collect()]
    return GBTClassificationModel.load(f"{path}/model"), names


def exported(spark: SparkSession, path: str) -> list[list[Node]]:
    """The trees of a stored model, read from its table of nodes."""
    rows = spark.read.parquet(f"{path}/data")
    if rows.count() > MOST_NODES:
        raise ValueError("the model has too many nodes to send to every task")
    trees: dict[int, dict[int, Node]] = {}
    for r in rows.select("treeID", "nodeData.*").collect():
        leaf = r["leftChild"] < 0
        made = Node(float(r["rawCount"]), r["prediction"]) if leaf else Node(float(r["rawCount"]), 0.0, r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0], r["leftChild"], r["rightChild"])
        trees.setdefault(r["treeID"], {})[r["id"]] = made
    return [[nodes[i] for i in range(len(nodes))] for _, nodes in sorted(trees.items())]


def boosted(spark: SparkSession, path: str, features: int, weights: list[float]) -> Ensemble:
    """The margin (log odds) of a stored boosting model of two classes: twice its weighted sum."""
    return ensemble(exported(spark, path), features, [2 * w for w in weights])


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))
