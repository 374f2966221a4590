"""Detectors and attribution: tree models of Spark, linear attribution, and parts that are declared only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.attribution import EPS


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features_", handleInvalid="error").transform(df)


def train_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 50, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """ML-05."""
    return RandomForestClassifier(featuresCol="features_", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(df, features))


def predict(model: RandomForestClassificationModel, df: DataFrame, features: list[str]) -> DataFrame:
    """ML-02: ``proba`` as an array with one probability for each class."""
    return model.transform(assembled(df, features)).withColumn("proba", vector_to_array("probability")).drop("features_", "rawPrediction", "probability", "prediction")


def both_classes(p: Column) -> Column:
    """ML-02: a scalar score of the last class as one probability for each of two classes."""
    return F.array(1 - p, p)


def checked_width(proba: Column, classes: int) -> Column:
    """ML-02: ``proba``, or an error where it has not one entry for each class."""
    return F.when(F.size(proba) == classes, proba).otherwise(F.raise_error(F.lit(f"there must be {classes} probabilities")))


def attack_probability(proba: Column, benign: int) -> Column:
    """ML-01."""
    return 1 - F.get(proba, F.lit(benign))


def log_margin(proba: Column) -> Column:
    """ML-03: logit for two classes, clipped log probability for more."""
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.get(proba, F.lit(1))))
    logit = F.log(p / (1 - p))
    return F.when(F.size(proba) == 2, F.array(-logit, logit)).otherwise(F.transform(proba, lambda x: F.log(F.greatest(x, F.lit(1e-12)))))


def select_class(values: Column, index: Column) -> Column:
    """ML-08: attributions of the predicted class out of an array for each class."""
    return F.get(values, index)


def prediction_view(proba: Column, classes: list[str]) -> Column:
    """ML-11: struct (label, p); two classes are cut at 0.5, more go by the first maximum."""
    names = F.array(*[F.lit(c) for c in classes])
    if len(classes) == 2:
        p = F.get(proba, F.lit(1))
        return F.struct(F.when(p >= 0.5, classes[1]).otherwise(classes[0]).alias("label"), p.alias("p"))
    top = F.array_max(proba)
    return F.struct(F.get(names, F.array_position(proba, top).cast("int") - 1).alias("label"), top.alias("p"))


class Undeclared(NotImplementedError):
    """Declared in the design, not implemented anywhere; calling it is an error."""


def retrained_erasure(*_: object) -> None:
    """L2-15."""
    raise Undeclared("erasure with retraining is declared only")


def transformer_detector(*_: object) -> None:
    """ML-06."""
    raise Undeclared("the tabular transformer is declared only")


def deep_attribution(*_: object) -> None:
    """ML-09."""
    raise Undeclared("attribution of deep models is declared only")


#: Names by which configurations call for a correction.
CORRECTIONS = ("drop_duplicate_flows", "repair_label_leakage", "handle_nan_inf", "fix_attack_window_timestamps", "canonicalise_feature_names")


def apply_correction(name: str, df: DataFrame) -> DataFrame:
    """PF-14: known steps raise until they are defined; unknown ones are a ``KeyError``."""
    if name not in CORRECTIONS:
        raise KeyError(name)
    raise Undeclared(f"the correction {name} is declared only")
