"""Corruption operators: an array of claims in, a struct (label, claims) out.

A claim that is rebuilt loses its direction evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens.functions.attribution import CLAIM, flipped


def claim(feature: Column, direction: Column, rank: Column, magnitude: Column, evidence: Column | None = None) -> Column:
    return F.struct(feature.alias("feature"), direction.alias("direction"), rank.cast("int").alias("rank"), magnitude.cast("double").alias("magnitude"), (F.lit(None) if evidence is None else evidence).cast("string").alias("direction_evidence"))


def highest_magnitude(claims: Column) -> Column:
    """Index of the first largest magnitude, null counting as 0."""
    sizes = F.transform(claims, lambda c: F.coalesce(c["magnitude"], F.lit(0.0)))
    return (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int")


def rank_one(claims: Column) -> Column:
    """Index of the first claim of rank 1, else 0."""
    at = F.array_position(F.transform(claims, lambda c: F.coalesce(c["rank"], F.lit(-1))), F.lit(1))
    return F.when(at > 0, at - 1).otherwise(0).cast("int")


def _at(claims: Column, index: Column, change: Callable[[Column], Column]) -> Column:
    return F.transform(claims, lambda c, i: F.when(i == index, change(c)).otherwise(c))


def _made(label: Column | str, claims: Column) -> Column:
    return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), claims.cast(CLAIM).alias("claims"))


def fabricated_feature(claims: Column, feature: str = "ghost_feature") -> Column:
    top = F.coalesce(F.array_max(F.transform(claims, lambda c: c["rank"])), F.lit(0)) + 1
    new = claim(F.lit(feature), F.lit("+"), top, F.lit(0.5))
    return _made("corrupted", F.concat(claims.cast(CLAIM), F.array(new).cast(CLAIM)))


def sign_flip(claims: Column) -> Column:
    """A highest claim without direction leaves the claims as they are, labelled skipped."""
    at = highest_magnitude(claims)
    direction = F.get(claims, at)["direction"]
    done = _at(claims, at, lambda c: claim(c["feature"], flipped(c["direction"]), c["rank"], c["magnitude"]))
    return F.when(direction.isNull(), _made("skipped", claims)).otherwise(_made("corrupted", done))


def rank_inversion(claims: Column) -> Column:
    first, second = F.get(claims, F.lit(0))["rank"], F.get(claims, F.lit(1))["rank"]
    done = F.transform(claims, lambda c, i: F.when(i == 0, claim(c["feature"], c["direction"], second, c["magnitude"])).when(i == 1, claim(c["feature"], c["direction"], first, c["magnitude"])).otherwise(c))
    return _made("corrupted", F.when(F.size(claims) < 2, claims).otherwise(done))


def omission(claims: Column) -> Column:
    at = rank_one(claims)
    return _made("corrupted", F.filter(claims, lambda c, i: i != at))


def magnitude_inflation(claims: Column, factor: float = 3.0) -> Column:
    return _made("corrupted", _at(claims, highest_magnitude(claims), lambda c: claim(c["feature"], c["direction"], c["rank"], F.coalesce(c["magnitude"], F.lit(1.0)) * factor)))


def vague_substitution(claims: Column, feature: str = "some network feature") -> Column:
    return _made("corrupted", _at(claims, rank_one(claims), lambda c: claim(F.lit(feature), c["direction"], c["rank"], c["magnitude"])))


OPERATORS: dict[str, Callable[..., Column]] = {
    "fabricated_feature": fabricated_feature,
    "sign_flip": sign_flip,
    "rank_inversion": rank_inversion,
    "omission": omission,
    "magnitude_inflation": magnitude_inflation,
    "vague_substitution": vague_substitution,
}


def apply_operator(name: str, claims: Column, **params: object) -> Column:
    """CO-07: the named operator; unknown names raise ``KeyError``."""
    return OPERATORS[name](claims, **params)
