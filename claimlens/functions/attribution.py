"""Attribution arrays and claims as Column functions; every row stands alone, nothing is shuffled.

``ranked`` is an array of structs (feature, value, direction, rank) in order of
absolute value; ties keep the original order. ``claims`` is an array of structs
(feature, direction, rank, magnitude, direction_evidence) in stated order.

Plans open these arrays by ``inline_outer`` and drop the empty row: ``inline`` would
add a filter on the array's size, for which the optimizer makes the array again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
CLAIM = "array<struct<feature:string,direction:string,rank:int,magnitude:double,direction_evidence:string>>"
RANKED = "array<struct<feature:string,value:double,direction:string,rank:int>>"


def sign(value: Column) -> Column:
    """The direction of a value; zero counts as raising."""
    return F.when(value >= 0, "+").otherwise("-")


def flipped(direction: Column) -> Column:
    return F.when(direction == "+", "-").when(direction == "-", "+")


def ranked(names: Column, values: Column, top: int | None = None) -> Column:
    """WN-01, WN-02: features by absolute value, with direction and 1-based rank."""
    keyed = F.zip_with(names, values, lambda n, v: F.struct(n.alias("feature"), v.alias("value")))
    keyed = F.transform(keyed, lambda x, i: F.struct((-F.abs(x["value"])).alias("a"), i.alias("i"), x["feature"].alias("feature"), x["value"].alias("value")))
    # natural order; a comparator would be interpreted for each comparison
    ordered = F.sort_array(keyed)
    if top is not None:
        ordered = F.slice(ordered, 1, top)
    return F.transform(ordered, lambda x, i: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), sign(x["value"]).alias("direction"), (i + 1).alias("rank")))


def features(items: Column) -> Column:
    return F.transform(items, lambda x: x["feature"])


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is empty."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def present(claims: Column, top: Column) -> Column:
    """JN-05: claims on features of the reference list."""
    return F.filter(claims, lambda c: F.exists(top, lambda r: r["feature"] == c["feature"]))


def mention_precision(claims: Column, top: Column) -> Column:
    """Claims count with repeats."""
    return share(F.size(present(claims, top)), F.size(claims))


def mention_recall(claims: Column, top: Column) -> Column:
    return share(F.size(F.array_intersect(features(top), features(claims))), F.size(top))


def mention_f1(claims: Column, top: Column) -> Column:
    # an array of one element stands for a name: both parts are made once
    parts = F.array(F.struct(mention_precision(claims, top).alias("p"), mention_recall(claims, top).alias("r")))
    return F.transform(parts, lambda x: F.when(x["p"] + x["r"] > 0, 2 * x["p"] * x["r"] / (x["p"] + x["r"])).otherwise(F.lit(0.0)))[0]


def asserted(claims: Column) -> Column:
    """L1-05: claims whose direction is stated; evidence that is null counts as stated."""
    return F.filter(claims, lambda c: ~c["direction_evidence"].eqNullSafe(F.lit("default")))


def agreeing(claims: Column, top: Column) -> Column:
    return F.filter(claims, lambda c: F.exists(top, lambda r: (r["feature"] == c["feature"]) & r["direction"].eqNullSafe(c["direction"])))


def dsa(claims: Column, top: Column) -> Column:
    """Share of the present claims whose direction is the attribution's."""
    there = present(claims, top)
    return share(F.size(agreeing(there, top)), F.size(there))


def dsa_asserted(claims: Column, top: Column) -> Column:
    return dsa(asserted(claims), top)


def direction_assertion_rate(claims: Column, top: Column) -> Column:
    there = present(claims, top)
    return share(F.size(asserted(there)), F.size(there))


def hfr(claims: Column, known: Column) -> Column:
    """Share of claims on features that the attribution does not know (JN-06)."""
    strange = F.filter(claims, lambda c: ~F.array_contains(known, c["feature"]))
    return share(F.size(strange), F.size(claims))


def arc_pairs(claims: Column, top: Column) -> Column:
    """L1-09: (claimed rank, rank in the reference list) in order of the claims."""
    stated = F.filter(claims, lambda c: c["rank"].isNotNull() & F.exists(top, lambda r: r["feature"] == c["feature"]))
    return F.transform(stated, lambda c: F.struct(c["rank"].alias("x"), F.array_position(features(top), c["feature"]).cast("int").alias("y")))


def ordinal_spearman(pairs: Column) -> Column:
    """WN-04: ranks by value, ties by input order; 0 for fewer than two pairs.

    Such ranks have no ties, so the coefficient is 1 - 6 * sum(d^2) / (n (n^2 - 1)).
    """
    n = F.size(pairs)

    def placed(field: str) -> Column:
        ordered = F.sort_array(F.transform(pairs, lambda p, i: F.struct(p[field].alias("v"), i.alias("i"))))
        return F.transform(pairs, lambda p, i: F.array_position(F.transform(ordered, lambda o: o["i"]), i))

    squares = F.aggregate(F.zip_with(placed("x"), placed("y"), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    return F.when(n >= 2, 1 - 6.0 * squares / (n * (n * n - 1))).otherwise(F.lit(0.0))


def cited(claims: Column, known: Column, k: int) -> Column:
    """WN-09: the first ``k`` different known features by (rank, nulls last, position)."""
    keyed = F.transform(claims, lambda c, i: F.struct(F.coalesce(c["rank"], F.lit(2147483647)).alias("r"), i.alias("i"), c["feature"].alias("feature")))
    mine = F.filter(F.sort_array(keyed), lambda c: F.array_contains(known, c["feature"]))
    return F.slice(F.array_distinct(features(mine)), 1, k)


def linear_score(names: Column | Sequence[str], x: Column, weights: dict[str, float], bias: float) -> Column:
    """ML-10: clip(bias + sum of weight * x, 0, 1), added in the order of the names; names known to the plan are written out."""
    if isinstance(names, Column):
        table = F.create_map(*[F.lit(y) for pair in weights.items() for y in pair])
        total = F.aggregate(F.zip_with(names, x, lambda n, v: F.coalesce(table[n], F.lit(0.0)) * v), F.lit(float(bias)), lambda s, t: s + t)
    else:
        total = F.lit(float(bias))
        for i, name in enumerate(names):
            total = total + F.lit(float(weights.get(name, 0.0))) * F.get(x, F.lit(i))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def margin(p: Column) -> Column:
    """ML-03: logit with probabilities kept ``EPS`` off the ends."""
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.log(q / (1 - q))


def erased(names: Column | Sequence[str], x: Column, background: Column, removed: Column) -> Column:
    """L2-01: values of removed features replaced by the background, missing ones by 0."""
    if isinstance(names, Column):
        return F.zip_with(names, F.arrays_zip(x.alias("x"), background.alias("b")), lambda n, v: F.when(F.array_contains(removed, n), F.coalesce(v["b"], F.lit(0.0))).otherwise(v["x"]))
    at = [F.lit(i) for i in range(len(names))]
    return F.array(*[F.when(F.array_contains(removed, F.lit(n)), F.coalesce(F.get(background, i), F.lit(0.0))).otherwise(F.get(x, i)) for n, i in zip(names, at, strict=True)])


def first_argmax(p: Column) -> Column:
    """WN-11: 0-based index of the first largest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def reliance(comprehensiveness: Column, sufficiency: Column, threshold: float) -> Column:
    """L2-16: the 2x2 of both deltas; a value at the threshold is high."""
    high_c, high_s = comprehensiveness >= threshold, sufficiency >= threshold
    return F.when(high_c & ~high_s, "load_bearing").when(high_c & high_s, "necessary_not_sufficient").when(~high_c & ~high_s, "redundant").otherwise("irrelevant")
