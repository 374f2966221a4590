"""Claim extraction and text rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.attribution import CLAIM

#: Stems that lower, stems that raise, and connectives that raise only without either.
LOWERING = ("decreas", "lower", "reduc", "diminish", "weaken", "suppress", "dampen", "lessen", "downward")
RAISING = ("increas", "rais", "higher", "elevat", "push", "boost", "amplif", "strengthen", "reinforc", "heighten", "intensif", "upward")
CONNECTIVES = ("contribut", "add", "driv", "drove", "support", "signal", "reinforc", "bolster", "push toward", "point to")
#: Words the verifier reads.
SAYS_MORE = ("increase", "increased", "higher", "raise", "raised", "elevat", "push", "more")
SAYS_LESS = ("decrease", "decreased", "lower", "lowered", "reduce", "reduced", "less")
WINDOW, VERIFIER_WINDOW = 300, 60
HITS = "array<struct<at:int,size:int,feature:string>>"


def norm(text: Column) -> Column:
    """TX-01: lower case with _ and - as spaces; the length stays."""
    return F.translate(F.lower(text), "_-", "  ")


def sentence_end(window: Column) -> Column:
    """TX-04: 1-based place of the terminator, 0 if none; a point inside a number is none."""
    return F.regexp_instr(window, F.lit(r"[.!?;](?=\s|$)|\n"))


def with_mentions(df: DataFrame, text: str, variants: str, out: str = "hits") -> DataFrame:
    """TX-02, TX-03: first unmasked hit of each variant, longest variants first, the earliest per feature.

    ``variants`` is an array of (variant, feature) sorted by length; a found span is
    overwritten so that shorter variants cannot match inside it. What a lambda
    reads is a column of its own, as nothing inside a lambda is shared.
    """
    start = F.struct(F.col("norm_").alias("masked"), F.array().cast(HITS).alias("hits"))

    def step(state: Column, v: Column) -> Column:
        at = F.position(v["variant"], state["masked"])
        size = F.length(v["variant"])
        hit = F.struct(at.cast("int").alias("at"), size.cast("int").alias("size"), v["feature"].alias("feature"))
        masked = F.concat(F.substring(state["masked"], F.lit(1), at - 1), F.repeat(F.lit("\x00"), size), F.substr(state["masked"], at + size))
        return F.when(at > 0, F.struct(masked.alias("masked"), F.concat(state["hits"], F.array(hit).cast(HITS)).alias("hits"))).otherwise(F.struct(state["masked"].alias("masked"), state["hits"].alias("hits")))

    there = df.withColumn("norm_", norm(F.col(text))).withColumn("near_", F.filter(variants, lambda v: F.contains(F.col("norm_"), v["variant"])))
    found = there.withColumn("found_", F.aggregate("near_", start, step, lambda s: F.array_sort(s["hits"]))).withColumn("names_", F.transform("found_", lambda x: x["feature"]))
    first = F.filter("found_", lambda h, i: F.array_position(F.col("names_"), h["feature"]) == i + 1)
    return found.withColumn(out, first).drop("norm_", "near_", "found_", "names_")


def _nearest(text: Column, stems: tuple[str, ...]) -> Column:
    """1-based place of the first stem, null if there is none."""
    return F.array_min(F.filter(F.array(*[F.position(F.lit(s), text) for s in stems]), lambda p: p > 0))


def direction_of(window: Column) -> Column:
    """TX-05: struct (direction, magnitude, evidence) that the words after a mention state."""
    low = F.lower(window)
    neg, pos, via = _nearest(low, LOWERING), _nearest(low, RAISING), _nearest(low, CONNECTIVES)
    given = F.regexp_extract(window, r"=\s*([+-]\d+(?:\.\d+)?)", 1)
    number = F.when(given != "", given).otherwise(F.regexp_extract(window, r"(?<![\w.])([+-]\d+(?:\.\d+)?)", 1))
    value = F.when(number != "", number.cast("double"))
    made = lambda d, m, e: F.struct(F.lit(d).cast("string").alias("direction") if isinstance(d, str) or d is None else d.alias("direction"), m.cast("double").alias("magnitude"), F.lit(e).alias("evidence"))
    none = F.lit(None)
    return (
        F.when(neg.isNotNull() & (pos.isNull() | (neg <= pos)), made("-", none, "word"))
        .when(pos.isNotNull(), made("+", none, "word"))
        .when(value.isNotNull(), made(F.when(value >= 0, "+").otherwise("-"), F.abs(value), "number"))
        .when(via.isNotNull(), made("+", none, "connective"))
        .otherwise(made(None, none, "default"))
    )


def with_claims(df: DataFrame, text: str, hits: str, out: str = "claims") -> DataFrame:
    """TX-03: claims of the mentions in order; a window ends at the next mention, its sentence or 300 characters."""
    begins = df.withColumn("ends_", F.concat(F.slice(F.transform(hits, lambda h: h["at"]), 2, 100000), F.array(F.length(text) + 1)))

    def raw(h: Column, end: Column) -> Column:
        begin = h["at"] + h["size"]
        return F.substr(F.col(text), begin, F.greatest(F.lit(0), F.least(end - begin, F.lit(WINDOW))))

    raws = begins.withColumn("raw_", F.zip_with(hits, "ends_", raw)).withColumn("stop_", F.transform("raw_", sentence_end))
    cut = F.zip_with("raw_", "stop_", lambda r, n: F.when(n > 0, F.substring(r, F.lit(1), n - 1)).otherwise(r))
    said = raws.withColumn("window_", cut).withColumn("said_", F.transform("window_", direction_of))
    made = F.zip_with(F.transform(hits, lambda h, i: F.struct(h["feature"].alias("feature"), (i + 1).alias("rank"))), "said_", lambda h, d: F.struct(h["feature"].alias("feature"), d["direction"].alias("direction"), h["rank"].alias("rank"), d["magnitude"].alias("magnitude"), d["evidence"].alias("direction_evidence")))
    return said.withColumn(out, F.when(F.size(hits) > 0, made).otherwise(F.array().cast(CLAIM))).drop("ends_", "raw_", "stop_", "window_", "said_")


def json_slice(text: Column) -> Column:
    """TX-06: from the first [ to the last ], null if there is none."""
    first, last = F.position(F.lit("["), text), F.length(text) - F.position(F.lit("]"), F.reverse(text)) + 1
    return F.when((first > 0) & (F.position(F.lit("]"), text) > 0) & (last > first), F.substr(text, first, last - first + 1))


def parse_claims(text: Column) -> Column:
    """Claims of a JSON answer; items without a feature or with a direction other than + and - are left out."""
    kind = "array<struct<feature:string,direction:string,magnitude:double>>"
    parsed = F.from_json(json_slice(text), kind)
    return F.filter(parsed, lambda c: (F.coalesce(F.trim(c["feature"]), F.lit("")) != "") & c["direction"].isin("+", "-"))


def verdict(draft: Column, evidence: Column) -> Column:
    """TX-10: reason of the rule verifier; ``evidence`` is an array of (feature, direction)."""
    low = F.lower(draft)
    cited = F.filter(evidence, lambda e: F.position(F.lower(e["feature"]), low) > 0)

    def clashes(e: Column) -> Column:
        name = F.lower(e["feature"])
        window = F.substr(low, F.position(name, low), F.length(name) + VERIFIER_WINDOW)
        more = F.regexp_like(window, F.lit("|".join(SAYS_MORE)))
        less = F.regexp_like(window, F.lit("|".join(SAYS_LESS)))
        return F.when(e["direction"] == "+", less & ~more).otherwise(more & ~less)

    return F.when(F.size(evidence) == 0, "no_evidence").when(F.size(cited) == 0, "no_cited_feature").when(F.exists(cited, clashes), "direction_mismatch").otherwise("supported")


def render_list(ranked: Column) -> Column:
    """GN-01: ``feature=+v.4f; ...`` in order."""
    return F.array_join(F.transform(ranked, lambda r: F.format_string("%s=%+.4f", r["feature"], r["value"])), "; ")


def render_template(ranked: Column, label: Column) -> Column:
    """GN-02: one numbered line for each feature."""
    line = lambda r: F.format_string("%d. %s %s the %s score (magnitude %.4f)", r["rank"], r["feature"], F.when(r["direction"] == "+", "increased").otherwise("decreased"), label, F.abs(r["value"]))
    return F.array_join(F.transform(ranked, line), "\n")
