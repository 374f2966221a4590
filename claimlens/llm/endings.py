"""How a text ends: Column expressions that tell a whole ending from a cut one.

A text is cut if it stops inside a word, number, sentence or JSON value, or shows
a trace of the cut. Whole endings are: final punctuation, a closed bracket, a
closing line between dashes, a label with one of the usual values, a list of
``name=number`` whose last number has as many decimals as the first, one bare
word of capitals. The rules look at the whole text (delimiters that stay open)
and at its last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that show nothing.
INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}"
#: Marks that programs leave where they cut a text.
TRACE = r"(?:…|\.{3,}|�+|[\[<(]\s*(?:truncated|cut|cut off|snip|abgeschnitten|gekürzt|tronqué|coupé|truncado|cortado|…|\.\.\.)\s*[\]>)])$"
#: Values of a closing label.
LEVELS = r"(?:high|low|moderate|medium|strong|weak|yes|no|none|hoch|mittel|gering|niedrig|mäßig|haute?|moyenne?|modérée?|faible|élevée?|alta|alto|media|medio|moderada|baja|bajo)"
CLOSERS = r"[*_`\"'”’»]*"


def body(text: Column) -> Column:
    """The text without white space and invisible characters at its ends."""
    return F.regexp_replace(text, f"^[{INVISIBLE}]+|[{INVISIBLE}]+$", "")


def has_trace(text: Column) -> Column:
    return F.regexp_like(body(text), F.lit(TRACE))


def without_trace(text: Column) -> Column:
    """The text up to the cut, where a trace shows the cut, else as it is."""
    return F.when(has_trace(text), F.regexp_replace(body(text), TRACE, "")).otherwise(text)


def _count(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / len(sign)


def json_like(text: Column) -> Column:
    return F.regexp_like(body(text), F.lit(r"^(?:```\w*\s*)?[\[{]\s*(?:[\[{\"\]}]|$)"))


def json_cut(text: Column) -> Column:
    """A JSON value whose brackets or quotes stay open."""
    bare = F.regexp_replace(text, r'\\.', "")
    outside = F.regexp_replace(bare, r'"[^"]*"', "")
    return (_count(outside, "[") > _count(outside, "]")) | (_count(outside, "{") > _count(outside, "}")) | (_count(bare, '"') % 2 == 1)


def with_ending(df: DataFrame, text: str, out: str = "cut") -> DataFrame:
    """``df`` with whether the ending of ``text`` is cut; null and empty texts are not.

    The parts that several rules look at are columns of their own, so that each
    is made once for a row.
    """
    like = lambda c, p: F.regexp_like(F.col(c), F.lit(p))
    parts = df.withColumn("b_", body(F.col(text))).withColumn("line_", F.substring_index(F.replace("b_", F.lit("\r"), F.lit("\n")), "\n", -1)).withColumn("tail_", F.regexp_replace("line_", CLOSERS + "$", ""))
    open_bracket = like("line_", r"[(\[][^()\[\]]*$")
    open_fence = _count(F.col("b_"), "```") % 2 == 1
    open_bold = ((F.size(F.split("line_", r"\*\*")) - 1) % 2 == 1) & ~like("line_", r"^\*\*[^*]+$|^[^*]+\*\*$")
    marker_only = like("line_", r"^\s*(?:[-*•]|\d+[.)])\s*\**$")
    stops = like("tail_", r"[.!?。！？]$")
    number_dot = like("tail_", r"(?:^|[\s(=+\- ])(?:\d{1,3}(?:,\d{3})+|\d{1,6})\.$")
    bracket = like("tail_", r"[)\]]$")
    dashes = like("line_", r"^[-=*_~#]{2,}.*[-=*_~#]{2,}$|^</\w+>$")
    label = F.regexp_like(F.lower("line_"), F.lit(rf"^[*_]*\p{{L}}[\p{{L}} ]{{0,30}}?\s?:[*_]*\s*{LEVELS}[*_]*$"))
    last = F.length(F.regexp_extract("line_", r"[=:]\s*[+-]?\d[\d,]*\.(\d+)$", 1))
    first = F.when(last > 0, F.length(F.regexp_extract("b_", r"[=:]\s*[+-]?\d[\d,]*\.(\d+)", 1)))
    listed = F.coalesce(last == first, F.lit(False))
    word = (F.length("b_") < 60) & like("b_", r"^[\W_]*\p{Lu}{3,}[\W_]*$")
    whole = (stops & ~number_dot) | bracket | dashes | label | word | listed
    prose = marker_only | open_bracket | open_fence | open_bold | ~whole
    traced = like("b_", TRACE)
    cut = F.when(json_like(F.col("b_")), json_cut(F.col("b_"))).otherwise(prose)
    judged = F.when(F.coalesce(F.length("b_"), F.lit(0)) == 0, F.lit(False)).otherwise(traced | cut)
    return parts.withColumn(out, judged).drop("b_", "line_", "tail_")
