"""Free-entered values mapped to the entry of a reference list that they mean.

Different values are mapped once each and the mapping is joined back to the rows,
so a value that a third of the rows carry costs one mapping; the join back leaves
a hot value to Spark's skew handling, or broadcasts the mapping only under the
session's size threshold.

Every entry comes out of one pigeonhole join on strings that both sides are
rewritten to first:
* ``tight``: full-width, styled and look-alike letters become ASCII, invisible
  ones go; case, punctuation and spacing do not count (``squeezed``);
* ``sorted``, ``bare`` and ``ordered``: the words, sorted or as they stand, without
  fillers, with synonyms of statistics and abbreviations (a prefix that fits one
  word of the list only) as meant; ``bare`` and ``ordered`` leave out a trailing
  remark in brackets.
A reference string that may take ``k`` edits is cut into ``k + 1`` segments, one of
which must stand unharmed in the value, near its place. Segments and positional
substrings of the values meet by an equality join on (edits, length of the
reference, number of the segment, substring), so that place and length are in the
key; only the lengths and sizes that the list has are made, however long. The
pairs are verified by the built-in ``levenshtein``. A swap of neighbours counts
as one slip: slips = max(letters that differ, ceil(distance / 2)).

Among the entries within reach an equal ``tight`` goes before equal words, these
before equal words without a remark, these before edits.

A value gets an entry only if exactly one entry is best; a tie or no match gives
0. Values without an entry come out of an anti-join.

Defined results: null and blank values are no cases; a value equal to a name of
the list is no case; names that two entries share single out none; empty tables
give no rows; texts longer than the longest reference string and its edits match
nothing, since none is within reach.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.sources import shared_dir

#: Words of statistics that mean the same, and words that carry no meaning in a name.
SYNONYMS = {"average": "mean", "avg": "mean", "maximum": "max", "peak": "max", "highest": "max", "largest": "max", "minimum": "min", "lowest": "min", "smallest": "min", "standard": "std", "stddev": "std", "stdev": "std"}
FILLERS = ("the", "of", "a", "an", "for", "in", "per", "dev", "deviation", "feature", "value", "metric", "field", "input")
#: Letters of other scripts that look like these.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ı": "i", "ɡ": "g", "ԁ": "d", "ո": "n", "ս": "u"}
MAX_SLIPS = 2
SHORT, TINY = 9, 5


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Letters whose compatible decomposition is one ASCII letter or digit, by rule, and letters to drop."""
    made = dict(LOOKALIKES)
    gone = []
    for code in range(128, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        sign = chr(code)
        if sign in made:
            continue
        if unicodedata.category(sign) in ("Cf", "Mn"):
            gone.append(sign)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", sign) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            made[sign] = plain
    return "".join(made) + "".join(gone), "".join(made.values())


def folded(value: Column) -> Column:
    """ASCII letters where the value shows letters that stand for them."""
    return F.translate(value, *fold_table())


def words(value: Column) -> Column:
    """Lower-case words and numbers; a capital inside a word starts another."""
    apart = F.regexp_replace(folded(value), "([a-z])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(apart), F.lit("[a-z0-9]+"), 0)


def squeezed(value: Column) -> Column:
    return F.regexp_replace(F.lower(folded(value)), "[^a-z0-9]+", "")


def without_number(value: Column) -> Column:
    """The value without a number it is given."""
    return F.regexp_replace(folded(value), r"\s*[=:]\s*[+-]?\d[\d.,]*", " ")


def without_remark(value: Column) -> Column:
    """The value without a number it is given and without what it ends with in brackets."""
    return F.regexp_replace(without_number(value), r"\s*[(\[{][^()\[\]{}]*[)\]}][\s.,;:*_`\"']*$", "")


def spellings(name: Column) -> Column:
    """``squeezed`` forms of a name with each synonym of its statistic."""
    low = F.lower(folded(name))
    swapped = [squeezed(F.regexp_replace(low, rf"\b{stat}\b", word)) for word, stat in (*SYNONYMS.items(), ("standarddeviation", "std"))]
    return F.array_distinct(F.array(squeezed(name), *swapped))


def names_of(catalog: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """Rows (entry, name) of the canonical name and all aliases."""
    every = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return catalog.select(F.col(key).alias("entry"), F.explode(every).alias("name")).filter(F.trim("name") != "").distinct()


def word_table(names: DataFrame) -> DataFrame:
    """Rows (word, meant): synonyms, fillers (meant null) and abbreviations of the words in ``names``."""
    spark = names.sparkSession
    fixed = spark.createDataFrame([*SYNONYMS.items(), *((w, None) for w in FILLERS)], "word string, meant string")
    known = names.select(F.explode(words(F.col("name"))).alias("full")).distinct().join(fixed.select(F.col("word").alias("full")), "full", "left_anti")
    starts = known.filter(F.length("full") >= 5).select("full", F.explode(F.sequence(F.lit(3), F.length("full") - 1)).alias("n"))
    short = starts.groupBy(F.expr("substring(full, 1, n)").alias("word")).agg(F.min("full").alias("meant"), F.count("*").alias("n")).filter("n = 1")
    taken = known.select(F.col("full").alias("word")).unionByName(fixed.select("word"))
    return fixed.unionByName(short.join(taken, "word", "left_anti").select("word", "meant"))


def with_words(df: DataFrame, value: str, table: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """``by`` with ``ordered`` and ``sorted``, the words as meant, joined without spaces and with."""
    spelt = df.select(*by, F.posexplode_outer(words(F.col(value))).alias("at", "word"))
    meant = spelt.join(table.select("word", F.col("meant"), F.lit(True).alias("known")), "word", "left").withColumn("meant", F.when(F.col("known"), F.col("meant")).otherwise(F.col("word")))
    each = meant.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("meant").isNotNull(), F.struct("at", "meant")))).alias("all"))
    in_order = F.transform("all", lambda x: x["meant"])
    return each.select(*by, F.array_join(in_order, "").alias(prefix + "ordered"), F.array_join(F.sort_array(in_order), " ").alias(prefix + "sorted"))


def slips_allowed(length: Column) -> Column:
    return F.when(length < TINY, 0).when(length < SHORT, 1).otherwise(MAX_SLIPS)


def segments(refs: DataFrame) -> DataFrame:
    """Rows (ref, k, size_of, i, start, size): each string cut into k + 1 segments; strings without ``k`` take 2 * slips."""
    k = F.col("k") if "k" in refs.columns else 2 * slips_allowed(F.length("ref"))
    cut = refs.select("ref", k.alias("k"), F.length("ref").alias("size_of")).filter("size_of > 0").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    edge = lambda i: F.floor(F.col("size_of") * i / (F.col("k") + 1)).cast("int")
    return cut.select("ref", "k", "size_of", "i", (edge(F.col("i")) + 1).alias("start"), (edge(F.col("i") + 1) - edge(F.col("i"))).alias("size"))


def probes(index: DataFrame) -> DataFrame:
    """Rows (n, k, size_of, i, size, lo, hi): where a text of ``n`` letters may hold segment ``i`` of strings of ``size_of``.

    With d = n - size_of, a segment that stands unharmed after at most i edits and
    before at most k - i more starts within i of its place and within k - i of its
    place moved by d; some segment of every string within reach does so. The rows
    are at most (2k + 1)(k + 1) for each length of a string, 45 for each letter of
    the longest string, however many strings and texts there are.
    """
    shapes = index.select("k", "size_of", "i", "start", "size").distinct().withColumn("d", F.explode(F.sequence(-F.col("k"), F.col("k"))))
    left = F.greatest(F.col("start") - F.col("i"), F.col("start") + F.col("d") - (F.col("k") - F.col("i")), F.lit(1))
    right = F.least(F.col("start") + F.col("i"), F.col("start") + F.col("d") + (F.col("k") - F.col("i")), F.col("n") - F.col("size") + 1)
    placed = shapes.withColumn("n", F.col("size_of") + F.col("d")).select("n", "k", "size_of", "i", "size", left.alias("lo"), right.alias("hi"))
    return placed.filter("n > 0 AND lo <= hi")


def letters_apart(a: Column, b: Column) -> Column:
    """Most letters that one string has beyond the other, order left out."""
    x, y = (F.filter(F.split(c, ""), lambda s: s != "") for c in (a, b))
    one = lambda p, q: F.aggregate(F.array_distinct(p), F.lit(0), lambda n, s: n + F.greatest(F.lit(0), F.size(F.filter(p, lambda t: t == s)) - F.size(F.filter(q, lambda t: t == s))))
    return F.greatest(one(x, y), one(y, x))


def within_reach(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows (text, ref, k, distance) of each different ``text`` and the strings at most ``k`` edits away, by the pigeonhole."""
    index = segments(refs)
    placed = texts.select("text").distinct().withColumn("n", F.length("text")).join(F.broadcast(probes(index)), "n")
    keys = ["k", "size_of", "i", "segment"]
    grams = placed.select("text", "k", "size_of", "i", "size", F.explode(F.sequence("lo", "hi")).alias("at")).select("text", "k", "size_of", "i", F.expr("substring(text, at, size)").alias("segment"))
    met = grams.join(index.select("ref", "k", "size_of", "i", F.expr("substring(ref, start, size)").alias("segment")), keys)
    return met.select("text", "ref", "k").distinct().withColumn("distance", F.expr("levenshtein(text, ref, k)")).filter("distance >= 0")


def near(values: DataFrame, refs: DataFrame) -> DataFrame:
    """(value, entry, slips, distance) of the entries within reach of a string; ``values`` has (value, text)."""
    slips = F.greatest(letters_apart(F.col("text"), F.col("ref")), F.ceil(F.col("distance") / 2).cast("int"))
    close = within_reach(values, refs).withColumn("slips", slips).filter(F.col("slips") * 2 <= F.col("k"))
    return values.join(close, "text").join(refs, "ref").select("value", "entry", "slips", "distance")


def forms_of(values: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (value, text, tight, sorted, bare, edits): the strings of each different value and what they are used for."""
    every = values.select("value").distinct().select("value", squeezed(F.col("value")).alias("tight"), F.array_join(words(without_number(F.col("value"))), " ").alias("whole"), F.array_join(words(without_remark(F.col("value"))), " ").alias("bare"))
    spelt = every.select(F.explode(F.array_distinct(F.array("whole", "bare"))).alias("spelt")).distinct()
    meant = with_words(spelt, "spelt", table, ["spelt"])
    both = every.select("value", "tight", F.explode(F.array(F.struct(F.lit(False).alias("is_bare"), F.col("whole").alias("spelt")), F.struct(F.lit(True).alias("is_bare"), F.col("bare").alias("spelt")))).alias("x")).select("value", "tight", "x.*")
    known = both.join(meant, "spelt")
    in_set = F.concat(F.lit("="), F.replace("sorted", F.lit(" "), F.lit("")))
    use = lambda text, tight, whole, bare, edits: F.struct(text.alias("text"), *[F.lit(x).alias(n) for x, n in ((tight, "tight"), (whole, "sorted"), (bare, "bare"), (edits, "edits"))])
    of_bare = F.array(use(F.col("tight"), True, False, False, True), use(in_set, False, False, True, True), use(F.col("ordered"), False, False, False, True))
    of_whole = F.array(use(in_set, False, True, False, False))
    strings = known.select("value", F.explode(F.when(F.col("is_bare"), of_bare).otherwise(of_whole)).alias("x")).select("value", "x.*").filter("text NOT IN ('', '=')")
    return strings.groupBy("value", "text").agg(*[F.bool_or(c).alias(c) for c in ("tight", "sorted", "bare", "edits")])


def strings_of(names: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (entry, ref, role, k): the strings of each entry; spellings with synonyms take no edits."""
    refs = with_words(names, "name", table, ["entry", "name"])
    fixed = refs.select("entry", F.explode(spellings(F.col("name"))).alias("ref"), F.lit("spelling").alias("role"), F.lit(0).alias("k"))
    kinds = F.array(F.struct(squeezed(F.col("name")).alias("ref"), F.lit("tight").alias("role")), F.struct(F.col("ordered").alias("ref"), F.lit("ordered").alias("role")), F.struct(F.concat(F.lit("="), F.replace("sorted", F.lit(" "), F.lit(""))).alias("ref"), F.lit("sorted").alias("role")))
    loose = refs.select("entry", F.explode(kinds).alias("x")).select("entry", "x.*").withColumn("k", 2 * slips_allowed(F.length("ref")))
    return fixed.unionByName(loose).filter("ref NOT IN ('', '=')").distinct()


def map_values(values: DataFrame, catalog: DataFrame, key: str = "feature_id", name: str = "feature", aliases: str = "aliases") -> DataFrame:
    """Rows (value, entry, how) for each different ``value``; entry 0 where none is singled out."""
    shared_dir(values.sparkSession)
    table = word_table(catalog.select(F.col(name).alias("name")).filter("name IS NOT NULL")).checkpoint()
    strings = strings_of(names_of(catalog, key, name, aliases), table).checkpoint()
    forms = forms_of(values, table).checkpoint()

    met = within_reach(forms, strings.select("ref", "k"))
    slips = F.greatest(letters_apart(F.col("text"), F.col("ref")), F.ceil(F.col("distance") / 2).cast("int"))
    close = met.withColumn("slips", F.when(F.col("distance") == 0, 0).otherwise(slips)).filter(F.col("slips") * 2 <= F.col("k"))
    pairs = forms.join(close, "text").join(strings, ["ref", "k"])
    same = F.col("distance") == 0
    step = F.when(F.col("tight") & same & F.col("role").isin("tight", "spelling"), 0).when(F.col("sorted") & same & (F.col("role") == "sorted"), 1).when(F.col("bare") & same & (F.col("role") == "sorted"), 2)
    usable = pairs.withColumn("step", step).withColumn("edits", F.col("edits") & (F.col("role") != "spelling")).filter("step IS NOT NULL OR edits")
    cost = F.min(F.when(F.col("edits"), F.struct("slips", "distance")))
    each = usable.groupBy("value", "entry").agg(*[F.bool_or(F.coalesce(F.col("step") == i, F.lit(False))).alias(f"at{i}") for i in range(3)], cost.alias("cost"))
    # a handful of entries within reach of one value; the counts and least keys are all that is kept of them
    one = lambda c: F.struct(F.count_if(c).alias("n"), F.min(F.when(c, F.col("entry"))).alias("entry"))
    found = each.groupBy("value").agg(*[one(F.col(f"at{i}")).alias(f"by{i}") for i in range(3)], F.sort_array(F.collect_list(F.when(F.col("cost").isNotNull(), F.struct("cost", "entry")))).alias("near"))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    edits = F.when(first.isNotNull() & ~F.coalesce(first["cost"] == second["cost"], F.lit(False)), first["entry"])
    steps = [(F.when(F.col(f"by{i}.n") == 1, F.col(f"by{i}.entry")), how) for i, how in enumerate(("spelling", "words", "words"))] + [(edits, "edits")]
    how = F.coalesce(*[F.when(c.isNotNull(), F.lit(x)) for c, x in steps])
    named = found.select("value", F.coalesce(*[c for c, _ in steps]).cast("int").alias("entry"), how.alias("how")).filter("entry IS NOT NULL").checkpoint()
    none = values.select("value").distinct().join(named, "value", "left_anti").select("value", F.lit(0).alias("entry"), F.lit("none").alias("how"))
    return named.unionByName(none)


def occurrences(claims: DataFrame, annotations: DataFrame, passes: DataFrame) -> DataFrame:
    """Rows (src, row_id, pos, value) of every typed feature name."""
    one = claims.select(F.lit("claims").alias("src"), F.col("claim_id").alias("row_id"), F.lit(0).alias("pos"), F.col("feature").alias("value"))
    two = annotations.filter("added").select(F.lit("annotations").alias("src"), "row_id", F.lit(0).alias("pos"), F.col("feature").alias("value"))
    three = passes.select(F.lit("llm_passes").alias("src"), F.col("pass_row_id").alias("row_id"), F.posexplode("claims").alias("pos", "c")).select("src", "row_id", "pos", F.col("c.feature").alias("value"))
    return one.unionByName(two).unionByName(three)


def cases(rows: DataFrame, catalog: DataFrame, name: str = "feature") -> DataFrame:
    """Rows whose value is neither null, blank nor exactly a name of the list."""
    typed = rows.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
    return typed.join(catalog.select(F.col(name).alias("value")).distinct(), "value", "left_anti")


def map_rows(rows: DataFrame, catalog: DataFrame, key: str = "feature_id", name: str = "feature", aliases: str = "aliases") -> DataFrame:
    """``rows`` that are cases, with ``entry`` and ``how``."""
    typed = cases(rows, catalog, name)
    return typed.join(map_values(typed.select("value"), catalog, key, name, aliases), "value")
