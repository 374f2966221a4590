"""Rendering, extraction and verification of explanations, and the call ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from claimlens.functions import text as X

from claimlens.operators.flow import PHI_SQL, audited
from claimlens.plans.parallel import deal_out
from claimlens.registry import Registry
from claimlens.sources import load

registry = Registry()

_B0 = "string_agg(printf('%s=%+.4f', feature, phi), '; ' ORDER BY rank)"
_B1 = "string_agg(printf('%d. %s %s the %s score (magnitude %.4f)', rank, feature, CASE direction WHEN '+' THEN 'increased' ELSE 'decreased' END, class, abs(phi)), chr(10) ORDER BY rank)"


@registry.add("gn_01_raw_list", f"WITH {PHI_SQL}, t AS (SELECT instance_id, {_B0} AS text FROM ranked WHERE rank <= 3 GROUP BY 1) SELECT length(text) AS chars, count(*) AS n FROM t GROUP BY 1")
def gn_01_raw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select(F.length(X.render_list(F.col("top"))).alias("chars"))
    return rows.groupBy("chars").agg(F.count("*").alias("n"))


@registry.add("gn_02_template", f"WITH {PHI_SQL}, t AS (SELECT instance_id, class, {_B1} AS text FROM ranked WHERE rank <= 3 GROUP BY 1, 2) SELECT class, split_part(text, ' the ', 1) AS head, count(*) AS n FROM t GROUP BY 1, 2")
def gn_02_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(spark, sf_dir).select("class", F.substring_index(X.render_template(F.col("top"), F.col("class")), " the ", 1).alias("head"))
    return rows.groupBy("class", "head").agg(F.count("*").alias("n"))


@registry.add("gn_06_abstaining_fallback", "SELECT generator_id, fallback_generator_id, count(*) AS n, count(*) FILTER (WHERE text LIKE '1. %') AS template_texts FROM explanations WHERE abstained GROUP BY 1, 2")
def gn_06_abstaining_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "explanations").filter("abstained")
    return rows.groupBy("generator_id", "fallback_generator_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").startswith("1. ")).alias("template_texts"))


@registry.add("tx_01_norm", "SELECT translate(lower(feature), '_-', '  ') AS name, count(*) AS n FROM claims WHERE feature IS NOT NULL GROUP BY 1")
def tx_01_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "claims").filter("feature IS NOT NULL").groupBy(X.norm(F.col("feature")).alias("name")).agg(F.count("*").alias("n"))


@registry.add("tx_04_sentence_end", "SELECT length(regexp_extract(text, '(?s)^(.*?)(?:[.!?;](?:\\s|$)|\\n|$)', 1)) AS chars, count(*) AS n FROM explanations WHERE text IS NOT NULL GROUP BY 1")
def tx_04_sentence_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the first sentence; points inside numbers do not end it."""
    end = X.sentence_end(F.col("text"))
    chars = F.when(end > 0, end - 1).otherwise(F.length("text"))
    return load(spark, sf_dir, "explanations").filter("text IS NOT NULL").groupBy(chars.alias("chars")).agg(F.count("*").alias("n"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-02: one row with all names and aliases, longest first; the catalog is a fixed list."""
    c = load(spark, sf_dir, "feature_catalog")
    every = c.select("feature", F.explode(F.concat(F.array("feature"), "aliases")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("v")).alias("size"), X.norm(F.col("v")).alias("variant"), "feature")))
    return every.agg(F.transform(ordered, lambda x: F.struct(x["variant"].alias("variant"), x["feature"].alias("feature"))).alias("variants"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-03: claims of every explanation by the rules."""
    rows = deal_out(load(spark, sf_dir, "explanations").select("explanation_id", "generator_id", F.coalesce("text", F.lit("")).alias("text")))
    found = X.with_mentions(rows.crossJoin(F.broadcast(variants(spark, sf_dir))), "text", "variants").drop("variants")
    return X.with_claims(found, "text", "hits")


@registry.add("tx_03_rule_extraction", None)
def tx_03_rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(spark, sf_dir).select("generator_id", F.inline_outer("claims")).filter("feature IS NOT NULL")
    return rows.groupBy("generator_id", "direction", "direction_evidence").agg(F.count("*").alias("claims"))


_LOW = "lower(substr(text, 1, 300))"


def _stems(stems: tuple[str, ...]) -> str:
    return "list_min(list_filter([" + ", ".join(f"strpos({_LOW}, '{x}')" for x in stems) + "], lambda p: p > 0))"


_GIVEN = "coalesce(nullif(regexp_extract(substr(text, 1, 300), '=\\s*([+-][0-9]+(?:\\.[0-9]+)?)', 1), ''), nullif(regexp_extract(substr(text, 1, 300), '(?:^|[^0-9A-Za-z_.])([+-][0-9]+(?:\\.[0-9]+)?)', 1), ''))"


@registry.add(
    "tx_05_direction",
    f"WITH n AS (SELECT generator_id, {_stems(X.LOWERING)} AS neg, {_stems(X.RAISING)} AS pos, {_stems(X.CONNECTIVES)} AS via, try_cast({_GIVEN} AS DOUBLE) AS v FROM explanations WHERE text IS NOT NULL), "
    "d AS (SELECT generator_id, CASE WHEN neg IS NOT NULL AND (pos IS NULL OR neg <= pos) THEN '-' WHEN pos IS NOT NULL THEN '+' WHEN v >= 0 THEN '+' WHEN v < 0 THEN '-' WHEN via IS NOT NULL THEN '+' END AS direction, "
    "CASE WHEN neg IS NOT NULL OR pos IS NOT NULL THEN 'word' WHEN v IS NOT NULL THEN 'number' WHEN via IS NOT NULL THEN 'connective' ELSE 'default' END AS evidence FROM n) SELECT generator_id, direction, evidence, count(*) AS n FROM d GROUP BY 1, 2, 3",
)
def tx_05_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first window of every explanation states."""
    rows = load(spark, sf_dir, "explanations").filter("text IS NOT NULL").select("generator_id", X.direction_of(F.substring("text", 1, 300)).alias("d"))
    return rows.groupBy("generator_id", F.col("d.direction").alias("direction"), F.col("d.evidence").alias("evidence")).agg(F.count("*").alias("n"))


_SLICE = "substr(text, strpos(text, '['), length(text) - strpos(reverse(text), ']') + 2 - strpos(text, '['))"


def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-07: (explanation_id, generator_id, claims, source): claims of a linked call whose JSON has some, else those of the rules.

    Of several such calls the one with the least id counts; a hot request hash is reduced before it is joined.
    """
    calls = load(spark, sf_dir, "llm_calls").select("request_hash", "call_id", X.parse_claims(F.col("text")).alias("c")).filter(F.size("c") > 0)
    first = calls.groupBy("request_hash").agg(F.min(F.struct("call_id", "c")).alias("x"))
    linked = load(spark, sf_dir, "explanations").select("explanation_id", F.explode("llm_call_ids").alias("request_hash"))
    parsed = linked.join(first, "request_hash").groupBy("explanation_id").agg(F.min("x").alias("x"))
    stated = F.transform("x.c", lambda c, i: F.struct(c["feature"].alias("feature"), c["direction"].alias("direction"), (i + 1).alias("rank"), c["magnitude"].alias("magnitude"), F.lit("json").alias("direction_evidence")))
    rows = extracted(spark, sf_dir).join(parsed, "explanation_id", "left")
    return rows.select("explanation_id", "generator_id", F.when(F.col("x").isNull(), F.col("claims")).otherwise(stated).alias("claims"), F.when(F.col("x").isNull(), "rules").otherwise("json").alias("source"))


_PARSED = f"""s AS (SELECT request_hash, {_SLICE} AS j FROM llm_calls WHERE strpos(text, '[') > 0 AND strpos(text, ']') > 0 AND length(text) - strpos(reverse(text), ']') + 1 > strpos(text, '[')),
    c AS (SELECT request_hash, unnest(from_json(j, '[{{"feature":"VARCHAR","direction":"VARCHAR","magnitude":"DOUBLE"}}]')) AS c FROM s WHERE json_valid(j))"""


@registry.add(
    "tx_07_extract",
    f"WITH {_PARSED}, g AS (SELECT DISTINCT request_hash FROM c WHERE trim(coalesce(c.feature, '')) <> '' AND c.direction IN ('+', '-')) "
    "SELECT generator_id, CASE WHEN explanation_id IN (SELECT explanation_id FROM (SELECT explanation_id, unnest(llm_call_ids) AS h FROM explanations) JOIN g ON g.request_hash = h) THEN 'json' ELSE 'rules' END AS source, count(*) AS n FROM explanations GROUP BY 1, 2",
)
def tx_07_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, sf_dir).groupBy("generator_id", "source").agg(F.count("*").alias("n"))


@registry.add("tx_06_parse_json", f"WITH s AS (SELECT {_SLICE} AS j FROM llm_calls WHERE strpos(text, '[') > 0 AND strpos(text, ']') > strpos(text, '[')), c AS (SELECT unnest(from_json(j, '[{{\"feature\":\"VARCHAR\",\"direction\":\"VARCHAR\",\"magnitude\":\"DOUBLE\"}}]')) AS c FROM s WHERE json_valid(j)) SELECT c.feature AS feature, c.direction AS direction, count(*) AS n FROM c WHERE c.feature IS NOT NULL AND c.direction IN ('+', '-') GROUP BY 1, 2".replace("{{", "{").replace("}}", "}"))
def tx_06_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "llm_calls").select(F.inline_outer(X.parse_claims(F.col("text")))).filter("feature IS NOT NULL")
    return rows.groupBy("feature", "direction").agg(F.count("*").alias("n"))


@registry.add("tx_08_candidates", "WITH v AS (SELECT feature, regexp_replace(lower(unnest(list_concat([feature], aliases))), '[^a-z0-9]+', '', 'g') AS v FROM feature_catalog), t AS (SELECT item_id, regexp_replace(lower(explanation_text), '[^a-z0-9]+', '', 'g') AS t FROM probe_items) SELECT DISTINCT item_id, feature FROM t JOIN v ON contains(t, v)")
def tx_08_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose name or alias stands in the text, signs and spaces left out; names are a fixed list."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    c = load(spark, sf_dir, "feature_catalog").select("feature", F.explode(F.concat(F.array("feature"), "aliases")).alias("v"))
    names = c.agg(F.collect_set(F.struct(squeeze(F.col("v")).alias("v"), "feature")).alias("names"))
    rows = load(spark, sf_dir, "probe_items").select("item_id", squeeze(F.col("explanation_text")).alias("t")).crossJoin(F.broadcast(names))
    hit = F.filter("names", lambda n: F.contains(F.col("t"), n["v"]))
    return rows.select("item_id", F.explode_outer(F.array_distinct(F.transform(hit, lambda n: n["feature"]))).alias("feature")).filter("feature IS NOT NULL")


_LINE = r"(?m)(?:^|; |\d\. |- )(\p{Lu}[^=:\n;]*?)(?:=|: | = [^()\n]*\(weight )([+-])\d"
_ANY = lambda words: "regexp_matches(w, '" + "|".join(words) + "')"
_VERDICTS = f"""e AS (SELECT call_id, lower(coalesce(text, '')) AS d, lower(trim(unnest(regexp_extract_all(prompt, '{_LINE}', 1)))) AS f, unnest(regexp_extract_all(prompt, '{_LINE}', 2)) AS s FROM llm_calls),
    w AS (SELECT call_id, s, strpos(d, f) > 0 AS cited, substr(d, strpos(d, f), length(f) + {X.VERIFIER_WINDOW}) AS w FROM e),
    k AS (SELECT call_id, count(*) FILTER (WHERE cited) AS cited, count(*) FILTER (WHERE cited AND CASE s WHEN '+' THEN {_ANY(X.SAYS_LESS)} AND NOT {_ANY(X.SAYS_MORE)} ELSE {_ANY(X.SAYS_MORE)} AND NOT {_ANY(X.SAYS_LESS)} END) AS clashes FROM w GROUP BY 1),
    v AS (SELECT snapshot_id, CASE WHEN k.call_id IS NULL THEN 'no_evidence' WHEN cited = 0 THEN 'no_cited_feature' WHEN clashes > 0 THEN 'direction_mismatch' ELSE 'supported' END AS reason FROM llm_calls c LEFT JOIN k ON k.call_id = c.call_id)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with the reason of the rule verifier against the evidence quoted in their own prompt."""
    calls = deal_out(load(spark, sf_dir, "llm_calls").select("call_id", "snapshot_id", "prompt", "text"))
    lines, signs = F.regexp_extract_all("prompt", F.lit(_LINE), 1), F.regexp_extract_all("prompt", F.lit(_LINE), 2)
    evidence = F.zip_with(lines, signs, lambda f, s: F.struct(F.trim(f).alias("feature"), s.alias("direction")))
    return calls.withColumn("evidence", evidence).withColumn("reason", X.verdict(F.coalesce("text", F.lit("")), F.coalesce("evidence", F.array().cast("array<struct<feature:string,direction:string>>"))))


@registry.add("tx_10_rule_verifier", f"WITH {_VERDICTS} SELECT reason, count(*) AS calls FROM v GROUP BY 1")
def tx_10_rule_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("calls"))


def decide_abstention(draft: Column, reason: Column, fallback: Column) -> Column:
    """TX-12, GN-06: struct (text, abstained, reason): a draft the verifier supports stands, else the fallback's text is given."""
    gone = reason != "supported"
    return F.struct(F.when(gone, fallback).otherwise(draft).alias("text"), gone.alias("abstained"), reason.alias("reason"))


@registry.add("tx_12_verify_then_abstain", f"WITH {_VERDICTS} SELECT snapshot_id, reason <> 'supported' AS abstained, count(*) AS n, count(*) FILTER (WHERE reason <> 'supported') AS fallback_texts FROM v GROUP BY 1, 2")
def tx_12_verify_then_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts are verified, those that fail give way to the fallback."""
    rows = verdicts(spark, sf_dir).select("snapshot_id", decide_abstention(F.col("text"), F.col("reason"), F.lit("\x00fallback")).alias("x"))
    return rows.groupBy("snapshot_id", "x.abstained").agg(F.count("*").alias("n"), F.count_if(F.col("x.text") == "\x00fallback").alias("fallback_texts"))


@registry.add("tx_11_verdict_token", "SELECT contains(upper(text), 'SUPPORTED') AND NOT contains(upper(text), 'UNSUPPORTED') AS supported, count(*) AS n FROM llm_calls WHERE prompt LIKE '%UNSUPPORTED%' AND text IS NOT NULL GROUP BY 1")
def tx_11_verdict_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-12: a draft that is not supported is abstained from."""
    up = F.upper("text")
    rows = load(spark, sf_dir, "llm_calls").filter(F.contains("prompt", F.lit("UNSUPPORTED")) & F.col("text").isNotNull())
    return rows.groupBy((F.contains(up, F.lit("SUPPORTED")) & ~F.contains(up, F.lit("UNSUPPORTED"))).alias("supported")).agg(F.count("*").alias("n"))


@registry.add("tx_13_prompt_lines", "WITH l AS (SELECT DISTINCT left(model_id, 4) AS family, trim(unnest(string_split(prompt, chr(10)))) AS line FROM llm_calls) SELECT line, count(*) AS families FROM l WHERE length(line) > 30 GROUP BY 1 HAVING count(*) > 1")
def tx_13_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PV-17: prompt lines of over 30 characters that several model families share."""
    lines = load(spark, sf_dir, "llm_calls").select(F.substring("model_id", 1, 4).alias("family"), F.explode(F.split("prompt", "\n")).alias("line"))
    kept = lines.select("family", F.trim("line").alias("line")).filter(F.length("line") > 30).distinct()
    return kept.groupBy("line").agg(F.count("*").alias("families")).filter("families > 1")


# Ledger and content hashes


def quoted(value: Column) -> Column:
    """The JSON of one value; null is ``null``."""
    made = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(made, F.lit(6), F.length(made) - 6)


def tight_json(value: Column) -> Column:
    """Stored JSON, whose keys stand in order, without blanks outside its strings."""
    return F.regexp_replace(value, r'\s*([:,])\s*(?=(?:[^"]*"[^"]*")*[^"]*$)', "$1")


def request_hash(model_id: Column, snapshot_id: Column, prompt: Column, params: Column) -> Column:
    """LL-01: sha256 of the canonical JSON of what determines an answer, keys in order, nulls kept."""
    parts = (("model_id", quoted(model_id)), ("params", F.coalesce(tight_json(params), F.lit("null"))), ("prompt", quoted(prompt)), ("snapshot_id", quoted(snapshot_id)))
    fields = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts]
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.array(*fields), ","), F.lit("}")), 256)


_CANONICAL = """'{"model_id":' || coalesce(to_json(model_id)::VARCHAR, 'null') || ',"params":' || coalesce(json(params)::VARCHAR, 'null') || ',"prompt":' || coalesce(to_json(prompt)::VARCHAR, 'null') || ',"snapshot_id":' || coalesce(to_json(snapshot_id)::VARCHAR, 'null') || '}'"""


@registry.add("ll_01_request_hash", f"SELECT sha256({_CANONICAL}) AS hash, count(*) AS n FROM llm_calls GROUP BY 1")
def ll_01_request_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = request_hash(F.col("model_id"), F.col("snapshot_id"), F.col("prompt"), F.col("params"))
    return load(spark, sf_dir, "llm_calls").groupBy(hashed.alias("hash")).agg(F.count("*").alias("n"))


@registry.add("ll_02_replay", "WITH f AS (SELECT request_hash, min(call_id) AS call_id FROM llm_calls WHERE NOT cached GROUP BY 1) SELECT count(*) AS requests, count(f.call_id) AS answered, count(*) - count(f.call_id) AS missing FROM (SELECT DISTINCT unnest(llm_call_ids) AS request_hash FROM explanations) r LEFT JOIN f ON f.request_hash = r.request_hash")
def ll_02_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of explanations looked up in the ledger; misses are counted, a strict replay raises on them."""
    asked = load(spark, sf_dir, "explanations").select(F.explode("llm_call_ids").alias("request_hash")).distinct()
    ledger = load(spark, sf_dir, "llm_calls").filter("NOT cached").groupBy("request_hash").agg(F.min("call_id").alias("call_id"))
    return asked.join(ledger, "request_hash", "left").agg(F.count("*").alias("requests"), F.count("call_id").alias("answered"), F.count_if(F.col("call_id").isNull()).alias("missing"))


@registry.add("ll_03_first_occurrence", "SELECT request_hash, arg_min(snapshot_id, call_id) AS snapshot_id, min(call_id) AS call_id FROM llm_calls GROUP BY 1")
def ll_03_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a hash wins; a hot hash is reduced before it moves."""
    return load(spark, sf_dir, "llm_calls").groupBy("request_hash").agg(F.min_by("snapshot_id", "call_id").alias("snapshot_id"), F.min("call_id").alias("call_id"))


@registry.add("ll_04_pinned_snapshot", "SELECT snapshot_id, regexp_matches(snapshot_id, '-r[0-9]+$') AS pinned, count(*) AS n FROM llm_calls GROUP BY 1, 2")
def ll_04_pinned_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "llm_calls").groupBy("snapshot_id", F.regexp_like("snapshot_id", F.lit("-r[0-9]+$")).alias("pinned")).agg(F.count("*").alias("n"))


@registry.add("ll_05_stub_provider", "SELECT snapshot_id, min('stub ' || left(sha256(prompt), 12)) AS least, max('stub ' || left(sha256(prompt), 12)) AS most FROM llm_calls GROUP BY 1")
def ll_05_stub_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider whose text depends on the prompt's hash only."""
    made = F.concat(F.lit("stub "), F.substring(F.sha2("prompt", 256), 1, 12))
    return load(spark, sf_dir, "llm_calls").groupBy("snapshot_id").agg(F.min(made).alias("least"), F.max(made).alias("most"))


_PARTS = (1, 17, 33, 49)
_ALL_SUMS = " || ',' || ".join(f"sum(('0x' || substr(h, {i}, 16))::UBIGINT::HUGEINT)" for i in _PARTS)


_HASH_SQL = f"SELECT kind, count(*) AS n, sha256({_ALL_SUMS}) AS digest FROM (SELECT kind, sha256(doc_id || ':' || coalesce(sha256(text), '')) AS h FROM documents) GROUP BY 1"


@registry.add("pv_02_content_hash", _HASH_SQL)
@registry.add("pv_02_content_hash_all", _HASH_SQL)
def pv_02_content_hash_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all documents of each kind: the hashes of id and text, summed in four parts, so in any order and as partial sums."""
    hashed = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce(F.sha2("text", 256), F.lit(""))), 256)
    rows = load(spark, sf_dir, "documents").select("kind", hashed.alias("h"))
    sums = [F.sum(F.conv(F.substring("h", i, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in _PARTS]
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest"))


_ROW_SQL = "sha256(concat_ws(chr(31), coalesce(feature_id::VARCHAR, chr(0)), coalesce(feature, chr(0)), coalesce(description, chr(0)), coalesce(units, chr(0)), coalesce(array_to_string(aliases, chr(30)), chr(0))))"


def row_hash(*columns: Column) -> Column:
    """sha256 of a row's values as text, nulls told from empty ones."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


@registry.add("pv_04_table_digest", f"SELECT count(*) AS n, sha256({_ALL_SUMS}) AS digest FROM (SELECT {_ROW_SQL} AS h FROM feature_catalog)")
def pv_04_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digest of a table: row count and the row hashes, summed in four parts."""
    rows = load(spark, sf_dir, "feature_catalog").select(row_hash(F.col("feature_id"), F.col("feature"), F.col("description"), F.col("units"), F.array_join("aliases", "\x1e")).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", i, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in _PARTS]
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest"))


@registry.add("pv_05_run_ids", "WITH r AS (SELECT cell_id || '__' || left(request_hash, 7) || '__' || strftime(timestamp_utc, '%Y-%m-%dT%H%MZ') AS run FROM llm_calls) SELECT regexp_extract(run, '__([0-9a-f]{7})__', 1) AS commit, count(*) AS n FROM r WHERE regexp_matches(run, '__[0-9a-f]{7}__[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{4}Z$') GROUP BY 1")
def pv_05_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.concat_ws("__", "cell_id", F.substring("request_hash", 1, 7), F.date_format("timestamp_utc", "yyyy-MM-dd'T'HHmm'Z'"))
    rows = load(spark, sf_dir, "llm_calls").select(run.alias("run")).filter(F.regexp_like("run", F.lit("__[0-9a-f]{7}__[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{4}Z$")))
    return rows.groupBy(F.regexp_extract("run", "__([0-9a-f]{7})__", 1).alias("commit")).agg(F.count("*").alias("n"))


_RUNS = "runs AS (SELECT cell_id, strftime(created_utc, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE abstained) AS gone FROM explanations GROUP BY 1, 2), states AS (SELECT cell_id, day, CASE WHEN n >= 2 THEN 'COMPLETE' ELSE 'FAILED' END AS status, gone = 0 AS passed FROM runs)"


@registry.add("pv_11_enforce_gates", f"WITH {_RUNS} SELECT c.generator, count(*) AS cells, count(*) FILTER (WHERE c.cell_id IN (SELECT cell_id FROM states WHERE status = 'COMPLETE' AND passed)) AS open FROM cells c GROUP BY 1")
def pv_11_enforce_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate is open if one of its runs is complete and passed; a run is a day of a cell, complete with two rows, passed without a fallback."""
    runs = load(spark, sf_dir, "explanations").groupBy("cell_id", F.to_date("created_utc").alias("day")).agg(F.count("*").alias("n"), F.count_if("abstained").alias("gone"))
    passed = runs.filter("n >= 2 AND gone = 0").select("cell_id").distinct().withColumn("open", F.lit(True))
    cells = load(spark, sf_dir, "cells").join(passed, "cell_id", "left")
    return cells.groupBy("generator").agg(F.count("*").alias("cells"), F.count_if("open").alias("open"))


@registry.add(
    "pv_14_lineage",
    "WITH c AS (SELECT generator, cell_id, count(*) AS n FROM llm_calls LEFT JOIN cells USING (cell_id) GROUP BY 1, 2), s AS (SELECT generator, cell_id, snapshot_id, count(*) AS n FROM llm_calls LEFT JOIN cells USING (cell_id) GROUP BY 1, 2, 3) "
    "SELECT 1 AS level, generator AS path, sum(n)::BIGINT AS calls FROM c GROUP BY 2 UNION ALL SELECT 2, concat_ws('/', generator, cell_id), n FROM c UNION ALL SELECT 3, concat_ws('/', generator, cell_id, snapshot_id), n FROM s",
)
def pv_14_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree generator, cell, snapshot with the calls below each node, from one roll-up of the calls."""
    calls = load(spark, sf_dir, "llm_calls").groupBy("cell_id", "snapshot_id").agg(F.count("*").alias("n")).join(load(spark, sf_dir, "cells").select("cell_id", "generator"), "cell_id", "left")
    rolled = calls.groupingSets([["generator"], ["generator", "cell_id"], ["generator", "cell_id", "snapshot_id"]], "generator", "cell_id", "snapshot_id").agg(F.sum("n").alias("calls"), (3 - F.bit_count(F.grouping_id())).cast("int").alias("level"))
    return rolled.select("level", F.concat_ws("/", "generator", "cell_id", "snapshot_id").alias("path"), "calls")


@registry.add("pv_15_dangling", "SELECT count(DISTINCT h) AS cited, count(DISTINCT h) FILTER (WHERE h NOT IN (SELECT request_hash FROM llm_calls WHERE request_hash IS NOT NULL)) AS dangling FROM (SELECT unnest(llm_call_ids) AS h FROM explanations)")
def pv_15_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = load(spark, sf_dir, "explanations").select(F.explode("llm_call_ids").alias("request_hash")).distinct()
    there = load(spark, sf_dir, "llm_calls").select("request_hash").distinct().withColumn("there", F.lit(True))
    return cited.join(there, "request_hash", "left").agg(F.count("*").alias("cited"), F.count_if(F.col("there").isNull()).alias("dangling"))


@registry.add("st_stream_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the batch form of the streaming counts by hour and type."""
    from claimlens.streaming.windows import windowed

    return windowed(load(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
