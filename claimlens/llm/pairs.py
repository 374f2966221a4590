"""Defects of prompt and response pairs, by ordered rules on built-in expressions.

All rules stay in the JVM and look at one row each, so the plan is one scan
without a shuffle. Each rule is judged on its own and every triggered type comes
out in ``defects`` in the order of the rules; ``defect`` is the first.

Rules, in order:
* ``empty``: nothing is left beside white space, invisible characters,
  punctuation, markup or a role name. Nothing is left then for other rules to judge.
* ``copy``: most runs of four words of the answer stand in the prompt.
* ``refusal``: a phrase that declines (four languages) in an answer that explains
  nothing, so that it names none of the evidence to which the prompt gives a
  number; other numbers do not count. In a copy only a phrase that the prompt lacks declines.
* ``truncated``: see :mod:`claimlens.llm.endings`. A copy that ends where a line of
  the prompt ends is whole.
* ``language``: most letters of the answer are of another script, or its function
  words mainly of another language, than the prompt asks for or, if it asks for
  none, is written in.

A verdict word that stands in capitals in the instructions (and ``[]`` where they
ask for a list) is sound, with a reason after it or not. A refusal in other words
is one even where the instructions offer such a word.

Defined results: a null text is ``empty``; a null prompt offers nothing and
states no language; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.endings import INVISIBLE, body, json_like, with_ending

COPIED_SHARE = 0.55
RUN = 4
#: Letters and digits by which the end of a copy is looked up in the lines of the prompt.
TAIL = 12
#: Names of roles.
ROLES = r"assistant|user|system|human|ai|bot|model|answer|response|reply|output|assistent|asistente|usuario|antwort|respuesta|réponse|utilisateur|nutzer"
#: Articles, pronouns, prepositions, conjunctions and auxiliaries of the languages; some are words of two of them.
FUNCTION_WORDS = {
    "en": "the|a|an|in|on|as|no|so|and|with|of|to|is|was|were|for|by|it|its|which|from|that|this|these|those|are|because|since|not|there|whose|has|have|had|be|been|at|or|while|where|into|but|out|than|then|they|their|them|we|our|you|your|she|his|her|if|how|when|what|who|would|could|should|does|did|do|each|any|both|only|more|most|about|against|between|through",
    "de": "der|die|das|des|in|an|am|so|es|und|den|dem|für|mit|von|zu|bei|ist|wurde|wurden|werden|eine|einen|einer|einem|ein|nicht|sich|auf|weil|auch|dass|aus|sie|ich|wird|vom|zum|zur|im|um|warum|wie|wenn|oder|aber|sind|hat|haben|kann|noch|nach|durch|über|unter|gegen|ohne|wir|ihr|er|dieser|diese|dieses|kein|keine|sein|seine|als|vor|zwischen",
    "es": "el|la|los|las|de|en|a|un|que|es|no|son|si|o|e|con|por|para|y|al|del|se|su|sus|más|hacia|una|como|también|lo|qué|cada|sin|este|esta|esto|estos|fue|fueron|está|están|porque|pero|cuando|donde|muy|hasta|desde|ni|sino|ella|ellos|nosotros|usted|hay|sido|unos|unas|según|entre|sobre|contra",
    "fr": "le|la|les|de|des|en|a|un|que|du|une|et|est|pour|avec|à|au|aux|dans|été|sur|par|vers|il|ils|elle|elles|on|ne|pas|se|si|son|sa|ses|cette|ce|ces|aussi|qui|je|pourquoi|chaque|comme|plutôt|nous|vous|mais|où|donc|car|sont|était|leur|leurs|sans|sous|entre|être|avoir|ont|même|très|parce|dont|ou|quand",
}
#: Names of the languages in these languages.
LANGUAGE_NAMES = {
    "en": "english|englisch|englischer|inglés|ingles|anglais",
    "de": "german|deutsch|deutscher|alemán|aleman|allemand",
    "es": "spanish|spanisch|spanischer|español|espanol|espagnol|castellano",
    "fr": "french|französisch|französischer|francés|frances|français|francais",
}
#: Scripts as regular expressions name them; Japanese is mostly told by kana beside Han.
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "han": r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}", "hangul": r"\p{IsHangul}", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}"}
#: Names of languages of other scripts in the four languages.
SCRIPT_NAMES = {
    "cyrillic": "russian|russisch|ruso|russe|ukrainian|ukrainisch|ucraniano|ukrainien|bulgarian|bulgarisch|búlgaro|bulgare",
    "greek": "greek|griechisch|griego|grec",
    "arabic": "arabic|arabisch|árabe|arabe|persian|persisch|persa|persan",
    "hebrew": "hebrew|hebräisch|hebreo|hébreu",
    "han": "chinese|chinesisch|chino|chinois|japanese|japanisch|japonés|japonais",
    "hangul": "korean|koreanisch|coreano|coréen",
    "devanagari": "hindi",
    "thai": "thai|tailandés|thaï",
}
#: Phrases that decline, in the four languages.
REFUSALS = (
    r"\b(?:can ?no?t|can['’]t|unable to|not able to|won['’]t|will not|am not (?:allowed|permitted) to|may not|must not) (?:be )?(?:able to )?(?:help|assist|comply|answer|comment|discuss|provide|produce|write|writing|explain|do (?:that|this|so)|share|talk|fulfill?|continue|process|list|give|engage|respond|support)",
    r"\b(?:must|have to|need to) (?:decline|refuse|pass)|\bi (?:decline|refuse)\b|off limits|(?:falls?|lies|is) (?:outside|beyond) (?:what|of)|(?:outside|beyond) (?:my|the) (?:scope|remit)|rather not|prefer not to|not something i (?:do|can|may)|something i (?:won['’]t|cannot|can['’]t)|i have to leave aside|no (?:explanation|answer|list|text) will be given",
    r"\bas an? (?:ai|language model|assistant)\b|(?:against|under) (?:my|our) (?:current )?(?:guidelines|policy|policies|rules)|\b(?:i['’]m|i am) (?:sorry|afraid)\b|^\W*sorry\b|\bi apologi[sz]e\b",
    r"kann ich (?:leider )?(?:nicht|keine)|darf ich (?:leider )?(?:nicht|keine)|muss ich (?:leider )?ablehnen|werde ich (?:mich )?nicht|möchte ich (?:\w+ )?(?:nicht|keine)|nicht (?:helfen|beantworten|möglich|äußern|weiterhelfen)|lehne (?:ich|es) (?:\w+ )?ab|tut mir leid|ich bedaure|\bals (?:ki|sprachmodell)\b",
    r"no (?:puedo|podemos) (?:ayudar|responder|hacer|dar|explicar|escribir|comentar|atender|cumplir)|no me está permitido|(?:debo|tengo que) (?:rechazar|declinar)|prefiero no|no debo|lo siento|lamento|no voy a|me niego|como modelo de lenguaje",
    r"je ne (?:peux|puis|dois|vais|saurais) pas (?:vous )?(?:y )?(?:aider|répondre|expliquer|écrire|commenter|donner|fournir)|m['’]est pas permis|dois (?:refuser|décliner)|préfère (?:ne (?:pas|rien)|éviter)|désolée?\b|je (?:refuse|regrette)|en tant que modèle",
)
#: Titles of quoted material in the four languages.
QUOTED = "Draft|Text|Passage|Excerpt|Document|Quote|Article|Message|Source text|Entwurf|Auszug|Dokument|Zitat|Artikel|Nachricht|Texto|Borrador|Fragmento|Documento|Cita|Artículo|Mensaje|Texte|Brouillon|Extrait|Citation"


def left_over(text: Column) -> Column:
    """What is neither white space, invisible, punctuation, markup nor a role name."""
    bare = F.regexp_replace(text, r"```[\w+-]*|</?[a-zA-Z][^<>]*>|<\|[^|>]*\|>", " ")
    bare = F.regexp_replace(bare, rf"(?i)(?m)^[{INVISIBLE}*#>_-]*(?:{ROLES})[{INVISIBLE}*_]*:", " ")
    bare = F.regexp_replace(bare, rf"(?i)^[{INVISIBLE}\p{{P}}\p{{S}}]*(?:{ROLES})[{INVISIBLE}\p{{P}}\p{{S}}]*$", "")
    return F.regexp_replace(bare, rf"[{INVISIBLE}\p{{P}}\p{{S}}]+", "")


def instructions(prompt: Column) -> Column:
    """The prompt without a quoted draft or text, which is no instruction."""
    return F.regexp_replace(prompt, rf"(?s)(?:^|\n)(?:{QUOTED})\s?:\s*\n.*(?=\n\n|\n\p{{L}}+\s?:\s*$)", "\n")


def verdict_word(text: Column) -> Column:
    """The first word of the answer in capitals."""
    return F.upper(F.regexp_extract(text, r"^[\s*_`\"'(\[>#-]*(\p{L}+)", 1))


def offered(text: Column, told: Column) -> Column:
    """Whether the answer is, or starts with, a verdict or empty list that the instructions name."""
    word = verdict_word(text)
    rest = F.regexp_extract(text, r"^[\s*_`\"'(\[>#-]*\p{L}+[*_`\"')\]]*\s*(.?)", 1)
    names = (F.length(word) >= 4) & F.regexp_like(told, F.concat(F.lit(r"(?<![\p{L}])"), word, F.lit(r"(?![\p{L}])")))
    nothing = F.regexp_like(body(text), F.lit(r"^(?:```\w*\s*)?(?:\[\s*\]|\{\s*\})(?:\s*```)?$")) & F.regexp_like(told, F.lit(r"(?i)json|list|array"))
    return (names & F.regexp_like(rest, F.lit(r"^(?:[\p{P}–—]|)$"))) | nothing


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def word_runs(words: Column, n: int = RUN) -> Column:
    """Hashes of the different runs of ``n`` neighbouring words."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))


def with_copied_share(df: DataFrame, text: str, prompt: str, where: Column, out: str = "copied") -> DataFrame:
    """Share of the answer's word runs that stand in the prompt; a shorter answer counts as one run.

    Rows that ``where`` leaves out get 0 unread.
    """
    words = df.withColumn("mine_", F.when(where, plain_words(F.col(text)))).withColumn("theirs_", F.when(F.size("mine_") > 1, plain_words(F.col(prompt))))
    runs = words.withColumn("runs_", word_runs(F.col("mine_"))).withColumn("of_", F.when(F.size("mine_") >= RUN, word_runs(F.col("theirs_"))))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    few = (F.size("mine_") >= 2) & F.contains(spaced("theirs_"), spaced("mine_"))
    share = F.when(F.size("mine_") < RUN, F.when(few, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect("runs_", "of_")) / F.greatest(F.size("runs_"), F.lit(1)))
    return runs.withColumn(out, F.when(F.col("theirs_").isNotNull(), F.coalesce(share, F.lit(0.0))).otherwise(F.lit(0.0))).drop("mine_", "theirs_", "runs_", "of_")


def with_word_counts(df: DataFrame, text: str, out: str) -> DataFrame:
    """How many function words of each language the text has, as an array of (n, k)."""
    words = df.withColumn("words_", bare_words(F.col(text)))
    return words.withColumn(out, word_counts("words_")).drop("words_")


def bare_words(text: Column) -> Column:
    """Lower-case words of letters that touch no digit."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])\p{L}+(?![\p{L}\p{N}])"), 0)


def word_counts(words: str) -> Column:
    among = lambda of: F.size(F.filter(words, lambda x: x.isin(*of.split("|"))))
    return F.array(*[F.struct(among(w).alias("n"), F.lit(k).alias("k")) for k, w in FUNCTION_WORDS.items()])


def leading(counts: str) -> Column:
    """The language whose function words lead with two at least, else null."""
    most = F.array_max(F.col(counts))
    return F.when((most["n"] >= 2) & (F.size(F.filter(counts, lambda x: x["n"] == most["n"])) == 1), most["k"])


def another_language(counts: str, asked: Column) -> Column:
    """Whether some language has two function words at least, and more than the one asked for."""
    own = F.array_max(F.transform(F.filter(counts, lambda x: x["k"] == asked), lambda x: x["n"]))
    most = F.array_max(F.col(counts))["n"]
    return (most >= 2) & (most > own)


def main_script(text: Column) -> Column:
    """The script of most letters; counted only where a letter is not Latin, null without letters."""
    counts = F.array(*[F.struct((F.length(text) - F.length(F.regexp_replace(text, f"[{x}]", ""))).alias("n"), F.lit(k).alias("k")) for k, x in SCRIPTS.items()])
    most = F.array_max(counts)
    return F.when(F.regexp_like(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")), F.when(most["n"] > 0, most["k"])).when(F.regexp_like(text, F.lit(r"\p{L}")), F.lit("latin"))


def last_named(words: str) -> Column:
    """The last of the words that is the name of a language."""
    every = [w for names in (*SCRIPT_NAMES.values(), *LANGUAGE_NAMES.values()) for w in names.split("|")]
    named = F.filter(words, lambda x: x.isin(*every))
    return F.element_at(F.when(F.size(named) > 0, named), -1)


def among_names(named: Column, of: dict[str, str]) -> Column:
    """The key of ``of`` to which the name belongs."""
    return F.coalesce(*[F.when(named.isin(*w.split("|")), F.lit(k)) for k, w in of.items()])


def evidence(told: Column) -> Column:
    """Names that the prompt gives a number to."""
    return F.array_distinct(F.transform(F.regexp_extract_all(told, F.lit(r"(\p{Lu}[\p{L}\p{N}/-]*(?: [\p{L}\p{N}/-]+){0,5})\s?[=:]\s?[+-]?\d"), 1), lambda x: F.lower(x)))


def checked(calls: DataFrame, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """``calls`` with ``defects`` (array in the order of the rules) and ``defect`` (the first, null if sound)."""
    inner = calls.select(F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("row"), F.coalesce(F.col(prompt), F.lit("")).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    one = inner.withColumn("told", instructions(F.col("p"))).withColumn("left", left_over(F.col("t"))).withColumn("low", F.lower("t"))
    two = one.withColumn("sound", offered(F.col("t"), F.col("told"))).withColumn("json", json_like(F.col("t")))
    three = with_ending(with_copied_share(two, "t", "p", ~F.col("sound") & ~F.col("json"), "share"), "t", "cut")
    phrase = F.lit(False)
    for x in REFUSALS:
        phrase = phrase | (F.regexp_like("low", F.lit(x)) & ~(F.col("copy") & F.regexp_like(F.lower("p"), F.lit(x))))
    answer = ~F.col("sound") & ~F.col("json")
    four = (
        three.withColumn("empty", (F.length("left") == 0) & ~F.col("sound"))
        .withColumn("copy", ~F.col("empty") & answer & (F.col("share") >= COPIED_SHARE))
        .withColumn("script", main_script(F.col("t")))
        .withColumn("words", bare_words(F.col("told")))
        .withColumn("named", last_named("words"))
        # the language that the instructions name last, else the one they are written in
        .withColumn("asks", F.when(F.col("script").isNotNull(), F.coalesce(among_names(F.col("named"), SCRIPT_NAMES), F.when(F.col("named").isNotNull(), F.lit("latin")), main_script(F.col("told")))))
        .withColumn("foreign", F.coalesce(answer & ~F.col("empty") & (F.col("script") != F.col("asks")), F.lit(False)))
        .withColumn("names", F.when(answer & ~F.col("empty"), evidence(F.col("p"))))
        .withColumn("explains", F.coalesce(F.exists("names", lambda x: F.contains(F.col("low"), x)), F.lit(False)))
        # the phrases are looked for where nothing is explained, which few answers do
        .withColumn("declines", ~F.col("empty") & answer & ~F.col("explains") & phrase)
    )
    five = with_word_counts(four, "t", "is").withColumn("written", word_counts("words")).withColumn("asked", F.coalesce(among_names(F.col("named"), LANGUAGE_NAMES), leading("written")))
    bare = F.col("sound") & F.regexp_like(body(F.col("t")), F.lit(r"^[\W_]*\p{L}+[\W_]*$|^\[\s*\]$"))
    line_end = F.exists(F.split("p", "\n"), lambda x: (F.length(letters(x)) >= 4) & F.endswith(letters(F.col("t")), F.right(letters(x), F.lit(TAIL))))
    truncated = ~F.col("empty") & F.col("cut") & ~bare & ~(F.col("copy") & line_end)
    words = ~F.col("json") & another_language("is", F.col("asked"))
    other = ~F.col("empty") & (F.col("foreign") | F.coalesce(words, F.lit(False)))
    rules = (("empty", F.col("empty")), ("copy", F.col("copy")), ("refusal", F.col("declines")), ("truncated", truncated), ("language", other))
    every = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules]), lambda x: x.isNotNull())
    return five.select("row.*", every.alias("defects")).withColumn("defect", F.get("defects", F.lit(0)))


def fallbacks(explanations: DataFrame) -> DataFrame:
    """Rows (request_hash, fallback): whether an explanation made from the call abstained."""
    used = explanations.select(F.explode("llm_call_ids").alias("request_hash"), "abstained")
    return used.groupBy("request_hash").agg(F.bool_or("abstained").alias("fallback"))
