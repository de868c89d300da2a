"""Line-first cleaning: rules judge each line, lines that fail go, and a
document that loses too much text is rejected.

A line (cut at \\n) with a word fails by the first of these rules:
``navigation`` (three separators or more that stand alone, at least one per
five words), ``boilerplate`` (phrases of ``BOILERPLATE``, in any of its languages and
on word edges, hold at least one in ``DENSITY`` of its words: a sentence that names a
cookie or a privacy policy in passing stays), ``symbols`` (symbols above a tenth of the characters in words), ``shouting`` (20 capitals or more
and over 60 % of the Latin letters), ``repetition`` (over 30 % of the words
equal the word before), ``punctuation`` (no word has a sentence mark among
its last two characters). A document is rejected if the base rules fail it (under 50 words,
or over half of them in repeated 3-word windows), or if failed lines hold over
``MAX_LOST`` percent of its words.

Defined results: a null text has no words and fails the base rules; lines
without a word never fail; a text of any length is judged whole, in memory in proportion to it; repeated rows are judged row by row; an empty table
gives no rows; further columns pass through ``clean`` untouched."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, read
from .textstats import has_word, n_symbols, stats, word_chars

MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 50, 40
DENSITY = 3
RULES = ("navigation", "boilerplate", "symbols", "shouting", "repetition", "punctuation")

# Separators, phrases and sentence marks of web pages.
SEPARATORS = ("|", "»", "›", "•", "·", ">", "/")
BOILERPLATE = {
    "en": ("all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "privacy notice", "cookie policy",
           "cookie settings", "we use cookies", "uses cookies", "accept cookies", "accept all cookies", "lorem ipsum", "sign up", "sign in", "log in",
           "create an account", "subscribe now", "subscribe to our", "newsletter", "unsubscribe", "click here", "read more", "share this", "follow us",
           "powered by", "skip to content", "skip to main content", "back to top", "enable javascript", "please enable javascript", "javascript is disabled", "javascript is required"),
    "de": ("alle rechte vorbehalten", "impressum", "datenschutz", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "verwenden cookies",
           "cookies akzeptieren", "cookie einstellungen", "jetzt anmelden", "jetzt registrieren", "hier klicken", "klicken sie hier", "mehr lesen", "weiterlesen",
           "zum inhalt springen", "nach oben", "javascript aktivieren", "aktivieren sie javascript"),
    "fr": ("tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d utilisation", "conditions générales", "utilise des cookies",
           "utilisons des cookies", "accepter les cookies", "se connecter", "s inscrire", "abonnez vous", "cliquez ici", "lire la suite", "en savoir plus",
           "aller au contenu", "haut de page", "activer javascript"),
    "es": ("todos los derechos reservados", "aviso legal", "política de privacidad", "política de cookies", "términos de uso", "términos y condiciones",
           "condiciones de uso", "utiliza cookies", "utilizamos cookies", "aceptar cookies", "iniciar sesión", "suscríbete", "haga clic aquí", "haz clic aquí",
           "leer más", "saber más", "ir al contenido", "volver arriba", "activar javascript"),
}
MARKS = ".!?…:;\"'”’»)]。！？"

_CAPITALS, _SMALL = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")
_WORD, _TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\W_]+")
_PHRASES = sorted({p for ps in BOILERPLATE.values() for p in ps}, key=lambda p: (-len(p), p))
#: Every word stands between two spaces of its own, so that a match lies on word edges.
CUES = "|".join(" " + p.replace(" ", "  ") + " " for p in _PHRASES)
_CUES = re.compile(CUES)
#: The longest word of every phrase: a text without it hasn't the phrase.
_ANCHORS = tuple(sorted({max(p.split(), key=len) for p in _PHRASES}))


def anchors(text: str) -> list[str]:
    low = text.lower()
    return [a for a in _ANCHORS if a in low]


def is_boilerplate(low: str) -> bool:
    """Whether phrases hold at least one in DENSITY of a lower-case line's letter-and-digit words."""
    terms = _TERM.findall(low)
    held = sum(c.count("  ") + 1 for c in _CUES.findall(" " + "  ".join(terms) + " "))
    return held > 0 and DENSITY * held >= len(terms)


def failed_rule(line: str, present: list[str] | tuple[str, ...] = _ANCHORS) -> str | None:
    """The first rule that a line with a word fails; ``present`` are the anchors to look for."""
    ws = _WORD.findall(line)
    if any(s in line for s in SEPARATORS):
        alone = sum(w in SEPARATORS for w in ws)
        if alone >= 3 and 5 * alone >= len(ws):
            return "navigation"
    low = line.lower()
    if any(a in low for a in present) and is_boilerplate(low):
        return "boilerplate"
    if 10 * n_symbols(line) > word_chars(line):
        return "symbols"
    if low != line:
        capitals = len(_CAPITALS.findall(line))
        if capitals >= 20 and 5 * capitals > 3 * (capitals + len(_SMALL.findall(line))):
            return "shouting"
    if 10 * sum(map(str.__eq__, ws, ws[1:])) > 3 * len(ws):
        return "repetition"
    if not any(c in MARKS for w in ws for c in w[-2:]):
        return "punctuation"
    return None


def judge(text: str) -> tuple[str, list[str | None], int]:
    """Text without failed lines, each line's failed rule, and the words lost."""
    kept, why, lost, present = [], [], 0, anchors(text)
    for line in text.split("\n"):
        rule = failed_rule(line, present) if has_word(line) else None
        why.append(rule)
        if rule is None:
            kept.append(line)
        else:
            lost += len(_WORD.findall(line))
    return "\n".join(kept), why, lost


def verdict(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, lost_words, clean text."""
    x = stats(text)
    clean, why, lost = judge(text)
    base = x["n_words"] < MIN_WORDS or 100 * x["n_repeat_words"] > MAX_REPEATED * x["n_words"]
    return (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], base,
            not base and 100 * lost <= MAX_LOST * x["n_words"], sum(r is not None for r in why), lost, clean)


COUNTS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
VERDICT = [*COUNTS, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
           T.StructField("n_failed_lines", T.LongType()), T.StructField("lost_words", T.LongType())]


def clean(docs: DataFrame) -> DataFrame:
    """docs with every column in a struct ``row``, its verdict, and the text
    without failed lines as ``clean_text``."""
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([rows.schema["row"], *VERDICT, T.StructField("clean_text", T.StringType())])

    def make():
        def run(batch):
            row = batch.column("row")
            return [row, *zip(*[verdict(str(t or "")) for t in row.field("text").to_pylist()])]
        return run

    return map_batches(rows, make, schema)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *VERDICT])

    def make():
        return lambda batch: [batch.column("doc_id"), *zip(*[verdict(t or "")[:-1] for t in batch.column("text").to_pylist()])]

    return map_batches(docs, make, schema)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{word}') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)),
rep AS (SELECT rid, count(DISTINCT i + o) AS n
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri), (SELECT unnest([0, 1, 2]) AS o)
        WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM s),
lw AS (SELECT rid, line, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS terms, regexp_extract_all(line, '{word}') AS ws FROM l WHERE regexp_matches(line, '{word}')),
m AS (SELECT rid, line, len(ws) AS n, len(list_filter(ws, lambda w: w IN ({_sql_list(SEPARATORS)}))) AS alone,
             len(terms) AS n_terms, coalesce(list_sum(list_transform(regexp_extract_all(' ' || array_to_string(terms, '  ') || ' ', '{CUES}'),
                                                                   lambda c: length(c) - length(replace(c, '  ', ' ')) + 1)), 0) AS held,
             length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
             length(array_to_string(ws, '')) AS chars,
             length(regexp_replace(line, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS up,
             length(regexp_replace(line, '[^a-zß-öø-ÿ]', '', 'g')) AS down,
             len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS same,
             len(list_filter(ws, lambda w: regexp_matches(right(w, 2), '[.!?…:;"''”’»)\]。！？]'))) > 0 AS ended
      FROM lw),
f AS (SELECT rid, line, n, (alone >= 3 AND 5 * alone >= n) OR (held > 0 AND {DENSITY} * held >= n_terms) OR 10 * symbols > chars
             OR (up >= 20 AND 5 * up > 3 * (up + down)) OR 10 * same > 3 * n OR NOT ended AS failed FROM m),
p AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (failed) AS bad, coalesce(sum(n) FILTER (failed), 0) AS lost
      FROM f GROUP BY rid),
a AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(bad, 0) AS n_failed_lines, coalesce(lost, 0) AS lost_words
      FROM s LEFT JOIN p USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost_words <= {MAX_LOST} * n_words AS kept,
       n_failed_lines, CAST(lost_words AS BIGINT) AS lost_words
FROM a"""
