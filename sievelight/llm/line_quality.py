"""Line-first quality rules, with built-in Spark functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses too much of its text is rejected.

Defined cases: null and empty texts have no word, fail the base rules and are
not kept; ties cannot occur; repeated rows are judged alike, each on its own;
very long texts are judged whole; an empty table gives an empty result; extra
columns, whatever their names, are ignored by ``line_quality`` and kept by
``cleaned_text``; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[ \t\n\x0B\f\r]+"
HAS_WORD = r"[^ \t\n\x0B\f\r]"
SYMBOL = r"[#*$%&|<>]"

#: Punctuation: a line fails when this share of it is symbols, when it has letters nowhere, or when it has eight words or more and no end of a sentence.
SYMBOL_PERCENT = 10
EIGHT_WORDS = r"^\s*(?:\S+\s+){7}\S"
ENDS = r"[.!?…:;。！？][\"”’»)\]]*\s*$"
#: Navigation: separators between short labels, or only a label of a menu, in English, French, German and Spanish.
NAVIGATION = (
    r"^\s*(?:[^|»>•]{1,30}\s*[|»>•]\s*){2,}[^|»>•]{0,30}$|^\s*(?:home|menu|login|log in|sign in|sign up|register|next|previous|back to top|read more|skip to content|contact us|about us"
    r"|accueil|connexion|inscription|suivant|précédent|haut de page|lire la suite|contact|startseite|anmelden|registrieren|weiter|zurück|nach oben|weiterlesen|kontakt|impressum"
    r"|inicio|iniciar sesión|registrarse|siguiente|anterior|volver arriba|leer más|contacto)\s*[.:>»]?\s*$"
)
#: Boilerplate sentences of web pages in the same languages.
BOILERPLATE = (
    r"(?:accept (?:all )?cookies|we use cookies|cookie policy|all rights reserved|terms of (?:use|service)|privacy policy|enable javascript|javascript is (?:disabled|required)|subscribe to our newsletter|click here to|share (?:this )?on (?:facebook|twitter)|lorem ipsum"
    r"|accepter (?:tous )?les cookies|nous utilisons des cookies|tous droits réservés|politique de confidentialité|mentions légales|cookies akzeptieren|wir verwenden cookies|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung"
    r"|aceptar (?:todas las )?cookies|utilizamos cookies|todos los derechos reservados|condiciones de uso|política de privacidad)"
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def repeated_window_words(hashes: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    ``hashes`` are the windows' hashes by position.  Sorted (hash, position)
    pairs put equal windows side by side; the sorted positions of those then
    cover min(3, distance to the next) words each.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = let(
        pairs,
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda x, j: F.struct(((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])).alias("same"), x["i"].alias("i"))),
                    lambda x: x["same"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = let(
        repeated,
        lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rules remove."""
    return (
        (100 * F.regexp_count(line, F.lit(SYMBOL)) > SYMBOL_PERCENT * F.length(line))
        | ~line.rlike(r"\p{L}")
        | (line.rlike(EIGHT_WORDS) & ~line.rlike(ENDS))
        | line.rlike("(?iu)" + NAVIGATION)
        | line.rlike("(?iu)" + BOILERPLATE)
    )


def line_quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_kept_share: float = 0.5) -> DataFrame:
    """Counts and verdict per row of ``docs(doc_id, text)``.

    ``base_failed`` are the document rules (too few words, repetition);
    ``kept`` also asks that the lines which pass hold ``min_kept_share`` of the
    words' characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)).alias("lines"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    counted = lines.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        ).alias("windows"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("line_chars"),
        F.aggregate(F.filter("lines", lambda x: ~line_fails(x)), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("passed_chars"),
    )
    ruled = counted.withColumn("n_repeat_words", F.coalesce(repeated_window_words(F.col("windows")), F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("passed_chars") >= min_kept_share * F.col("line_chars"))).alias("kept"),
        F.round(F.when(F.col("line_chars") > 0, F.col("passed_chars") / F.col("line_chars")).otherwise(0.0), 6).alias("kept_share"),
    )


def cleaned_text(docs: DataFrame) -> DataFrame:
    """``docs`` with the failing lines of ``text`` removed; lines without a word stay, null stays null."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(HAS_WORD) | ~line_fails(x))
    return docs.withColumn("text", F.array_join(kept, "\n"))


#: DuckDB SQL for ``line_quality`` over ``documents``.
ORACLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, text,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), wins AS (
  SELECT doc_id, text, w, lines,
    CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g
  FROM cut
), places AS (
  SELECT doc_id, unnest(g) AS gram, unnest(range(0, len(g))) AS i FROM wins
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM places) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM repeats, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id
), counted AS (
  SELECT wins.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS line_chars,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT (
      100 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > {SYMBOL_PERCENT} * length(x)
      OR NOT regexp_matches(x, '\p{{L}}')
      OR regexp_matches(x, '{EIGHT_WORDS}') AND NOT regexp_matches(x, '{ENDS}')
      OR regexp_matches(x, '(?i){NAVIGATION}')
      OR regexp_matches(x, '(?i){BOILERPLATE}'))), lambda x: length(x))), 0) AS passed_chars
  FROM wins LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND passed_chars >= 0.5 * line_chars AS kept,
  round(CASE WHEN line_chars > 0 THEN passed_chars / line_chars ELSE 0.0 END, 6) AS kept_share
FROM counted
"""
