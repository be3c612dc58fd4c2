"""Line-first quality rules: failing lines go, then documents that lose too much of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: Phrases of boilerplate lines (lower case) in English, German, French and Spanish.
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "sign up for our newsletter", "lorem ipsum", "add to cart", "powered by"]
BOILERPLATE += ["alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "in den warenkorb", "newsletter abonnieren"]
BOILERPLATE += ["tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "ajouter au panier", "mentions légales"]
BOILERPLATE += ["todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "haga clic aquí", "añadir al carrito", "aviso legal"]
#: Punctuation of ASCII.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: A line with this share of separators against words is navigation.
NAVIGATION = "|>»›•·"
#: A document that loses more than this percentage of its line characters is rejected.
MOST_LOST = 50


def has_boilerplate(text: Column) -> Column:
    """Whether a phrase of BOILERPLATE is in a text, in any case."""
    low, found = F.lower(text), F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def line_fails(line: Column, phrases: Column | bool = True) -> Column:
    """Punctuation, navigation and boilerplate rules of one line; phrases are looked for where `phrases` holds."""
    size = F.length(line)
    marks = size - F.length(F.translate(line, MARKS, ""))
    words = F.size(F.split(F.trim(line), SPACE + "+"))
    separators = size - F.length(F.translate(line, NAVIGATION, ""))
    punctuation = marks * 10 > size * 3
    navigation = (separators >= 3) & (separators * 3 >= words - separators)
    return punctuation | navigation | (F.lit(phrases) & has_boilerplate(line))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_lost: int = MOST_LOST, clean: bool = False) -> DataFrame:
    """Counts, base verdict and kept flag of every row; with clean=True also clean_text, the surviving lines.

    Words are runs without ASCII white space of the whole text; null texts have none. word_chars: code
    points in words; n_symbols: characters of [#*$%&|<>]; n_dup_lines: lines with a word that equal an
    earlier line; n_repeat_words: words inside 5-word windows found twice or more in the text, the first
    included (windows are compared by a 64-bit hash of their words). base_failed: under 10 words, or over a
    fifth of the words repeated. Lines failing a rule are removed; kept is false if base_failed, or if over
    most_lost percent of the characters of lines with a word were removed. Every row gives one row, repeated
    rows too; other columns are ignored; an empty table gives none. All counts are long.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"))
    # A phrase of a line is one of the text, so lines are searched only in texts that have one.
    rows = rows.withColumn("phrases", has_boilerplate(F.col("text")))
    trimmed = F.regexp_replace("text", rf"^{SPACE}+|{SPACE}+\z", "")
    rows = rows.select(
        "doc_id",
        "phrases",
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    rows = rows.withColumn("h", F.when(F.size("w") >= 5, windows).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("ok", F.filter("lines", lambda x: ~line_fails(x, F.col("phrases"))))
    # Only texts with a repeated window sort their windows; equal neighbours are the repeated ones.
    order = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    rows = rows.withColumn("order", order)
    twice = F.array_sort(F.transform(F.filter("order", lambda x, j: (x["h"] == F.get("order", j - 1)["h"]) | (x["h"] == F.get("order", j + 1)["h"])), lambda x: x["i"]))
    rows = rows.withColumn("at", twice)
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    size = lambda c: F.aggregate(F.transform(c, F.length), F.lit(0), lambda a, x: a + x)
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        size("lines").cast("long").alias("line_chars"),
        size("ok").cast("long").alias("ok_chars"),
        (F.size("lines") - F.size("ok")).cast("long").alias("n_removed_lines"),
        *([F.array_join("ok", "\n").alias("clean_text")] if clean else []),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & ((F.col("line_chars") - F.col("ok_chars")) * 100 <= F.col("line_chars") * most_lost)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_removed_lines", *(["clean_text"] if clean else []))
