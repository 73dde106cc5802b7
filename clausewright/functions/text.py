"""Scalar text functions as Columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"
NUMBER = r"(\d[\d,]*(?:\.\d+)?)"
# Raised and lowered digits, zero-width characters, ligatures, and the folded marks with what they become.
RAISED = "¹²³⁰⁴-⁹₀-₉"
ZERO_WIDTH = "​‌‍⁠﻿"
LIGATURES = "ﬀ-ﬆ"
FOLDS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-"}
DECLINED = ("", "null", "none", "n/a", "na", "nil", "unknown", "not applicable", "-")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers of two characters or more, in order, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1), lambda w: F.length(w) >= 2)


def strip_footnotes(text: Column) -> Column:
    """Raised and lowered digits directly after a digit, bracket, slash or hyphen go."""
    return F.regexp_replace(text, rf"([\d)/\-])[{RAISED}]+", "$1")


def fold_punctuation(text: Column) -> Column:
    return F.replace(F.translate(text, "".join(FOLDS), "".join(FOLDS.values())), F.lit("…"), F.lit("..."))


def normalise(text: Column) -> Column:
    """Footnotes, zero-width characters, soft hyphens, punctuation and hard blanks, in this order.
    The compatibility forms of letters are left to the caller: SQL has no function for them."""
    clean = F.regexp_replace(F.regexp_replace(strip_footnotes(text), f"[{ZERO_WIDTH}]+", ""), "\u00ad", "")
    return F.translate(fold_punctuation(clean), " ", " ")


def numeric_spans(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 1), lambda n: F.replace(n, F.lit(","), F.lit("")))


def slug(term: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(term)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_clause(clause: Column) -> Column:
    """Trimmed, without dots at the ends, lower case; blank is null."""
    c = F.lower(F.regexp_replace(F.trim(clause), r"^\.+|\.+$", ""))
    return F.when(c != "", c)


# The form of a canonical clause id.
CANONICAL = r"^(?:excl\.\d{2}|def\.[a-z][a-z0-9_]{1,38}|(?:[IVX]{1,4}|\d{1,2})(?:\.\d{1,3})*(?:\.[a-z]{1,3})?(?:\.table)?)$"


def canonical_clause(value: Column) -> Column:
    """excl.NN, def.slug, or dotted parts without blanks, letters but roman numbers in lower case; null if it is none."""
    v = F.regexp_replace(F.trim(value), r"\.+$", "")
    excl = F.regexp_extract(v, r"(?i)^(?:code[\s.]*)?excl[\s.]*(\d{1,2})$", 1)
    term = F.when(v.rlike(r"(?i)^def(?:inition)?[.: ]"), F.regexp_extract(v, r"(?i)^(?:def(?:inition)?[\s.:]+)?([A-Za-z][A-Za-z0-9 /&'-]{1,38})$", 1)).otherwise(F.lit(""))
    bare = F.replace(F.regexp_replace(v, r"(?i)^(?:section|sec|clause|cl)[\s.]*", ""), F.lit(" "), F.lit(""))
    parts = F.array_join(F.transform(F.split(bare, r"\."), lambda p: F.when(p.rlike(r"^\p{L}+$") & ~p.rlike("(?i)^[IVX]{1,4}$"), F.lower(p)).otherwise(p)), ".")
    return F.when(excl != "", F.concat(F.lit("excl."), F.lpad(excl, 2, "0"))).when(term != "", F.concat(F.lit("def."), slug(term))).when(parts.rlike(CANONICAL), parts)


def concept_problem(concept: Column, known: Column) -> Column:
    """Null for a concept of the vocabulary `known` (an array); else the members that share its first six letters."""
    start = F.substring(F.element_at(F.split(concept, r"\."), -1), 1, 6)
    return F.when(F.array_contains(known, concept), F.lit(None)).otherwise(F.concat(F.lit("unknown; near: "), F.array_join(F.array_sort(F.filter(known, lambda k: F.contains(k, start))), ", ")))


# Shapes of keys.
KEYS = (r"(AIza[0-9A-Za-z_\-]{2})[0-9A-Za-z_\-]{18,}", r"(sk-[0-9A-Za-z_\-]{3})[0-9A-Za-z_\-]{17,}", r"(AQ\.[0-9A-Za-z_\-]{3})[0-9A-Za-z_\-]{17,}", r"(ghp_[0-9A-Za-z]{2})[0-9A-Za-z]{20,}")


def redact(text: Column) -> Column:
    """Keys of known shapes keep their first six characters."""
    for shape in KEYS:
        text = F.regexp_replace(text, shape, "$1...REDACTED")
    return text


def cap(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def is_declined(answer: Column) -> Column:
    return answer.isNull() | F.regexp_replace(F.lower(F.trim(answer)), r"^\.+|\.+$", "").isin(*DECLINED)


def strip_fence(text: Column) -> Column:
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(text)


def span_key(span: Column) -> Column:
    part = lambda name: F.coalesce(span[name].cast("string"), F.lit(""))
    return F.concat(part("document_id"), F.lit("#"), part("clause_id"), F.lit("@"), part("page"))
