"""One normal form for what is indexed and what is asked.

In this order: footnote marks after a figure go, before they could turn into digits; characters that
show nothing and soft hyphens go; compatibility forms are composed (NFKC); quotes and dashes are
folded; hard blanks become blanks. Nothing of this touches a text of ASCII characters, which stays in
the JVM; the others pass through Python once, for all steps, since only Python can compose them.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import FOLDS, LIGATURES, RAISED, ZERO_WIDTH, numeric_spans, strip_footnotes, tokens

FOOTNOTE = re.compile(rf"(?<=[0-9)/\-])[{RAISED}]+")
GONE = re.compile(f"[{ZERO_WIDTH}\u00ad]+")
FOLDED = str.maketrans({**FOLDS, "…": "...", "\u00a0": " "})


def composed(text: str) -> str:
    """A text after composition, its marks and invisible characters gone."""
    return unicodedata.normalize("NFKC", GONE.sub("", FOOTNOTE.sub("", text)))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(composed, na_action="ignore")


@F.pandas_udf(StringType())
def _normalised(s: pd.Series) -> pd.Series:
    return s.map(lambda t: composed(t).translate(FOLDED), na_action="ignore")


def _odd(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7f]")


def stripped(text: Column) -> Column:
    """What goes before characters are composed."""
    return F.regexp_replace(F.regexp_replace(strip_footnotes(text), f"[{ZERO_WIDTH}]+", ""), "­", "")


def normalised(text: Column) -> Column:
    """The normal form. Null stays null, empty stays empty."""
    return F.when(_odd(text), _normalised(F.when(_odd(text), text))).otherwise(text)


def query_form(text: Column) -> Column:
    """The normal form of a question, without outer white space; changed figures are no error here."""
    return F.regexp_replace(normalised(text), r"(?U)^\s+|\s+$", "")


def figures_changed(text: Column) -> Column:
    """Whether the normal form shows other figures than the text: such a text must not be indexed unseen."""
    return F.coalesce(numeric_spans(text) != numeric_spans(normalised(text)), F.lit(False))


def strict(text: Column) -> Column:
    """The normal form, or an error where it would show other figures."""
    return F.when(figures_changed(text), F.raise_error(F.concat(F.lit("figures changed in: "), F.substring(text, 1, 80)))).otherwise(normalised(text))


def change_counts(text: Column) -> dict[str, Column]:
    """How many characters of each kind the normal form changes; sums of them are those of all texts together."""
    t = F.coalesce(text, F.lit(""))
    bare = strip_footnotes(t)
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("bigint")
    return {
        "footnotes": (F.length(t) - F.length(bare)).cast("bigint"), "zero_width": count(bare, f"[{ZERO_WIDTH}]"), "soft_hyphens": count(bare, "­"), "ligatures": count(stripped(t), f"[{LIGATURES}]"),
        "punctuation": count(F.when(_odd(t), _composed(F.when(_odd(t), t))).otherwise(t), f"[{''.join(k for k in FOLDS)}]"), "nbsp": count(t, " "), "chars_in": F.length(t).cast("bigint"), "chars_out": F.length(normalised(t)).cast("bigint"),
    }


def search_tokens(text: Column) -> Column:
    """The tokens of the normal form; the same for documents and questions."""
    return tokens(normalised(text))

