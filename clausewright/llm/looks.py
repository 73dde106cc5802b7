"""One form for texts that look the same (problem 2).

A character is stable if it stands for itself in the common form. Texts made of stable characters
only are passed through; in the others each unstable segment is cut out together with the starter
before it (a combining mark acts on that starter), brought to the common form and spliced back.

The form: no invisible characters, one blank for every kind of blank, plain width, letters of a
ligature apart, accents composed, look-alike letters of Greek and Cyrillic as Latin letters.
What a reader can see stays: case, accents, punctuation, raised and lowered figures, fractions,
digits, line breaks. A joiner stays where it changes the shape (after a virama, in Arabic, in emoji).
"""

from __future__ import annotations

import re
import sys
import unicodedata as U
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters of other alphabets with the shape of a Latin letter, and that letter.
ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "Ϲ": "C", "ϲ": "c", "ϳ": "j", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i",
    "Օ": "O", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "Ս": "U", "Տ": "S",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮜ": "U", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲥ": "c", "ⲣ": "p",
}
# Kinds of blank, line ends, and characters that show nothing besides those of category Cf.
BLANKS = "\t               　"
LINE_ENDS = "\u000b\u0085  "
HIDDEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
JOINERS = "‌‍"
VISIBLE_CF = "؀؁؂؃؄؅۝܏࣢"
BEYOND = re.compile("[\U00010000-\U0010ffff]")
PARTNERS = 10_000  # texts of one form that a task holds against those that look for them
PLAIN_TAGS = ("<wide>", "<narrow>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")


def _single(ch: str) -> str | None:
    """What one character becomes, or None if only composition can change it."""
    if ch in BLANKS:
        return " "
    if ch in LINE_ENDS:
        return "\n"
    if ch in "\n\f\r":
        return None
    kind = U.category(ch)
    if ch in HIDDEN or (kind in ("Cf", "Cc") and ch not in VISIBLE_CF and ch not in JOINERS) or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    parts = U.decomposition(ch).split()
    if parts and parts[0] in PLAIN_TAGS and ch != "ſ" and parts[1:2] != ["0020"]:
        out = "".join(chr(int(x, 16)) for x in parts[1:])
        return "".join(_single(c) if _single(c) is not None else c for c in out)
    return ALIKE.get(ch)


@cache
def rules() -> tuple[dict[int, str], dict[bool, tuple[re.Pattern[str], re.Pattern[str]]]]:
    """The map of single characters; and, for texts with and without characters beyond the basic
    plane, the pattern of one unstable character and that of a segment. A class within the basic
    plane is a bitmap for the regex engine, one beyond it a list of ranges, which is slow.
    Built from the Unicode database once per worker."""
    table: dict[int, str] = {}
    unstable: list[int] = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2FFFF and not 0x2F800 <= cp <= 0x2FA1F or 0x30000 <= cp <= 0xDFFFF or cp >= 0xF0000 or 0xD800 <= cp <= 0xF8FF:
            continue
        ch = chr(cp)
        kind = U.category(ch)
        if kind == "Cn":
            continue
        to = _single(ch)
        if to is not None:
            table[cp] = to
        nfd = U.normalize("NFD", ch)
        if to is not None or ch in JOINERS or U.combining(ch) or kind[0] == "M" or U.normalize("NFC", ch) != ch or any(c in ALIKE for c in nfd) or 0x1100 <= cp <= 0x11FF:
            unstable.append(cp)
    for cp in [*range(9), 9, 11, 13, *range(14, 32), 127]:
        unstable.append(cp)
        if cp != 13:
            table[cp] = _single(chr(cp)) or ""
    patterns = {}
    for wide in (False, True):
        spans: list[list[int]] = []
        for cp in sorted(c for c in unstable if wide or c < 0x10000):
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
        cls = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"
        patterns[wide] = (re.compile(cls), re.compile(f"(?s).?{cls}+(?:\n)?"))
    return table, patterns


def _keeps_joiner(before: str) -> bool:
    return bool(before) and (U.combining(before) == 9 or "؀" <= before <= "ࣿ" or U.category(before) in ("So", "Sk"))


def _segment(m: re.Match[str]) -> str:
    table = rules()[0]
    s = m[0]
    if "‌" in s or "‍" in s:
        s = "".join(c for i, c in enumerate(s) if c not in JOINERS or _keeps_joiner(s[i - 1] if i else ""))
    # a joiner or mark may hide between letter and accent: drop and map first, then compose
    s = U.normalize("NFD", s.replace("\r\n", "\n").replace("\r", "\n").translate(table)).translate(table)
    return U.normalize("NFC", s)


def common_form(text: str | None) -> str | None:
    """The common form of a text; null stays null, empty stays empty. Applying it twice changes nothing."""
    if text is None:
        return None
    one, segment = rules()[1][bool(BEYOND.search(text))]
    if not one.search(text):
        return text
    while (out := segment.sub(_segment, text)) != text:  # a removed character can bring a letter and its accent together
        text = out
    return text


def common_form_col(c: Column) -> Column:
    """Only texts with a character outside printable ASCII and line feed go through Python."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(common_form, na_action="ignore")

    odd = c.rlike(r"[^\n\f -~]")
    return F.when(odd, fold(F.when(odd, c))).otherwise(c)


def same_looks(chunks: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b): chunks whose texts differ as strings and are equal in the common form.

    Null ids and null texts take no part; a repeated row counts once. In every pair at least one
    text differs from its form, so only those texts look for partners, and only their forms are met.
    Texts are read and brought to the form once, into hashes (96 bits of the form, 128 of the text).
    The partners of a form are spread over as many tasks as their number asks for; the texts that look
    for them are repeated for each."""
    forms = chunks.where("chunk_id is not null and text is not null").select("chunk_id", "text", common_form_col(F.col("text")).alias("form"))
    keyed = cut(forms.select("chunk_id", F.xxhash64("form").alias("k1"), F.hash("form").alias("k2"), F.md5("text").alias("raw"), (F.col("text") != F.col("form")).alias("changed")).distinct())
    form = ["k1", "k2"]
    met = keyed.join(keyed.where("changed").select(*form).distinct(), form, "left_semi")
    sizes = met.groupBy(*form).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("tasks"))
    left = keyed.where("changed").join(sizes, form).select(*form, F.col("chunk_id").alias("x"), F.col("raw").alias("xr"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))
    right = met.join(sizes, form).select(*form, F.col("chunk_id").alias("y"), F.col("raw").alias("yr"), F.pmod(F.xxhash64("chunk_id"), F.col("tasks")).cast("int").alias("salt"))
    both = left.join(right, [*form, "salt"]).where("xr <> yr and x <> y")
    return both.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def form_report(chunks: DataFrame) -> DataFrame:
    """Every chunk's text in the common form, with the counts that probe reports keep of it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return chunks.select(
        "chunk_id", "source_id", common_form_col(F.col("text")).alias("form"),
        F.regexp_count(t, F.lit(" ")).alias("nbsp_chars"), F.regexp_count(t, F.lit("[ﬀ-ﬆ]")).alias("ligature_chars"), F.regexp_count(t, F.lit("­")).alias("soft_hyphens"),
    ).distinct()
