"""SQL shared by the checks: the normal form of texts, built from the Unicode database."""

from __future__ import annotations

import sys
import unicodedata as U
from functools import cache

from ..functions import text as T


@cache
def composed() -> str:
    """values (character, its compatibility decomposition) of all characters that have one of their own."""
    rows = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        whole = U.normalize("NFKD", ch)
        if whole != U.normalize("NFD", ch):
            rows.append("('" + ch + "', '" + whole.replace("'", "''") + "')")
    return ", ".join(rows)


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '([\\d)/\\-])[{T.RAISED}]+', '\\1', 'g'), '[{T.ZERO_WIDTH}{chr(0xAD)}]+', '', 'g')"


def folded(text: str) -> str:
    return f"translate(replace(translate({text}, '{''.join(T.FOLDS)}', '''''''''\"\"\"---'), '…', '...'), '{chr(0xA0)}', ' ')"


def normalised(name: str, source: str) -> str:
    """CTEs that end in name(id, text, nfkc): the normal form of the texts of source(id, text), one row per id,
    and the text after composition only."""
    return f"""{name}_p as materialized (select id, {stripped('text')} as t from {source}), {name}_k(k, v) as (values {composed()}),
    {name}_o as (select id, string_split(t, '') as cs from {name}_p where regexp_matches(t, '[^\\x00-\\x7f]')), {name}_c as (select id, unnest(cs) as ch, generate_subscripts(cs, 1) as pos from {name}_o),
    {name}_n as (select id, nfc_normalize(string_agg(coalesce(v, ch), '' order by pos)) as t from {name}_c left join {name}_k on k = ch group by id),
    {name} as materialized (select p.id, {folded('coalesce(n.t, p.t)')} as text, coalesce(n.t, p.t) as nfkc from {name}_p p left join {name}_n n on n.id = p.id)"""


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '([\\p{{L}}\\p{{N}}]+)', 1), lambda w: length(w) >= 2)"
