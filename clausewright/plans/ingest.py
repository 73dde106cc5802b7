"""Queries of tables, pages, the clause index and the corpus build over the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CANONICAL
from ..operators import clauses as L
from ..operators import documents as D
from ..operators import tables as B
from ..sources.parquet import table
from .corpus import _C, _GRID, _census


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    got = D.table_rows(table(spark, sf, "chunks"), "source_id", "pages", F.col("span.clause_id").alias("clause_id"), F.lit(None).cast("string").alias("caption"))
    return got.withColumnRenamed("chunk_id", "table_id")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return L.page_parts(table(spark, sf, "chunks"))


def context_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).select("table_id", B.context_label(F.col("source_id"), F.col("pages"), F.col("clause_id"), F.col("caption")).alias("label"))


def stitch_class(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).select("table_id", B.stitch_class(F.col("header")).alias("class"))


def caption_header(spark: SparkSession, sf: str) -> DataFrame:
    """The header of every table after a lone caption is replaced by the rows of names below it."""
    got = B.with_recovered_header(_tables(spark, sf))
    return got.select("table_id", "recovered", F.array_join("header", "|").alias("header"), F.size("rows").cast("bigint").alias("n_rows"))


def table_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return B.sentences(_tables(spark, sf)).select("table_id", F.col("ordinal").cast("bigint").alias("ordinal"), "text")


def table_row_groups(spark: SparkSession, sf: str) -> DataFrame:
    return B.row_groups(_tables(spark, sf)).select("table_id", *(F.col(c).cast("bigint").alias(c) for c in ("ordinal", "first_row", "last_row")), "split", F.md5("text").alias("digest"))


def table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return B.table_chunks(t).unionByName(B.table_chunks(t, "row_nl")).select("chunk_id", "table_id", "kind", F.length("text").cast("bigint").alias("chars"))


def extraction_report(spark: SparkSession, sf: str) -> DataFrame:
    return B.extraction_report(_tables(spark, sf))


def serialisation_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Both forms of the tables of each source side by side: chunks, characters, tokens, and the ratio, 0 over nothing."""
    t = _tables(spark, sf)
    both = B.table_chunks(t).unionByName(B.table_chunks(t, "row_nl")).groupBy("source_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"{n}_chunks") for n, k in (("markdown", "table_markdown"), ("row", "table_row_nl"))), *(F.coalesce(F.floor(F.sum(F.when(F.col("kind") == k, F.length("text"))) / 4), F.lit(0)).alias(f"{n}_tokens") for n, k in (("markdown", "table_markdown"), ("row", "table_row_nl")))
    )
    ratio = lambda a, b: F.round(F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), 6)
    return both.select("*", ratio("row_chunks", "markdown_chunks").alias("chunk_ratio"), ratio("row_tokens", "markdown_tokens").alias("token_ratio"))


def clause_index(spark: SparkSession, sf: str) -> DataFrame:
    return L.clause_index(_parts(spark, sf))


def chunk_clause_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("chunk_id is not null and text is not null")
    return c.select("chunk_id", F.array_join(L.chunk_clause_ids(F.col("text"), F.col("span.clause_id")), ",").alias("clause_ids")).dropDuplicates(["chunk_id"])


def _concepts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "golden").where("concept_id is not null").select(F.col("concept_id").alias("concept"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return L.concept_pages(_parts(spark, sf), L.anchors(_concepts(spark, sf)))


def concept_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that name a concept of the evaluation items."""
    return _hits(spark, sf)


def concept_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts of each source beside those of the source that follows it."""
    s = table(spark, sf, "sources").where("superseded_by is not null").select(F.col("id").alias("left_id"), F.col("superseded_by").alias("right_id"))
    got = L.concept_mapping(L.concept_clauses(_hits(spark, sf), clause_index(spark, sf)), s)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return got.select("left_id", "right_id", "concept", *(text(c) for c in ("left_pages", "left_clauses", "right_pages", "right_clauses")))


def page_flags(spark: SparkSession, sf: str) -> DataFrame:
    return L.page_flags(_parts(spark, sf)).select("source_id", "page", "chars", "words", "cid", "replaced", *L.HEADINGS, "has_text", F.round("space_ratio", 6).alias("space_ratio"), "fused", "contaminated", "suspect")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return L.document_flags(L.page_flags(_parts(spark, sf)))


def document_flags(spark: SparkSession, sf: str) -> DataFrame:
    lists = (L.compacted(F.col(c)).alias(c) for c in ("blank_pages", "ligature_pages", "suspect_pages"))
    return _documents(spark, sf).select("source_id", "pages", "chars", "ligatures", "median_chars", *L.HEADINGS, "dominant", *lists)


def document_defects(spark: SparkSession, sf: str) -> DataFrame:
    return L.defects(_documents(spark, sf)).select("source_id", F.col("ordinal").cast("bigint").alias("ordinal"), "defect", "detail")


def blank_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the census without a text layer in any chunk."""
    n = _census(spark, sf)
    every = n.where("n_pages >= 1").select("source_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    return every.join(L.page_flags(_parts(spark, sf)).where("has_text").select("source_id", "page"), ["source_id", "page"], "left_anti")


def locate_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The first five hits of each document, with the heading each stands under."""
    return L.locate(_parts(spark, sf), "waiting period").select("source_id", "page", "chunk_id", F.col("at").cast("bigint").alias("at"), "snippet", "heading")


def chunk_meta(spark: SparkSession, sf: str) -> DataFrame:
    """What the manifest says of the source of each chunk; a chunk of an unknown source has nulls."""
    s = table(spark, sf, "sources").where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("source_id"), "insurer", "product", "effective_from", "effective_to", "superseded_by")
    return table(spark, sf, "chunks").select("chunk_id", "source_id").distinct().join(s, "source_id", "left")


def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    """Prose of the chunks and the tables' row groups as one corpus: chunks and characters per source and kind, and ids that stand twice."""
    prose = table(spark, sf, "chunks").where("chunk_id is not null and source_id is not null and not kind like 'table%'").select("chunk_id", "source_id", "kind", F.length("text").alias("n")).dropDuplicates(["chunk_id"])
    tables = B.table_chunks(_tables(spark, sf).where("source_id is not null")).select("chunk_id", "source_id", "kind", F.length("text").alias("n"))
    both = prose.unionByName(tables)
    twice = both.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit(1).alias("again"))
    return both.join(twice, "chunk_id", "left").groupBy("source_id", "kind").agg(F.count("*").alias("n"), F.sum("n").alias("chars"), F.count("again").alias("twice"))


def orphan_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of tables without a usable header that no prose covers."""
    t = _tables(spark, sf).where(F.size(B.filled(F.col("header"))) == 0).select("source_id", F.explode("pages").alias("page")).distinct()
    prose = table(spark, sf, "chunks").where("not kind like 'table%'").select("source_id", F.explode("pages").alias("page")).distinct()
    return t.join(prose, ["source_id", "page"], "left_anti")


QUERIES = {f.__name__: f for f in (context_labels, stitch_class, caption_header, table_sentences, table_row_groups, table_chunks, extraction_report, serialisation_ratio, clause_index, chunk_clause_ids, concept_pages, concept_mapping, page_flags, document_flags, document_defects, blank_pages, locate_hits, chunk_meta, corpus_build, orphan_pages)}

_FILLED = lambda c: f"list_filter({c}, lambda f: trim(coalesce(f, '')) <> '')"
_LABEL = "concat_ws(', ', source_id, case when len(pages) > 1 then 'pages ' || pages[1] || '-' || pages[-1] when len(pages) = 1 then 'page ' || pages[1] end, 'clause ' || nullif(clause_id, ''))"
_TAB = f"{_GRID}, tt as (select chunk_id as table_id, source_id, pages, span.clause_id as clause_id, header, rows from tb join c using (chunk_id))"
_CLASS = f"case when len({_FILLED('header')}) = 0 then 'spurious' when list_max(list_transform({_FILLED('header')}, lambda x: length(x))) >= 250 then 'spurious' when len({_FILLED('header')}) < 2 then 'caption_header' else 'data_grid' end"


def _recovered(src: str) -> str:
    first = f"coalesce({_FILLED('r')}[1], '')"
    return f"""ld as (select *, case when len({_FILLED('header')}) <= 1 and len(rows) > 0 then coalesce(nullif(list_position(list_transform(rows, lambda r: regexp_matches({first}, '\\d')), true), 0) - 1, len(rows)) else 0 end as lead from {src}),
        rc as (select *, case when lead > 0 then trim({_FILLED('header')}[1]) end as recovered, case when lead > 0 then list_transform(range(1, greatest(len(header), list_max(list_transform(rows[1:lead], lambda r: len(r)))) + 1), lambda i: array_to_string(list_filter(list_transform(rows[1:lead], lambda r: trim(coalesce(r[i], ''))), lambda z: z <> ''), ' ')) else header end as h2, rows[lead + 1:] as r2 from ld)"""


_SENT = f"""{_recovered('(select * from tt where len(' + _FILLED('header') + ') > 0)')}, se as (select table_id, source_id, unnest(r2) as row, generate_subscripts(r2, 1) as k, h2, {_LABEL} || case when recovered is not null and not contains(lower({_LABEL}), lower(recovered)) then ', ' || recovered else '' end as label from rc),
    pr as (select *, list_filter(list_transform(range(1, len(h2) + 1), lambda i: {{'h': trim(coalesce(h2[i], '')), 'v': trim(coalesce(row[i], ''))}}), lambda p: p.v <> '') as p from se),
    sn as (select table_id, source_id, row_number() over (partition by table_id order by k) - 1 as ordinal, '[' || label || '] For ' || case when p[1].h <> '' then p[1].h || ' ' else '' end || p[1].v || case when len(p) > 1 then ': ' || array_to_string(list_transform(p[2:], lambda x: case when x.h <> '' then x.h else 'value' end || ' is ' || x.v), '; ') else '' end || '.' as text from pr where len(p) > 0)"""
_LINE = lambda r: f"'| ' || array_to_string(list_transform(range(1, len(header) + 1), lambda i: replace(coalesce({r}[i], ''), '|', '/')), ' | ') || ' |'"
_HEAD = f"'Table from ' || {_LABEL} || chr(10) || chr(10) || ({_LINE('header')}) || chr(10) || '|' || repeat('---|', len(header))"
_GROUPS = f"""us as (select *, {_HEAD} as head, length({_HEAD}) as bare, list_transform(rows, lambda r: {_LINE('r')}) as li, list_transform(rows, lambda r: length(array_to_string(list_transform(r, lambda y: coalesce(y, '')), ' | ')) + 4) as sz from tt where len({_FILLED('header')}) > 0 and len(rows) > 0),
    wh as (select *, head || chr(10) || array_to_string(li, chr(10)) as whole from us),
    wk as (select table_id, 1 as i, 0 as grp, sz[1] as size from wh union all select wk.table_id, i + 1, case when bare + size + sz[i + 1] > 1400 then grp + 1 else grp end, case when bare + size + sz[i + 1] > 1400 then sz[i + 1] else size + sz[i + 1] end from wk join wh on wh.table_id = wk.table_id where i < len(rows)),
    w2 as (select table_id, source_id, i, head, li[i] as line, length(whole) > 1400 as split, case when length(whole) <= 1400 then 0 else grp end as ordinal from wk join wh using (table_id)),
    gp as (select table_id, any_value(source_id) as source_id, ordinal, min(i) - 1 as first_row, max(i) - 1 as last_row, any_value(split) as split, any_value(head) || chr(10) || string_agg(line, chr(10) order by i) as text from w2 group by table_id, ordinal)"""
_CHUNKS = "(select table_id || case when split then '#g' || ordinal else '#whole' end as chunk_id, table_id, source_id, 'table_markdown' as kind, text from gp union all select table_id || '#r' || ordinal, table_id, source_id, 'table_row_nl', text from sn)"
_PARTS = f"""{_C}, pp as (select source_id, chunk_id, pages[least(i, len(pages))] as page, part as text from (select source_id, chunk_id, pages, unnest(string_split(text, chr(12))) as part, generate_subscripts(string_split(text, chr(12)), 1) as i from c where chunk_id is not null and source_id is not null and text is not null and len(pages) > 0) where pages[least(i, len(pages))] is not null)"""
_SLUG = lambda x: f"regexp_replace(regexp_replace(lower(trim({x}, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_Q = lambda p: p.replace("'", "''")
_INDEX = f"""ln as (select source_id, page, line from (select source_id, page, unnest(string_split(text, chr(10))) as line from pp) where not regexp_matches(line, '(?i){D.PAGE_NUMBER}')),
    mt as (select source_id, page, 'section' as pattern, regexp_extract(line, '{_Q(D.SECTION)}', 1) as raw from ln union all select source_id, page, 'numbered', regexp_extract(line, '{_Q(D.NUMBERED)}', 1) from ln union all select source_id, page, 'definition', regexp_extract(line, '{_Q(D.DEFINITION)}', 1) from ln
      union all select source_id, page, 'excl_code', unnest(regexp_extract_all(text, '{_Q(D.EXCLUSION)}', 1)) from pp union all select source_id, page, 'compound', unnest(list_transform(regexp_extract_all(text, '{_Q(L.COMPOUND)}', 0), lambda x: upper(regexp_extract(x, '{_Q(L.COMPOUND)}', 1)) || '.' || regexp_extract(x, '{_Q(L.COMPOUND)}', 2) || case when regexp_extract(x, '{_Q(L.COMPOUND)}', 3) <> '' then '.' || lower(regexp_extract(x, '{_Q(L.COMPOUND)}', 3)) else '' end)) from pp),
    ci as (select distinct source_id as document_id, case pattern when 'excl_code' then 'excl.' || raw when 'definition' then 'def.' || {_SLUG('raw')} else raw end as clause_id, page, pattern from mt where raw <> '' and regexp_full_match(case pattern when 'excl_code' then 'excl.' || raw when 'definition' then 'def.' || {_SLUG('raw')} else raw end, '{CANONICAL[1:-1]}'))"""
_HITS = "an as (select distinct concept_id as concept, lower(replace(split_part(concept_id, '.', -1), '_', ' ')) as phrase from golden where concept_id is not null), hc as (select distinct source_id as document_id, concept, page from pp join an on contains(lower(pp.text), phrase) where phrase <> '')"
_CNT = lambda ch: f"len(regexp_extract_all(text, '{ch}'))"
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"
_FLAGS = f"""pm as (select source_id, page, length(trim(text, ' ')) as chars, len({_WORDS}) as words, len(list_filter({_WORDS}, lambda w: length(w) > 30)) as long_words, length(text) as len0, {_CNT(' ')} as blanks, {_CNT('\\(cid:\\d+\\)')} as cid, {_CNT('�')} as replaced, {_CNT('[ﬀ-ﬆ]')} as ligatures, {_CNT(chr(0xAD))} as soft_hyphens, {_CNT(chr(0xA0))} as nbsp, {_CNT('[ऀ-ॿ]')} as devanagari,
      {', '.join(f"len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' and length(trim(x, ' ')) <= 120 and regexp_matches(x, '{_Q(p)}'))) as {n}" for n, p in L.HEADINGS.items())} from pp),
    ps as (select source_id, page, {', '.join(f'sum({m})::bigint as {m}' for m in ('chars', 'words', 'long_words', 'len0', 'blanks', 'cid', 'replaced', 'ligatures', 'soft_hyphens', 'nbsp', 'devanagari', *L.HEADINGS))} from pm group by 1, 2),
    pf as (select *, chars >= 80 as has_text, case when len0 > 0 then blanks / len0 else 0 end as space_ratio, chars >= 80 and long_words >= 0.03 * words as fused, ligatures > 0 as contaminated from ps), pg as (select *, has_text and (cid > 0 or replaced > 3 or fused or contaminated) as suspect from pf)"""
_LIST = lambda flag: f"coalesce(list_sort(list(page) filter ({flag})), [])"
_COMPACT = lambda c: f"case when len({c}) = 0 then '-' else array_to_string((list_transform(list_zip(list_filter({c}, lambda p: not list_contains({c}, p - 1)), list_filter({c}, lambda p: not list_contains({c}, p + 1))), lambda z: case when z[1] = z[2] then z[1]::varchar else z[1] || '-' || z[2] end))[1:12], ', ') || case when len(list_filter({c}, lambda p: not list_contains({c}, p - 1))) > 12 then ', +' || (len(list_filter({c}, lambda p: not list_contains({c}, p - 1))) - 12) || ' more' else '' end end"
_DOMINANT = "case greatest(" + ", ".join(L.HEADINGS) + ") when 0 then null " + " ".join(f"when {n} then '{n}'" for n in L.HEADINGS) + " end"
_DOCS = f"""{_PARTS}, {_FLAGS}, dr as (select source_id, count(*) as pages, {', '.join(f'sum({m})::bigint as {m}' for m in ('chars', 'ligatures', 'soft_hyphens', 'devanagari', *L.HEADINGS))}, median(chars) as median_chars, {_LIST('not has_text')} as blank_pages, {_LIST('contaminated')} as ligature_pages, {_LIST('cid > 0')} as cid_pages, {_LIST('fused')} as fused_pages, {_LIST('suspect')} as suspect_pages from pg group by 1),
    dd as (select *, {_DOMINANT} as dominant from dr)"""
_RULES = [("ligatures", "len(ligature_pages) > 0", _COMPACT("ligature_pages")), ("broken_encoding", "len(cid_pages) > 0", _COMPACT("cid_pages")), ("fused_words", "len(fused_pages) > 0", _COMPACT("fused_pages")), ("soft_hyphens", "soft_hyphens > 0", "soft_hyphens::varchar"), ("blank_pages", "len(blank_pages) > 0", _COMPACT("blank_pages")), ("devanagari", "devanagari > 0", "devanagari::varchar"), ("no_headings", "dominant is null", "''")]
_ANYHEAD = " or ".join(f"regexp_matches(h, '{_Q(p)}')" for p in L.HEADINGS.values())
_CENSUS_N = "n as (select source_id, max(pages) as n_pages from probe_report where ok and pages is not null and source_id is not null group by 1)"
ORACLES = {
    "context_labels": f"with {_TAB} select table_id, {_LABEL} as label from tt",
    "stitch_class": f"with {_TAB} select table_id, {_CLASS} as class from tt",
    "caption_header": f"with {_TAB}, {_recovered('tt')} select table_id, recovered, array_to_string(h2, '|') as header, len(r2) as n_rows from rc",
    "table_sentences": f"with {_TAB}, {_SENT} select table_id, ordinal, text from sn",
    "table_row_groups": f"with recursive {_TAB}, {_GROUPS} select table_id, ordinal, first_row, last_row, split, md5(text) as digest from gp",
    "table_chunks": f"with recursive {_TAB}, {_SENT}, {_GROUPS} select chunk_id, table_id, kind, length(text) as chars from {_CHUNKS}",
    "extraction_report": f"with {_TAB}, k as (select *, {_CLASS} as cls from tt) select source_id, count(*) as tables, sum(len(rows))::bigint as n_rows, count(*) filter (len(pages) > 1) as page_spanning, count(*) filter (len({_FILLED('header')}) = 0) as headerless, count(*) filter (cls = 'data_grid') as data_grid, count(*) filter (cls = 'caption_header') as caption_header, count(*) filter (cls = 'spurious') as spurious from k group by 1",
    "serialisation_ratio": f"""with recursive {_TAB}, {_SENT}, {_GROUPS}, b as (select source_id, count(*) filter (kind = 'table_markdown') as markdown_chunks, count(*) filter (kind = 'table_row_nl') as row_chunks, coalesce(sum(length(text)) filter (kind = 'table_markdown'), 0)::bigint // 4 as markdown_tokens, coalesce(sum(length(text)) filter (kind = 'table_row_nl'), 0)::bigint // 4 as row_tokens from {_CHUNKS} group by 1)
        select *, round(case when markdown_chunks = 0 then 0 else row_chunks / markdown_chunks end, 6) as chunk_ratio, round(case when markdown_tokens = 0 then 0 else row_tokens / markdown_tokens end, 6) as token_ratio from b""",
    "clause_index": f"with {_PARTS}, {_INDEX} select * from ci",
    "chunk_clause_ids": f"""with {_C}, m as (select chunk_id, list_concat(list_concat([span.clause_id], list_transform(regexp_extract_all(text, '{_Q(L.COMPOUND)}', 0), lambda x: upper(regexp_extract(x, '{_Q(L.COMPOUND)}', 1)) || '.' || regexp_extract(x, '{_Q(L.COMPOUND)}', 2) || case when regexp_extract(x, '{_Q(L.COMPOUND)}', 3) <> '' then '.' || lower(regexp_extract(x, '{_Q(L.COMPOUND)}', 3)) else '' end)), list_transform(regexp_extract_all(text, '{_Q(D.EXCLUSION)}', 1), lambda x: 'excl.' || x)) as ids, span.clause_id as head from c where chunk_id is not null and text is not null),
        k as (select chunk_id, list_filter(ids, lambda x, i: x is not null and (i = 1 or regexp_full_match(x, '{CANONICAL[1:-1]}'))) as ids from m) select chunk_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') as clause_ids from k""",
    "concept_pages": f"with {_PARTS}, {_HITS} select * from hc",
    "concept_mapping": f"""with {_PARTS}, {_INDEX}, {_HITS}, cc as (select document_id, concept, list_sort(list(distinct hc.page)) as pages, coalesce(list_sort(list(distinct ci.clause_id) filter (ci.clause_id is not null)), []) as clauses from hc left join ci using (document_id, page) group by 1, 2)
        select s.id as left_id, s.superseded_by as right_id, concept, array_to_string(l.pages, ',') as left_pages, array_to_string(l.clauses, ',') as left_clauses, array_to_string(r.pages, ',') as right_pages, array_to_string(r.clauses, ',') as right_clauses from (select distinct id, superseded_by from sources) s join cc l on l.document_id = s.id join cc r on r.document_id = s.superseded_by and r.concept = l.concept""".replace("superseded_by as right_id, concept,", "superseded_by as right_id, l.concept,"),
    "page_flags": f"with {_PARTS}, {_FLAGS} select source_id, page, chars, words, cid, replaced, {', '.join(L.HEADINGS)}, has_text, round(space_ratio, 6) as space_ratio, fused, contaminated, suspect from pg",
    "document_flags": f"with {_DOCS} select source_id, pages, chars, ligatures, median_chars, {', '.join(L.HEADINGS)}, dominant, {', '.join(f'{_COMPACT(p)} as {p}' for p in ('blank_pages', 'ligature_pages', 'suspect_pages'))} from dd",
    "document_defects": f"with {_DOCS}, de as (select source_id, list_filter([{', '.join(f'''case when {w} then {{'defect': '{n}', 'detail': {d}}} end''' for n, w, d in _RULES)}], lambda x: x is not null) as d from dd), d1 as (select source_id, case when len(d) > 0 then d else [{{'defect': 'none', 'detail': ''}}] end as d from de) select source_id, generate_subscripts(d, 1) - 1 as ordinal, unnest(d, recursive := true) from d1",
    "blank_pages": f"with {_PARTS}, {_FLAGS}, {_CENSUS_N} select source_id, page from (select source_id, unnest(range(1, n_pages + 1))::int as page from n) except select source_id, page from pg where has_text",
    "locate_hits": f"""with {_PARTS}, hi as (select *, strpos(lower(text), 'waiting period') as pos from pp), hh as (select source_id, page, chunk_id, pos, substr(text, greatest(pos - 20, 1), 54) as snippet, trim(list_filter(string_split(substr(text, 1, pos - 1), chr(10)), lambda h: {_ANYHEAD})[-1], ' ') as heading, row_number() over (partition by source_id order by page, chunk_id, pos) as rn from hi where pos > 0)
        select source_id, page, chunk_id, pos as "at", snippet, heading from hh where rn <= 5""",
    "chunk_meta": "select distinct chunk_id, c.source_id, s.insurer, s.product, s.effective_from, s.effective_to, s.superseded_by from chunks c left join (select distinct on (id) * from sources) s on s.id = c.source_id",
    "corpus_build": f"""with recursive {_TAB}, {_GROUPS}, b as (select chunk_id, source_id, kind, length(text) as n from c where chunk_id is not null and source_id is not null and kind not like 'table%' union all select table_id || case when split then '#g' || ordinal else '#whole' end, source_id, 'table_markdown', length(text) from gp where source_id is not null), w as (select *, count(*) over (partition by chunk_id) as m from b)
        select source_id, kind, count(*) as n, sum(n)::bigint as chars, count(*) filter (m > 1) as twice from w group by 1, 2""",
    "orphan_pages": f"with {_TAB} select source_id, unnest(pages) as page from tt where len({_FILLED('header')}) = 0 except select source_id, unnest(pages) from chunks where kind not like 'table%'",
}
