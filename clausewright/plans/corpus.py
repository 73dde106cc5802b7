"""Queries of text functions, documents, tables, the manifest and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalise as Z
from ..functions import text as T
from ..operators import answers as A
from ..operators import documents as D
from ..operators import manifest as M
from ..session import scratch
from ..sources.parquet import table
from ..streaming.limits import run_files
from . import sql as Q
from .evaluation import _A, _C, _SLUG, _T, _canonical, _truths


def _once(spark: SparkSession, sf: str, *made: Column | str) -> DataFrame:
    """What is wanted of every chunk, each chunk once: the columns are made before rows are compared, so
    no text is shuffled unless it is asked for."""
    return table(spark, sf, "chunks").select("chunk_id", *made).dropDuplicates(["chunk_id"])


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "judge_validate").where("answer_id is not null").dropDuplicates(["answer_id"])


def norm_numeric_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, F.array_join(T.numeric_spans(F.col("text")), "|").alias("numbers"))


def norm_full(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of every chunk in the normal form, and whether its figures would change by it."""
    return _once(spark, sf, F.md5(Z.normalised(F.col("text"))).alias("digest"), Z.figures_changed(F.col("text")).alias("figures_changed"))


def norm_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What normalising changes in the texts of each source."""
    made = Z.change_counts(F.col("text"))
    return _once(spark, sf, "source_id", *(c.alias(n) for n, c in made.items())).groupBy("source_id").agg(*(F.sum(n).alias(n) for n in made))


def norm_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "golden").where("id is not null").groupBy("id").agg(F.max("question").alias("question")).select("id", Z.query_form(F.col("question")).alias("question"))


def tokenise_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = Z.search_tokens(F.col("text"))
    return _once(spark, sf, F.size(t).cast("bigint").alias("tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("types"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "kind", F.length("text").alias("n")).groupBy("kind").agg(F.floor(F.sum("n") / 4).alias("tokens"))


def term_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").select("product").distinct().where("product is not null").select("product", T.slug(F.col("product")).alias("slug"))


def clause_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of spans, of lists of ids and of truths, as written and in canonical form."""
    ids = table(spark, sf, "chunks").select(F.explode(F.concat(F.array("span.clause_id"), F.coalesce("meta.clause_ids", F.array().cast("array<string>")))).alias("raw"))
    truths = table(spark, sf, "golden").select(F.explode("ground_truth_spans").alias("s")).select(F.col("s.clause_id").alias("raw"))
    return ids.unionByName(truths).where("raw is not null").distinct().select("raw", T.canonical_clause(F.col("raw")).alias("clause_id"))


def concept_check(spark: SparkSession, sf: str) -> DataFrame:
    """Products of the manifest as concept names, against the vocabulary of the evaluation items, with near misses."""
    known = table(spark, sf, "golden").agg(F.array_sort(F.collect_set("concept_id")).alias("known"))
    asked = table(spark, sf, "sources").where("product is not null").select(T.slug(F.col("product")).alias("concept")).distinct()
    return asked.join(F.broadcast(known)).select("concept", T.concept_problem(F.col("concept"), F.col("known")).alias("problem"))  # one row


def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Every raw output with its keys masked."""
    return _answers(spark, sf).select("answer_id", F.md5(T.redact(F.col("gen_raw"))).alias("digest"))


def quote_cap(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, T.cap(F.col("text")).alias("quote"))


def declined_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).where(T.is_declined(F.col("answer"))).select("answer_id")


def span_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, T.span_key(F.col("span")).alias("key"))


def page_probe(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, *(c.alias(n) for n, c in D.page_measures(F.col("text")).items()))


def document_probe(spark: SparkSession, sf: str) -> DataFrame:
    m = D.page_measures(F.col("text"))
    pages = _once(spark, sf, "source_id", *(c.alias(n) for n, c in m.items())).where("source_id is not null")
    return pages.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.median("chars").alias("median_chars"), F.sum("ligatures").alias("ligatures"), F.sum("soft_hyphens").alias("soft_hyphens"), F.sum("nbsp").alias("nbsp"), F.sum("devanagari").alias("devanagari"), F.count_if(~F.col("has_text")).alias("without_text"))


def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return D.page_ranges(table(spark, sf, "chunks").where("source_id is not null").select("source_id", F.explode("pages").alias("page")), "source_id", "page")


def heading_totals(spark: SparkSession, sf: str) -> DataFrame:
    latest = table(spark, sf, "probe_report").where("ok and source_id is not null").groupBy("source_id").agg(F.max_by("heading_totals", F.struct("probed_at", "probe_id")).alias("m"))
    return latest.select(F.explode("m").alias("pattern", "n")).groupBy("pattern").agg(F.sum("n").alias("hits"))


def locate_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """The first hit of a phrase per chunk, with its surroundings."""
    at = F.locate("waiting period", F.lower("text"))
    return table(spark, sf, "chunks").withColumn("at", at).where("at > 0").select("chunk_id", F.col("at").cast("bigint").alias("at"), F.expr("substring(text, greatest(at - 20, 1), 60)").alias("snippet")).dropDuplicates(["chunk_id"])


def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    return D.running_lines(D.lines(table(spark, sf, "chunks")).where("source_id is not null and page is not null"), 3, 0.1)


def clause_ids_on_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.lines(table(spark, sf, "chunks")).select("chunk_id", "line_no", F.regexp_extract("line", D.NUMBERED, 1).alias("numbered"), F.regexp_extract("line", D.DEFINITION, 1).alias("definition"))
    return rows.where("numbered <> '' or definition <> ''").select("chunk_id", F.col("line_no").cast("bigint").alias("line_no"), "numbered", "definition")


def clause_chunks(spark: SparkSession, sf: str) -> DataFrame:
    got = D.clause_chunks(table(spark, sf, "documents"), "doc_id", "text")
    return got.withColumn("section_path", F.array_join("section_path", ">"))


def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return D.table_rows(table(spark, sf, "chunks")).select("chunk_id", D.markdown(F.col("header"), F.col("rows")).alias("text"))


def table_row_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table_rows(table(spark, sf, "chunks")).select("chunk_id", "header", F.posexplode("rows").alias("row", "cells"))
    return rows.select("chunk_id", F.col("row").cast("bigint").alias("row"), D.row_sentences(F.col("header"), F.col("cells")).alias("sentence"))


def table_stitch(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as fragments on consecutive pages; the quantity decides where a fragment ends and starts."""
    li = table(spark, sf, "lineitem")
    frag = li.select(
        F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("page"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("index_on_page"), (F.col("l_quantity") * 6).alias("y0"), (842 - F.col("l_tax") * 2000).alias("y1"), F.lit(842.0).alias("page_height"),
        F.array(F.lit(50.0), F.lit(300.0) + F.col("l_discount") * 300).alias("col_xs"), F.array("l_returnflag", "l_linestatus").alias("header"), F.array(F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("rows"),
    )
    return D.stitch(frag).select("source_id", "table_no", F.col("fragments").cast("bigint").alias("fragments"), F.size("rows").cast("bigint").alias("n_rows"))


def build_report(spark: SparkSession, sf: str) -> DataFrame:
    n = _once(spark, sf, "kind", F.length("text").alias("size"))
    return n.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("chars"), F.round(F.avg(F.col("size").cast("double")), 1).alias("mean_chars"), F.count_if(F.col("size") > 1200).alias("oversize"))


def _census(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "probe_report").where("ok and pages is not null and source_id is not null").groupBy("source_id").agg(F.max("pages").alias("n_pages"))


def uncovered_pages(spark: SparkSession, sf: str) -> DataFrame:
    return M.uncovered_pages(table(spark, sf, "chunks"), _census(spark, sf))


def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources")
    return M.source_rules(s).unionByName(M.graph_rules(s))


def superseded_ids(spark: SparkSession, sf: str) -> DataFrame:
    return M.superseded_ids(table(spark, sf, "sources"))


def resolve_spans(spark: SparkSession, sf: str) -> DataFrame:
    clauses = table(spark, sf, "chunks").where("span.clause_id is not null").select("span.document_id", "span.clause_id", "span.page").distinct()
    return M.resolve_spans(_truths(spark, sf), clauses, _census(spark, sf)).select("item_id", F.col("truth_idx").cast("bigint").alias("truth_idx"), "severity", "rule")


def run_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "ANSWER").alias("answered"), F.round(F.sum("wall_gen_s"), 4).alias("seconds"))


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items that are still to be answered: the latest row of an item counts."""
    latest = table(spark, sf, "judge_validate").where("id is not null").groupBy("id").agg(F.max_by("outcome", F.struct("judged_at", "answer_id")).alias("outcome"))
    return table(spark, sf, "golden").where("id is not null").select("id").distinct().join(latest.where("outcome = 'ANSWER'"), "id", "left_anti")


def rate_limit_window(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the user in the last hour, this one included."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-3600, 0)
    return e.select("event_id", F.count("*").over(w).alias("n"))


def rate_limit_accept(spark: SparkSession, sf: str) -> DataFrame:
    return A.rate_limit(table(spark, sf, "events"), most=2, seconds=3600)


def rate_limit_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same decisions from a stream: the calls as four files in the order of time, a batch each."""
    e = table(spark, sf, "events").where("user_id is not null and ts is not null").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    folder = scratch(spark, "calls")
    width = (ends["b"] - ends["a"]) / 4 if ends["a"] is not None else None
    for i in range(4 if width is not None else 1):
        part = e if width is None else e.where((F.col("ts") >= F.lit(ends["a"] + i * width)) & ((F.col("ts") < F.lit(ends["a"] + (i + 1) * width)) | F.lit(i == 3)))
        part.coalesce(1).write.mode("append").parquet(folder)
    return run_files(spark, folder, "event_id bigint, user_id bigint, ts timestamp", 2, 3600)


def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 9).select(F.col("id").alias("attempt"), F.least(F.lit(90.0), 0.25 * F.pow(F.lit(2.0), F.col("id") - 1)).alias("wait_s"))


_NAMES = ["norm_numeric_spans", "norm_full", "norm_changes", "norm_questions", "tokenise_counts", "token_estimate", "term_slug", "clause_canonical", "concept_check", "redact_secrets", "quote_cap", "declined_answers", "span_keys", "page_probe", "document_probe", "page_ranges", "heading_totals", "locate_phrase", "running_lines", "clause_ids_on_line", "clause_chunks", "table_markdown", "table_row_sentences", "table_stitch", "build_report", "uncovered_pages", "manifest_violations", "superseded_ids", "resolve_spans", "run_log_summary", "resume_antijoin", "rate_limit_window", "rate_limit_accept", "rate_limit_streamed", "retry_schedule"]
QUERIES = {n: globals()[n] for n in _NAMES}
_L = f"{_C}, l as (select chunk_id, source_id, span.page as page, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from c)"
_N = lambda ch: f"length(regexp_replace(coalesce(text, ''), '[^{ch}]', '', 'g'))"
_PROBE = f"length(coalesce(text, '')) as chars, {_N('ﬀ-ﬆ')} as ligatures, {_N(chr(0xAD))} as soft_hyphens, {_N(chr(0xA0))} as nbsp, {_N('ऀ-ॿ')} as devanagari, {_N(chr(0xFFFD))} as replaced, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') as w, length(trim(coalesce(text, ''), ' ')) >= 80 as has_text"
_CENSUS = "n as (select source_id, max(pages) as n_pages from probe_report where ok and pages is not null and source_id is not null group by 1)"
_DECLINED = "(answer is null or regexp_replace(lower(trim(answer, ' ')), '^\\.+|\\.+$', '', 'g') in ('', 'null', 'none', 'n/a', 'na', 'nil', 'unknown', 'not applicable', '-'))"
_GRID = f"{_C}, gr as (select chunk_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x, ' '), '|') and not regexp_full_match(x, '[\\s|:-]+')), lambda x: list_transform(string_split(regexp_replace(trim(x, ' '), '^\\||\\|$', '', 'g'), '|'), lambda y: trim(y, ' '))) as g from c where chunk_id is not null and kind = 'table_markdown'), tb as (select chunk_id, g[1] as header, g[2:] as rows from gr where len(g) > 0)"
_NUMS = lambda t: f"list_transform(regexp_extract_all(coalesce({t}, ''), '(\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda n: replace(n, ',', ''))"
_NORMED = f"src as (select chunk_id as id, any_value(text) as text from chunks where chunk_id is not null group by 1), {Q.normalised('nt', 'src')}"
_TXT = "coalesce(src.text, '')"
_BARE = f"regexp_replace({_TXT}, '([\\d)/\\-])[{T.RAISED}]+', '\\1', 'g')"
_LEN = lambda t, ch: f"(length({t}) - length(regexp_replace({t}, '[{ch}]', '', 'g')))"
_CHANGES = {
    "footnotes": f"length({_TXT}) - length({_BARE})", "zero_width": _LEN(_BARE, T.ZERO_WIDTH), "soft_hyphens": _LEN(_BARE, chr(0xAD)), "ligatures": _LEN(Q.stripped(_TXT), T.LIGATURES), "punctuation": _LEN("coalesce(nt.nfkc, '')", "".join(T.FOLDS)), "nbsp": _LEN(_TXT, chr(0xA0)), "chars_in": f"length({_TXT})", "chars_out": "length(coalesce(nt.text, ''))",
}


_KEPT = "list_filter(kept, lambda k: k > t - 3600)"
_ACCEPTED = f"""with recursive e as (select event_id, user_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events where user_id is not null and ts is not null),
    w as (select user_id, rn, event_id, true as accepted, [t] as kept from e where rn = 1 union all select e.user_id, e.rn, e.event_id, len({_KEPT}) < 2, case when len({_KEPT}) < 2 then list_append({_KEPT}, t) else {_KEPT} end from w join e on e.user_id = w.user_id and e.rn = w.rn + 1) select event_id, accepted from w"""


def _mask(text: str) -> str:
    for shape in T.KEYS:
        text = f"regexp_replace({text}, '{shape}', '\\1...REDACTED', 'g')"
    return text


ORACLES = {
    "norm_numeric_spans": f"with {_C} select chunk_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '(\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda n: replace(n, ',', '')), '|') as numbers from c",
    "tokenise_counts": f"with {_NORMED}, k as (select id as chunk_id, {Q.tokens('text')} as tk from nt) select chunk_id, len(tk) as tokens, len(list_distinct(tk)) as types from k",
    "norm_full": f"with {_NORMED} select id as chunk_id, md5(nt.text) as digest, coalesce({_NUMS('src.text')} <> {_NUMS('nt.text')}, false) as figures_changed from nt join src using (id)",
    "norm_changes": f"with {_NORMED}, {_C} select c.source_id, {', '.join(f'sum({x})::bigint as {n}' for n, x in _CHANGES.items())} from nt join src using (id) join c on c.chunk_id = id group by 1",
    "norm_questions": f"with {Q.normalised('nt', '(select id, max(question) as text from golden where id is not null group by 1)')} select id, regexp_replace(text, '^[\\s\x0b\x0c\x85\xa0]+|[\\s\x0b\x0c\x85\xa0]+$', '', 'g') as question from nt",
    "clause_canonical": f"with r as (select distinct unnest(list_concat([span.clause_id], coalesce(meta.clause_ids, []))) as raw from chunks union select distinct s.clause_id from (select unnest(ground_truth_spans) as s from golden)) select raw, {_canonical('raw')} as clause_id from r where raw is not null",
    "concept_check": f"with k as (select list_sort(list(distinct concept_id) filter (concept_id is not null)) as known from golden), a as (select distinct {_SLUG('product')} as concept from sources where product is not null) select concept, case when not list_contains(known, concept) then 'unknown; near: ' || array_to_string(list_filter(known, lambda n: contains(n, substr(concept, 1, 6))), ', ') end as problem from a cross join k",
    "redact_secrets": f"with {_A} select answer_id, md5({_mask('gen_raw')}) as digest from a",
    "token_estimate": f"with {_C} select kind, sum(length(text))::bigint // 4 as tokens from c group by 1",
    "term_slug": "select distinct product, regexp_replace(regexp_replace(lower(trim(product, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from sources where product is not null",
    "quote_cap": f"with {_C} select chunk_id, case when length(text) > 300 then substr(text, 1, 300) || '…' else text end as quote from c",
    "declined_answers": f"with {_A} select answer_id from a where {_DECLINED}",
    "span_keys": f"with {_C} select chunk_id, coalesce(span.document_id, '') || '#' || coalesce(span.clause_id, '') || '@' || coalesce(span.page::varchar, '') as key from c",
    "page_probe": f"with {_C}, p as (select chunk_id, {_PROBE} from c) select chunk_id, chars, len(w) as words, has_text, case when len(w) > 0 then len(list_filter(w, lambda x: length(x) > 30)) / len(w) >= 0.03 else false end as fused, ligatures, soft_hyphens, nbsp, devanagari, replaced from p",
    "document_probe": f"with {_C}, p as (select source_id, {_PROBE} from c where source_id is not null) select source_id, count(*) as n, sum(chars)::bigint as chars, median(chars) as median_chars, sum(ligatures)::bigint as ligatures, sum(soft_hyphens)::bigint as soft_hyphens, sum(nbsp)::bigint as nbsp, sum(devanagari)::bigint as devanagari, count(*) filter (not has_text) as without_text from p group by 1",
    "page_ranges": "with o as (select distinct source_id, unnest(pages) as p from chunks where source_id is not null), i as (select *, p - row_number() over (partition by source_id order by p) as g from o where p is not null), r as (select source_id, min(p) as a, max(p) as b from i group by source_id, g) select source_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from r group by 1",
    "heading_totals": "with m as (select source_id, arg_max(heading_totals, row(probed_at, probe_id)) as m from probe_report where ok and source_id is not null group by 1), e as (select unnest(map_entries(m)) as e from m) select e.key as pattern, sum(e.value)::bigint as hits from e group by 1",
    "locate_phrase": f"with {_C}, p as (select chunk_id, text, strpos(lower(text), 'waiting period') as pos from c) select chunk_id, pos as \"at\", substr(text, greatest(pos - 20, 1), 60) as snippet from p where pos > 0",
    "running_lines": f"with {_L}, k as (select * from l where source_id is not null and page is not null), n as (select source_id, count(distinct page) as pages from k group by 1), s as (select source_id, trim(line, ' ') as line, count(distinct page) as n from k where trim(line, ' ') <> '' group by 1, 2) select source_id, line, s.n from s join n using (source_id) where s.n >= greatest(3, floor(pages * 0.1))",
    "clause_ids_on_line": f"with {_L}, p as (select chunk_id, line_no, regexp_extract(line, '^\\s{{0,8}}(\\d{{1,2}}(?:\\.\\d{{1,3}}){{0,3}})[\\.\\)]\\s', 1) as numbered, regexp_extract(line, '^\\s{{0,6}}([A-Z][A-Za-z][A-Za-z /&''-]{{1,38}}):\\s', 1) as definition from l where chunk_id is not null) select * from p where numbered <> '' or definition <> ''",
    "table_markdown": f"with {_GRID}, ln as (select chunk_id, header, list_transform(list_concat([header], rows), lambda r: '| ' || array_to_string(list_transform(list_concat(r, list_transform(range(greatest(len(header) - len(r), 0)), lambda z: '')), lambda y: replace(y, '|', '/')), ' | ') || ' |') as a from tb) select chunk_id, array_to_string(list_concat([a[1], '|' || repeat(' --- |', len(header))], a[2:]), chr(10)) as text from ln",
    "table_row_sentences": f"with {_GRID}, ex as (select chunk_id, header, unnest(rows) as cells, generate_subscripts(rows, 1) - 1 as row from tb) select chunk_id, row, 'For ' || header[1] || ' ' || cells[1] || ': ' || array_to_string(list_transform(list_filter(range(2, greatest(len(header), len(cells)) + 1), lambda i: coalesce(cells[i], '') <> ''), lambda i: coalesce(header[i], '') || ' is ' || cells[i]), '; ') as sentence from ex",
    "table_stitch": """with f as (select l_orderkey as source_id, l_linenumber as page, l_quantity * 6 as y0, 842 - l_tax * 2000 as y1, 300 + l_discount * 300 as x, l_returnflag || l_linestatus as h, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ix from lineitem),
        m as (select *, case when page = lag(page) over w + 1 and lag(y1) over w >= 752 and y0 <= 140 and abs(x - lag(x) over w) <= 24 then 0 else 1 end as new from f window w as (partition by source_id order by ix)), n as (select *, sum(new) over (partition by source_id order by ix) as table_no from m),
        k as (select *, first_value(h) over (partition by source_id, table_no order by ix) as h0 from n) select source_id, table_no::bigint as table_no, count(*) as fragments, (count(*) + count(*) filter (h <> h0)) as n_rows from k group by 1, 2""",
    "build_report": f"with {_C} select kind, count(*) as n, sum(length(text))::bigint as chars, round(avg(length(text)), 1) as mean_chars, count(*) filter (length(text) > 1200) as oversize from c group by 1",
    "uncovered_pages": f"with {_CENSUS} select source_id, page from (select source_id, unnest(range(1, n_pages + 1))::int as page from n) except select source_id, unnest(pages) from chunks",
    "manifest_violations": """with r as (select id, unnest([case when authority_rank not between 1 and 3 then 'rank_range' end, case when superseded_by = id or list_contains(supersedes, id) then 'self_supersession' end, case when kind = 'brochure' then 'brochure' end, case when kind = 'adversarial_fixture' and authority_rank <> 3 then 'fixture_rank' end, case when superseded_by is not null and effective_to is null then 'superseded_without_end' end, case when effective_from > effective_to then 'period_reversed' end]) as rule from sources)
        select * from r where rule is not null union all select id, 'duplicate_id' from sources group by 1 having count(*) > 1 union all select distinct id, rule from (select id, 'superseded_by_unknown' as rule, superseded_by as t from sources union all select id, 'supersedes_unknown', unnest(supersedes) from sources union all select id, 'parent_unknown', parent_document_id from sources) where t is not null and t not in (select id from sources)""",
    "superseded_ids": "select id from sources where superseded_by is not null union select unnest(supersedes) from sources",
    "resolve_spans": f"""with {_T}, {_CENSUS}, cl as (select span.document_id as document_id, span.clause_id as clause_id, list(distinct span.page) filter (span.page is not null) as pg from chunks where span.clause_id is not null group by 1, 2),
        b as (select item_id, truth_idx, case when n_pages is null then 'ERROR:unknown_document' when page > n_pages then 'ERROR:page_beyond_end' when t.clause_id is null then 'WARN:no_clause' when cl.clause_id is null and regexp_matches(t.clause_id, '^(excl|def)[.]') then 'UNVERIFIABLE:clause_absent' when cl.clause_id is null then 'ERROR:clause_absent' when page is not null and not list_contains(coalesce(pg, []), page) then 'ERROR:clause_elsewhere' when len(pg) > 3 then 'UNVERIFIABLE:ambiguous' end as f
        from t left join n on n.source_id = t.document_id left join cl on cl.document_id = t.document_id and cl.clause_id = t.clause_id) select item_id, truth_idx, split_part(f, ':', 1) as severity, split_part(f, ':', 2) as rule from b where f is not null""",
    "run_log_summary": f"with {_A} select run_id, count(*) as n, count(*) filter (outcome = 'ANSWER') as answered, round(sum(wall_gen_s), 4) as seconds from a group by 1",
    "resume_antijoin": "with l as (select id, arg_max(outcome, row(judged_at, answer_id)) as o from judge_validate where id is not null group by 1) select distinct id from golden where id is not null and id not in (select id from l where o = 'ANSWER')",
    "rate_limit_window": "select event_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts)) range between 3600 preceding and current row) as n from events",
    "rate_limit_accept": _ACCEPTED,
    "rate_limit_streamed": _ACCEPTED,
    "retry_schedule": "select a as attempt, least(90.0, 0.25 * pow(2, a - 1))::double as wait_s from range(1, 9) t(a)",
}
