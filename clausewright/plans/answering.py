"""Queries of answering: raw outputs, citations against retrieved passages, decisions, prompts, floors of the measures, resolution."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import evaluation as E
from ..operators import manifest as M
from ..operators import runs as N
from ..operators.pipeline import answered
from ..operators.retrievers import LexicalRetriever
from ..session import ship
from ..sources.parquet import table
from .corpus import _CENSUS, _DECLINED, _answers, _census
from .evaluation import ORACLES as _EVALUATION
from .evaluation import _A, _C, _T, _golden, _ranked, _ratings, _truths, golden_violations
from .ingest import _HITS, _PARTS, _hits
from .runs import ORACLES as _RUNS
from .runs import _CHECK_SQL, _items, _passages


def _given(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("answer_id", F.col("id").alias("item_id"), "run_id", "answer", "citations", "declined", "gen_raw")


def raw_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Every raw output with how it could be read, and what it says where it could."""
    p = A.parsed(F.col("gen_raw"))
    return _given(spark, sf).select("answer_id", A.parse_status(F.col("gen_raw")).alias("status"), F.lower(p["can_answer"]).alias("can_answer"), F.array_join(p["citations"], ",").alias("citations"))


def citation_verify(spark: SparkSession, sf: str) -> DataFrame:
    return A.verified(_given(spark, sf), _passages(spark, sf))


def answer_decision(spark: SparkSession, sf: str) -> DataFrame:
    """The ladder over the retrieved passages, the state of the raw output, the citations and the answer."""
    g = _given(spark, sf)
    v = A.verified(g, _passages(spark, sf))
    error = F.when(A.parse_status(F.col("gen_raw")).isin("broken", "other"), "malformed")
    said = F.when(~F.coalesce("declined", F.lit(False)), F.col("answer"))
    return g.join(v, "answer_id").select("answer_id", A.outcome(F.col("candidates"), error, F.col("unfounded"), said).alias("decision"))


def judge_abstain(spark: SparkSession, sf: str) -> DataFrame:
    args = (F.col("judge_parsed"), F.col("judge_responsive"), F.col("judge_support"))
    return _answers(spark, sf).select("answer_id", A.judge_abstains(*args).alias("abstains"), A.judge_abstains_strict(*args).alias("strict"))


def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    """What the tokens of each run would cost under every model of the price list."""
    prices = spark.createDataFrame(A.PRICES, "model string, i string, o string").select("model", F.col("i").cast("decimal(18,6)").alias("in_rate"), F.col("o").cast("decimal(18,6)").alias("out_rate"))
    used = _given(spark, sf).groupBy("run_id").agg(F.sum(F.floor(F.length(F.coalesce("gen_raw", F.lit(""))) / 4)).alias("input"), F.sum(F.floor(F.length(F.coalesce("answer", F.lit(""))) / 4)).alias("output"))
    each = used.select("run_id", "input", "output", F.explode(F.array(*(F.lit(m) for m, _, _ in A.PRICES))).alias("name"))
    keyed = each.select(F.concat_ws("/", "run_id", "name").alias("model"), "input", "output", "name")
    named = keyed.select("model", "name").distinct().join(prices.withColumnRenamed("model", "name"), "name").select("model", "in_rate", "out_rate")
    return A.costs(keyed, named).select("model", "input", "output", F.col("usd").cast("double").alias("usd"))


def _full_passages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("chunk_id is not null").select("chunk_id", F.col("span.page").alias("page"), "text")
    p = _passages(spark, sf)
    wanted = c.join(p.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    return p.join(wanted, "chunk_id")


def prompt_assembly(spark: SparkSession, sf: str) -> DataFrame:
    made = A.prompts(_full_passages(spark, sf), _items(spark, sf).where("question is not null").select("item_id", "question"))
    return made.select("item_id", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("digest"))


def ask_response(spark: SparkSession, sf: str) -> DataFrame:
    """What an asker is shown of each answer: its citations with their place and a quote of at most 300 characters."""
    cites = _given(spark, sf).select("answer_id", "item_id", F.explode("citations").alias("rank")).distinct()
    shown = cites.join(_full_passages(spark, sf), ["item_id", "rank"])
    return shown.select("answer_id", "rank", "chunk_id", "document_id", "page", T.cap(F.col("text")).alias("quote"))


def engine_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The engines without a model over all items. The passages carry no score that counts as confidence."""
    items = _items(spark, sf)
    best = _passages(spark, sf).select("item_id", "rank", F.lit(0.0).alias("confidence"))
    return A.engine(items, "null").unionByName(A.engine(items, "echo")).unionByName(A.engine(items, "retrieval", best)).select("item_id", "engine", "abstained", "reason", F.md5("answer").alias("answer"), "confidence")


def floor_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """The measures of the engines that bracket the scale: one withholds all, one answers all without a citation."""
    items = _items(spark, sf)
    both = A.engine(items, "null").unionByName(A.engine(items, "echo"))
    results = both.select(F.concat_ws("/", "engine", "item_id").alias("result_id"), F.col("engine").alias("run_id"), "item_id", "abstained", "answer", F.array().cast("array<int>").alias("citations"), F.lit(0.0).alias("wall_ms"), F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"))
    none = spark.createDataFrame([], "query_id string, id string, score double, rank int")  # nothing is retrieved
    scores = E.ranking_scores(items.select("item_id"), _ranked(spark, sf, none), _truths(spark, sf))
    got = N.aggregates(N.verdicts(N.behaviour(items, results, _passages(spark, sf, none)), scores)).where("slice = 'all'")
    return got.select("run_id", "n_items", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg", "hit_rate", "abstain_recall", "false_abstention_rate", "unsupported_answer_rate", "injection_resistance")), F.col("expected_cost").cast("bigint").alias("expected_cost"))


def _first_line(prompts: list[str]) -> list[str]:
    """A provider without a model: the first line of the first passage as the answer, cited."""
    out = []
    for p in prompts:
        body = p.split(">>>\n[1] ", 1)[1].split("\n<<<END PASSAGE 1>>>", 1)[0]
        out.append(json.dumps({"answer": body.split("\n")[0].strip(), "citations": [1, 1], "reasoning": ""}))
    return out


def pipeline_answers(spark: SparkSession, sf: str) -> DataFrame:
    """All items through the stages, with BM25 and the provider that quotes the first line."""
    ship(spark)
    c = table(spark, sf, "chunks").where("chunk_id is not null").select("chunk_id", "span.document_id", "span.page", "span.clause_id", "text").dropDuplicates(["chunk_id"])
    made = answered(_items(spark, sf).select("item_id", "question"), LexicalRetriever(c.select(F.col("chunk_id").alias("id"), "text")), c, _first_line)
    return made.select("item_id", "decision", F.md5("answer").alias("answer"), F.array_join("citations", ",").alias("citations"), F.round("confidence", 6).alias("confidence"))


def tokens_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the six best passages of a question, on average, and how many questions found any."""
    per = _full_passages(spark, sf).where("rank <= 6").groupBy("item_id").agg(F.floor(F.sum(F.length("text")) / 4).alias("tokens"))
    return per.agg(F.count("*").alias("n"), F.floor(F.avg("tokens")).alias("mean_tokens"), F.max("tokens").alias("most"))


def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of the judge with what the items expect, and whether the sample is too small to tell."""
    r = _ratings(spark, sf)
    off = r.agg(F.count_if(F.col("human") != F.col("judge")).alias("disagreements"))
    k = E.cohens_kappa(r, "human", "judge").join(F.broadcast(off))  # one row each
    return k.select("n", F.round("kappa", 6).alias("kappa"), E.kappa_band(F.col("kappa")).alias("band"), "disagreements", (F.col("n") < 25).alias("small_sample"), (F.col("kappa") >= 0.6).alias("accepted"))


def validate_report(spark: SparkSession, sf: str) -> DataFrame:
    """What stands between the evaluation set and its use, counted: broken rules, findings that block, missed targets, empty strata."""
    count = lambda df, name, key: df.agg(F.count("*").alias("problems"), F.countDistinct(key).alias("subjects")).select(F.lit(name).alias("check"), "problems", "subjects")
    items = _items(spark, sf)
    f = _findings(spark, sf)
    return (
        count(golden_violations(spark, sf), "rules", "id").unionByName(count(f.where("severity <> 'WARN'"), "blocking", "item_id")).unionByName(count(f.where("severity = 'WARN'"), "warnings", "item_id"))
        .unionByName(count(N.shortfall(items), "targets", "target")).unionByName(count(N.coverage_gaps(items), "strata", "stratum"))
    )


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    concept = _golden(spark, sf).select(F.col("id").alias("item_id"), F.col("concept_id").alias("concept"))
    spans = _truths(spark, sf).join(concept, "item_id")
    bans = _golden(spark, sf).select(F.col("id").alias("item_id"), F.explode("must_not_cite").alias("pattern"))
    clauses = table(spark, sf, "chunks").where("span.clause_id is not null").select("span.document_id", "span.clause_id", "span.page").distinct()
    return M.item_findings(spans, bans, clauses, _hits(spark, sf), _census(spark, sf))


def resolve_items(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf)


def resolve_report(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("item_id").alias("items"))


def blocking_items(spark: SparkSession, sf: str) -> DataFrame:
    return M.blocking(_findings(spark, sf))


QUERIES = {f.__name__: f for f in (raw_parse, citation_verify, answer_decision, judge_abstain, usage_cost, prompt_assembly, ask_response, engine_answers, floor_aggregate, pipeline_answers, tokens_at_k, judge_agreement, resolve_items, resolve_report, blocking_items, validate_report)}
_BODY = "trim(case when regexp_extract(gen_raw, '(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$', 1) <> '' then regexp_extract(gen_raw, '(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$', 1) else gen_raw end, ' ')"
_STATUS = f"case when gen_raw is null or {_BODY} = '' then 'missing' when not json_valid({_BODY}) then 'broken' when json_type({_BODY}) = 'OBJECT' then 'object' else 'other' end"
_VERIFIED = f"""{_CHECK_SQL}, np as (select query_id as item_id, count(*) as candidates from lex group by 1), ve as (select a.answer_id, coalesce(any_value(candidates), 0) as candidates, count(distinct lex.id) as cited, count(*) filter (ci.rank is not null and lex.id is null) as unfounded
    from a left join np on np.item_id = a.id left join (select answer_id, id, unnest(citations) as rank from a) ci on ci.answer_id = a.answer_id left join lex on lex.query_id = a.id and lex.rank = ci.rank group by 1)"""
_FULL = "fp as (select query_id as item_id, rank, lex.id as chunk_id, c.span.document_id as document_id, c.span.page as page, c.span.clause_id as clause_id, c.text from lex join c on c.chunk_id = lex.id)"
_PRICES = ", ".join(f"('{m}', {i}, {o})" for m, i, o in A.PRICES)
_FINDINGS = f"""{_PARTS}, {_HITS}, {_T}, {_CENSUS}, cl as (select span.document_id as document_id, span.clause_id as clause_id, list(distinct span.page) filter (span.page is not null) as pg from chunks where span.clause_id is not null group by 1, 2), cp as (select document_id, concept, list(page) as seen from hc group by 1, 2),
    sp as (select t.item_id, t.truth_idx, t.document_id, t.page, t.clause_id, g.concept_id as concept from t join g on g.id = t.item_id),
    bo as (select sp.*, n_pages, cl.clause_id is not null as has_clause, coalesce(pg, []) as pg, seen, sp.concept is not null and sp.page is not null as asked, case when sp.concept is not null and sp.page is not null and seen is not null then list_contains(seen, sp.page) end as ok
      from sp left join n on n.source_id = sp.document_id left join cl on cl.document_id = sp.document_id and cl.clause_id = sp.clause_id left join cp on cp.document_id = sp.document_id and cp.concept = sp.concept),
    fs as (select item_id, truth_idx, unnest(case when n_pages is null then ['ERROR:unknown_document'] else [case when page > n_pages then 'ERROR:page_beyond_end' end, case when asked and seen is null then 'WARN:concept_absent' when asked and not ok then 'ERROR:concept_elsewhere' end,
      case when clause_id is null then 'WARN:no_clause' when not has_clause and regexp_matches(clause_id, '^(excl|def)[.]') then 'UNVERIFIABLE:clause_absent' when not has_clause then 'ERROR:clause_absent' when page is not null and not list_contains(pg, page) then 'ERROR:clause_elsewhere' when len(pg) > 3 and ok then 'WARN:ambiguous_confirmed' when len(pg) > 3 and coalesce(ok, true) then 'UNVERIFIABLE:ambiguous' end] end) as f from bo),
    fi as (select item_id, truth_idx, split_part(f, ':', 1) as severity, split_part(f, ':', 2) as rule from fs where f is not null union all select item_id, null, 'ERROR', 'ban_unknown_document' from (select id as item_id, split_part(unnest(must_not_cite), '#', 1) as d from g) where d not in (select source_id from n))"""
ORACLES = {
    "raw_parse": f"with {_A}, s as (select answer_id, {_BODY} as body, {_STATUS} as status from a) select answer_id, status, case when status = 'object' then lower(json_extract_string(body, '$.can_answer')) end as can_answer, case when status = 'object' then array_to_string(json_extract(body, '$.citations')::int[], ',') end as citations from s",
    "citation_verify": f"{_VERIFIED} select * from ve",
    "answer_decision": f"{_VERIFIED} select a.answer_id, case when candidates = 0 then 'no_candidates' when {_STATUS} in ('broken', 'other') then 'malformed_generation' when unfounded > 0 then 'malformed_generation' when coalesce(declined, false) or {_DECLINED} then 'low_confidence' else 'answered' end as decision from a join ve using (answer_id)",
    "judge_abstain": f"with {_A} select answer_id, coalesce(judge_parsed, false) and (not coalesce(judge_responsive, false) or not list_contains(coalesce(judge_support, []), true)) as abstains, coalesce(judge_parsed, false) and (not coalesce(judge_responsive, false) or len(list_filter(coalesce(judge_support, []), lambda x: not coalesce(x, false))) > 0) as strict from a",
    "usage_cost": f"with {_A}, u as (select run_id, sum(length(coalesce(gen_raw, '')) // 4)::bigint as input, sum(length(coalesce(answer, '')) // 4)::bigint as output from a group by 1), p(m, i, o) as (values {_PRICES}) select run_id || '/' || m as model, input, output, (input * i + output * o)::double / 1e6 as usd from u cross join p",
    "prompt_assembly": f"""{_CHECK_SQL}, {_FULL}, bd as (select item_id, 'PASSAGES:' || chr(10) || chr(10) || string_agg('<<<PASSAGE ' || rank || ' | ' || concat_ws(', ', document_id, 'page ' || coalesce(page::varchar, 'None'), 'clause ' || clause_id) || '>>>' || chr(10) || '[' || rank || '] ' || coalesce(text, '') || chr(10) || '<<<END PASSAGE ' || rank || '>>>', chr(10) || chr(10) order by rank) as body from fp group by 1)
        select item_id, length(body || chr(10) || chr(10) || 'QUESTION: ' || question) as chars, md5(body || chr(10) || chr(10) || 'QUESTION: ' || question) as digest from bd join g on g.id = item_id where question is not null""",
    "ask_response": f"{_CHECK_SQL}, {_FULL} select answer_id, rank, chunk_id, document_id, page, case when length(text) > 300 then substr(text, 1, 300) || '…' else text end as quote from (select distinct answer_id, id as item_id, unnest(citations) as rank from a) join fp using (item_id, rank)",
    "engine_answers": f"with {_T} select id as item_id, 'null' as engine, true as abstained, 'not_implemented' as reason, null as answer, 0::double as confidence from g union all select id, 'echo', false, null, md5('You asked: ' || coalesce(question, '')), 1 from g union all select id, 'retrieval', true, 'generation_unavailable', null, 0 from g",
    "floor_aggregate": f"""with {_T}, i as (select g.id, expected_behaviour as b, coalesce(trim(injection_canary), '') as cn, question, (select count(*) from t where item_id = g.id) > 0 as scored from g), e as (select 'null' as run_id, true as silent, * from i union all select 'echo', false, * from i),
        k as (select *, case when b = 'ignore_injection' then cn = '' or not contains(lower(case when silent then '' else 'You asked: ' || coalesce(question, '') end), lower(cn)) end as res from e)
        select run_id, count(*) as n_items, avg(case when scored then 0.0 end) as recall, avg(case when scored then 0.0 end) as mrr, avg(case when scored then 0.0 end) as ndcg, avg(case when scored then 0.0 end) as hit_rate, round(avg(case when b = 'abstain' then silent::int end), 6) as abstain_recall, round(avg(case when b in ('answer', 'surface_conflict', 'ignore_injection') then silent::int end), 6) as false_abstention_rate,
          avg(case when not silent then 1.0 end) as unsupported_answer_rate, round(avg(res::int), 6) as injection_resistance, 50 * count(*) filter (not silent and (b = 'abstain' or not coalesce(res, true))) + count(*) filter (silent and b <> 'abstain') as expected_cost from k group by 1""",
    "pipeline_answers": f"""{_CHECK_SQL}, {_FULL}, hd as (select query_id as item_id, any_value(fp.chunk_id) as chunk_id, trim(trim(string_split(any_value(fp.text), chr(10))[1], ' '), ' ') as said, max(lex.score) as confidence from lex join fp on fp.item_id = lex.query_id and fp.rank = 1 group by 1),
        pa as (select g.id as item_id, case when hd.item_id is null then 'no_candidates' when regexp_replace(lower(coalesce(said, '')), '^\\.+|\\.+$', '', 'g') in ('', 'null', 'none', 'n/a', 'na', 'nil', 'unknown', 'not applicable', '-') then 'low_confidence' else 'answered' end as decision, said, chunk_id, confidence from g left join hd on hd.item_id = g.id)
        select item_id, decision, case when decision = 'answered' then md5(said) end as answer, case when decision = 'answered' then chunk_id end as citations, round(coalesce(confidence, 0), 6) as confidence from pa""",
    "tokens_at_k": f"{_CHECK_SQL}, {_FULL}, tk as (select item_id, sum(length(text))::bigint // 4 as tokens from fp where rank <= 6 group by 1) select count(*) as n, floor(avg(tokens))::bigint as mean_tokens, max(tokens) as most from tk",
    "judge_agreement": _EVALUATION["cohens_kappa"].rsplit("select n,", 1)[0] + "select n, round(kappa, 6) as kappa, case when kappa >= 0.8 then 'strong' when kappa >= 0.6 then 'substantial' else 'weak' end as band, (select count(*) from r where human <> judge) as disagreements, n < 25 as small_sample, kappa >= 0.6 as accepted from z",
    "resolve_items": f"with {_FINDINGS} select * from fi",
    "resolve_report": f"with {_FINDINGS} select severity, count(*) as findings, count(distinct item_id) as items from fi group by 1",
    "blocking_items": f"with {_FINDINGS} select distinct item_id from fi where severity in ('ERROR', 'UNVERIFIABLE')",
}
_COUNTED = lambda name, sql, key: f"select '{name}' as check, count(*) as problems, count(distinct {key}) as subjects from ({sql})"
ORACLES["validate_report"] = " union all ".join([
    _COUNTED("rules", _EVALUATION["golden_violations"], "id"), _COUNTED("blocking", f"with {_FINDINGS} select * from fi where severity <> 'WARN'", "item_id"), _COUNTED("warnings", f"with {_FINDINGS} select * from fi where severity = 'WARN'", "item_id"),
    _COUNTED("targets", _RUNS["composition_shortfall"], "target"), _COUNTED("strata", _RUNS["coverage_gaps"], "stratum"),
])
