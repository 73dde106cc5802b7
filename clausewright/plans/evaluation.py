"""Queries of evaluation over the questions, answers and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CANONICAL, canonical_clause, clean_clause
from ..operators import evaluation as E
from ..sources.parquet import table
from .retrieval import _ASKED, _CORPUS, _bm25_sql, _terms
from ..operators import retrieval as R
from ..operators import runs as N


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "golden").where("id is not null").dropDuplicates(["id"])


def _truths(spark: SparkSession, sf: str) -> DataFrame:
    return _golden(spark, sf).select(F.col("id").alias("item_id"), F.posexplode("ground_truth_spans").alias("truth_idx", "s")).select("item_id", "truth_idx", "s.document_id", "s.page", "s.clause_id")


def _best(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best chunks of every question."""
    asked = _golden(spark, sf).select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return R.bm25_blocks(_terms(spark, sf), asked)


def _ranked(spark: SparkSession, sf: str, best: DataFrame | None = None) -> DataFrame:
    """The spans of the ten best chunks of every question, each under all its clause ids."""
    best = _best(spark, sf) if best is None else best
    spans = table(spark, sf, "chunks").select(F.col("chunk_id").alias("id"), "span", F.array_distinct(F.concat(F.array("span.clause_id"), F.coalesce("meta.clause_ids", F.array().cast("array<string>")))).alias("c")).dropDuplicates(["id"])
    return best.join(spans, "id").select(F.col("query_id").alias("item_id"), "rank", "span.document_id", "span.page", F.explode_outer("c").alias("clause_id"))


def retrieval_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = E.ranking_scores(_golden(spark, sf).select(F.col("id").alias("item_id")), _ranked(spark, sf), _truths(spark, sf))
    return scores.select("item_id", *(F.round(m, 6).alias(m) for m in ("recall", "precision", "mrr", "ndcg", "hit_rate")))


def metric_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    names = ["recall", "precision", "mrr", "ndcg", "hit_rate"]
    means = E.mean_and_skips(E.ranking_scores(_golden(spark, sf).select(F.col("id").alias("item_id")), _ranked(spark, sf), _truths(spark, sf)), names)
    return means.select("metric", F.round("mean", 6).alias("mean"), "n", "skipped")


def span_match_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk spans against the truths of the same document, counted under each mode. Chunks with the
    same place are counted first, so a document meets its truths once per place and not per chunk."""
    chunks = table(spark, sf, "chunks").select("chunk_id", "span.document_id", "span.clause_id", "span.page").dropDuplicates(["chunk_id"]).groupBy("document_id", "clause_id", "page").agg(F.count("*").alias("m"))
    t = _truths(spark, sf).select("item_id", "truth_idx", "document_id", F.col("clause_id").alias("t_clause"), F.col("page").alias("t_page"))
    both = t.join(chunks, "document_id")
    count = lambda mode: F.sum(F.when(E.span_match(F.col("clause_id"), F.col("page"), F.col("t_clause"), F.col("t_page"), mode), F.col("m")).otherwise(0))
    return both.groupBy("item_id", "truth_idx").agg(count("exact").alias("exact"), count("clause_prefix").alias("prefix"), count("page").alias("page"))


def must_not_cite(spark: SparkSession, sf: str) -> DataFrame:
    """Forbidden patterns hit by the passages an item's best chunks would cite."""
    banned = _golden(spark, sf).select(F.col("id").alias("item_id"), F.explode("must_not_cite").alias("pattern"))
    banned = banned.select("item_id", "pattern", F.substring_index("pattern", "#", 1).alias("document_id"), clean_clause(F.when(F.col("pattern").contains("#"), F.substring_index("pattern", "#", -1))).alias("banned"))
    cited = _ranked(spark, sf).select("item_id", "document_id", clean_clause(F.col("clause_id")).alias("clause"))
    hit = banned.join(cited, ["item_id", "document_id"]).where(F.col("banned").isNull() | E.covers(F.col("banned"), F.col("clause")))
    return hit.select("item_id", "pattern").distinct()


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """The judge's verdict against whether the item expects an answer."""
    return table(spark, sf, "judge_validate").where("answer_id is not null").dropDuplicates(["answer_id"]).select("answer_id", F.when(F.col("should_abstain"), 1).when(~F.col("should_abstain"), 0).alias("human"), F.when(F.col("judge_abstains_strict"), 1).when(~F.col("judge_abstains_strict"), 0).alias("judge"))


def cohens_kappa(spark: SparkSession, sf: str) -> DataFrame:
    k = E.cohens_kappa(_ratings(spark, sf), "human", "judge")
    return k.select("n", F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), F.round("kappa", 6).alias("kappa"), E.kappa_band(F.col("kappa")).alias("band"))


def kappa_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return _ratings(spark, sf).where("human <> judge").select("answer_id", "human", "judge")


def calibration_cost(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "judge_validate").where("answer_id is not null").dropDuplicates(["answer_id"]).select(F.coalesce("should_abstain", F.lit(False)).alias("expected"), (F.col("outcome") == "ABSTAIN").alias("abstained"))
    return r.agg(
        F.count_if(F.expr("abstained and expected")).alias("correct_abstentions"), F.count_if(F.expr("abstained and not expected")).alias("wrong_abstentions"), F.count_if(F.expr("not abstained and expected")).alias("wrong_answers"),
        F.count_if(F.expr("not abstained and not expected")).alias("correct_answers"), (50 * F.count_if(F.expr("not abstained and expected")) + F.count_if(F.expr("abstained and not expected"))).alias("cost"),
    )


def metric_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Answers, abstentions and citations overall, by stratum and by author, in one pass."""
    a = table(spark, sf, "judge_validate").where("answer_id is not null").dropDuplicates(["answer_id"])
    both = a.join(_golden(spark, sf).select("id", "strata", "authored_by"), "id")
    sets = both.groupingSets([[], [F.col("strata")], [F.col("authored_by")]], F.col("strata"), F.col("authored_by"))
    return sets.agg(F.grouping_id("strata", "authored_by").cast("bigint").alias("slice"), F.count("*").alias("n"), F.count_if(F.col("outcome") == "ANSWER").alias("answered"), F.round(F.avg(F.size("citations").cast("double")), 6).alias("citations"))


def _waits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "judge_validate").where("answer_id is not null").dropDuplicates(["answer_id"]).select("run_id", F.col("wall_gen_s").alias("s")).where("s is not null and run_id is not null")


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return _waits(spark, sf).groupBy("run_id").agg(F.round(F.avg("s"), 3).alias("mean"), F.expr("percentile_disc(0.5) within group (order by s)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by s)").alias("p95"))


def percentile_half_even(spark: SparkSession, sf: str) -> DataFrame:
    w = _waits(spark, sf)
    return N.rank_percentile(w, ["run_id"], "s", 95, "p95").join(N.rank_percentile(w, ["run_id"], "s", 50, "p50"), "run_id")


def gate_check(spark: SparkSession, sf: str) -> DataFrame:
    """Measured rates of the answers against limits, one of which has no measurement."""
    a = table(spark, sf, "judge_validate").where("answer_id is not null").dropDuplicates(["answer_id"])
    m = a.agg(F.avg((F.col("outcome") == "ABSTAIN").cast("double")).alias("abstained"), F.avg(F.coalesce("membership_ok", F.lit(False)).cast("double")).alias("grounded"))
    long = m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("actual")) for c in m.columns))).alias("r")).select("r.*")
    limits = spark.createDataFrame([("abstained", 0.5, True), ("grounded", 0.99, False), ("recall", 0.4, False), ("p95", None, True)], "metric string, bound double, lower_is_better boolean")
    return E.gate(long, limits)


def stratified_subset(spark: SparkSession, sf: str) -> DataFrame:
    return E.stratified_sample(table(spark, sf, "golden"))


def composition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _golden(spark, sf).groupBy("strata", "authored_by").agg(F.count("*").alias("n"))


def golden_violations(spark: SparkSession, sf: str) -> DataFrame:
    """All rules that an item breaks, at once."""
    asked, reference = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("reference_answer", F.lit("")))
    spans, bans = F.greatest(F.coalesce(F.size("ground_truth_spans"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size("must_not_cite"), F.lit(0)), F.lit(0))
    sides = F.size(F.array_distinct(F.transform("ground_truth_spans", lambda s: F.struct(s["document_id"], s["clause_id"]))))
    places = F.size(F.array_distinct(F.transform("ground_truth_spans", lambda s: s["document_id"])))
    does, stratum, fails = F.col("expected_behaviour"), F.col("strata"), F.coalesce("expected_to_fail", F.lit(False))
    why = F.trim(F.coalesce("expected_failure_reason", F.lit("")))
    rules = [
        ("question_empty", asked == ""), ("question_short", (asked != "") & (F.length(asked) < 10)), ("answer_without_span", (does == "answer") & (spans == 0)), ("answer_without_reference", (does == "answer") & (reference == "")),
        ("abstain_with_span", (does == "abstain") & (spans > 0)), ("override_needs_two_spans", (stratum == "conditional_override") & (spans < 2)), ("conflict_needs_two_sides", (does == "surface_conflict") & (F.coalesce(sides, F.lit(0)) < 2)),
        ("contradiction_needs_two_documents", (stratum == "contradictory") & (F.coalesce(places, F.lit(0)) < 2)), ("supersession_needs_ban", (stratum == "supersession") & (bans == 0)), ("supersession_behaviour", (stratum == "supersession") & (does != "answer")),
        ("injection_needs_canary", (does == "ignore_injection") & (F.coalesce("injection_canary", F.lit("")) == "")), ("injection_behaviour", (stratum == "injection") & (does != "ignore_injection")), ("unanswerable_behaviour", (stratum == "unanswerable") & (does != "abstain")),
        ("needs_concept", (stratum.isin("contradictory", "cross_doc_comparison", "conditional_override") | (bans > 0)) & F.col("concept_id").isNull()), ("clause_form", F.exists("ground_truth_spans", lambda s: s["clause_id"].isNotNull() & canonical_clause(s["clause_id"]).isNull())),
        ("failure_needs_reason", fails & (why == "")), ("reason_needs_failure", ~fails & (F.coalesce("expected_failure_reason", F.lit("")) != "")), ("ban_form", F.exists("must_not_cite", lambda p: F.coalesce((p == "") | p.startswith("#"), F.lit(True)))),
    ]
    return E.violations(_golden(spark, sf), "id", rules)


_A = "a as (select * from (select *, row_number() over (partition by answer_id) as rn from judge_validate where answer_id is not null) where rn = 1)"
_G = "g as (select * from (select *, row_number() over (partition by id) as rn from golden where id is not null) where rn = 1)"
_T = f"{_G}, t as (select item_id, truth_idx, s.document_id as document_id, s.page as page, s.clause_id as clause_id from (select id as item_id, unnest(ground_truth_spans) as s, generate_subscripts(ground_truth_spans, 1) - 1 as truth_idx from g))"
_C = "c as (select * from (select *, row_number() over (partition by chunk_id) as rn from chunks) where rn = 1)"
_RANKED = f"""{_bm25_sql(_CORPUS, _ASKED, 10)}, {_C}, r as (select query_id as item_id, rank, span.document_id as document_id, span.page as page, clause_id from (select query_id, rank, span, unnest(list_distinct_nulls) as clause_id from (
    select query_id, rank, span, list_concat([span.clause_id], coalesce(meta.clause_ids, [])) as list_distinct_nulls from lex join c on c.chunk_id = lex.id)))"""
_CLEAN = lambda c: f"nullif(lower(regexp_replace(trim({c}), '^\\.+|\\.+$', '', 'g')), '')"
_PREFIX = lambda a, b: f"coalesce({a} = {b} or starts_with({b}, {a} || '.'), false)"
_PAGE = lambda a, b: f"coalesce({a} = {b}, false)"
_MATCH = f"case when {_CLEAN('r.clause_id')} is null or {_CLEAN('t.clause_id')} is null then {_PAGE('r.page', 't.page')} else {_PREFIX(_CLEAN('r.clause_id'), _CLEAN('t.clause_id'))} or {_PREFIX(_CLEAN('t.clause_id'), _CLEAN('r.clause_id'))} end"
_SCORES = f"""with {_T}, {_RANKED}, h as (select distinct r.item_id, rank, truth_idx from r join t on r.item_id = t.item_id and r.document_id = t.document_id where {_MATCH}),
    nt as (select item_id, count(distinct truth_idx) as n from t group by 1), ret as (select item_id, count(distinct rank) as returned from r group by 1),
    pr as (select item_id, min(rank) as first, count(distinct rank) as relevant, count(distinct truth_idx) as found from h group by 1),
    dcg as (select item_id, sum(1 / log2(rank + 1)) as dcg from (select distinct item_id, rank from (select item_id, truth_idx, min(rank) as rank from h group by 1, 2)) group by 1),
    sc as (select g.id as item_id, case when n is not null then coalesce(found / n, 0) end as recall, case when n is not null then coalesce(relevant / returned, 0) end as precision, case when n is not null then coalesce(1.0 / first, 0) end as mrr,
      case when n is not null then coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1))), 0) end as ndcg, case when n is not null then case when relevant > 0 then 1.0 else 0.0 end end as hit_rate
      from g left join nt on nt.item_id = g.id left join ret on ret.item_id = g.id left join pr on pr.item_id = g.id left join dcg on dcg.item_id = g.id)"""
_NAMES = ("recall", "precision", "mrr", "ndcg", "hit_rate")
_STM = lambda mode: {"exact": f"case when {_CLEAN('c.clause_id')} is null or {_CLEAN('t.clause_id')} is null then {_PAGE('c.page', 't.page')} else {_CLEAN('c.clause_id')} = {_CLEAN('t.clause_id')} end", "page": _PAGE("c.page", "t.page")}.get(mode, _MATCH.replace("r.", "c."))

QUERIES = {f.__name__: f for f in (retrieval_scores, metric_aggregate, span_match_modes, must_not_cite, cohens_kappa, kappa_disagreements, calibration_cost, metric_slices, latency_summary, percentile_half_even, gate_check, stratified_subset, composition_counts, golden_violations)}
_SLUG = lambda x: f"regexp_replace(regexp_replace(lower(trim({x}, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _canonical(x: str) -> str:
    v = f"regexp_replace(trim({x}, ' '), '\\.+$', '')"
    excl = f"regexp_extract({v}, '(?i)^(?:code[\\s.]*)?excl[\\s.]*(\\d{{1,2}})$', 1)"
    term = f"regexp_extract({v}, '(?i)^(?:def(?:inition)?[\\s.:]+)?([A-Za-z][A-Za-z0-9 /&''-]{{1,38}})$', 1)"
    bare = f"replace(regexp_replace({v}, '(?i)^(?:section|sec|clause|cl)[\\s.]*', ''), ' ', '')"
    parts = f"array_to_string(list_transform(string_split({bare}, '.'), lambda zz: case when regexp_full_match(zz, '\\p{{L}}+') and not regexp_full_match(zz, '(?i)[IVX]{{1,4}}') then lower(zz) else zz end), '.')"
    return f"case when {excl} <> '' then 'excl.' || lpad({excl}, 2, '0') when regexp_matches({v}, '(?i)^def(?:inition)?[.: ]') and {term} <> '' then 'def.' || {_SLUG(term)} when regexp_full_match({parts}, '{CANONICAL[1:-1]}') then {parts} end"


_N_SPANS, _N_BANS = "coalesce(len(ground_truth_spans), 0)", "coalesce(len(must_not_cite), 0)"
_RULES = [
    ("question_empty", "trim(coalesce(question, ''), ' ') = ''"), ("question_short", "trim(coalesce(question, ''), ' ') <> '' and length(trim(question, ' ')) < 10"), ("answer_without_span", f"expected_behaviour = 'answer' and {_N_SPANS} = 0"), ("answer_without_reference", "expected_behaviour = 'answer' and trim(coalesce(reference_answer, ''), ' ') = ''"),
    ("abstain_with_span", f"expected_behaviour = 'abstain' and {_N_SPANS} > 0"), ("override_needs_two_spans", f"strata = 'conditional_override' and {_N_SPANS} < 2"), ("conflict_needs_two_sides", "expected_behaviour = 'surface_conflict' and coalesce(len(list_distinct(list_transform(ground_truth_spans, lambda s: s.document_id || '#' || coalesce(s.clause_id, chr(1))))), 0) < 2"),
    ("contradiction_needs_two_documents", "strata = 'contradictory' and coalesce(len(list_distinct(list_transform(ground_truth_spans, lambda s: s.document_id))), 0) < 2"), ("supersession_needs_ban", f"strata = 'supersession' and {_N_BANS} = 0"), ("supersession_behaviour", "strata = 'supersession' and expected_behaviour <> 'answer'"),
    ("injection_needs_canary", "expected_behaviour = 'ignore_injection' and coalesce(injection_canary, '') = ''"), ("injection_behaviour", "strata = 'injection' and expected_behaviour <> 'ignore_injection'"), ("unanswerable_behaviour", "strata = 'unanswerable' and expected_behaviour <> 'abstain'"),
    ("needs_concept", f"(strata in ('contradictory', 'cross_doc_comparison', 'conditional_override') or {_N_BANS} > 0) and concept_id is null"), ("clause_form", f"len(list_filter(ground_truth_spans, lambda s: s.clause_id is not null and ({_canonical('s.clause_id')}) is null)) > 0"),
    ("failure_needs_reason", "coalesce(expected_to_fail, false) and trim(coalesce(expected_failure_reason, ''), ' ') = ''"), ("reason_needs_failure", "not coalesce(expected_to_fail, false) and coalesce(expected_failure_reason, '') <> ''"), ("ban_form", "len(list_filter(must_not_cite, lambda p: coalesce(p = '' or starts_with(p, '#'), true))) > 0"),
]
ORACLES = {
    "retrieval_scores": f"{_SCORES} select item_id, {', '.join(f'round({m}, 6) as {m}' for m in _NAMES)} from sc",
    "metric_aggregate": f"{_SCORES} " + " union all ".join(f"select '{m}' as metric, round(avg({m}), 6) as mean, count({m}) as n, count(*) - count({m}) as skipped from sc" for m in _NAMES),
    "span_match_modes": f"""with {_T}, {_C.replace('c as', 'c0 as')}, c as (select span.document_id as document_id, span.clause_id as clause_id, span.page as page from c0)
        select item_id, truth_idx, count(*) filter ({_STM('exact')}) as exact, count(*) filter ({_STM('clause_prefix')}) as prefix, count(*) filter ({_STM('page')}) as page from t join c using (document_id) group by item_id, truth_idx""",
    "must_not_cite": f"""with {_G}, {_RANKED}, b as (select item_id, pattern, split_part(pattern, '#', 1) as document_id, {_CLEAN("case when contains(pattern, '#') then split_part(pattern, '#', -1) end")} as banned from (select id as item_id, unnest(must_not_cite) as pattern from g))
        select distinct b.item_id, pattern from b join r on b.item_id = r.item_id and b.document_id = r.document_id where banned is null or {_PREFIX('banned', _CLEAN('r.clause_id'))}""",
    "cohens_kappa": f"""with {_A}, r as (select should_abstain::int as human, judge_abstains_strict::int as judge from a where should_abstain is not null and judge_abstains_strict is not null), o as (select count(*) as n, avg((human = judge)::int) as po from r),
        e as (select sum(coalesce(x, 0) * coalesce(y, 0)) as xy from (select human as label, count(*) as x from r group by 1) full join (select judge as label, count(*) as y from r group by 1) using (label)), k as (select n, po, xy / (n * n) as pe from o cross join e), z as (select *, case when pe >= 1 then 0 else (po - pe) / (1 - pe) end as kappa from k)
        select n, round(po, 6) as po, round(pe, 6) as pe, round(kappa, 6) as kappa, case when kappa >= 0.8 then 'strong' when kappa >= 0.6 then 'substantial' else 'weak' end as band from z""",
    "kappa_disagreements": f"with {_A} select answer_id, should_abstain::int as human, judge_abstains_strict::int as judge from a where should_abstain <> judge_abstains_strict",
    "calibration_cost": f"""with {_A}, r as (select coalesce(should_abstain, false) as e, outcome = 'ABSTAIN' as b from a) select count(*) filter (b and e) as correct_abstentions, count(*) filter (b and not e) as wrong_abstentions, count(*) filter (not b and e) as wrong_answers,
        count(*) filter (not b and not e) as correct_answers, 50 * count(*) filter (not b and e) + count(*) filter (b and not e) as cost from r""",
    "metric_slices": f"""with {_A}, {_G} select strata, authored_by, grouping(strata, authored_by) as slice, count(*) as n, count(*) filter (outcome = 'ANSWER') as answered, round(avg(len(citations)), 6) as citations from a join g using (id) group by grouping sets ((), (strata), (authored_by))""",
    "latency_summary": f"with {_A} select run_id, round(avg(wall_gen_s), 3) as mean, quantile_disc(wall_gen_s, 0.5) as p50, quantile_disc(wall_gen_s, 0.95) as p95 from a where wall_gen_s is not null and run_id is not null group by 1",
    "percentile_half_even": f"with {_A}, l as (select run_id, list_sort(list(wall_gen_s)) as v from a where wall_gen_s is not null and run_id is not null group by 1) select run_id, " + ", ".join(f"v[greatest(1, least(len(v), round_even({p / 100} * len(v) + 0.5, 0)::int))] as p{p}" for p in (95, 50)) + " from l",
    "gate_check": f"""with {_A}, m as (select round(avg((outcome = 'ABSTAIN')::int), 6) as abstained, round(avg(coalesce(membership_ok, false)::int), 6) as grounded from a)
        select 'abstained' as metric, abstained as actual, 0.5::double as bound, abstained <= 0.5 as passed from m union all select 'grounded', grounded, 0.99, grounded >= 0.99 from m union all select 'recall', null, 0.4, false""",
    "stratified_subset": """with o as (select id, min(strata) as stratum from golden where id is not null and strata is not null group by 1), t as (select *, row_number() over (partition by stratum order by md5('7:' || id), id) as turn from o)
        select id, stratum, turn from t order by turn, case when stratum in ('unanswerable', 'contradictory', 'supersession', 'injection') then 0 else 1 end, stratum limit 20""",
    "composition_counts": f"with {_G} select strata, authored_by, count(*) as n from g group by all",
    "golden_violations": f"with {_G} " + " union all ".join(f"select id, '{n}' as rule from g where {c}" for n, c in _RULES),
}
