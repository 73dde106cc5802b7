"""Queries of the sources and stores: JSON lines, sheets, persisted indexes, caches and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import jsonl, sheet, store
from ..sources.parquet import table
from .evaluation import _A, _G, _golden
from .retrieval import _CORPUS, _terms
from .runs import _AGG_SQL, _measured

MODEL = "given-64"


def _read_back(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    jsonl.write_jsonl(rows, path, ("written by the engine", "one object a line"))
    return jsonl.items_of(jsonl.read_jsonl(spark, path, rows.schema))


def _joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest written as JSON lines with comments and read again."""
    got = _read_back(spark, table(spark, sf, "sources").where("id is not null"), "manifest")
    return got.select("id", "url", "kind", "publisher", "authority_rank", "insurer", "version_label", "effective_from", "effective_to", _joined("mirror_urls"), _joined("supersedes"), "superseded_by", "parent_document_id")


def golden_scan(spark: SparkSession, sf: str) -> DataFrame:
    got = _read_back(spark, _golden(spark, sf), "golden")
    spans = F.array_join(F.transform("ground_truth_spans", lambda s: F.concat_ws("/", s["document_id"], s["page"].cast("string"), s["clause_id"])), "|")
    return got.select("id", "question", "strata", "expected_behaviour", spans.alias("spans"), "as_of_date", _joined("must_not_cite"), "expected_to_fail")


def jsonl_proof(spark: SparkSession, sf: str) -> DataFrame:
    """How many evaluation items do not come back as they were written."""
    rows = _golden(spark, sf)
    path = scratch(spark, "proof")
    jsonl.write_jsonl(rows, path, ("proof",))
    return jsonl.proven(rows, path).agg(F.count("*").alias("lost"))


def manifest_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by what may be done with them: fixtures are kept out of the corpus by their kind."""
    kind = F.coalesce(F.col("kind"), F.lit(""))
    return table(spark, sf, "sources").select("id", F.when(kind == "adversarial_fixture", "adversarial").otherwise("production").alias("subset"))


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.rows_of(_golden(spark, sf))


def sheet_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items out of their own sheet: there and back."""
    got = sheet.items_of(sheet.rows_of(_golden(spark, sf)))
    spans = F.array_join(F.transform("ground_truth_spans", lambda s: F.concat_ws("/", s["document_id"], F.coalesce(s["page"].cast("string"), F.lit("-")), F.coalesce(s["clause_id"], F.lit("-")))), "|")
    return got.select("id", "strata", "expected_behaviour", "question", "authored_by", "concept_id", "as_of_date", spans.alias("spans"), _joined("must_not_cite"), "expected_to_fail", "problem")


def bm25_index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Terms and words of every chunk out of the index as it was kept."""
    path = scratch(spark, "index")
    store.save_index(_terms(spark, sf), path)
    posts, docs = store.load_index(spark, path)
    per = posts.groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))
    return docs.join(per, "id", "left").select(F.col("id").alias("chunk_id"), F.col("dl").cast("bigint").alias("dl"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("words", F.lit(0)).alias("words"))


def store_covers_index(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the index that the store of texts lacks."""
    return store.uncovered(_terms(spark, sf), table(spark, sf, "chunks").where("text is not null").select(F.col("chunk_id").alias("id"))).select(F.col("id").alias("chunk_id"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors out of their store against its contract; documents without one are missing."""
    path = scratch(spark, "vectors")
    store.save_vectors(_vectors(spark, sf), path, MODEL)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return store.vector_problems(store.load_vectors(spark, path, MODEL), 64, docs).select(F.col("id").alias("vec_id"), "problem")


def _probe(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = docs.where("text is not null").join(_vectors(spark, sf), "id").select(store.content_key(F.col("text"), MODEL).alias("key"), "embedding")
    return store.cache_probe(docs, cache, MODEL)


def embed_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text has an embedding, under whatever id."""
    return _probe(spark, sf)[0].select(F.col("id").alias("doc_id"), "key")


def embed_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Texts still to be embedded, each once."""
    return _probe(spark, sf)[1].select("key", F.length("text").cast("bigint").alias("chars"))


def replies_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Every question as a request, answered from the recorded outputs of the first run."""
    key = lambda i, q: store.request_key("answer", F.struct(i.alias("id"), q.alias("question")))
    asked = _golden(spark, sf).select("id", key(F.col("id"), F.col("question")).alias("key"))
    a = table(spark, sf, "judge_validate").where("answer_id is not null and gen_raw is not null")
    first = a.agg(F.min("run_id").alias("run_id"))
    said = a.join(F.broadcast(first), "run_id").join(_golden(spark, sf).select("id", "question"), "id").select(key(F.col("id"), F.col("question")).alias("key"), F.col("gen_raw").alias("response"))
    return store.replayed(asked, said).select("id", "hit", F.md5("response").alias("response"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregates of both runs, appended to a log run by run and read again."""
    rows = _measured(spark, sf).select("run_id", "slice", "name", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), "n_items", "errors")
    path = scratch(spark, "log")
    jsonl.append_log(rows.where("slice = 'all'"), path)
    jsonl.append_log(rows.where("slice <> 'all'"), path)
    return jsonl.read_log(spark, path, rows.schema)


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Content hash of every document, and whether its first 1,024 characters show the mark of a PDF."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.contains(F.substring(t, 1, 1024), F.lit("%PDF")).alias("pdf"))


QUERIES = {f.__name__: f for f in (manifest_scan, golden_scan, jsonl_proof, manifest_subsets, sheet_rows, sheet_items, bm25_index_roundtrip, store_covers_index, vector_problems, embed_cache_hits, embed_cache_misses, replies_replayed, run_log, content_hash)}
_CELL = lambda c: f"nullif(trim({c}, ' '), '')"
_SPAN = lambda f: f"coalesce(array_to_string(list_transform(ground_truth_spans, lambda s: coalesce(s.{f}::varchar, '')), '|'), '')"
_SHEET = {"document_id": _SPAN("document_id"), "page": _SPAN("page"), "clause_id": _SPAN("clause_id"), "must_not_cite": "coalesce(array_to_string(must_not_cite, '|'), '')", "expected_to_fail": "case when coalesce(expected_to_fail, false) then 'TRUE' else '' end"}
_LINES = lambda c: f"array_to_string({c}, '|') as {c}"
_KEY = lambda t: f"sha256('{MODEL}' || chr(0) || chr(0) || chr(0) || {t})"
_CACHE = f"k as (select doc_id, text, {_KEY('text')} as key from documents where text is not null), hk as (select distinct key from k where doc_id in (select vec_id from embeddings))"
ORACLES = {
    "manifest_scan": f"select id, url, kind, publisher, authority_rank, insurer, version_label, effective_from, effective_to, {_LINES('mirror_urls')}, {_LINES('supersedes')}, superseded_by, parent_document_id from sources where id is not null",
    "golden_scan": f"with {_G} select id, question, strata, expected_behaviour, array_to_string(list_transform(ground_truth_spans, lambda s: concat_ws('/', s.document_id, s.page::varchar, s.clause_id)), '|') as spans, as_of_date, {_LINES('must_not_cite')}, expected_to_fail from g",
    "jsonl_proof": "select 0::bigint as lost",
    "manifest_subsets": "select id, case when kind = 'adversarial_fixture' then 'adversarial' else 'production' end as subset from sources",
    "sheet_rows": f"with {_G} select " + ", ".join(f"{_SHEET.get(c, f'coalesce({c}::varchar, {chr(39) * 2})')} as {c}" for c in sheet.COLUMNS) + " from g",
    "sheet_items": f"""with {_G} select {_CELL('id')} as id, {_CELL('strata')} as strata, {_CELL('expected_behaviour')} as expected_behaviour, {_CELL('question')} as question, coalesce({_CELL('authored_by')}, 'human') as authored_by, {_CELL('concept_id')} as concept_id, as_of_date,
        case when not (len(ground_truth_spans) = 1 and ground_truth_spans[1].page is null) or ground_truth_spans is null then coalesce(array_to_string(list_transform(ground_truth_spans, lambda s: concat_ws('/', trim(s.document_id, ' '), coalesce(s.page::varchar, '-'), coalesce({_CELL('s.clause_id')}, '-'))), '|'), '') end as spans, coalesce(array_to_string(list_filter(list_transform(must_not_cite, lambda p: trim(p, ' ')), lambda p: p <> ''), '|'), '') as must_not_cite, coalesce(expected_to_fail, false) as expected_to_fail, case when len(ground_truth_spans) = 1 and ground_truth_spans[1].page is null then 'pages and documents differ in number' end as problem
        from g where {_CELL('id')} is not null and {_CELL('question')} is not null""",
    "bm25_index_roundtrip": f"with {_CORPUS} select dl.id as chunk_id, dl, count(term) as terms, coalesce(sum(tf), 0)::bigint as words from dl left join p on p.id = dl.id group by all",
    "store_covers_index": "select distinct chunk_id from chunks where chunk_id is not null and chunk_id not in (select chunk_id from chunks where text is not null and chunk_id is not null)",
    "vector_problems": "select vec_id, case when embedding is null then 'null' when len(embedding) <> 64 then 'dimension' when abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 1e-3 then 'length' end as problem from embeddings where problem is not null union all select vec_id, 'twice' from embeddings group by 1 having count(*) > 1 union all select distinct doc_id, 'missing' from documents where doc_id not in (select vec_id from embeddings)",
    "embed_cache_hits": f"with {_CACHE} select doc_id, key from k join hk using (key)",
    "embed_cache_misses": f"with {_CACHE} select key, length(any_value(text)) as chars from k where key not in (select key from hk) group by 1",
    "replies_replayed": f"with {_A}, {_G}, r as (select id, min(gen_raw) as raw from a where gen_raw is not null and run_id = (select min(run_id) from a where gen_raw is not null) group by 1) select g.id, r.id is not null as hit, md5(raw) as response from g left join r on g.id = r.id",
    "run_log": f"{_AGG_SQL} select run_id, slice, name, round(recall, 6) as recall, round(ndcg, 6) as ndcg, n_items, errors from ag",
    "content_hash": "select doc_id, sha256(coalesce(text, '')) as sha256, contains(substr(coalesce(text, ''), 1, 1024), '%PDF') as pdf from documents",
}
