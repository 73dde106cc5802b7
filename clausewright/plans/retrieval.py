"""Queries of retrieval: chunks and documents as the corpus, evaluation questions and stated vectors as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.parquet import table
from . import sql as Q

AS_OF = "2023-06-30"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return R.doc_terms(table(spark, sf, "chunks"), "chunk_id", "text")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "golden").groupBy(F.col("id").alias("query_id")).agg(F.max("question").alias("text"))


def _allowed(spark: SparkSession, sf: str) -> DataFrame:
    return R.candidates(table(spark, sf, "chunks"), as_of=AS_OF).select(F.col("chunk_id").alias("id")).distinct()


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _bm25(spark: SparkSession, sf: str, **kw) -> DataFrame:  # noqa: ANN003
    return _shown(R.bm25_blocks(_terms(spark, sf), _asked(spark, sf), **kw))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


def bm25_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, allow=_allowed(spark, sf))


def bm25_k1_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, k1=0.0)


def bm25_b_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, b=0.0)


def bm25_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).select(F.col("id").alias("chunk_id"), F.col("dl").cast("bigint").alias("dl"))


def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark, sf)
    df = R.postings(terms).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(R.corpus_stats(terms))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark, sf)
    posts = R.postings(terms).agg(F.count("*").alias("postings"), F.countDistinct("term").alias("n_terms"))
    return R.corpus_stats(terms).join(F.broadcast(posts)).select(F.col("n").alias("n_chunks"), "n_terms", F.round("avgdl", 6).alias("avgdl"), "postings", (F.col("postings") * 12).alias("bytes"))


def in_force_asof(spark: SparkSession, sf: str) -> DataFrame:
    return _allowed(spark, sf).select(F.col("id").alias("chunk_id"))


def candidate_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.candidates(table(spark, sf, "chunks"), documents=("aster-floater-2024",), tables_only=True).select("chunk_id").distinct()


def undated_supersession_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("meta.superseded_by is not null and meta.effective_to is null").agg(F.countDistinct("chunk_id").alias("n"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return _vectors(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _dense(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return R.dense(_vectors(spark, sf), _vector_queries(spark, sf), "vec_id", "embedding", k)


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_dense(spark, sf))


def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.dense(_vectors(spark, sf).where("label % 2 = 0"), _vector_queries(spark, sf), "vec_id", "embedding"))


def dense_norm_check(spark: SparkSession, sf: str) -> DataFrame:
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return _vectors(spark, sf).select("vec_id", F.size("embedding").cast("bigint").alias("dim"), (F.abs(F.sqrt(norm) - 1) <= 1e-3).alias("unit"))


def _document_arm(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms, queries and top k of all documents, those without a vector too; the stated query set: the whole text of every document whose id is divisible by 100."""
    docs = table(spark, sf, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])  # the shuffle is of texts, half as large as their tokens
    terms = R.doc_terms(docs, "doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return terms, asked, R.bm25_blocks(terms, asked, k)


def rrf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.fuse([(_document_arm(spark, sf, 30)[2], 1.0), (_dense(spark, sf, 30), 1.0)]))


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.fuse([(_document_arm(spark, sf, 30)[2], 0.3), (_dense(spark, sf, 30), 0.7)]))


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    terms, asked, wide = _document_arm(spark, sf, 30)
    return _shown(R.rerank(wide, asked, terms))


def confidence_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    fused = R.fuse([(_document_arm(spark, sf, 30)[2], 1.0), (_dense(spark, sf, 30), 1.0)])
    return fused.select("query_id", "id", F.round(R.confidence(F.lit(None).cast("double"), F.when(F.col("rank") <= 5, F.col("score")), F.col("score_1")), 6).alias("confidence"))


def _terms_sql(source: str) -> str:
    """The inverted index of a source (id, text): documents with tokens, lengths, statistics, postings, frequencies."""
    return f"""src as ({source}), {Q.normalised('nt_d', 'src')}, d as materialized (select id, {Q.tokens('text')} as tk from nt_d), dl as (select id, len(tk) as dl from d),
    st as (select count(*) as n, avg(dl) as avgdl from dl), p as materialized (select id, term, count(*) as tf from (select id, unnest(tk) as term from d) group by all), df as (select term, count(*) as df from p group by 1)"""


def _asked_sql(source: str) -> str:
    return f"qs as ({source}), {Q.normalised('nt_q', 'qs')}, q as (select distinct id as query_id, unnest({Q.tokens('text')}) as term from nt_q)"


_CORPUS = _terms_sql("select chunk_id as id, any_value(text) as text from chunks where chunk_id is not null group by 1")
_DOCS = _terms_sql("select doc_id as id, any_value(text) as text from documents where doc_id is not null group by 1")
_ASKED = _asked_sql("select id, max(question) as text from golden where id is not null group by 1")
_DOC_ASKED = _asked_sql("select doc_id as id, any_value(text) as text from documents where doc_id % 100 = 0 group by 1")


def _bm25_sql(corpus: str, asked: str, k: int, k1: float = 1.5, b: float = 0.75, allow: str = "true") -> str:
    return f"""{corpus}, {asked}, s as (select query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) as score
        from q join p using (term) join df using (term) join dl on p.id = dl.id cross join st where {allow} group by all),
        lex as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) where rank <= {k})"""


def _dense_sql(k: int, where: str = "true") -> str:
    return f"""den as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from (
        select a.vec_id as query_id, b.vec_id as id, list_dot_product(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b where a.vec_id % 100 = 0 and ({where}))) where rank <= {k})"""


_SHOW = "select query_id, rank, id, round(score, 6) as score from"
_FORCE = f"(meta.effective_from is null or meta.effective_from <= date '{AS_OF}') and (meta.effective_to is null or meta.effective_to >= date '{AS_OF}')"
_ALLOW = f"p.id in (select chunk_id from chunks where {_FORCE})"


def _rrf_sql(w1: float, w2: float) -> str:
    return f"""with {_bm25_sql(_DOCS, _DOC_ASKED, 30)}, {_dense_sql(30)}, u as (select query_id, id, {w1} / (60 + rank) as part, null::double as d from lex union all select query_id, id, {w2} / (60 + rank), score from den),
        f as (select query_id, id, sum(part) as score, max(d) as d from u group by all), r as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) where rank <= 10)"""


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_topk_filtered, bm25_k1_zero, bm25_b_zero, bm25_doc_stats, bm25_idf, bm25_index_stats, in_force_asof, candidate_filter, undated_supersession_count, dense_topk, dense_topk_filtered, dense_norm_check, rrf_topk, rrf_weighted, rerank_topk, confidence_coalesce)}
ORACLES = {
    "bm25_topk": f"with {_bm25_sql(_CORPUS, _ASKED, 10)} {_SHOW} lex",
    "bm25_topk_filtered": f"with {_bm25_sql(_CORPUS, _ASKED, 10, allow=_ALLOW)} {_SHOW} lex",
    "bm25_k1_zero": f"with {_bm25_sql(_CORPUS, _ASKED, 10, k1=0.0)} {_SHOW} lex",
    "bm25_b_zero": f"with {_bm25_sql(_CORPUS, _ASKED, 10, b=0.0)} {_SHOW} lex",
    "bm25_doc_stats": f"with {_CORPUS} select id as chunk_id, dl from dl",
    "bm25_idf": f"with {_CORPUS} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df cross join st",
    "bm25_index_stats": f"with {_CORPUS} select n as n_chunks, (select count(*) from df) as n_terms, round(avgdl, 6) as avgdl, (select count(*) from p) as postings, (select count(*) from p) * 12 as bytes from st",
    "in_force_asof": f"select distinct chunk_id from chunks where {_FORCE}",
    "candidate_filter": "select distinct chunk_id from chunks where span.document_id = 'aster-floater-2024' and (coalesce(meta.is_table, false) or kind like 'table%')",
    "undated_supersession_count": "select count(distinct chunk_id) as n from chunks where meta.superseded_by is not null and meta.effective_to is null",
    "dense_topk": f"with {_dense_sql(10)} {_SHOW} den",
    "dense_topk_filtered": f"with {_dense_sql(10, 'b.label % 2 = 0')} {_SHOW} den",
    "dense_norm_check": "select vec_id, len(embedding) as dim, abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) <= 1e-3 as unit from embeddings",
    "rrf_topk": f"{_rrf_sql(1.0, 1.0)} {_SHOW} r",
    "rrf_weighted": f"{_rrf_sql(0.3, 0.7)} {_SHOW} r",
    "rerank_topk": f"""with {_bm25_sql(_DOCS, _DOC_ASKED, 30)}, qn as (select query_id, count(*) as m from q group by 1), o as (select lex.query_id, lex.id, count(p.term) / max(m)::double as score from lex join qn using (query_id) left join q on q.query_id = lex.query_id left join p on p.id = lex.id and p.term = q.term group by all),
        r as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from o) where rank <= 10) {_SHOW} r""",
    "confidence_coalesce": f"{_rrf_sql(1.0, 1.0)} select query_id, id, round(coalesce(case when rank <= 5 then score end, d, 0.0), 6) as confidence from r",
}
