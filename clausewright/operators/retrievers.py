"""What a retriever, a reranker, an embedder and a provider are, and those that this engine brings.

All work on sets: a retriever takes a table of questions (query_id, text) and gives a ranking
(query_id, rank, id, score) of at most k rows a question; a null or blank question has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as R

WIDE, ARM = 30, 3  # candidates of a reranker at least; how many times k each arm of a fusion is asked for


@runtime_checkable
class Retriever(Protocol):
    name: str

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame: ...


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, ranked: DataFrame, questions: DataFrame, k: int) -> DataFrame: ...


Embedder = Callable[[list[str]], list[list[float]]]  # runs on the workers, a batch at a time
Provider = Callable[[list[str]], list[str]]  # prompts to raw outputs, on the workers, a batch at a time


def embedded(texts: DataFrame, embedder: Embedder, prefix: str = "") -> DataFrame:
    """(id, embedding) of texts (id, text): batches go through the embedder with the prefix before each. A null text has none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"id": df["id"], "embedding": list(embedder([prefix + t for t in df["text"]]))})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.where("text is not null").select("id", "text").mapInPandas(rows, f"id {kind}, embedding array<float>")


def _none(questions: DataFrame, kind: str) -> DataFrame:
    return questions.sparkSession.createDataFrame([], f"query_id {questions.schema['query_id'].dataType.simpleString()}, id {kind}, score double, rank int")


@dataclass(frozen=True)
class NullRetriever:
    """Finds nothing: the floor of all measures."""

    name: str = "null"

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame:
        return _none(questions, "string")


@dataclass(frozen=True)
class FixedRetriever:
    """Gives every question the same ids in the same order."""

    ids: tuple[str, ...]
    name: str = "fixed"

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame:
        if not self.ids[:k]:
            return _none(questions, "string")
        given = F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.lit(x).alias("id"), F.lit(1.0 / (i + 1)).alias("score")) for i, x in enumerate(self.ids[:k])))
        got = questions.select("query_id").distinct().select("query_id", F.explode(given).alias("g")).select("query_id", "g.id", "g.score", "g.rank")
        return got if allow is None else got.join(allow, "id", "left_semi").select("query_id", "id", "score", "rank")


@dataclass(frozen=True)
class FailingRetriever:
    """Fails when its result is asked for: to test that a run takes errors as errors."""

    name: str = "failing"

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame:
        return questions.select("query_id", F.raise_error(F.lit("retriever failed")).cast("string").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))


@dataclass(frozen=True)
class LexicalRetriever:
    """BM25 over texts (id, text). Every id of the index must have a text: null texts are an error if `strict`."""

    texts: DataFrame
    name: str = "bm25"
    strict: bool = False

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame:
        if self.strict and not self.texts.where("id is not null and text is null").isEmpty():
            raise ValueError("texts are missing for some ids of the index")
        return R.bm25_blocks(R.doc_terms(self.texts, "id", "text"), questions, k, allow=allow)


@dataclass(frozen=True)
class DenseRetriever:
    """Exact nearest vectors (id, embedding). Questions come with their vector in `q`, or are embedded."""

    vectors: DataFrame
    embedder: Embedder | None = None
    prefix: str = ""
    name: str = "dense"

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame:
        asked = questions
        if "q" not in questions.columns:
            if self.embedder is None:
                raise ValueError("questions without vectors need an embedder")
            asked = embedded(questions.select(F.col("query_id").alias("id"), "text").where("trim(text) <> ''"), self.embedder, self.prefix).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
        kept = self.vectors if allow is None else self.vectors.join(allow.select("id").distinct(), "id", "left_semi")
        return R.dense(kept, asked, "id", "embedding", k)


@dataclass(frozen=True)
class FusedRetriever:
    """Reciprocal rank fusion of other retrievers, each asked for three times k."""

    arms: tuple[Retriever, ...]
    weights: tuple[float, ...] = ()
    constant: int = R.RRF_K
    name: str = "fused"

    def __post_init__(self) -> None:
        if not self.arms or self.constant <= 0 or self.weights and len(self.weights) != len(self.arms):
            raise ValueError("fusion needs an arm, a weight for each and a positive constant")

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame:
        weights = self.weights or (1.0,) * len(self.arms)
        return R.fuse([(a.retrieve(questions, ARM * k, allow), w) for a, w in zip(self.arms, weights)], k, self.constant)


@dataclass(frozen=True)
class OverlapReranker:
    """The share of a question's words that a text has; stands where a model would be."""

    texts: DataFrame

    def rerank(self, ranked: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        return R.rerank(ranked, questions, R.doc_terms(self.texts, "id", "text"), k)


@dataclass(frozen=True)
class ScoringReranker:
    """Pairs of question and text through a scorer on the workers, a batch at a time."""

    texts: DataFrame
    scorer: Callable[[list[str], list[str]], list[float]] = field(repr=False)

    def rerank(self, ranked: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        scorer = self.scorer
        pairs = ranked.select("query_id", "id").join(questions.select("query_id", F.col("text").alias("asked")), "query_id").join(self.texts.select("id", "text").dropDuplicates(["id"]), "id")

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                yield pd.DataFrame({"query_id": df["query_id"], "id": df["id"], "score": [float(s) for s in scorer(df["asked"].fillna("").tolist(), df["text"].fillna("").tolist())]})

        kinds = {c: ranked.schema[c].dataType.simpleString() for c in ("query_id", "id")}
        return R.top(pairs.select("query_id", "id", "asked", "text").mapInPandas(rows, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k)


@dataclass(frozen=True)
class RerankingRetriever:
    """Asks wide, at least for WIDE, and returns the k that the reranker puts first."""

    inner: Retriever
    reranker: Reranker
    name: str = "reranked"

    def retrieve(self, questions: DataFrame, k: int = 10, allow: DataFrame | None = None) -> DataFrame:
        return self.reranker.rerank(self.inner.retrieve(questions, max(WIDE, k), allow), questions, k)
