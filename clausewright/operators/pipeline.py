"""Questions to answers in stages: retrieve, ask a provider, read its output, verify citations, decide.

Each stage is a table, so a run over many questions is one plan and its parallelism that of the
partitions. A provider that fails fails for its row only: the error is a column, not the end of a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers as A
from .retrievers import Provider, Retriever

REPAIRS = 1  # further attempts after an output that is no object


def generated(prompts: DataFrame, provider: Provider, repairs: int = REPAIRS) -> DataFrame:
    """(item_id, raw, error, attempts) of prompts (item_id, prompt). An output that is not a JSON object is
    asked for again with what was said, at most `repairs` times; then the error is `malformed`. A provider
    that raises gives the kind of its `kind` attribute, else `unknown`."""

    def one(prompt: str) -> tuple[str | None, str | None, int]:
        ask, raw = prompt, None
        for attempt in range(1, repairs + 2):
            try:
                raw = provider([ask])[0]
            except Exception as e:  # noqa: BLE001 - whatever a provider raises is this row's error
                return None, str(getattr(e, "kind", "unknown")), attempt
            if A.is_object(raw):
                return raw, None, attempt
            ask = f"{prompt}\n\nThe reply before this was not valid JSON:\n{(raw or '')[:500]}\n\nReply with JSON only."
        return raw, "malformed", repairs + 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            try:
                first = list(provider(df["prompt"].tolist()))
            except Exception:  # noqa: BLE001 - then each row for itself
                first = [None] * len(df)
            got = [(raw, None, 1) if A.is_object(raw) else one(p) for raw, p in zip(first, df["prompt"])]
            yield pd.DataFrame({"item_id": df["item_id"], "raw": [g[0] for g in got], "error": [g[1] for g in got], "attempts": [g[2] for g in got]})

    return prompts.select("item_id", "prompt").mapInPandas(rows, "item_id string, raw string, error string, attempts int")


def answered(questions: DataFrame, retriever: Retriever, passages: DataFrame, provider: Provider, k: int = 10) -> DataFrame:
    """(item_id, decision, answer, citations, confidence, attempts): one row per question.

    questions: item_id, question; passages: chunk_id, document_id, page, clause_id, text, the texts that
    the retriever's ids name. The decision is the first that holds: no candidates, the reason of a
    provider's error, a citation that names no passage, a declined answer, answered. Only an answered
    question has an answer and citations (chunk ids, each once)."""
    asked = questions.where("item_id is not null").dropDuplicates(["item_id"])
    ranked = retriever.retrieve(asked.select(F.col("item_id").alias("query_id"), F.col("question").alias("text")), k)
    found = ranked.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("chunk_id"), "score").join(passages.dropDuplicates(["chunk_id"]), "chunk_id")
    said = generated(A.prompts(found, asked.select("item_id", "question")), provider)
    read = said.select("item_id", "error", "attempts", A.parsed(F.col("raw")).alias("p")).select("item_id", "error", "attempts", F.col("p.answer").alias("answer"), F.col("p.citations").alias("citations"))
    checked = A.verified(read.select(F.col("item_id").alias("answer_id"), "item_id", "citations"), found)
    best = found.groupBy("item_id").agg(F.max("score").alias("confidence"), F.count("*").alias("n"))
    both = asked.select("item_id").join(best, "item_id", "left").join(read, "item_id", "left").join(checked.select(F.col("answer_id").alias("item_id"), "unfounded"), "item_id", "left")
    decision = A.outcome(F.coalesce("n", F.lit(0)), F.col("error"), F.coalesce("unfounded", F.lit(0)), F.col("answer"))
    cited = read.select("item_id", F.explode(F.array_distinct("citations")).alias("rank")).join(found.select("item_id", "rank", "chunk_id"), ["item_id", "rank"]).groupBy("item_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("cited"))
    done = both.withColumn("decision", decision).join(cited, "item_id", "left")
    only = lambda c: F.when(F.col("decision") == "answered", c)
    return done.select("item_id", "decision", only(F.trim("answer")).alias("answer"), only(F.coalesce("cited", _empty())).alias("citations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def _empty() -> Column:
    return F.array().cast("array<string>")
