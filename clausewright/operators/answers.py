"""Answers: raw output parse, citation membership, judge verdicts, outcome, cost, prompts, limits."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_declined, strip_fence

RAW = "struct<can_answer:string,confidence:string,answer:string,citations:array<int>,reasoning:string>"
# Prices per million tokens in USD, input and output.
PRICES = [("flash-free", "0", "0"), ("flash-paid", "0.10", "0.40"), ("haiku", "1.00", "5.00"), ("local", "0", "0")]


FENCE = re.compile(r"^\s*```(?:json)?\s*(.*?)\s*```\s*$", re.S)


def parsed(raw: Column) -> Column:
    """The raw output as a struct; fences are stripped, booleans and numbers may be strings, broken output is null."""
    return F.when(parse_status(raw) == "object", F.from_json(strip_fence(raw), RAW, {"mode": "PERMISSIVE"}))


def parse_status(raw: Column) -> Column:
    """missing (null or blank), object, other (JSON of another kind) or broken."""
    body = F.trim(strip_fence(raw))
    value = F.try_parse_json(body)
    return F.when(raw.isNull() | F.coalesce(body == "", F.lit(True)), "missing").when(value.isNull(), "broken").when(F.schema_of_variant(value).startswith("OBJECT"), "object").otherwise("other")


def is_object(raw: str | None) -> bool:
    """parse_status of one output on a worker: whether it is a JSON object, fenced or not."""
    if raw is None:
        return False
    try:
        return isinstance(json.loads(FENCE.sub(r"\1", raw)), dict)
    except ValueError:
        return False


# Why an answer is withheld, by what went wrong with the provider.
REASONS = {"rate_limited": "generation_unavailable", "transport": "service_degraded", "safety_blocked": "generation_blocked", "malformed": "malformed_generation", "not_configured": "generation_not_configured", "provider_suspended": "generation_forbidden", "unknown": "generation_unavailable"}
BASE_DELAY = {"transport": 0.25, "rate_limited": 20.0}  # seconds; other errors are not tried again


def abstain_reason(error: Column) -> Column:
    """Why an answer is withheld after an error of a kind; an unlisted kind counts as unavailable, none as null."""
    named = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    return F.when(error.isNotNull(), F.coalesce(named[error], F.lit("generation_unavailable")))


_FAILURE = "struct<error:struct<details:array<struct<`@type`:string,retryDelay:string,violations:array<struct<quotaId:string>>>>>>"
_REPLY = "struct<candidates:array<struct<finishReason:string,content:struct<parts:array<struct<text:string>>>>>,promptFeedback:struct<blockReason:string>,usageMetadata:struct<promptTokenCount:int,candidatesTokenCount:int>,modelVersion:string>"


def daily_quota(body: Column) -> Column:
    """Whether an error body names a quota of a day, which no waiting within a run outlasts."""
    details = F.from_json(body, _FAILURE)["error"]["details"]
    return F.coalesce(F.exists(details, lambda d: d["@type"].endswith("QuotaFailure") & F.exists(d["violations"], lambda v: F.contains(v["quotaId"], F.lit("PerDay")))), F.lit(False))


def retry_after(header: Column, body: Column) -> Column:
    """Seconds that the server asks to wait: the header if it is a number, else the first delay in the body, else null."""
    delays = F.transform(F.from_json(body, _FAILURE)["error"]["details"], lambda d: F.when(d["retryDelay"].endswith("s"), F.regexp_replace(d["retryDelay"], "s$", "").try_cast("double")))
    return F.coalesce(header.try_cast("double"), F.get(F.filter(delays, lambda x: x.isNotNull()), F.lit(0)))


def error_kind(status: Column, body: Column) -> Column:
    """The kind of an HTTP error; null below 400."""
    return F.when(status < 400, F.lit(None)).when(status.isin(401, 403), "provider_suspended").when(status == 429, F.when(daily_quota(body), "unknown").otherwise("rate_limited")).when(status >= 500, "transport").otherwise("unknown")


def reply(body: Column) -> Column:
    """(text, finish, truncated, input_tokens, output_tokens, error) of a provider's body. A blocked prompt or
    response, no candidate, and a cut before any text are errors, never empty answers."""
    r = F.from_json(body, _REPLY)
    first = F.get(r["candidates"], F.lit(0))
    finish = F.when(first.isNotNull(), F.coalesce(first["finishReason"], F.lit("STOP")))
    text = F.coalesce(F.array_join(F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit(""))
    error = (
        F.when(first.isNull() & r["promptFeedback"]["blockReason"].isNotNull(), "safety_blocked").when(first.isNull(), "malformed").when(finish == "SAFETY", "safety_blocked").when((finish == "MAX_TOKENS") & (F.trim(text) == ""), "malformed")
    )
    use = r["usageMetadata"]
    return F.struct(F.when(error.isNull(), text).alias("text"), finish.alias("finish"), F.coalesce(finish == "MAX_TOKENS", F.lit(False)).alias("truncated"), F.coalesce(use["promptTokenCount"], F.lit(0)).alias("input_tokens"), F.coalesce(use["candidatesTokenCount"], F.lit(0)).alias("output_tokens"), error.alias("error"))


def retry_wait(kind: Column, attempt: Column, server: Column, jitter: Column, most: float = 90.0) -> Column:
    """Seconds before the next attempt: a second more than the server asks, else a base doubled with every
    attempt, then lengthened by `jitter` (0 to 0.5); null for errors that are not tried again."""
    base = F.create_map(*(F.lit(x) for kv in BASE_DELAY.items() for x in kv))[kind]
    return F.when(base.isNotNull(), F.when(server.isNotNull(), F.least(server + 1, F.lit(most))).otherwise(F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(most)) * (1 + jitter)))


def verdict(raw: Column, cited: Column) -> Column:
    """(support, responsive, reason, read) of a judge's output: fence stripped, the object within other
    text found, yes and 1 taken as true, a lone support repeated for every citation. An output without
    an object is not read."""
    body = strip_fence(F.trim(raw))
    found = F.when(F.try_parse_json(body).isNotNull(), body).otherwise(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")))
    value = F.try_parse_json(found)
    read = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    yes = lambda c: F.coalesce(F.lower(F.trim(c)).isin("true", "yes", "1"), F.lit(False))
    many = F.try_variant_get(value, "$.support", "array<string>")
    one = F.try_variant_get(value, "$.support", "string")
    support = F.when(many.isNotNull(), F.transform(many, yes)).when(one.isNotNull(), F.array_repeat(yes(one), F.greatest(cited, F.lit(1)))).otherwise(F.array().cast("array<boolean>"))
    return F.struct(F.when(read, support).otherwise(F.array().cast("array<boolean>")).alias("support"), (read & yes(F.try_variant_get(value, "$.responsive", "string"))).alias("responsive"), F.when(read, F.substring(F.coalesce(F.try_variant_get(value, "$.reason", "string"), F.lit("")), 1, 300)).otherwise("").alias("reason"), read.alias("read"))


def engine(items: DataFrame, name: str, passages: DataFrame | None = None) -> DataFrame:
    """(item_id, engine, abstained, reason, answer, confidence) of the engines without a model: `null`
    withholds every answer, `echo` gives the question back without a citation, `retrieval` withholds
    with the confidence of the best passage (item_id, rank, confidence), 0 without one."""
    if name == "null":
        made = (F.lit(True), F.lit("not_implemented"), F.lit(None).cast("string"), F.lit(0.0))
    elif name == "echo":
        made = (F.lit(False), F.lit(None).cast("string"), F.concat(F.lit("You asked: "), F.coalesce("question", F.lit(""))), F.lit(1.0))
    elif name == "retrieval" and passages is not None:
        items = items.join(passages.where("rank = 1").select("item_id", F.col("confidence").alias("best")), "item_id", "left")
        made = (F.lit(True), F.lit("generation_unavailable"), F.lit(None).cast("string"), F.coalesce("best", F.lit(0.0)))
    else:
        raise ValueError(f"no engine {name!r}")
    return items.select("item_id", F.lit(name).alias("engine"), *(c.alias(n) for c, n in zip(made, ("abstained", "reason", "answer", "confidence"))))


def bad_citations(citations: Column, n: Column) -> Column:
    return F.filter(F.coalesce(citations, F.array().cast("array<int>")), lambda c: c.isNull() | (c < 1) | (c > n))


def judge_abstains(parsed_ok: Column, responsive: Column, support: Column) -> Column:
    """Not responsive, or no passage supports; never if the verdict could not be read."""
    none = ~F.exists(F.coalesce(support, F.array().cast("array<boolean>")), lambda s: F.coalesce(s, F.lit(False)))
    return F.coalesce(parsed_ok, F.lit(False)) & (~F.coalesce(responsive, F.lit(False)) | none)


def judge_abstains_strict(parsed_ok: Column, responsive: Column, support: Column) -> Column:
    every = F.forall(F.coalesce(support, F.array().cast("array<boolean>")), lambda s: F.coalesce(s, F.lit(False)))
    return F.coalesce(parsed_ok, F.lit(False)) & (~F.coalesce(responsive, F.lit(False)) | ~every)


def verified(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, candidates, cited, unfounded): how many passages the answer had, how many different ones
    it cites, and how many entries name none. answers: answer_id, item_id, citations; passages: item_id,
    rank, chunk_id."""
    n = passages.groupBy("item_id").agg(F.count("*").alias("candidates"))
    cites = answers.select("answer_id", "item_id", F.explode("citations").alias("rank")).join(passages.select("item_id", "rank", "chunk_id"), ["item_id", "rank"], "left")
    per = cites.groupBy("answer_id").agg(F.countDistinct("chunk_id").alias("cited"), F.count_if(F.col("chunk_id").isNull()).alias("unfounded"))
    both = answers.select("answer_id", "item_id").join(n, "item_id", "left").join(per, "answer_id", "left")
    return both.select("answer_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "cited", "unfounded")))


def outcome(candidates: Column, error: Column, ungrounded: Column, answer: Column) -> Column:
    """The decision ladder, first hit: no candidates, provider error, ungrounded citation, declined, answered."""
    return F.when(candidates == 0, "no_candidates").when(error.isNotNull(), abstain_reason(error)).when(ungrounded > 0, "malformed_generation").when(is_declined(answer), "low_confidence").otherwise("answered")


def prompts(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, prompt): numbered passages between marks, in rank order, then the question. A question
    without passages has none. passages: item_id, rank, document_id, page, clause_id, text."""
    where = F.concat_ws(", ", "document_id", F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("None"))), F.concat(F.lit("clause "), "clause_id"))
    n = F.col("rank").cast("string")
    block = F.concat(F.lit("<<<PASSAGE "), n, F.lit(" | "), where, F.lit(">>>\n["), n, F.lit("] "), F.coalesce("text", F.lit("")), F.lit("\n<<<END PASSAGE "), n, F.lit(">>>"))
    bodies = passages.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    return bodies.join(questions, "item_id").select("item_id", F.concat(F.lit("PASSAGES:\n\n"), "body", F.lit("\n\nQUESTION: "), "question").alias("prompt"))


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, input, output, usd) in exact decimals; an unknown model costs null, so that it is seen."""
    total = usage.groupBy("model").agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    each = lambda n, rate: F.col(n).cast("decimal(14,0)") * F.col(rate).cast("decimal(10,6)")
    usd = (each("input", "in_rate") + each("output", "out_rate")) * F.lit(Decimal("0.000001"))
    return total.join(F.broadcast(prices), "model", "left").select("model", "input", "output", usd.alias("usd"))  # the price list


def rate_limit(events: DataFrame, most: int = 20, seconds: int = 60) -> DataFrame:
    """(event_id, accepted). Calls are folded in order within a user's session: a gap of `seconds`
    empties the window, so sessions are independent and a busy user is spread over tasks."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") >= seconds, F.lit(True))
    calls = events.where("user_id is not null and ts is not null").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("s", F.sum(gap.cast("int")).over(w))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, kept = None, []
        for df in batches:
            out = []
            for u, k, t in zip(df["user_id"], df["s"], df["ts"]):
                if (u, k) != session:
                    session, kept = (u, k), []
                now = t.timestamp()
                kept = [x for x in kept if x > now - seconds]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(now)
            yield pd.DataFrame({"event_id": df["event_id"], "accepted": out})

    ordered = calls.repartition("user_id", "s").sortWithinPartitions("user_id", "s", "ts", "event_id")
    return ordered.mapInPandas(fold, "event_id bigint, accepted boolean")
