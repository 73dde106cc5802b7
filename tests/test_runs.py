"""Evaluation runs: behaviour, verdicts, aggregates, gate, composition, report."""

import pytest
from pyspark.sql import functions as F

from clausewright.operators import answers as A
from clausewright.operators import runs as N

ITEM = "item_id string, question string, strata string, authored_by string, expected_behaviour string, injection_canary string, must_not_cite array<string>, expected_to_fail boolean"
RESULT = "result_id string, run_id string, item_id string, abstained boolean, answer string, citations array<int>, wall_ms double, input_tokens bigint, output_tokens bigint"
PASSAGE = "item_id string, rank int, chunk_id string, document_id string, clause_id string"


def items(spark):
    return spark.createDataFrame([
        ("a", "q a", "flat_lookup", "human", "answer", None, [], False), ("u", "q u", "unanswerable", "human", "abstain", None, None, False), ("i", "q i", "injection", "seed_unverified", "ignore_injection", " HAHA ", [], False),
        ("c", "q c", "contradictory", "human", "surface_conflict", None, [], False), ("s", "q s", "supersession", "human", "answer", None, ["old#4.2", "older"], True), ("e", "q e", "eligibility", "llm_verified", "answer", None, [], False),
    ], ITEM)


def passages(spark):
    return spark.createDataFrame([(i, r, f"{i}{r}", "old" if i == "s" else f"d{r}", "4.2.b" if i == "s" else "1") for i in "auicse" for r in (1, 2)], PASSAGE)


def results(spark, rows):
    return spark.createDataFrame([(f"{r}-{i}", r, i, ab, ans, c, 10.0 * n, 1, 2) for n, (r, i, ab, ans, c) in enumerate(rows)], RESULT)


def checked(spark, rows):
    return {r["item_id"]: r for r in N.behaviour(items(spark), results(spark, rows), passages(spark)).collect()}


def test_behaviour_of_each_kind(spark):
    got = checked(spark, [("r", "a", False, "x", [1, 3]), ("r", "u", True, None, None), ("r", "i", False, "so haha it is", [1]), ("r", "c", False, "x", [1, 2]), ("r", "s", False, "x", [2]), ("r", "e", None, None, None)])
    assert got["a"]["grounded"] is False and got["a"]["hard_failure"] and got["a"]["abstained_wrongly"] is False
    assert got["u"]["abstained_correctly"] is True and got["u"]["grounded"] is None and got["u"]["hard_failure"] is False
    assert got["i"]["injection_resisted"] is False and got["i"]["hard_failure"]
    assert got["c"]["conflict_surfaced"] is True and got["c"]["without_citations"] is False
    assert got["s"]["violations"] == 1 and got["s"]["hard_failure"]
    assert got["e"]["hard_failure"] is None and got["e"]["without_citations"] is None
    none = checked(spark, [("r", "a", False, "x", []), ("r", "c", False, "x", None)])
    assert none["a"]["grounded"] and none["a"]["without_citations"] and none["c"]["conflict_surfaced"] is False


def judged(spark, rows):
    scores = spark.createDataFrame([(i, 1.0, 0.5, 1.0, 1.0, 1.0) for i in "aise"] + [("u", None, None, None, None, None), ("c", 0.0, 0.0, 0.0, 0.0, 0.0)], "item_id string, recall double, precision double, mrr double, ndcg double, hit_rate double")
    return N.verdicts(N.behaviour(items(spark), results(spark, rows), passages(spark)), scores)


ROWS = [("r", "a", False, "x", [1]), ("r", "u", True, None, None), ("r", "i", False, "no", [1]), ("r", "c", True, None, None), ("r", "s", False, "x", []), ("r", "e", None, None, None)]


def test_expectations_and_aggregate(spark):
    j = judged(spark, ROWS)
    assert {r["item_id"]: r["expectation"] for r in j.collect()} == {"a": "passed", "u": "passed", "i": "passed", "c": "failed", "s": "fixed", "e": "failed"}
    agg = {(r["slice"], r["name"]): r for r in N.aggregates(j).collect()}
    whole = agg["all", ""]
    assert (whole["n_items"], whole["errors"], whole["n_scored"], whole["n_skipped"], whole["passed"], whole["failed"], whole["fixed"], whole["failed_as_expected"]) == (6, 1, 4, 1, 3, 2, 1, 0)
    assert whole["false_abstention_rate"] == 0.25 and whole["abstain_recall"] == 1.0 and whole["expected_cost"] == 1 and whole["p95_agentic_ms"] is None and whole["p95_flat_ms"] == 40.0
    assert agg["stratum", "eligibility"]["errors"] == 1 and agg["author", "human"]["n_items"] == 4
    gate = {r["check"]: r["passed"] for r in N.gate_rows(N.aggregates(j)).collect()}
    assert gate["min_recall_at_k"] and gate["max_supersession_violations"] and not gate["p95_agentic_ms"]
    floor = {r["check"]: r["passed"] for r in N.gate_rows(N.aggregates(j), "v0_floor").collect()}
    assert not floor["exact_recall"]
    text = N.report(N.aggregates(j), N.gate_rows(N.aggregates(j)), N.warnings(items(spark), N.aggregates(j)))
    assert "| r | 6 | 4 | 1 |" in text and "p95_agentic_ms" in text and "unverified_items (1)" in text
    assert N.aggregates(judged(spark, [])).count() == 0


def test_profiles_are_checked():
    assert N.profile()["gate"]["min_recall_at_k"] == 0.4
    with pytest.raises(KeyError):
        N.profile("none")
    with pytest.raises(ValueError):
        N.profile("x", {"x": {"gate": {"min_fun": 1}}})


def test_rank_percentile_by_hand(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 5.0), ("b", None), ("c", None)], "g string, v double")
    got = {r["g"]: r["p"] for r in N.rank_percentile(df, ["g"], "v", 95, "p").collect()}
    assert got == {"a": 20.0, "b": 5.0}


def test_composition(spark):
    assert {r["target"] for r in N.shortfall(items(spark)).collect()} == {"total", "human_authored", "unanswerable", "injection", "supersession", "seed_unverified"}
    assert {r["stratum"] for r in N.coverage_gaps(items(spark)).collect()} == set(N.STRATA) - {"flat_lookup", "unanswerable", "injection", "contradictory", "supersession", "eligibility"}
    assert N.coverage_gaps(items(spark).where("false")).count() == len(N.STRATA)


def test_provider_replies_and_errors(spark):
    rows = [("ok", '{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}],"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":2}}'), ("blocked", '{"promptFeedback":{"blockReason":"X"}}'), ("none", "{}"), ("safety", '{"candidates":[{"finishReason":"SAFETY"}]}'), ("cut", '{"candidates":[{"finishReason":"MAX_TOKENS"}]}'), ("part", '{"candidates":[{"finishReason":"MAX_TOKENS","content":{"parts":[{"text":"a"}]}}]}'), ("junk", "no json"), ("null", None)]
    got = {r["k"]: r["r"] for r in spark.createDataFrame(rows, "k string, b string").select("k", A.reply(F.col("b")).alias("r")).collect()}
    assert got["ok"]["text"] == "ab" and got["ok"]["input_tokens"] == 3 and got["ok"]["error"] is None and got["ok"]["finish"] == "STOP"
    assert [got[k]["error"] for k in ("blocked", "none", "safety", "cut", "part", "junk", "null")] == ["safety_blocked", "malformed", "safety_blocked", "malformed", None, "malformed", "malformed"]
    assert got["part"]["truncated"] and got["part"]["text"] == "a"
    day = '{"error":{"details":[{"@type":"x/QuotaFailure","violations":[{"quotaId":"RequestsPerDay"}]}]}}'
    wait = '{"error":{"details":[{"@type":"x/RetryInfo","retryDelay":"7.5s"}]}}'
    e = spark.createDataFrame([(429, None, day), (429, None, wait), (429, "3", wait), (503, None, None), (403, None, None), (404, "soon", "x"), (200, None, None)], "s int, h string, b string")
    kinds = e.select(A.error_kind(F.col("s"), F.col("b")), A.retry_after(F.col("h"), F.col("b")), A.daily_quota(F.col("b"))).collect()
    assert [r[0] for r in kinds] == ["unknown", "rate_limited", "rate_limited", "transport", "provider_suspended", "unknown", None]
    assert [r[1] for r in kinds] == [None, 7.5, 3.0, None, None, None, None] and [r[2] for r in kinds] == [True] + [False] * 6
    w = spark.createDataFrame([("transport", 1, None), ("transport", 3, None), ("rate_limited", 9, None), ("rate_limited", 1, 5.0), ("unknown", 1, None)], "k string, a int, s double")
    assert [r[0] for r in w.select(A.retry_wait(F.col("k"), F.col("a"), F.col("s"), F.lit(0.0))).collect()] == [0.25, 1.0, 90.0, 6.0, None]
    assert [r[0] for r in spark.createDataFrame([("transport",), ("new",), (None,)], "k string").select(A.abstain_reason(F.col("k"))).collect()] == ["service_degraded", "generation_unavailable", None]


def test_judge_outputs(spark):
    rows = [('```json\n{"support": [true, "no", "YES"], "responsive": "true", "reason": "r"}\n```', 3), ('text {"support": "1", "responsive": true} text', 2), ('{"responsive": false}', 1), ("[1]", 1), ("broken {", 1), (None, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, n int").select(A.verdict(F.col("t"), F.col("n"))).collect()]
    assert (list(got[0]["support"]), got[0]["responsive"], got[0]["reason"], got[0]["read"]) == ([True, False, True], True, "r", True)
    assert list(got[1]["support"]) == [True, True] and got[2]["read"] and list(got[2]["support"]) == [] and not got[2]["responsive"]
    assert [g["read"] for g in got[3:]] == [False, False, False]


def test_outputs_are_never_lost(spark):
    rows = [(1, '{"answer": "x", "citations": [1]}'), (2, "```json\n[1]\n```"), (3, "{"), (4, ""), (5, None), (6, "  ")]
    got = [r[0] for r in spark.createDataFrame(rows, "i int, t string").orderBy("i").select(A.parse_status(F.col("t"))).collect()]
    assert got == ["object", "other", "broken", "missing", "missing", "missing"]


def test_engines(spark):
    got = {r["item_id"]: r["confidence"] for r in A.engine(items(spark), "retrieval", spark.createDataFrame([("a", 1, 0.4), ("a", 2, 0.9)], "item_id string, rank int, confidence double")).collect()}
    assert got == {"a": 0.4, **dict.fromkeys("uicse", 0.0)}
    with pytest.raises(ValueError):
        A.engine(items(spark), "other")


def test_floors_retrieve_nothing(spark, tmp_path, monkeypatch):
    from clausewright.operators import retrieval as R
    from clausewright.plans import answering

    span = "array<struct<document_id: string, page: int, clause_id: string>>"
    spark.createDataFrame([("a", "q a", "answer", None, "s", "human", None, False, [("d", 1, "4")]), ("u", "q u", "abstain", None, "s", "human", None, False, None)], f"id string, question string, expected_behaviour string, injection_canary string, strata string, authored_by string, must_not_cite array<string>, expected_to_fail boolean, ground_truth_spans {span}").write.parquet(f"{tmp_path}/golden.parquet")
    spark.createDataFrame([("c", "q a", ("d", 1, "4"), ([],))], "chunk_id string, text string, span struct<document_id: string, page: int, clause_id: string>, meta struct<clause_ids: array<string>>").write.parquet(f"{tmp_path}/chunks.parquet")
    monkeypatch.setattr(R, "bm25_blocks", lambda *a, **k: pytest.fail("questions were ranked"))
    got = {r["run_id"]: r for r in answering.floor_aggregate(spark, str(tmp_path)).collect()}
    assert (got["null"]["n_items"], got["null"]["recall"], got["null"]["abstain_recall"], got["echo"]["unsupported_answer_rate"], got["echo"]["expected_cost"]) == (2, 0.0, 1.0, 1.0, 50)


def test_results_are_judged_once(spark, monkeypatch):
    from clausewright.plans import runs

    monkeypatch.setattr(runs, "_judged", lambda s, sf: judged(s, ROWS).withColumn("rows_read", F.monotonically_increasing_id()))
    got = runs._measured(spark, "")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # a checkpoint, which no user plans anew
    assert sorted(map(repr, got.collect())) == sorted(map(repr, N.aggregates(judged(spark, ROWS)).collect()))
