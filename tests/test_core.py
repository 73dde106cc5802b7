import datetime as dt
import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import answers, documents, evaluation, retrieval
from clausewright.operators.components import connected_components
from clausewright.operators.history import source_periods

SNAP = "source_id string, snapshot_date date, version_label string, effective_from date, effective_to date, superseded_by string, withdrawn boolean, loaded_at timestamp, extra string"
day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=90 * n)


def snaps(spark, states, missing=()):
    rows = [("s", day(i), None if x == "gone" else x, None, None, None, x == "gone", dt.datetime(2024, 1, 1), "x") for i, x in enumerate(states) if i not in missing]
    return spark.createDataFrame(rows, SNAP)


def periods(df):
    return sorted((r["valid_from"], r["valid_to"]) for r in source_periods(df).collect())


def test_periods_follow_states_gaps_and_withdrawals(spark):
    assert periods(snaps(spark, ["a", " A ", "b", "a", "gone", "a"])) == [(day(0), day(2)), (day(2), day(3)), (day(3), day(4)), (day(5), None)]
    assert periods(snaps(spark, ["a", "a", "a"], missing={1})) == [(day(0), None)]
    assert periods(snaps(spark, ["gone", "gone"])) == []
    assert periods(snaps(spark, ["", None, "  "])) == [(day(0), None)]
    assert periods(snaps(spark, [])) == []


def test_periods_longer_than_a_word(spark):
    states = ["a"] * 150 + ["b"] * 62 + ["a"]
    assert periods(snaps(spark, states)) == [(day(0), day(150)), (day(150), day(212)), (day(212), None)]


def test_last_load_counts_and_repeats_do_not(spark):
    a, b = snaps(spark, ["a", "a"]), snaps(spark, ["b", "b"]).withColumn("loaded_at", F.lit("2025-01-01").cast("timestamp"))
    rows = list(source_periods(a.unionByName(b).unionByName(b)).collect())
    assert [(r["valid_from"], r["state"]["f0"]) for r in rows] == [(day(0), "b")]


def test_components_chain_star_and_empty(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(5, 5), (7, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(9)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("c1", "waiting period for cataract surgery"), ("c2", "cataract surgery is covered after the waiting period ends"), ("c3", "maternity expenses are excluded"), (None, "x y")], "id string, text string")
    terms = retrieval.doc_terms(docs, "id", "text")
    posts, stats = retrieval.postings(terms), retrieval.corpus_stats(terms)
    q = spark.createDataFrame([("q1", "cataract"), ("q2", "cataract cataract"), ("q3", "dental"), ("q4", None)], "query_id string, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25(posts, stats, q).collect()}
    assert got == pytest.approx({("q1", "c1"): 0.5081120316170116, ("q1", "c2"): 0.3836764320373352, ("q2", "c1"): 0.5081120316170116, ("q2", "c2"): 0.3836764320373352})
    flat = retrieval.bm25(posts, stats, q.where("query_id = 'q1'"), b=0.0).collect()
    assert [r["score"] for r in flat] == pytest.approx([math.log(1.6)] * 2)


def test_dense_and_fusion_by_hand(spark):
    v = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.70710678, 0.70710678]), ("d", None)], "id string, v array<float>")
    q = spark.createDataFrame([("n", [0.0, 1.0])], "query_id string, q array<float>")
    got = retrieval.dense(v, q, "id", "v", 2).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 4)) for r in got] == [("a", 1.0), ("c", 0.7071)]
    arm = lambda ids: spark.createDataFrame([("q", x, 1.0, i + 1) for i, x in enumerate(ids)], "query_id string, id string, score double, rank int")
    fused = retrieval.fuse([(arm("ab"), 1.0), (arm("cb"), 1.0)]).orderBy("rank").collect()
    assert [r["id"] for r in fused] == ["b", "a", "c"] and fused[0]["score"] == pytest.approx(2 / 62)
    with pytest.raises(ValueError):
        retrieval.fuse([])


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("i", r + 1, "d1", c, None) for r, c in enumerate(["9.9", "4.2", "8.8", "2.1", "7.7"])] + [("j", r + 1, "d1", "4.2", None) for r in range(3)], "item_id string, rank int, document_id string, clause_id string, page int")
    truths = spark.createDataFrame([("i", 0, "d1", "4.2", None), ("i", 1, "d1", "2.1", None), ("j", 0, "d1", "4.2.b", None), ("e", 0, "d1", "4.2", None)], "item_id string, truth_idx int, document_id string, clause_id string, page int")
    items = spark.createDataFrame([("i",), ("j",), ("e",), ("none",)], "item_id string")
    got = {r["item_id"]: r for r in evaluation.ranking_scores(items, ranked, truths, 5).collect()}
    assert got["i"]["ndcg"] == pytest.approx(0.650921, abs=1e-6) and got["i"]["mrr"] == 0.5 and got["i"]["recall"] == 1.0 and got["i"]["precision"] == 0.4
    assert got["j"]["ndcg"] == 1.0
    assert [got["e"][m] for m in ("recall", "precision", "mrr", "ndcg", "hit_rate")] == [0.0] * 5
    assert [got["none"][m] for m in ("recall", "precision", "mrr", "ndcg", "hit_rate")] == [None] * 5


def test_span_rules_and_kappa(spark):
    df = spark.createDataFrame([("4.2", 1, "4.2.b", 9), ("4.21", 1, "4.2", 9), (None, 7, "4.2", 7), (None, None, "4.2", 7)], "c string, p int, t string, q int")
    assert [r[0] for r in df.select(evaluation.span_match(F.col("c"), F.col("p"), F.col("t"), F.col("q"))).collect()] == [True, False, True, False]
    r = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [1, 0, 0, 0, 1])), "h int, j int")
    k = evaluation.cohens_kappa(r, "h", "j").first()
    assert (k["po"], round(k["pe"], 6), round(k["kappa"], 6)) == (0.8, 0.48, 0.615385)
    assert evaluation.cohens_kappa(r.where("h = 1 and j = 1"), "h", "j").first()["kappa"] == 0.0


def test_text_functions(spark):
    df = spark.createDataFrame([("Rs 1,200² “x” – a​b",)], "t string")
    assert df.select(T.normalise(F.col("t"))).first()[0] == 'Rs 1,200 "x" - ab'
    c = spark.createDataFrame([("Code Excl 2",), ("definition: Hospital Cash",), ("Section II. 15.",), ("4.2.B",), ("??",), (None,)], "t string")
    assert [r[0] for r in c.select(T.canonical_clause(F.col("t"))).collect()] == ["excl.02", "def.hospital_cash", "II.15", "4.2.b", None, None]


def test_blocks_of_prose():
    page = "5. Exclusions apply as follows:\nA. " + "x" * 57 + "\nB. " + "y" * 297 + "\nC. " + "z" * 57
    assert [len(t) for _, _, t in documents.blocks(page, 130)] == [92, 300, 60]
    text = "I - DEFINITIONS\nHospital: means a place as under:\ni. one\nii. two\nHospitalization: means a stay\n6. Next\nmore"
    assert [(k, c) for k, c, _ in documents.blocks(text)] == [("prose", None), ("definition", "def.hospital"), ("definition", "def.hospitalization"), ("prose", "6")]
    assert documents.blocks("") == []


def test_rate_limit_batch_and_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 61, 62, 200])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    want = {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True}
    assert {r[0]: r[1] for r in answers.rate_limit(df, 2, 60).collect()} == want
    from clausewright.streaming.limits import rate_limit_stream

    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r[0]: r[1] for r in spark.table("limited").collect()} == want


def test_library_stands_without_the_text_package():
    code = "import sys; sys.modules['clausewright.llm'] = None\nimport __spark_entry__ as e\nassert not any(n.startswith(('p1_', 'p2_')) for n in e.queries()) and 'p6_found' in e.queries()"
    from conftest import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
