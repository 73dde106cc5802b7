"""Retrievers, the answer pipeline, fetch outcomes, resumption, the column profile."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from clausewright.operators import clauses as L
from clausewright.operators import documents as D
from clausewright.operators import manifest as M
from clausewright.operators import pipeline as P
from clausewright.operators import retrievers as V

TEXTS = [("c1", "waiting period for cataract surgery"), ("c2", "cataract surgery is covered after the waiting period ends"), ("c3", "maternity expenses are excluded"), ("c4", None)]


def texts(spark):
    return spark.createDataFrame(TEXTS, "id string, text string")


def asked(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, text string")


def ids(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


def embedder():
    """Made within a function, so that it goes to the workers by value."""
    return lambda batch: [[1.0, 0.0] if "cataract" in t else [0.0, 1.0] for t in batch]


def test_retrievers_keep_one_contract(spark):
    q = asked(spark, ("a", "cataract surgery"), ("b", "maternity"), ("n", None), ("e", "  "))
    vectors = V.embedded(texts(spark), embedder())
    lexical, dense = V.LexicalRetriever(texts(spark)), V.DenseRetriever(vectors, embedder())
    assert ids(lexical.retrieve(q, 2)) == {"a": ["c1", "c2"], "b": ["c3"]}
    assert ids(dense.retrieve(q, 1)) == {"a": ["c1"], "b": ["c3"]}
    fused = V.FusedRetriever((lexical, dense))
    assert ids(fused.retrieve(q, 2))["a"] == ["c1", "c2"]
    assert ids(fused.retrieve(q, 2, texts(spark).where("id <> 'c1'").select("id")))["a"] == ["c2", "c3"]
    assert V.NullRetriever().retrieve(q).count() == 0 and ids(V.FixedRetriever(("x", "y", "z")).retrieve(q, 2))["n"] == ["x", "y"]
    assert V.FixedRetriever(()).retrieve(q).count() == 0
    again = V.RerankingRetriever(lexical, V.ScoringReranker(texts(spark), lambda asks, said: [len(s) for s in said]))
    assert ids(again.retrieve(q, 1)) == {"a": ["c2"], "b": ["c3"]}
    assert ids(V.RerankingRetriever(lexical, V.OverlapReranker(texts(spark))).retrieve(asked(spark, ("a", "cataract waiting ends")), 1)) == {"a": ["c2"]}
    for r in (lexical, dense, fused, again, V.NullRetriever(), V.FailingRetriever()):
        assert isinstance(r, V.Retriever)
    with pytest.raises(Exception, match="retriever failed"):
        V.FailingRetriever().retrieve(q).collect()
    with pytest.raises(ValueError):
        V.FusedRetriever((lexical,), (1.0, 2.0))
    with pytest.raises(ValueError):
        V.DenseRetriever(vectors).retrieve(q)
    with pytest.raises(ValueError):
        V.LexicalRetriever(texts(spark), strict=True).retrieve(q)


def provider():
    def answer(prompts):
        out = []
        for p in prompts:
            if "QUESTION: fail" in p:
                error = RuntimeError("down")
                error.kind = "transport"
                raise error
            if "QUESTION: mend" in p and "not valid JSON" not in p:
                out.append("{broken")
            elif "QUESTION: broken" in p:
                out.append("no json")
            elif "QUESTION: invent" in p:
                out.append(json.dumps({"answer": "x", "citations": [99]}))
            elif "QUESTION: decline" in p:
                out.append(json.dumps({"answer": "N/A", "citations": []}))
            else:
                out.append("```json\n" + json.dumps({"answer": " yes ", "citations": [1, 1, 2]}) + "\n```")
        return out

    return answer


def test_pipeline_decides_each_case(spark):
    passages = spark.createDataFrame([(i, "doc", 3, None, t) for i, t in TEXTS if t], "chunk_id string, document_id string, page int, clause_id string, text string")
    q = spark.createDataFrame([(w, f"{w} cataract surgery") for w in ("fail", "mend", "broken", "invent", "decline", "good")] + [("none", "dental"), ("null", None), (None, "cataract"), ("good", "good cataract surgery")], "item_id string, question string")
    got = {r["item_id"]: r for r in P.answered(q, V.LexicalRetriever(texts(spark)), passages, provider(), 2).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {"fail": "service_degraded", "mend": "answered", "broken": "malformed_generation", "invent": "malformed_generation", "decline": "low_confidence", "good": "answered", "none": "no_candidates", "null": "no_candidates"}
    assert got["good"]["answer"] == "yes" and got["good"]["citations"] == ["c1", "c2"] and got["good"]["confidence"] > 0
    assert got["mend"]["attempts"] == 2 and got["broken"]["attempts"] == 2 and got["none"]["confidence"] == 0.0
    assert got["invent"]["answer"] is None and got["invent"]["citations"] is None
    assert P.answered(q.where("false"), V.LexicalRetriever(texts(spark)), passages, provider()).count() == 0


def test_fetch_outcomes(spark):
    pdf, other = b"\xef\xbb\xbf %PDF-1.7 x", b"%PDF other"
    sha = hashlib.sha256(pdf).hexdigest()
    rows = [("ok", 0, 200, None, pdf), ("pin", 0, 200, None, other), ("mirror", 0, 503, None, None), ("mirror", 1, 200, None, pdf), ("drift", 0, 200, None, pdf), ("drift", 1, 200, None, other), ("time", 0, None, "ReadTimeout: timeout", None), ("net", 0, None, "reset", None), ("html", 0, 200, None, b"<html>"), ("empty", 0, 200, None, b"")]
    attempts = spark.createDataFrame([(a, b, c, d, bytearray(e) if e is not None else None) for a, b, c, d, e in rows], "id string, ordinal int, status int, failure string, content binary")
    sources = spark.createDataFrame([(i, sha if i in ("ok", "pin") else None) for i in ("ok", "pin", "mirror", "drift", "time", "net", "html", "empty", "never")], "id string, expected_sha256 string")
    got = {r["id"]: (r["outcome"], r["drift"]) for r in M.fetch_outcomes(attempts, sources).collect()}
    assert got == {"ok": ("ok", False), "pin": ("hash_mismatch", False), "mirror": ("ok", False), "drift": ("ok", True), "time": ("timeout", False), "net": ("network_error", False), "html": ("not_pdf", False), "empty": ("empty", False), "never": ("http_error", False)}


def test_sources_by_id_and_kind(spark):
    s = spark.createDataFrame([("a", "circular"), ("x", "adversarial_fixture"), ("n", None)], "id string, kind string")
    assert M.by_id(s, "a")["kind"] == "circular" and {r["id"] for r in M.production(s).collect()} == {"a", "n"} and [r["id"] for r in M.adversarial(s).collect()] == ["x"]
    with pytest.raises(KeyError):
        M.by_id(s, "zz")


def test_columns_of_a_page(spark):
    def block(page, ordinal, left, in_table=False, y0=100.0):
        return ("s", page, ordinal, 50.0 if left else 310.0, y0, 290.0 if left else 550.0, y0 + 20, 600.0, 842.0, in_table)

    whole = [block(1, i, i < 4) for i in range(8)]  # a column, then the other
    spliced = [block(2, i, i % 2 == 0) for i in range(8)]
    tabled = [block(3, i, i % 2 == 0, True) for i in range(6)] + [block(3, 6, True), block(3, 7, False)]
    few = [block(4, i, i % 2 == 0) for i in range(4)] + [block(4, 9, True, False, 10.0)]
    df = spark.createDataFrame(whole + spliced + tabled + few, "source_id string, page int, ordinal int, x0 double, y0 double, x1 double, y1 double, width double, height double, in_table boolean")
    got = {r["page"]: (r["two_column"], r["switches"]) for r in L.column_profile(df).collect()}
    assert got == {1: (True, 1), 2: (True, 7), 3: (True, 1), 4: (False, 0)}


def test_clause_ids_of_a_chunk(spark):
    df = spark.createDataFrame([("see Code Excl 3 and Code Excl 03, code excl 12 and II - Section 6 m.", "4.2"), ("none", None), (None, "1")], "t string, h string")
    got = [r[0] for r in df.select(L.chunk_clause_ids(F.col("t"), F.col("h"))).collect()]
    assert got == [["4.2", "II.6.m", "excl.03", "excl.12"], [], ["1"]]


def test_section_paths_and_furniture():
    text = "Section II Cover\nintro\n2. Benefits\n2.1) Room\nrent text\n2.2) Icu\nDEFINITIONS\nHospital: a place\nSection III End\n7. Footer line\nlast"
    got = [(clause, path) for _, clause, path, _ in D.outline(text, furniture=frozenset({"7. Footer line"}))]
    assert got[0] == ("II", ()) and ("def.hospital", ("definitions",)) in got and got[-1] == ("III", ())
    assert [b for b in D.blocks(text)] == [(k, c, t) for k, c, _, t in D.outline(text)]
