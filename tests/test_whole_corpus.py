"""The document queries over all documents, those without a vector too."""

import random

import pytest

from clausewright.operators import retrieval as R
from clausewright.plans import retrieval

DOCS = [(1, "waiting period for cataract surgery"), (100, "cataract surgery"), (101, "cataract surgery is covered"), (200, "maternity expenses"), (201, "maternity expenses are excluded"), (202, None)]
VECTORS = [(1, [1.0, 0.0]), (100, [0.0, 1.0]), (101, [0.6, 0.8])]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def ranked(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


def test_documents_without_a_vector_are_ranked_and_ask(spark, sf):
    assert ranked(retrieval.rerank_topk(spark, sf)) == {100: [1, 100, 101], 200: [200, 201]}
    for query in (retrieval.rrf_topk, retrieval.rrf_weighted):
        got = ranked(query(spark, sf))
        assert set(got) == {100, 200} and set(got[100]) == {1, 100, 101} and got[200] == [200, 201]
    asked = {(r["query_id"], r["id"]) for r in retrieval.confidence_coalesce(spark, sf).collect()}
    assert {(200, 200), (200, 201)} <= asked


def test_whole_text_of_a_query_counts(spark, tmp_path):
    docs = [(100, "\nwaiting period\nfor cataract surgery"), (101, "cataract surgery"), (200, "grace period\nmaternity expenses"), (201, "maternity expenses")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.rerank_topk(spark, str(tmp_path)).collect()}
    assert got == {(100, 100): 1.0, (100, 101): 0.4, (100, 200): 0.2, (200, 200): 1.0, (200, 201): 0.5, (200, 100): 0.25}


def test_blocks_rank_as_the_join_does(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (1 + i) for i in range(40)], k=n))
    docs = spark.createDataFrame([(i, text(rng.randint(0, 30))) for i in range(300)] + [(300, "w3 w7"), (301, "w7 w3"), (302, None)], "id long, text string")
    asked = spark.createDataFrame([(i, text(25)) for i in range(12)] + [(12, "w3 w7"), (13, "none"), (14, None)], "query_id long, text string")
    terms = R.doc_terms(docs, "id", "text")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    want = rows(R.bm25(R.postings(terms), R.corpus_stats(terms), asked, 7))
    assert len(want) == 91
    for heavy, width in ((512, 2000), (5, 11), (0, 40)):
        assert rows(R.bm25_blocks(terms, asked, 7, heavy=heavy, width=width)) == want
    assert rows(R.bm25_blocks(terms.where("id < 0"), asked)) == [] == rows(R.bm25_blocks(terms, asked.where("query_id < 0")))


def test_few_pairs_are_scored_exactly():
    """Ranking a block works out few scores, and gives those of scoring every pair; ties go to the first id."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(rng.choice(words, rng.integers(5, 60))) for _ in range(5000)]
    docs = docs[:4000] + docs[:1000]  # each of these ties with its copy
    asked = [np.unique(rng.choice(60, 8)) for _ in range(40)] + [np.array([3]), np.array([3, 7])]
    df = np.array([sum(w in d for d in (set(x.split()) for x in docs)) for w in words], float)
    weight = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    dl = np.array([len(d.split()) for d in docs])
    tf = np.array([[d.split().count(w) for w in words] for d in docs])
    w = weight * tf * 2.5 / (tf + (1.5 * (0.25 + 0.75 * dl / dl.mean()))[:, None])
    q, t = np.repeat(np.arange(len(asked)), [len(a) for a in asked]), np.concatenate(asked)
    for heavy in (512, 20):
        block = R.asked_block(list(range(len(asked))), words, weight, q, t, heavy)
        ranking, scored = R.Postings(block, 10, 1.5, 0.75, dl.mean(), heavy), 0
        keep = ranking._keep

        def counted(at_q, at_d, scores):
            nonlocal scored
            scored += sum(map(len, at_d))
            keep(at_q, at_d, scores)

        ranking._keep = counted
        items = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(dl), pa.array(docs)], ["id", "dl", "said"])
        for part in R.batched(iter([items.slice(0, 700), items.slice(700)]), 2000):
            ranking.add(part)
        got = {}
        for b in ranking.rows():
            for x, i, s in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(x, []).append((round(s, 9), i))
        for x, terms in enumerate(asked):
            s = np.round(w[:, terms].sum(axis=1), 9)
            assert sorted(i for _, i in got[x]) == sorted(np.lexsort((np.arange(len(s)), -s))[:10].tolist())
        assert scored < 0.02 * len(docs) * len(asked)
