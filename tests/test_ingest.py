"""Tables, clauses, pages, normal form, sources and stores, on literal fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clausewright.functions import normalise as Z
from clausewright.functions import text as T
from clausewright.operators import clauses as L
from clausewright.operators import documents as D
from clausewright.operators import manifest as M
from clausewright.operators import retrieval as R
from clausewright.operators import tables as B
from clausewright.sources import jsonl, sheet, store

TABLE = "table_id string, source_id string, pages array<int>, header array<string>, rows array<array<string>>, clause_id string, caption string"


def tables(spark, *rows):
    return spark.createDataFrame([(f"t{i}", "s", pages, header, body, clause, caption) for i, (pages, header, body, clause, caption) in enumerate(rows)], TABLE)


def test_a_caption_over_names_gives_way(spark):
    t = tables(spark, ([14, 15], ["Delivery", "", ""], [["Sum Insured", "Limit", "Limit"], ["", "Normal", "Caesarean"], ["5 lakh", "10", "20"], ["10 lakh", None, "30"]], "4.2", None), ([3], ["A", "B"], [["x", "1"]], None, "Cap"))
    got = {r["table_id"]: r for r in B.with_recovered_header(t).collect()}
    assert got["t0"]["recovered"] == "Delivery" and got["t0"]["header"] == ["Sum Insured", "Limit Normal", "Limit Caesarean"] and len(got["t0"]["rows"]) == 2
    assert got["t1"]["recovered"] is None and got["t1"]["header"] == ["A", "B"]
    said = [r["text"] for r in B.sentences(t).orderBy("table_id", "ordinal").collect()]
    assert said == ["[s, pages 14-15, clause 4.2, Delivery] For Sum Insured 5 lakh: Limit Normal is 10; Limit Caesarean is 20.", "[s, pages 14-15, clause 4.2, Delivery] For Sum Insured 10 lakh: Limit Caesarean is 30.", "[s, page 3, Cap] For A x: B is 1."]


def test_classes_of_stitched_tables(spark):
    t = tables(spark, ([1], ["", None], [], None, None), ([1], ["x" * 250, "y"], [], None, None), ([1], ["Cap", " "], [], None, None), ([1], ["A", "B"], [], None, None))
    assert [r[0] for r in t.orderBy("table_id").select(B.stitch_class(F.col("header"))).collect()] == ["spurious", "spurious", "caption_header", "data_grid"]
    r = B.extraction_report(t).first()
    assert (r["tables"], r["headerless"], r["data_grid"], r["caption_header"], r["spurious"]) == (4, 1, 1, 1, 2)
    assert B.sentences(t).count() == 0 and B.row_groups(t).count() == 0


def test_groups_of_rows_keep_the_header_and_all_rows(spark):
    rows = [[f"row {i}", "v" * (40 + 37 * i % 90)] for i in range(60)] + [["long", "w" * 2000], ["last", "z"]]
    t = tables(spark, ([1, 2], ["Name", "Value|x"], rows, None, None), ([1], ["Name"], [["1 one"]], None, None), ([2], ["Name"], [], None, None))
    got = B.row_groups(t).orderBy("table_id", "ordinal").collect()
    mine = [g for g in got if g["table_id"] == "t0"]
    assert [g["first_row"] for g in mine] == [0] + [g["last_row"] + 1 for g in mine[:-1]] and mine[-1]["last_row"] == len(rows) - 1
    assert all("| Name | Value/x |" in g["text"] and g["split"] for g in mine) and all(len(g["text"]) <= 1400 + g["last_row"] - g["first_row"] + 1 for g in mine if "w" * 50 not in g["text"])
    whole = [g for g in got if g["table_id"] == "t1"]
    assert len(whole) == 1 and not whole[0]["split"] and whole[0]["text"].startswith("Table from s, page 1\n\n| Name |\n|---|\n| 1 one |")
    ids = {r["chunk_id"] for r in B.table_chunks(t).collect()} | {r["chunk_id"] for r in B.table_chunks(t, "row_nl").collect()}
    assert {"t0#g0", "t1#whole", "t1#r0"} <= ids
    with pytest.raises(ValueError):
        B.table_chunks(t, "html")


def test_stitch_follows_pages_columns_and_edges(spark):
    kind = "source_id string, page int, index_on_page int, y0 double, y1 double, page_height double, col_xs array<double>, header array<string>, rows array<array<string>>, x0 double, x1 double"
    h = ["Sum Insured", "Room Rent Limit"]
    rows = [("s", 7, 0, 400.0, 800.0, 842.0, [50.0, 300.0], h, [["1", "2"]], 40.0, 500.0), ("s", 8, 0, 70.0, 800.0, 842.0, [52.0, 301.0], ["SUM insured", " room rent limit "], [["3", "4"]], 40.0, 500.0), ("s", 9, 0, 70.0, 300.0, 842.0, [50.0, 300.0], ["5", "6"], [["7", "8"]], 40.0, 500.0),
            ("m", 1, 0, 400.0, 800.0, 842.0, [50.0, 300.0], h, [], 0.0, 0.0), ("m", 2, 0, 70.0, 100.0, 842.0, [50.0, 372.0], h, [], 0.0, 0.0), ("e", 1, 0, 400.0, 800.0, 842.0, [], h, [["a"]], 40.0, 500.0), ("e", 2, 0, 70.0, 300.0, 842.0, [], h, [["b"]], 45.0, 490.0)]
    got = {(r["source_id"], r["table_no"]): r for r in D.stitch(spark.createDataFrame(rows, kind)).collect()}
    assert got["s", 1]["rows"] == [["1", "2"], ["3", "4"], ["5", "6"], ["7", "8"]] and got["s", 1]["pages"] == [7, 8, 9]
    assert len([k for k in got if k[0] == "m"]) == 2 and got["e", 1]["rows"] == [["a"], ["b"]]


def test_clause_index_of_pages(spark):
    chunks = [("c1", "s", [33, 34], "Section II Cover\n4.2) Room rent\nHospital: a place\n12 / 47\nsee Code \nExcl 08\fas in II - Section 6 m. and Code Excl 3"), ("c1", "s", [33, 34], "x"), ("c2", "s", [], "4.2. x"), ("c3", None, [1], "4.2. x"), ("c4", "s", None, None)]
    parts = L.page_parts(spark.createDataFrame(chunks[:1] + chunks[2:], "chunk_id string, source_id string, pages array<int>, text string"))
    got = {(r["clause_id"], r["page"], r["pattern"]) for r in L.clause_index(parts).collect()}
    assert got == {("II", 33, "section"), ("4.2", 33, "numbered"), ("def.hospital", 33, "definition"), ("excl.08", 33, "excl_code"), ("II.6.m", 34, "compound")}
    hits = L.concept_pages(parts, L.anchors(spark.createDataFrame([("limit.room_rent",), ("benefit.x",)], "concept string"), {"benefit.x": ("hospital", "never said")}))
    assert {(r["concept"], r["page"]) for r in hits.collect()} == {("limit.room_rent", 33), ("benefit.x", 33)}
    both = L.concept_clauses(hits.unionByName(hits.withColumn("document_id", F.lit("n"))), L.clause_index(parts))
    m = L.concept_mapping(both, spark.createDataFrame([("s", "n"), ("s", "z")], "left_id string, right_id string")).collect()
    assert {r["concept"] for r in m} == {"limit.room_rent", "benefit.x"} and all(r["right_clauses"] == [] and "4.2" in r["left_clauses"] for r in m)
    assert L.clause_index(parts.where("false")).count() == 0 and L.concept_pages(parts.where("false"), L.anchors(spark.createDataFrame([], "concept string"))).count() == 0


def test_page_and_document_flags(spark):
    parts = spark.createDataFrame([("s", 1, "a", "1. Heading line\n" + "word " * 30), ("s", 2, "b", "beneﬁt " * 20), ("s", 3, "c", "x" * 90), ("s", 4, "d", " "), ("s", 5, "e", "y")], "source_id string, page int, chunk_id string, text string")
    pages = {r["page"]: r for r in L.page_flags(parts).collect()}
    assert pages[2]["contaminated"] and pages[2]["suspect"] and pages[3]["fused"] and not pages[4]["has_text"] and pages[1]["numbered_clause"] == 1
    found = [(r["defect"], r["detail"]) for r in L.defects(L.document_flags(L.page_flags(parts))).orderBy("ordinal").collect()]
    assert found == [("ligatures", "2"), ("fused_words", "3"), ("blank_pages", "4-5")]
    c = spark.createDataFrame([([1, 2, 3, 7],), ([],), (list(range(1, 60, 2)),)], "p array<int>").select(L.compacted(F.col("p"))).collect()
    assert c[0][0] == "1-3, 7" and c[1][0] == "-" and c[2][0].endswith("23, +18 more")


def test_normal_form_and_its_guard(spark):
    rows = [("5,00,000/-¹ beneﬁt ‘x’…",), ("a\u200bb\u00adc\u00a0d",), ("10²",), ("x²",), ("½ day",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(Z.normalised(F.col("t"))).collect()]
    assert got == ["5,00,000/- benefit 'x'...", "abc d", "10", "x2", "1⁄2 day", None, ""]
    assert [r[0] for r in df.select(Z.figures_changed(F.col("t"))).collect()] == [False, False, False, True, True, False, False]
    with pytest.raises(Exception, match="figures changed"):
        df.select(Z.strict(F.col("t"))).collect()
    n = df.agg(*(F.sum(c).alias(k) for k, c in Z.change_counts(F.col("t")).items())).first()
    assert (n["footnotes"], n["zero_width"], n["soft_hyphens"], n["ligatures"], n["punctuation"], n["nbsp"]) == (2, 1, 1, 1, 2, 1)
    assert df.select(Z.search_tokens(F.col("t"))).first()[0] == ["00", "000", "benefit"]


def test_jsonl_comments_and_errors(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, n int, d date").schema
    (tmp_path / "m.jsonl").write_text('# head\n\n{"id": "a", "n": 1, "d": "2024-01-02"}\nnot json\n{"id": "b", "odd": 1}\n{"n": 3}\n[1]\n{"id": "c", "n": "x"}\n')
    got = {r["line_no"]: (r["item"], r["problem"]) for r in jsonl.read_jsonl(spark, str(tmp_path / "m.jsonl"), schema).collect()}
    assert set(got) == {3, 4, 5, 6, 7, 8} and got[3][1] is None and got[3][0]["d"] == dt.date(2024, 1, 2)
    assert all(got[i][1] for i in (4, 5, 6, 7, 8)) and "odd" in got[5][1] and "id" in got[6][1]
    with pytest.raises(ValueError, match="m.jsonl:4"):
        jsonl.items_of(jsonl.read_jsonl(spark, str(tmp_path / "m.jsonl"), schema))
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", None, dt.date(2020, 2, 2))], schema)
    jsonl.write_jsonl(rows, str(tmp_path / "out"), ("one", "two"))
    assert jsonl.proven(rows, str(tmp_path / "out")).count() == 0 and jsonl.proven(rows.limit(1), str(tmp_path / "out")).count() == 2
    jsonl.append_log(rows, str(tmp_path / "log"))
    jsonl.append_log(rows, str(tmp_path / "log"))
    assert jsonl.read_log(spark, str(tmp_path / "log"), schema).count() == 6


def test_sheet_there_and_back(spark, tmp_path):
    kind = "id string, strata string, expected_behaviour string, question string, reference_answer string, concept_id string, ground_truth_spans array<struct<document_id:string,page:int,clause_id:string>>, must_not_cite array<string>, expected_to_fail boolean, expected_failure_reason string, injection_canary string, notes string, authored_by string, as_of_date date"
    items = spark.createDataFrame([("h-02", "flat_lookup", "answer", "how long?", "r", None, [("d1", 3, "excl.02"), ("d2", 4, None)], ["x#1"], True, "why", None, None, "human", dt.date(2024, 5, 6)), ("h-03", None, None, None, None, None, None, None, None, None, None, None, None, None)], kind)
    back = sheet.items_of(sheet.rows_of(items)).collect()
    assert len(back) == 1 and [tuple(s) for s in back[0]["ground_truth_spans"]] == [("d1", 3, "excl.02"), ("d2", 4, None)]
    assert back[0]["expected_to_fail"] and back[0]["as_of_date"] == dt.date(2024, 5, 6) and back[0]["problem"] is None
    row = lambda **kw: {**dict.fromkeys(sheet.COLUMNS, None), "id": "a", "question": "q", **kw}
    bad = spark.createDataFrame([row(document_id="d|e", page="1|2", clause_id="c"), row(document_id="d|e", page="1"), row(document_id="d", page="x"), row(document_id="d|e", page="1|2", clause_id="|", expected_to_fail="maybe", must_not_cite="a| |b")], ", ".join(f"{c} string" for c in sheet.COLUMNS))
    got = sheet.items_of(bad).collect()
    assert [bool(r["problem"]) for r in got] == [True, True, True, False] and got[3]["must_not_cite"] == ["a", "b"] and not got[3]["expected_to_fail"]
    with pytest.raises(ValueError, match="differ"):
        sheet.staged_write(bad, str(tmp_path / "g"))
    assert not (tmp_path / "g").exists()
    sheet.staged_write(sheet.rows_of(items), str(tmp_path / "g"))
    sheet.staged_write(sheet.rows_of(items), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1


def test_stores_and_their_contracts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two two"), ("b", None)], "id string, text string")
    store.save_index(R.doc_terms(docs, "id", "text"), str(tmp_path / "i"))
    posts, lengths = store.load_index(spark, str(tmp_path / "i"))
    assert {(r["term"], r["tf"]) for r in posts.collect()} == {("one", 1), ("two", 2)} and {(r["id"], r["dl"]) for r in lengths.collect()} == {("a", 3), ("b", 0)}
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").parquet(str(tmp_path / "i" / "contract"))
    with pytest.raises(ValueError, match="version 99"):
        store.load_index(spark, str(tmp_path / "i"))
    v = spark.createDataFrame([("a", [0.6, 0.8]), ("a", [0.6, 0.8]), ("b", [1.0, 1.0]), ("c", [1.0]), ("d", None)], "id string, embedding array<float>")
    assert {(r["id"], r["problem"]) for r in store.vector_problems(v, 2, spark.createDataFrame([("z",)], "id string")).collect()} == {("a", "twice"), ("b", "length"), ("c", "dimension"), ("d", "null"), ("z", "missing")}
    store.save_vectors(v, str(tmp_path / "v"), "m", "q: ")
    assert store.load_vectors(spark, str(tmp_path / "v"), "m", "q: ").count() == 5
    with pytest.raises(ValueError):
        store.load_vectors(spark, str(tmp_path / "v"), "other", "q: ")
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, "y")], "id long, text string")
    cache = texts.where("id = 1").select(store.content_key(F.col("text"), "m").alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    hits, misses = store.cache_probe(texts, cache, "m")
    assert {r["id"] for r in hits.collect()} == {1, 2} and [r["text"] for r in misses.collect()] == ["y"]
    other = store.cache_probe(texts, cache, "m2")
    assert other[0].count() == 0 and other[1].count() == 2
    asked = texts.select("id", store.request_key("k", F.struct("text")).alias("key"))
    played = store.replayed(asked, asked.where("id = 1").select("key", F.lit("r").alias("response")))
    assert {(r["id"], r["hit"]) for r in played.collect()} == {(1, True), (2, True), (3, False), (4, False), (5, False)}
    assert store.uncovered(texts.select("id"), texts.where("id < 4")).count() == 2


def test_findings_of_items(spark):
    spans = spark.createDataFrame([("i", 0, "star", 14, "15", "bariatric"), ("i", 1, "none", 1, "1", None), ("i", 2, "star", 99, None, "bariatric"), ("i", 3, "star", 14, "15", None), ("i", 4, "star", 1, "excl.09", "gone"), ("i", 5, "star", 11, "15", "bariatric")], "item_id string, truth_idx int, document_id string, page int, clause_id string, concept string")
    clauses = spark.createDataFrame([("star", "15", p) for p in (14, 34, 36, 42)], "document_id string, clause_id string, page int")
    concepts = spark.createDataFrame([("star", "bariatric", 14), ("star", "bariatric", 15)], "document_id string, concept string, page int")
    bans = spark.createDataFrame([("i", "lost#4"), ("i", "star")], "item_id string, pattern string")
    got = {(r["truth_idx"], r["severity"], r["rule"]) for r in M.item_findings(spans, bans, clauses, concepts, spark.createDataFrame([("star", 48)], "source_id string, n_pages int")).collect()}
    assert got == {(0, "WARN", "ambiguous_confirmed"), (1, "ERROR", "unknown_document"), (2, "ERROR", "page_beyond_end"), (2, "ERROR", "concept_elsewhere"), (2, "WARN", "no_clause"), (3, "UNVERIFIABLE", "ambiguous"), (4, "WARN", "concept_absent"), (4, "UNVERIFIABLE", "clause_absent"), (5, "ERROR", "concept_elsewhere"), (5, "ERROR", "clause_elsewhere"), (None, "ERROR", "ban_unknown_document")}


def test_keys_are_masked(spark):
    shapes = ["AIza" + "x" * 30, "sk-ant-" + "y" * 30, "AQ." + "z" * 30, "sk-short"]
    got = [r[0] for r in spark.createDataFrame([(f"key {s} end",) for s in shapes], "t string").select(T.redact(F.col("t"))).collect()]
    assert got == [f"key {s[:6]}...REDACTED end" for s in shapes[:3]] + ["key sk-short end"]


def test_blocks_that_do_not_travel_rank_the_same(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 12))) for i in range(80)] + [(200, None)], "id long, text string")
    asked = spark.createDataFrame([(i, f"w{i % 17} w{(i * 3) % 17} zz") for i in range(30)] + [(99, None)], "query_id long, text string")
    terms = R.doc_terms(docs, "id", "text")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    want = rows(R.bm25(R.postings(terms), R.corpus_stats(terms), asked, 5))
    assert want and rows(R.bm25_blocks(terms, asked, 5)) == rows(R.bm25_blocks(terms, asked, 5, block=7, sent=600)) == want
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [(50, None)], "id long, v array<float>")
    q = v.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = rows(R.dense(v, q, "id", "v", 6))
    assert len(got) == 60 and got == rows(R.dense(v, q, "id", "v", 6, block=3, sent=300))
    assert R.dense(v, q.where("false"), "id", "v").count() == 0 == R.dense(v.where("false"), q, "id", "v").count()
