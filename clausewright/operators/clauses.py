"""Pages of documents, the clause index over them, concepts by their phrases, and the mapping between versions."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CANONICAL, slug
from . import documents as D

# The compound form of a clause id.
COMPOUND = r"(?i)\b([IVXLCDM]+)\s*[-–]\s*Section\s+(\d{1,2})\s*([a-z])?\."
# What a heading looks like on a page.
HEADINGS = {
    "numbered_clause": r"^\s{0,6}(\d+(?:\.\d+){0,3})[\.\)]?\s+\S", "section_roman": r"(?i)^\s{0,6}SECTION\s+[IVXLCDM]+\b", "section_numeric": r"(?i)^\s{0,6}SECTION\s+\d+\b", "all_caps": r"^\s{0,6}[A-Z][A-Z0-9 \-&/(),\.]{6,80}$",
    "annexure": r"(?i)^\s{0,6}(ANNEXURE|SCHEDULE|APPENDIX)\b", "alpha_subclause": r"^\s{0,6}\(([a-z]{1,3}|[ivxl]{1,5})\)\s+\S",
}
PHRASES = 100_000  # phrases of the vocabulary of concepts, at most; it is a hand-kept list


def page_parts(chunks: DataFrame) -> DataFrame:
    """(source_id, page, chunk_id, text): the part of every chunk on each of its pages. A form feed
    stands where the next page begins; parts beyond the last known page belong to it. Chunks without
    pages, source or text have none. Repeated rows count once; texts are not gathered by page."""
    parts = chunks.where("chunk_id is not null and source_id is not null and text is not null and size(pages) > 0").select("source_id", "chunk_id", "pages", F.posexplode(F.split("text", "\f")).alias("i", "text"))
    page = F.get("pages", F.least(F.col("i"), F.size("pages") - 1))
    return parts.select("source_id", page.alias("page"), "chunk_id", "i", "text").dropDuplicates(["chunk_id", "i"]).where("page is not null").drop("i")


def _id(pattern: str, raw: Column) -> Column:
    """The canonical id of what a pattern found, null if it has none."""
    made = {"excl_code": F.concat(F.lit("excl."), raw), "definition": F.concat(F.lit("def."), slug(raw))}.get(pattern, raw)
    return F.when(made.rlike(CANONICAL), made)


def clause_index(parts: DataFrame) -> DataFrame:
    """(document_id, clause_id, page, pattern): every id a page shows. Sections, numbers and definitions
    are looked for at the start of lines, codes and compound ids anywhere in the page's text, so that
    a line break inside them does no harm. Page numbers are no clauses."""
    lines = parts.select("source_id", "page", F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike("(?i)" + D.PAGE_NUMBER))
    named = {"section": D.SECTION, "numbered": D.NUMBERED, "definition": D.DEFINITION}
    anchored = F.array(*(F.struct(F.lit(n).alias("pattern"), _id(n, F.nullif(F.regexp_extract("line", p, 1), F.lit(""))).alias("clause_id")) for n, p in named.items()))
    codes = F.transform(F.regexp_extract_all("text", F.lit(D.EXCLUSION), 1), lambda x: F.struct(F.lit("excl_code").alias("pattern"), _id("excl_code", x).alias("clause_id")))
    whole = F.regexp_extract_all("text", F.lit(COMPOUND), 0)
    joined = lambda x: F.concat(F.upper(F.regexp_extract(x, COMPOUND, 1)), F.lit("."), F.regexp_extract(x, COMPOUND, 2), F.when(F.regexp_extract(x, COMPOUND, 3) != "", F.concat(F.lit("."), F.lower(F.regexp_extract(x, COMPOUND, 3)))).otherwise(F.lit("")))
    compound = F.transform(whole, lambda x: F.struct(F.lit("compound").alias("pattern"), _id("compound", joined(x)).alias("clause_id")))
    met = lines.select("source_id", "page", F.explode(anchored).alias("m")).unionByName(parts.select("source_id", "page", F.explode(F.concat(codes, compound)).alias("m")))
    return met.where("m.clause_id is not null").select(F.col("source_id").alias("document_id"), F.col("m.clause_id").alias("clause_id"), "page", F.col("m.pattern").alias("pattern")).distinct()


def chunk_clause_ids(text: Column, heading: Column) -> Column:
    """The clause ids of a chunk: that of its heading first, then codes and compound ids in the order of the text, each once."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(D.EXCLUSION), 1), lambda x: _id("excl_code", x))
    joined = lambda x: F.concat(F.upper(F.regexp_extract(x, COMPOUND, 1)), F.lit("."), F.regexp_extract(x, COMPOUND, 2), F.when(F.regexp_extract(x, COMPOUND, 3) != "", F.concat(F.lit("."), F.lower(F.regexp_extract(x, COMPOUND, 3)))).otherwise(F.lit("")))
    compound = F.transform(F.regexp_extract_all(text, F.lit(COMPOUND), 0), lambda x: _id("compound", joined(x)))
    return F.array_distinct(F.filter(F.concat(F.array(heading), F.coalesce(compound, F.array().cast("array<string>")), F.coalesce(codes, F.array().cast("array<string>"))), lambda x: x.isNotNull()))


def column_profile(blocks: DataFrame) -> DataFrame:
    """(source_id, page, two_column, switches): of the text blocks of a page in the order of the file.

    blocks: source_id, page, ordinal, x0, y0, x1, y1, width, height, in_table. Bands at the head and the
    foot do not count. A page is in two columns when a quarter of at least six blocks stand left, a quarter
    right, and few over both; each change of side outside tables is a switch, and one is right."""
    body = blocks.where("y0 > 60 and y1 < height - 40")
    side = F.when(F.col("x1") <= F.col("width") / 2 + 4, "L").when(F.col("x0") >= F.col("width") / 2 - 4, "R")
    sided = body.withColumn("side", side)
    page = ["source_id", "page"]
    counts = sided.groupBy(*page).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "L").alias("l"), F.count_if(F.col("side") == "R").alias("r"), F.count_if(F.col("side").isNull()).alias("over"))
    moved = sided.where("side is not null and not in_table").withColumn("before", F.lag("side").over(Window.partitionBy(*page).orderBy("ordinal")))
    switches = moved.groupBy(*page).agg(F.count_if(F.col("before") != F.col("side")).alias("switches"))
    two = (F.col("n") >= 6) & (F.col("l") >= 0.25 * F.col("n")) & (F.col("r") >= 0.25 * F.col("n")) & (F.col("over") < 0.35 * F.col("n"))
    return counts.join(switches, page, "left").select(*page, two.alias("two_column"), F.when(F.col("n") >= 6, F.coalesce("switches", F.lit(0))).otherwise(0).alias("switches"))


def anchors(concepts: DataFrame, curated: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(concept, phrase): the curated phrases of a concept, else the words of its name."""
    known = curated or {}
    given = concepts.sparkSession.createDataFrame([(c, p) for c, ps in known.items() for p in ps], "concept string, phrase string")
    own = concepts.select("concept").distinct().join(given.select("concept").distinct(), "concept", "left_anti")
    return given.join(concepts.select("concept").distinct(), "concept", "left_semi").unionByName(own.select("concept", F.lower(F.translate(F.element_at(F.split("concept", r"\."), -1), "_", " ")).alias("phrase"))).where("phrase <> ''")


def concept_pages(parts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(document_id, concept, page): pages whose text in lower case has a phrase of the concept. All
    phrases are sought at once by one automaton; the vocabulary is hand-kept and checked in size."""
    known = [(r["concept"], r["phrase"]) for r in phrases.limit(PHRASES + 1).collect()]
    if len(known) > PHRASES:
        raise ValueError("too many phrases for a vocabulary of concepts")
    sent = parts.sparkSession.sparkContext.broadcast(known)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[str, list[str]] = {}
        for concept, phrase in sent.value:
            of.setdefault(phrase, []).append(concept)
        finder = ahocorasick.Automaton()
        for phrase, concepts in of.items():
            finder.add_word(phrase, concepts)
        finder.make_automaton()
        for df in batches:
            got = [(s, c, p) for s, p, t in zip(df["source_id"], df["page"], df["text"]) for c in ({c for _, cs in finder.iter(t.lower()) for c in cs} if of else ())]
            yield pd.DataFrame(got, columns=["document_id", "concept", "page"])

    return parts.select("source_id", "page", "text").mapInPandas(rows, "document_id string, concept string, page int").distinct()


def concept_clauses(hits: DataFrame, index: DataFrame) -> DataFrame:
    """(document_id, concept, pages, clauses): sorted pages of each concept and the ids those pages show."""
    pages = hits.groupBy("document_id", "concept").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    shown = hits.join(index.select("document_id", "page", "clause_id").distinct(), ["document_id", "page"]).groupBy("document_id", "concept").agg(F.array_sort(F.collect_set("clause_id")).alias("clauses"))
    return pages.join(shown, ["document_id", "concept"], "left").select("document_id", "concept", "pages", F.coalesce("clauses", F.array().cast("array<string>")).alias("clauses"))


def concept_mapping(concepts: DataFrame, versions: DataFrame) -> DataFrame:
    """(left_id, right_id, concept, pages and clauses of each): concepts that both versions of a pair have."""
    side = lambda s: concepts.select(F.col("document_id").alias(f"{s}_id"), "concept", F.col("pages").alias(f"{s}_pages"), F.col("clauses").alias(f"{s}_clauses"))
    return versions.select("left_id", "right_id").distinct().join(side("left"), "left_id").join(side("right"), ["right_id", "concept"]).select("left_id", "right_id", "concept", "left_pages", "left_clauses", "right_pages", "right_clauses")


def page_flags(parts: DataFrame) -> DataFrame:
    """One row per page: sums of what its parts show, headings by pattern, and the flags. Without images
    no page is known to be a picture, so one without text is blank and not a case for OCR."""
    t = F.col("text")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) <= 120))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    like = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("bigint")
    made = {
        "chars": F.length(F.trim(t)).cast("bigint"), "words": F.size(words).cast("bigint"), "long_words": F.size(F.filter(words, lambda w: F.length(w) > 30)).cast("bigint"), "length": F.length(t).cast("bigint"), "blanks": count(" "), "cid": count(r"\(cid:\d+\)"), "replaced": count("�"),
        "ligatures": count("[ﬀ-ﬆ]"), "soft_hyphens": count("­"), "nbsp": count(" "), "devanagari": count("[ऀ-ॿ]"), **{n: like(p) for n, p in HEADINGS.items()},
    }
    sums = parts.select("source_id", "page", *(c.alias(n) for n, c in made.items())).groupBy("source_id", "page").agg(*(F.sum(n).alias(n) for n in made))
    has = F.col("chars") >= 80
    fused = has & (F.col("long_words") >= 0.03 * F.col("words"))
    return sums.withColumns({"has_text": has, "space_ratio": F.when(F.col("length") > 0, F.col("blanks") / F.col("length")).otherwise(0.0), "fused": fused, "contaminated": F.col("ligatures") > 0, "suspect": has & ((F.col("cid") > 0) | (F.col("replaced") > 3) | fused | (F.col("ligatures") > 0))})


def compacted(pages: Column, limit: int = 12) -> Column:
    """Sorted distinct pages as `1-3, 7`; more than `limit` ranges end in how many are left out."""
    first = F.filter(pages, lambda p: ~F.array_contains(pages, p - 1))
    last = F.filter(pages, lambda p: ~F.array_contains(pages, p + 1))
    runs = F.zip_with(first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b)))
    shown = F.array_join(F.slice(runs, 1, limit), ", ")
    return F.when(F.size(pages) == 0, "-").when(F.size(runs) > limit, F.concat(shown, F.lit(", +"), (F.size(runs) - limit).cast("string"), F.lit(" more"))).otherwise(shown)


def document_flags(pages: DataFrame) -> DataFrame:
    """One row per document: sums, lists of flagged pages, heading totals and the most frequent pattern."""
    listed = lambda flag: F.array_sort(F.collect_set(F.when(flag, F.col("page"))))
    rolled = pages.groupBy("source_id").agg(
        F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("chars", "ligatures", "soft_hyphens", "nbsp", "devanagari", *HEADINGS)), F.median("chars").alias("median_chars"), listed(~F.col("has_text")).alias("blank_pages"), listed(F.col("contaminated")).alias("ligature_pages"),
        listed(F.col("cid") > 0).alias("cid_pages"), listed(F.col("fused")).alias("fused_pages"), listed(F.col("suspect")).alias("suspect_pages"),
    )
    ranked = F.array(*(F.struct(F.col(n).alias("n"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(HEADINGS)))
    top = F.array_max(ranked)
    return rolled.withColumn("dominant", F.when(top["n"] > 0, top["name"]))


def defects(documents: DataFrame) -> DataFrame:
    """(source_id, ordinal, defect, detail): what is wrong with a document, worst first; silent damage
    comes before what fails loudly. A document without a defect has one row that says so."""
    n = lambda c: F.size(c)
    rule = lambda name, when, detail: F.when(when, F.struct(F.lit(name).alias("defect"), detail.alias("detail")))
    found = F.filter(F.array(
        rule("ligatures", n("ligature_pages") > 0, compacted(F.col("ligature_pages"))), rule("broken_encoding", n("cid_pages") > 0, compacted(F.col("cid_pages"))), rule("fused_words", n("fused_pages") > 0, compacted(F.col("fused_pages"))), rule("soft_hyphens", F.col("soft_hyphens") > 0, F.col("soft_hyphens").cast("string")),
        rule("blank_pages", n("blank_pages") > 0, compacted(F.col("blank_pages"))), rule("devanagari", F.col("devanagari") > 0, F.col("devanagari").cast("string")), rule("no_headings", F.col("dominant").isNull(), F.lit("")),
    ), lambda r: r.isNotNull())
    some = F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("none").alias("defect"), F.lit("").alias("detail"))))
    return documents.select("source_id", F.posexplode(some).alias("ordinal", "d")).select("source_id", "ordinal", "d.defect", "d.detail")


def locate(parts: DataFrame, phrase: str, context: int = 20, limit: int = 5) -> DataFrame:
    """(source_id, page, chunk_id, at, snippet, heading): the first hit of a phrase in each part of a
    page, letter case aside, with what surrounds it and the last heading line before it; at most
    `limit` hits of a document, by page."""
    at = F.locate(phrase.lower(), F.lower("text"))
    width = len(phrase) + 2 * context
    before = F.filter(F.split(F.substring(F.col("text"), F.lit(1), F.col("at") - 1), "\n"), lambda x: F.exists(F.array(*(F.lit(p) for p in HEADINGS.values())), lambda p: F.rlike(x, p)))
    hits = parts.withColumn("at", at).where("at > 0").withColumns({"snippet": F.substring(F.col("text"), F.greatest(F.col("at") - context, F.lit(1)), F.lit(width)), "heading": F.trim(F.element_at(F.when(F.size(before) > 0, before), -1))})
    w = Window.partitionBy("source_id").orderBy("page", "chunk_id", "at")
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("source_id", "page", "chunk_id", "at", "snippet", "heading")
