"""Documents: lines, headings, clauses, page measures, tables, prose blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import rows_match

# The patterns of clause recognition.
SECTION = r"(?i)^\s{0,8}Section\s+([IVXLCDM]+|\d{1,2})\b"
NUMBERED = r"^\s{0,8}(\d{1,2}(?:\.\d{1,3}){0,3})[\.\)]\s"
DEFINITION = r"^\s{0,6}([A-Z][A-Za-z][A-Za-z /&'-]{1,38}):\s"
EXCLUSION = r"(?i)\bCode\s+Excl\s*(\d{2})\b"
PAGE_NUMBER = r"^\s*\d{1,3}\s*(?:/|of)\s*\d{1,3}\s*$"
DEFINITIONS = r"(?i)^\s{0,8}(?:(?:[IVXLCDM]+|\d{1,2}(?:\.\d{1,2})*)[\s.)\-]*)?(?:standard|specific|general)?\s*definitions?\s*:?\s*$"
SUB_CLAUSE = r"^[ \t]{0,10}\(?(?:[ivxlcdm]{1,5}|[A-Za-z]|\d{1,2})[.)][ \t]"
PROSE_CHARS = 1200


def lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_id, page, line_no, line) of every chunk once."""
    one = chunks.where("chunk_id is not null").select("chunk_id", "source_id", F.col("span.page").alias("page"), "text").dropDuplicates(["chunk_id"])
    return one.select("chunk_id", "source_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def running_lines(rows: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(source_id, line): trimmed lines on at least max(least, share of the source's pages) pages."""
    pages = rows.groupBy("source_id").agg(F.countDistinct("page").alias("pages"))
    seen = rows.select("source_id", "page", F.trim("line").alias("line")).where("line <> ''").distinct().groupBy("source_id", "line").agg(F.count("page").alias("n"))
    return seen.join(pages, "source_id").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("source_id", "line", "n")


def page_ranges(rows: DataFrame, by: str, page: str) -> DataFrame:
    """(by, ranges): pages as 1-3, 7."""
    one = rows.where(F.col(page).isNotNull()).select(by, F.col(page).alias("p")).distinct()
    isle = one.withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy(by).orderBy("p")))
    runs = isle.groupBy(by, "g").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def page_measures(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.size(words)
    long = F.size(F.filter(words, lambda w: F.length(w) > 30))
    return {
        "chars": F.length(t).cast("bigint"), "words": n.cast("bigint"), "has_text": F.length(F.trim(t)) >= 80, "fused": F.when(n > 0, long / n >= 0.03).otherwise(False),
        "ligatures": F.regexp_count(t, F.lit("[ﬀ-ﬆ]")).cast("bigint"), "soft_hyphens": F.regexp_count(t, F.lit("\u00ad")).cast("bigint"), "nbsp": F.regexp_count(t, F.lit("\u00a0")).cast("bigint"), "devanagari": F.regexp_count(t, F.lit("[ऀ-ॿ]")).cast("bigint"), "replaced": F.regexp_count(t, F.lit("�")).cast("bigint"),
    }


def pack_segments(segments: list[str], most: int = PROSE_CHARS) -> list[str]:
    """Greedy packing, never inside a segment; one that is too long stands alone."""
    out: list[str] = []
    for s in segments:
        if out and len(out[-1]) + 1 + len(s) <= most:
            out[-1] += "\n" + s
        else:
            out.append(s)
    return out


def blocks(text: str, most: int = PROSE_CHARS) -> list[tuple[str, str | None, str]]:
    """(kind, clause_id, text) of the pieces of a document."""
    return [(kind, clause, piece) for kind, clause, _, piece in outline(text, most)]


def outline(text: str, most: int = PROSE_CHARS, furniture: frozenset[str] = frozenset()) -> list[tuple[str, str | None, tuple[str, ...], str]]:
    """(kind, clause_id, section path, text) of the pieces of a document, by a fold over its lines. The path
    are the ids of the open headings above. Trimmed lines in `furniture` are headers and footers: no headings.

    A section or numbered heading no deeper than the open block closes it; a deeper one and a
    sub-clause marker start a segment of it. A heading of definitions turns definitions on until a
    heading at its depth; inside, each definition is a block and is never split."""
    out: list[tuple[str, str | None, tuple[str, ...], str]] = []
    above: list[tuple[int, str]] = []
    path: tuple[str, ...] = ()
    kind, clause, depth, mode = "prose", None, 0, 0
    segments: list[list[str]] = []

    def close() -> None:
        parts = ["\n".join(s).strip() for s in segments]
        parts = [p for p in parts if p]
        for piece in ["\n".join(parts)] if kind == "definition" and parts else pack_segments(parts, most):
            out.append((kind, clause, path, piece))

    def under(level: int, name: str | None) -> tuple[str, ...]:
        while above and above[-1][0] >= level:
            above.pop()
        ids = tuple(n for _, n in above)
        if name:
            above.append((level, name))
        return ids

    for line in text.split("\n"):
        if re.match(PAGE_NUMBER, line):
            continue
        plain = line.strip() in furniture
        m_def = not plain and mode and re.match(DEFINITION, line)
        m_sec, m_num = (None, None) if plain else (re.match(SECTION, line), re.match(NUMBERED, line))
        level = 1 if m_sec else m_num[1].count(".") + 1 if m_num else 0
        if not plain and re.match(DEFINITIONS, line):
            close()
            mode = depth = level or 1
            path = under(depth, "definitions")
            kind, clause, segments = "prose", None, [[line]]
        elif m_def:
            close()
            path = under(mode + 1, None)
            kind, clause, depth, segments = "definition", "def." + re.sub("[^a-z0-9]+", "_", m_def[1].lower()).strip("_"), mode + 1, [[line]]
        elif level and (not segments or level <= depth or depth == 0):
            close()
            mode = 0 if mode and level <= mode else mode
            path = under(level, m_sec[1] if m_sec else m_num[1])
            kind, clause, depth, segments = "prose", m_sec[1] if m_sec else m_num[1], level, [[line]]
        elif not segments or level or re.match(SUB_CLAUSE, line):
            segments.append([line])
        else:
            segments[-1].append(line)
    close()
    return out


def clause_chunks(docs: DataFrame, key: str, text: str, most: int = PROSE_CHARS) -> DataFrame:
    """(key, ordinal, kind, clause_id, section_path, text): a null text has no pieces. The fold is per row, nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches):  # noqa: ANN001, ANN202
        for df in batches:
            got = [(k, i, kind, clause, list(path), piece) for k, t in zip(df.iloc[:, 0], df.iloc[:, 1]) for i, (kind, clause, path, piece) in enumerate(outline(t, most))]
            yield pd.DataFrame(got, columns=["id", "ordinal", "kind", "clause_id", "section_path", "text"])

    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(rows, f"id {kind}, ordinal int, kind string, clause_id string, section_path array<string>, text string").withColumnRenamed("id", key)


def table_rows(chunks: DataFrame, *keep: Column | str) -> DataFrame:
    """(chunk_id, header, rows) of markdown tables, and what is to be kept of the chunk: cells trimmed, the rule line dropped."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    all_lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x).startswith("|"))
    grid = F.transform(F.filter(all_lines, lambda x: ~x.rlike(r"^[\s|:-]+$")), cells)
    one = chunks.where("chunk_id is not null and kind = 'table_markdown'").select("chunk_id", "text", *keep).dropDuplicates(["chunk_id"])
    kept = one.columns[2:]
    return one.select("chunk_id", *kept, grid.alias("g")).where("size(g) > 0").select("chunk_id", *kept, F.col("g")[0].alias("header"), F.expr("slice(g, 2, size(g))").alias("rows"))


def row_sentences(header: Column, row: Column) -> Column:
    """For H V: h2 is v2; h3 is v3."""
    rest = F.transform(F.filter(F.arrays_zip(F.slice(header, 2, F.greatest(F.size(header) - 1, F.lit(0))).alias("h"), F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))).alias("v")), lambda x: F.coalesce(x["v"], F.lit("")) != ""), lambda x: F.concat(F.coalesce(x["h"], F.lit("")), F.lit(" is "), x["v"]))
    return F.concat(F.lit("For "), header[0], F.lit(" "), row[0], F.lit(": "), F.array_join(rest, "; "))


def markdown(header: Column, rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(header) - F.size(r), F.lit(0)))), lambda c: F.replace(c, F.lit("|"), F.lit("/"))), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header)), F.array(F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(header)))), F.transform(rows, line)), "\n")


def stitch(fragments: DataFrame) -> DataFrame:
    """(source_id, table_no, fragments, pages, header, rows): a fragment goes on when it is on the next page,
    the last one reaches the bottom (within 90), it starts at the top (140), and the columns agree
    within 24, or where neither has known columns, its edges. A repeated header row is dropped, letter
    case and blank cells aside; another internal header becomes a row.
    fragments: source_id, page, index_on_page, y0, y1, page_height, col_xs, header, rows; x0, x1 if known."""
    w = Window.partitionBy("source_id").orderBy("page", "index_on_page")
    prev = lambda c: F.lag(c).over(w)
    same = F.forall(F.zip_with("col_xs", prev("col_xs"), lambda a, b: F.coalesce(F.abs(a - b) <= 24, F.lit(False))), lambda x: x)
    if {"x0", "x1"} <= set(fragments.columns):
        bare = (F.size("col_xs") <= 0) & (F.size(prev("col_xs")) <= 0)
        same = F.when(bare, (F.abs(F.col("x0") - prev("x0")) <= 24) & (F.abs(F.col("x1") - prev("x1")) <= 24)).otherwise(same)
    goes_on = (F.col("page") == prev("page") + 1) & (prev("y1") >= prev("page_height") - 90) & (F.col("y0") <= 140) & (F.size("col_xs") == F.size(prev("col_xs"))) & same
    numbered = fragments.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("table_no", F.sum("new").over(w))
    parts = numbered.groupBy("source_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("page", "index_on_page", "header", "rows"))).alias("p"))
    rows = F.flatten(F.transform("p", lambda x, i: F.when((i == 0) | rows_match(x["header"], F.col("p")[0]["header"]), x["rows"]).otherwise(F.concat(F.array(x["header"]), x["rows"]))))
    return parts.select("source_id", "table_no", F.size("p").alias("fragments"), F.transform("p", lambda x: x["page"]).alias("pages"), F.col("p")[0]["header"].alias("header"), rows.alias("rows"))
