"""Tables cut from documents: labels, classes of what was stitched, header recovery, sentences and row groups.

A table is a row (table_id, source_id, pages, header, rows, clause_id, caption): header is an array of
cells, rows an array of such arrays. All rules are expressions on one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROSE_HEADER, TABLE_CHARS = 250, 1400


def clean_cell(cell: Column) -> Column:
    """White space runs as one blank, ends trimmed; a missing cell is empty."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " "))


def rows_match(a: Column, b: Column) -> Column:
    """Equal and not empty, letter case and blank cells aside."""
    said = lambda r: F.filter(F.transform(r, lambda c: F.lower(clean_cell(c))), lambda c: c != "")
    return F.coalesce((F.size(said(a)) > 0) & (said(a) == said(b)), F.lit(False))


def filled(header: Column) -> Column:
    return F.filter(header, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def context_label(source: Column, pages: Column, clause: Column, caption: Column) -> Column:
    """source, page or pages, clause, caption; what is missing is left out."""
    first, last = F.element_at(pages, 1), F.element_at(pages, -1)
    where = F.when(F.size(pages) > 1, F.concat(F.lit("pages "), first.cast("string"), F.lit("-"), last.cast("string"))).when(F.size(pages) == 1, F.concat(F.lit("page "), first.cast("string")))
    return F.concat_ws(", ", source, where, F.concat(F.lit("clause "), F.nullif(clause, F.lit(""))), F.nullif(caption, F.lit("")))


def stitch_class(header: Column) -> Column:
    """spurious: no header cells, or one as long as a paragraph; caption_header: one cell; else data_grid."""
    cells = filled(header)
    longest = F.array_max(F.transform(cells, lambda c: F.length(c)))
    return F.when(F.coalesce(F.size(cells), F.lit(0)) <= 0, "spurious").when(longest >= PROSE_HEADER, "spurious").when(F.size(cells) < 2, "caption_header").otherwise("data_grid")


def is_data_row(row: Column) -> Column:
    """The first cell that is not blank has a digit."""
    cells = filled(row)
    return F.when(F.size(cells) > 0, cells[0].rlike(r"\d")).otherwise(False)


def with_recovered_header(tables: DataFrame) -> DataFrame:
    """The tables, and where the header was a lone caption over rows of names, those rows as the header
    (joined by column) and the caption in `recovered`; other tables stay, with a null there."""
    n = F.coalesce(F.array_position(F.transform("rows", is_data_row), True).cast("int") - 1, F.lit(0))
    lead = F.when((n < 0), F.size("rows")).otherwise(n)
    marked = tables.withColumn("lead", F.when((F.size(filled(F.col("header"))) <= 1) & (F.size("rows") > 0), lead).otherwise(0))
    names = F.slice("rows", F.lit(1), F.col("lead"))
    width = F.greatest(F.size("header"), F.array_max(F.transform(names, lambda r: F.size(r))))
    cell = lambda r, i: F.trim(F.coalesce(F.get(r, i), F.lit("")))
    merged = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.filter(F.transform(names, lambda r: cell(r, i)), lambda c: c != ""), " "))
    moved = F.col("lead") > 0
    return marked.select(
        *(c for c in tables.columns if c not in ("header", "rows")), F.when(moved, F.trim(F.get(filled(F.col("header")), F.lit(0)))).alias("recovered"), F.when(moved, merged).otherwise(F.col("header")).alias("header"),
        F.when(moved, F.slice("rows", F.col("lead") + 1, F.size("rows"))).otherwise(F.col("rows")).alias("rows"),
    )


def row_sentence(label: Column, header: Column, row: Column) -> Column:
    """[label] For H V: h2 is v2; h3 is v3. Null for a row without a filled cell under the header."""
    pairs = F.filter(F.transform(header, lambda h, i: F.struct(F.trim(F.coalesce(h, F.lit(""))).alias("h"), F.trim(F.coalesce(F.get(row, i), F.lit(""))).alias("v"))), lambda p: p["v"] != "")
    lead = F.when(pairs[0]["h"] != "", F.concat(pairs[0]["h"], F.lit(" "), pairs[0]["v"])).otherwise(pairs[0]["v"])
    rest = F.array_join(F.transform(F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(1))), lambda p: F.concat(F.when(p["h"] != "", p["h"]).otherwise(F.lit("value")), F.lit(" is "), p["v"])), "; ")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("["), label, F.lit("] For "), lead, F.when(rest != "", F.concat(F.lit(": "), rest)).otherwise(F.lit("")), F.lit(".")))


def sentences(tables: DataFrame) -> DataFrame:
    """(table_id, source_id, ordinal, text): one sentence per filled row of the tables with a header.
    A recovered caption joins the label unless it stands there."""
    label = context_label(F.col("source_id"), F.col("pages"), F.col("clause_id"), F.col("caption"))
    full = F.when(F.col("recovered").isNotNull() & ~F.contains(F.lower(label), F.lower("recovered")), F.concat(label, F.lit(", "), F.col("recovered"))).otherwise(label)
    said = F.filter(F.transform("rows", lambda r: row_sentence(full, F.col("header"), r)), lambda s: s.isNotNull())
    return with_recovered_header(tables.where(F.size(filled(F.col("header"))) > 0)).select("table_id", "source_id", F.posexplode(said).alias("ordinal", "text"))


def markdown_text(label: Column, header: Column, rows: Column) -> Column:
    """The label, a blank line, the header, its rule and the rows, cut or filled to the header's width."""
    n = F.size(header)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.replace(F.coalesce(F.get(r, i), F.lit("")), F.lit("|"), F.lit("/"))), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Table from "), label), F.lit(""), line(header), F.concat(F.lit("|"), F.repeat(F.lit("---|"), n))), F.transform(rows, line)), "\n")


def row_groups(tables: DataFrame, most: int = TABLE_CHARS) -> DataFrame:
    """(table_id, source_id, ordinal, first_row, last_row, split, text): a table within `most` characters
    whole, a longer one in groups of rows, packed in order, each under the header; line breaks do not
    count towards the size of a group. A row that is too long stands alone. Tables without a header or rows have no group."""
    label = context_label(F.col("source_id"), F.col("pages"), F.col("clause_id"), F.col("caption"))
    usable = tables.where((F.size(filled(F.col("header"))) > 0) & (F.size("rows") > 0)).withColumn("label", label)
    usable = usable.withColumn("whole", markdown_text(F.col("label"), F.col("header"), F.col("rows")))
    bare = F.length(markdown_text(F.col("label"), F.col("header"), F.expr("filter(rows, x -> false)")))
    size = lambda r: F.length(F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")) + 4
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("i"))

    def step(acc: Column, r: Column) -> Column:
        over = (acc["i"] > 0) & (F.col("bare") + acc["size"] + size(r) > most)
        return F.struct(F.when(over, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"), F.when(over, size(r)).otherwise(acc["size"] + size(r)).alias("size"), (acc["i"] + 1).alias("i"))

    cut = F.when(F.length("whole") <= most, F.array(F.lit(0))).otherwise(F.aggregate("rows", start, step, lambda acc: acc["starts"]))
    dealt = usable.withColumn("bare", bare).withColumn("starts", cut).select("*", F.posexplode("starts").alias("ordinal", "first_row"))
    last = F.coalesce(F.get("starts", F.col("ordinal") + 1), F.size("rows")) - 1
    split = F.length("whole") > most
    text = F.when(split, markdown_text(F.col("label"), F.col("header"), F.slice("rows", F.col("first_row") + 1, last - F.col("first_row") + 1))).otherwise(F.col("whole"))
    return dealt.select("table_id", "source_id", "ordinal", "first_row", last.alias("last_row"), split.alias("split"), text.alias("text"))


def table_chunks(tables: DataFrame, serialisation: str = "markdown", most: int = TABLE_CHARS) -> DataFrame:
    """(chunk_id, table_id, source_id, kind, text): the chunks of all tables in one of the two forms."""
    if serialisation == "row_nl":
        rows = sentences(tables)
        return rows.select(F.concat("table_id", F.lit("#r"), F.col("ordinal").cast("string")).alias("chunk_id"), "table_id", "source_id", F.lit("table_row_nl").alias("kind"), "text")
    if serialisation != "markdown":
        raise ValueError(f"no serialisation {serialisation!r}")
    rows = row_groups(tables, most)
    tail = F.when(F.col("split"), F.concat(F.lit("#g"), F.col("ordinal").cast("string"))).otherwise(F.lit("#whole"))
    return rows.select(F.concat("table_id", tail).alias("chunk_id"), "table_id", "source_id", F.lit("table_markdown").alias("kind"), "text")


def extraction_report(tables: DataFrame) -> DataFrame:
    """Per source: tables, rows, tables on several pages, without a header, and how many of each class."""
    cls = stitch_class(F.col("header"))
    return tables.groupBy("source_id").agg(
        F.count("*").alias("tables"), F.sum(F.size("rows")).alias("n_rows"), F.count_if(F.size("pages") > 1).alias("page_spanning"), F.count_if(F.size(filled(F.col("header"))) == 0).alias("headerless"),
        *(F.count_if(cls == c).alias(c) for c in ("data_grid", "caption_header", "spurious")),
    )
