"""Evaluation items as rows of a spreadsheet: lists in one cell, spans in three columns by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the sheet, the separator within a cell, and what counts as yes.
COLUMNS = ("id", "strata", "expected_behaviour", "question", "reference_answer", "concept_id", "document_id", "page", "clause_id", "must_not_cite", "expected_to_fail", "expected_failure_reason", "injection_canary", "notes", "authored_by", "as_of_date")
SEP, YES = "|", ("true", "yes", "y", "1")


def cell(c: Column) -> Column:
    """The trimmed cell; a blank one is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def positions(c: Column) -> Column:
    """The parts of a cell by position, blank parts kept; an empty cell has none."""
    return F.when(cell(c).isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(F.trim(c.cast("string")), r"\|"), lambda p: F.trim(p)))


def listed(c: Column) -> Column:
    """The parts of a cell that are not blank."""
    return F.filter(positions(c), lambda p: p != "")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*YES), F.lit(False))


def rows_of(items: DataFrame) -> DataFrame:
    """Items as sheet rows, all text; what is missing is an empty cell, also within a span column."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    spans = lambda f: F.coalesce(F.array_join(F.transform("ground_truth_spans", lambda s: F.coalesce(s[f].cast("string"), F.lit(""))), SEP), F.lit(""))
    made = {"document_id": spans("document_id"), "page": spans("page"), "clause_id": spans("clause_id"), "must_not_cite": F.coalesce(F.array_join("must_not_cite", SEP), F.lit("")), "expected_to_fail": F.when(F.coalesce("expected_to_fail", F.lit(False)), "TRUE").otherwise("")}
    return items.select(*(made.get(c, text(c)).alias(c) for c in COLUMNS))


def items_of(rows: DataFrame) -> DataFrame:
    """Sheet rows as items with a `problem`. A row without an id or a question is not started and is left out.

    Pages must be as many as documents, and clauses too unless all are blank; a page is a number.
    A row with a problem keeps its scalar fields and has no spans."""
    begun = rows.where(cell(F.col("id")).isNotNull() & cell(F.col("question")).isNotNull())
    parts = begun.withColumns({"d": positions(F.col("document_id")), "p": positions(F.col("page")), "c": positions(F.col("clause_id"))})
    said = F.exists("c", lambda x: x != "")
    problem = (
        F.when(said & (F.size("c") != F.size("d")), "clauses and documents differ in number").when((F.size("d") > 0) & (F.size("p") != F.size("d")), "pages and documents differ in number")
        .when(F.exists("p", lambda x: (x != "") & ~x.rlike(r"^\d{1,9}$")), "a page is not a number")
    )
    spans = F.transform("d", lambda d, i: F.struct(d.alias("document_id"), F.get("p", i).try_cast("int").alias("page"), F.nullif(F.get("c", i), F.lit("")).alias("clause_id")))
    plain = ("reference_answer", "concept_id", "notes", "expected_failure_reason", "injection_canary")
    return parts.withColumn("problem", problem).select(
        cell(F.col("id")).alias("id"), cell(F.col("strata")).alias("strata"), cell(F.col("expected_behaviour")).alias("expected_behaviour"), cell(F.col("question")).alias("question"), F.coalesce(cell(F.col("authored_by")), F.lit("human")).alias("authored_by"), *(cell(F.col(c)).alias(c) for c in plain),
        cell(F.col("as_of_date")).try_cast("date").alias("as_of_date"), F.when(F.col("problem").isNull(), spans).alias("ground_truth_spans"), listed(F.col("must_not_cite")).alias("must_not_cite"), truthy(F.col("expected_to_fail")).alias("expected_to_fail"), "problem",
    )


def staged_write(rows: DataFrame, path: str) -> None:
    """Write the items of a sheet beside `path`, then put them there. A row with a problem stops it before anything changes."""
    items = items_of(rows)
    bad = [f"{r['id']}: {r['problem']}" for r in items.where("problem is not null").select("id", "problem").limit(20).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    spark = rows.sparkSession
    staged = f"{path}.staged"
    items.drop("problem").write.mode("overwrite").parquet(staged)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(at, True)
    if not files.rename(jvm.org.apache.hadoop.fs.Path(staged), at):
        raise OSError(f"could not put {staged} at {path}")
