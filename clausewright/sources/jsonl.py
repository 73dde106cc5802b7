"""Hand-kept JSON lines: manifests, evaluation items and run logs, with comments, and their errors by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

BROKEN = "_broken"


def read_jsonl(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """(file, line_no, item, problem): one row per line that is neither blank nor a comment (#).

    All problems are found at once: text that is no object of the schema, keys the schema does not
    have, required keys that are missing or null. Lines are numbered within their file, so a file is
    read as one row; these files are kept by hand. Logs without numbers are read by read_log."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_no"), F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    full = StructType([*schema.fields]).add(BROKEN, StringType())
    parsed = lines.withColumn("item", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    extra = F.array_except(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), F.array(*(F.lit(f.name) for f in schema.fields)))
    missing = F.filter(F.array(*(F.when(F.col("item")[r].isNull(), F.lit(r)) for r in required)), lambda x: x.isNotNull())
    problem = (
        F.when(F.col("item").isNull() | F.col("item")[BROKEN].isNotNull() | F.json_object_keys("line").isNull(), "not an object of this kind").when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(extra, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )
    return parsed.select("file", "line_no", F.col("item").dropFields(BROKEN).alias("item"), problem.alias("problem"))


def items_of(read: DataFrame) -> DataFrame:
    """The items of a scan; if any line has a problem, the first twenty are raised."""
    bad = read.where("problem is not null").orderBy("file", "line_no").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file'].rsplit('/', 1)[-1]}:{r['line_no']}: {r['problem']}" for r in bad))
    return read.select("item.*")


def write_jsonl(rows: DataFrame, path: str, header: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """One object a line, null fields left out; the header stands in comments before them."""
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    if header:
        lines = rows.sparkSession.createDataFrame([("\n".join(f"# {h}" for h in header),)], "value string").unionByName(lines)
    lines.write.mode(mode).text(path)


def proven(rows: DataFrame, path: str) -> DataFrame:
    """(line, n): what was written and does not come back the same, or comes back and was not written
    (n below 0); empty if all is well. Repeated rows are counted."""
    back = items_of(read_jsonl(rows.sparkSession, path, rows.schema, ()))
    side = lambda df, n: df.select(F.to_json(F.struct(*rows.columns)).alias("line"), F.lit(n).alias("n"))
    return side(rows, 1).unionByName(side(back, -1)).groupBy("line").agg(F.sum("n").alias("n")).where("n <> 0")


def append_log(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path, mode="append")


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All records of a log; a line that is none of its kind is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
