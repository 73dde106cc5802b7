"""Queries of the training-data problems, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.parquet import table
from .lines import in_deltas, records, rebuilt, repeated_lines
from .looks import form_report, same_looks
from .near import group_pairs, near_duplicates
from .packing import pack_documents
from .pairs import defective_pairs
from .reading import reading_bands
from .residue import residue
from .split import split_oversized
from .tokens import encoded, vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return group_pairs(near_duplicates(table(spark, sf, "chunks"), "chunk_id", "text"), "chunk_id")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of a group, with the group's id."""
    return near_duplicates(table(spark, sf, "chunks"), "chunk_id", "text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_looks(table(spark, sf, "chunks"))


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    return form_report(table(spark, sf, "chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(table(spark, sf, "chunks"))


def p3_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text without its repeated lines; texts without any stay as they are."""
    chunks = table(spark, sf, "chunks")
    recs = records(chunks, "chunk_id", "source_id", "text")
    lost = rebuilt(recs, repeated_lines(chunks).select(F.col("chunk_id").alias("id"), "line_no")).select(F.col("id").alias("chunk_id"), F.col("text").alias("cleaned"))
    return chunks.select("chunk_id", "text").distinct().join(lost, "chunk_id", "left").select("chunk_id", F.coalesce("cleaned", "text").alias("text"))


def p3_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """p3_found by the state: the quarters in which rows were loaded are merged in turn, rows without a time first."""
    chunks = table(spark, sf, "chunks").withColumn("quarter", F.coalesce(F.date_format(F.date_trunc("quarter", "loaded_at"), "yyyy-MM-dd"), F.lit("")))
    quarters = [r[0] for r in chunks.select("quarter").distinct().orderBy("quarter").collect()]  # a calendar
    marks = in_deltas(records(chunks.where(F.col("quarter") == q), "chunk_id", "source_id", "text") for q in quarters)
    if marks is None:
        return repeated_lines(chunks)
    return marks.select(F.col("id").alias("chunk_id"), "line_no")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return defective_pairs(table(spark, sf, "golden"), table(spark, sf, "judge_validate"), table(spark, sf, "documents").select("lang", "text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "chunks"))


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "chunks"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pieces(spark, sf).groupBy("chunk_id").agg(F.max("piece_no").alias("pieces")).where("pieces > 1").select("chunk_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(table(spark, sf, "documents"), "doc_id", "text", vocabulary_path())


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), vocabulary_path())


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading_bands(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def queries() -> dict[str, Query]:
    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        return run

    return {f.__name__: shipped(f) for f in (p1_found, p1_groups, p2_found, p2_forms, p3_found, p3_texts, p3_deltas, p4_found, p5_found, p7_found, p7_pieces, p8_ids, p9_containers, p10_found)}


_FORM = r"regexp_replace(trim(regexp_replace(lower(line), '[\s\x0b\x0c\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '\p{Nd}+', '0', 'g')"


def oracle_sql() -> dict[str, str]:
    marked = f"""
        lines as (select distinct chunk_id, source_id, line_no, {_FORM} as form from (
            select chunk_id, source_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from chunks where source_id is not null)),
        hot as (select source_id, form from lines where regexp_matches(form, '\\p{{L}}') group by source_id, form having count(distinct chunk_id) >= 6),
        marked as (select distinct chunk_id, line_no from lines join hot using (source_id, form))"""
    return {
        "p3_found": f"with {marked} select chunk_id, cast(line_no as int) as line_no from marked",
        "p3_deltas": f"with {marked} select chunk_id, cast(line_no as int) as line_no from marked",
        "p3_texts": f"""with {marked},
            parts as (select distinct chunk_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from chunks)
            select chunk_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where m is null), case when any_value(text) is not null then '' end) as text
            from (select p.*, m.chunk_id as m from parts p left join marked m using (chunk_id, line_no)) group by chunk_id""",
        "p7_found": "select distinct chunk_id from chunks where length(text) > 1200",
    }
