"""Lines repeated across the records of one source (problem 3), kept as incremental count tables.

The state has three tables: `counts` (source, line key, number of different records with the line),
`places` (source, line key, record, line number) and `seen` (record, digest of the text counted). A new
partition of records is a delta: its own counts, less those of the records it replaces, are merged
into the table, the lines whose count crosses the limit by this merge are the crossings, and `places`
leads from them to the records that are rebuilt, so the corpus is not read again. Counting a partition
twice, or a record that was delivered again, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

LIMIT = 6
PER_TASK = 50_000  # records of one crossed line that a task meets; a line of more is dealt to more tasks
FEW = 1_000_000  # lines of that many records that are broadcast (30 MB); more are joined
KEY = ["source", "k1", "k2"]
EMPTY_COUNTS = "source string, k1 bigint, k2 int, n bigint"


def line_form(line: Column) -> Column:
    """Lower case, outer white space gone, inner runs of it one blank, runs of digits one digit."""
    squeezed = F.regexp_replace(F.lower(line), r"(?U)\s+", " ")
    return F.regexp_replace(F.trim(squeezed), r"(?U)\d+", "0")


def _key(form: Column) -> list[Column]:
    return [F.xxhash64(form).alias("k1"), F.hash(form).alias("k2")]


def _forms(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), line_form)


def records(rows: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(id, source, text) of the rows that can be counted: id, source and text are not null."""
    return rows.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).where("id is not null and source is not null and text is not null")


def delta_counts(recs: DataFrame) -> DataFrame:
    """(source, k1, k2, n): in how many different records of the source each line with a letter stands.
    A line repeated within a record, and a record repeated in the partition, count once."""
    lines = recs.select("source", F.xxhash64("id").alias("h"), F.explode(F.array_distinct(F.filter(_forms(F.col("text")), lambda x: x.rlike(r"\p{L}")))).alias("form"))
    once = lines.select("source", *_key(F.col("form")), "h").distinct()
    return once.groupBy("source", "k1", "k2").agg(F.count("*").alias("n"))


def merge_counts(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The count table after a delta, with the count before it in `was`."""
    both = old.select("source", "k1", "k2", "n", F.col("n").alias("was")).unionByName(delta.select("source", "k1", "k2", "n", F.lit(0).cast("bigint").alias("was")))
    return both.groupBy("source", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))


def crossings(merged: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The lines that reach the limit by this merge, with their counts."""
    return merged.where((F.col("n") >= limit) & (F.col("was") < limit)).select(*KEY, "n")


def marked_lines(recs: DataFrame, crossed: DataFrame) -> DataFrame:
    """(id, line_no) of every line of the records that is among the crossed lines.

    If the crossed lines come with their counts `n`, those of many records are dealt to as many tasks
    as their count asks for."""
    lines = recs.select("id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("form", line_form(F.col("line"))).where(F.col("form").rlike(r"\p{L}"))
    left = lines.select("id", "source", F.xxhash64("id", "pos").alias("h"), (F.col("pos") + 1).alias("line_no"), *_key(F.col("form")))
    if "n" not in crossed.columns:
        return left.join(crossed, KEY, "left_semi").select("id", "line_no").distinct()
    tasks = F.ceil(F.col("n") / PER_TASK).cast("int")
    hot = cut(crossed.where(F.col("n") > PER_TASK).select(*KEY, tasks.alias("tasks")))
    hot = F.broadcast(hot) if hot.count() <= FEW else hot
    dealt = left.join(hot, KEY, "left").withColumn("salt", F.pmod(F.col("h"), F.coalesce("tasks", F.lit(1))).cast("int"))
    right = crossed.select(*KEY, F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"))
    return dealt.join(right, [*KEY, "salt"], "left_semi").select("id", "line_no").distinct()


def rebuilt(recs: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, text) of the records that lose a line, without their marked lines. Untouched records do
    not appear. A record of marked lines only becomes the empty text."""
    gone = marked.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    hit = recs.join(gone, "id")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i + 1))
    return hit.select("id", F.array_join(kept, "\n").alias("text")).distinct()


def placed(recs: DataFrame) -> DataFrame:
    """(source, k1, k2, id, line_no): every line with a letter of the records."""
    lines = recs.select("id", "source", F.posexplode(_forms(F.col("text"))).alias("pos", "form")).where(F.col("form").rlike(r"\p{L}"))
    return lines.select("source", *_key(F.col("form")), "id", (F.col("pos") + 1).alias("line_no"))


@dataclass(frozen=True)
class LineState:
    """Counts, places and counted records so far. All are plain tables: write them, read them, go on."""

    counts: DataFrame
    seen: DataFrame
    places: DataFrame

    @classmethod
    def empty(cls, recs: DataFrame) -> LineState:
        make = lambda df: recs.sparkSession.createDataFrame([], df.schema)
        return cls(make(recs.sparkSession.createDataFrame([], EMPTY_COUNTS)), make(_digests(recs)), make(placed(recs)))

    def advance(self, recs: DataFrame, limit: int = LIMIT) -> Step:
        """The state after a partition of records, and what the partition changes.

        Records that were counted with the same text change nothing. A record that comes with another
        text replaces the one before. Of rows that differ under one id in a partition the greatest by
        contents is taken."""
        one = recs.groupBy("id").agg(F.max(F.struct("source", "text")).alias("r")).select("id", "r.source", "r.text")
        fresh = cut(one.withColumn("digest", F.md5("text")).join(self.seen, ["id", "source", "digest"], "left_anti").drop("digest"))
        changed = cut(fresh.select("id").join(self.seen.select("id"), "id", "left_semi"))
        new, old = placed(fresh), self.places.join(changed, "id", "left_semi")
        sides = new.select(*KEY, "id").distinct().withColumn("d", F.lit(1)).unionByName(old.select(*KEY, "id").distinct().withColumn("d", F.lit(-1)))
        delta = sides.groupBy(*KEY).agg(F.sum("d").cast("bigint").alias("n"))
        merged = cut(merge_counts(self.counts, delta).where("n > 0 or was > 0"))
        places = self.places.join(changed, "id", "left_anti").unionByName(new)
        over = merged.where(F.col("n") >= limit).select(*KEY).join(new.select(*KEY).distinct(), KEY, "left_semi")
        met = lambda lines, keys: lines.join(keys, KEY, "left_semi").select("id", "line_no").distinct()
        marked = met(places, crossings(merged, limit)).unionByName(met(new, over)).distinct()
        cleared = met(self.places, merged.where((F.col("n") < limit) & (F.col("was") >= limit)).select(*KEY))
        seen = self.seen.join(changed, "id", "left_anti").unionByName(_digests(fresh))
        return Step(LineState(merged.where("n > 0").select(*KEY, "n"), seen, places), over, marked, cleared.unionByName(old.select("id", "line_no")).distinct())

    def merge(self, recs: DataFrame, limit: int = LIMIT) -> tuple[LineState, DataFrame]:
        """The state after a partition of records, and the lines over the limit that stand in its new
        records: those that reach it now, whose earlier records change too, and those that did before."""
        step = self.advance(recs, limit)
        return step.state, step.over


@dataclass(frozen=True)
class Step:
    """What a partition did: the state after it, the lines over the limit in its new records, and the
    (id, line_no) that are to go now (`marked`) or to stay after all (`cleared`), of whatever record."""

    state: LineState
    over: DataFrame
    marked: DataFrame
    cleared: DataFrame


def _digests(recs: DataFrame) -> DataFrame:
    return recs.select("id", "source", F.md5("text").alias("digest")).distinct()


def in_deltas(parts: Iterable[DataFrame], limit: int = LIMIT) -> DataFrame | None:
    """(id, line_no) after all parts were merged in turn; None without a part. Between parts the state is
    written to the shared folder, as it would be kept between days."""
    state = marks = None
    for recs in parts:
        state = state or LineState.empty(recs)
        marks = recs.sparkSession.createDataFrame([], recs.select("id", F.lit(1).alias("line_no")).schema) if marks is None else marks
        step = state.advance(recs, limit)
        state = LineState(cut(step.state.counts), cut(step.state.seen), cut(step.state.places))
        marks = cut(marks.join(step.cleared, ["id", "line_no"], "left_anti").unionByName(step.marked).distinct())
    return marks


def repeated_lines(rows: DataFrame, key: str = "chunk_id", source: str = "source_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, line_no) over a corpus that is one delta to an empty state. Null ids, sources and texts
    take no part; an empty corpus gives no rows."""
    recs = records(rows, key, source, text)
    crossed = cut(crossings(merge_counts(recs.sparkSession.createDataFrame([], EMPTY_COUNTS), delta_counts(recs)), limit))
    return marked_lines(recs, crossed).select(F.col("id").alias(key), "line_no")
