"""Validity periods of entity states from periodic snapshots, by presence bitmaps.

For every entity and state one bit is set per snapshot of the entity that shows the state. Bits are
numbered by the entity's own snapshots, so a missing snapshot leaves no hole. A run of consecutive
bits is one period. Bitmaps are kept as 62-bit words; a word is one row and so is a run, so a
long history is never held in one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 62
FOREVER = "9999-12-31"


def winners(rows: DataFrame, entity: str, at: str, loaded: str, fields: Sequence[tuple[str, Column]], withdrawn: str) -> DataFrame:
    """One row per entity and snapshot, the one loaded last. Equal load times: the greatest row by
    its contents, so that repeated and reordered input gives the same result. A null load time is
    the oldest. Rows with a null entity or snapshot are ignored; a null withdrawn flag is false."""
    state = F.struct(*[c.alias(f"f{i}") for i, (_, c) in enumerate(fields)])
    row = F.struct(F.coalesce(F.col(loaded).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("l"), F.coalesce(F.col(withdrawn), F.lit(False)).alias("w"), state.alias("s"))
    return rows.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(entity).alias("e"), F.col(at).alias("d"), row.alias("r")).groupBy("e", "d").agg(F.max("r").alias("r")).select("e", "d", "r.w", "r.s")


def validity_periods(rows: DataFrame, entity: str, at: str, loaded: str, fields: Sequence[tuple[str, Column]], withdrawn: str) -> DataFrame:
    """(entity, valid_from, valid_to, state): valid_to is exclusive, null while the state is current.

    Null is a value of a field. A withdrawn snapshot opens no period and ends the one before.
    After the first aggregation an entity has one row per snapshot date, so its window is small
    however often rows were delivered again. Empty input gives no rows."""
    w = Window.partitionBy("e").orderBy("d")
    snaps = winners(rows, entity, at, loaded, fields, withdrawn).withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.lead("d").over(w))
    word, bit = (F.col("i") / WORD).cast("int"), F.expr(f"shiftleft(1L, i % {WORD})")
    maps = snaps.where("not w").groupBy("e", "s", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    seq = Window.partitionBy("e", "s").orderBy("word")
    top = F.shiftright(F.col("bits"), WORD - 1).bitwiseAND(F.lit(1).cast("bigint"))
    before = F.when(F.lag("word").over(seq) == F.col("word") - 1, F.lag(top).over(seq)).otherwise(F.lit(0).cast("bigint"))
    after = F.when(F.lead("word").over(seq) == F.col("word") + 1, F.lead(F.col("bits").bitwiseAND(F.lit(1).cast("bigint"))).over(seq)).otherwise(F.lit(0).cast("bigint"))
    edged = maps.select("e", "s", "word", "bits", before.alias("before"), after.alias("after"))
    starts = F.expr("bits & ~((bits << 1) | before)")
    ends = F.expr(f"bits & ~((bits >> 1) | (after << {WORD - 1}))")
    marks = lambda m, kind: F.expr(f"filter(transform(sequence(0, {WORD - 1}), p -> if(({m} >> p) & 1L = 1L, struct(word * {WORD} + p as at, {kind} as kind), null)), x -> x is not null)")
    # In the order of their bits every start is followed by the end of its run.
    bounds = edged.withColumn("sb", starts).withColumn("eb", ends).select("e", "s", F.explode(F.concat(marks("sb", 0), marks("eb", 1))).alias("m"))
    runs = bounds.select("e", "s", "m.kind", F.col("m.at").alias("first"), F.lead("m.at").over(Window.partitionBy("e", "s").orderBy("m.at", "m.kind")).alias("last")).where("kind = 0")
    dates = snaps.select("e", "i", "d", "next")
    opened = runs.join(dates.select("e", F.col("i").alias("first"), F.col("d").alias("valid_from")), ["e", "first"])
    return opened.join(dates.select("e", F.col("i").alias("last"), F.col("next").alias("valid_to")), ["e", "last"]).select(F.col("e").alias(entity), "valid_from", "valid_to", F.col("s").alias("state"))


def clean_label(c: Column) -> Column:
    """Lower case without outer white space; a blank label is null."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def source_periods(snapshots: DataFrame) -> DataFrame:
    fields = [("version_label", clean_label(F.col("version_label"))), ("effective_from", F.col("effective_from")), ("effective_to", F.col("effective_to")), ("superseded_by", F.col("superseded_by"))]
    return validity_periods(snapshots, "source_id", "snapshot_date", "loaded_at", fields, "withdrawn")
