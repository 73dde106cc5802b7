"""Problem 6: the periods of each source's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import FOREVER, source_periods
from ..sources.parquet import table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    periods = source_periods(table(spark, sf, "source_snapshots"))
    return periods.select("source_id", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit(FOREVER)).alias("valid_to"))


def p6_history(spark: SparkSession, sf: str) -> DataFrame:
    """The periods with their states."""
    periods = source_periods(table(spark, sf, "source_snapshots"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    state = F.col("state")
    return periods.select("source_id", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit(FOREVER)).alias("valid_to"), state["f0"].alias("version_label"), day(state["f1"]).alias("effective_from"), day(state["f2"]).alias("effective_to"), state["f3"].alias("superseded_by"))


_PERIODS = r"""
    with latest as (select *, row_number() over (partition by source_id, snapshot_date order by loaded_at desc nulls last) as rn from source_snapshots where source_id is not null and snapshot_date is not null),
    kept as (select source_id, snapshot_date, coalesce(withdrawn, false) as gone, nullif(lower(regexp_replace(version_label, '^\s+|\s+$', '', 'g')), '') as version_label, effective_from, effective_to, superseded_by from latest where rn = 1),
    keyed as (select *, row(gone, version_label, effective_from, effective_to, superseded_by)::varchar as state from kept),
    marked as (select *, coalesce(state <> lag(state) over w, true) as new from keyed window w as (partition by source_id order by snapshot_date)),
    opened as (select *, lead(snapshot_date) over (partition by source_id order by snapshot_date) as next from marked where new)
    select source_id, strftime(snapshot_date, '%Y-%m-%d') as valid_from, coalesce(strftime(next, '%Y-%m-%d'), '9999-12-31') as valid_to{more} from opened where not gone"""

QUERIES = {"p6_found": p6_found, "p6_history": p6_history}
ORACLES = {
    "p6_found": _PERIODS.replace("{more}", ""),
    "p6_history": _PERIODS.replace("{more}", ", version_label, strftime(effective_from, '%Y-%m-%d') as effective_from, strftime(effective_to, '%Y-%m-%d') as effective_to, superseded_by"),
}
