"""The rate limiter as a stream: batches in turn equal one fold, and state ends."""

import datetime as dt
import random

from clausewright.operators.answers import rate_limit
from clausewright.streaming.limits import run_files

START = dt.datetime(2025, 1, 1)


def test_batches_equal_the_fold(spark, tmp_path):
    rng = random.Random(6)
    calls = sorted((rng.randrange(40_000), i) for i in range(400))
    rows = [(i, rng.randrange(5) if i % 50 else None, START + dt.timedelta(seconds=t)) for t, i in calls]
    schema = "event_id long, user_id long, ts timestamp"
    whole = spark.createDataFrame(rows, schema)
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r["event_id"], r["accepted"]) for r in rate_limit(whole, 2, 600).collect()}
    got = [(r["event_id"], r["accepted"]) for r in run_files(spark, str(tmp_path / "in"), schema, 2, 600).collect()]
    assert len(got) == len(set(got)) == 392 and set(got) == want and {a for _, a in want} == {True, False}
