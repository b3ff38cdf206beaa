"""Event streams over tables of several files whose times overlap."""

import duckdb
import pytest
from tallgrass.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr([f"{v:.10g}" if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", ["str_dedupe", "str_lease", "str_session", "str_sliding", "str_tumbling"])
def test_events_in_files_out_of_order(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(5, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = duck.sql(f"select {', '.join(got.columns)} from ({ORACLE[name]})").fetchall()
    assert want and plain(got.collect()) == plain(want)


def test_misses_are_joins(spark):
    """No task holds a target's jobs."""
    from tallgrass.streaming import state

    jobs = spark.createDataFrame([(1, "a", 1, 0, True)], "target long, url_key string, job_id long, missing_count int, is_active boolean")
    runs = spark.createDataFrame([(1, 1, 1)], "target long, run long, seen long")
    found = spark.createDataFrame([(1, 1, "b", None)], "target long, run long, url_key string, expected long")
    after = state.missed(found, jobs)._counted(jobs, found, runs)
    assert [(r.missing_count, r.is_active, r.outcome) for r in after.collect()] == [(1, True, "reconciled")]
    assert "Python" not in after._jdf.queryExecution().executedPlan().toString()


def test_retries_of_many_requests_in_few_shares(spark, tmp_path):
    """State is kept by share, not by request; a request without an id is one too."""
    import datetime

    from tallgrass.streaming import events as ev
    from tallgrass.streaming import state

    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(i, at, True) for i in [*range(300), None]] + [(i, at + datetime.timedelta(seconds=5), False) for i in range(0, 300, 2)]
    for n, part in enumerate((rows, [(-1, at + datetime.timedelta(days=9), False)])):
        spark.createDataFrame(part, "request_id long, at timestamp, failed boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("request_id long, at timestamp, failed boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with state.rocksdb(spark):
        ev.into_table(state.retries(source, base=60, late="1 minute", shares=3), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.request_id, r.attempt, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(i, 1, "done" if i is not None and i % 2 == 0 else "retry") for i in [*range(300), None]}
