"""Stored vectors across writes that break off, and keyed state across restarts and redelivery."""

import datetime
from random import Random

import pytest
from pyspark.sql import functions as F
from tallgrass.operators import lifecycle as lc
from tallgrass.operators.indexing import hashed_vector
from tallgrass.sources.collection import Collection, SizeMismatch
from tallgrass.streaming import events as ev
from tallgrass.streaming import state
from tallgrass.streaming.indexing import COLUMNS, index_changes

POINT = "key string, vector array<double>, label string, n long"


@pytest.fixture
def points(spark, tmp_path):
    made = Collection(spark, str(tmp_path / "points"), "label string")
    made.ensure(2, buckets=4)
    return made


def put(spark, points, rows, **more):
    return points.upsert(spark.createDataFrame(rows, POINT), order="n", **more)


def labels(points, version=None):
    return {r.key: r.label for r in points.read(version).collect()}


def test_writing_twice_is_writing_once(spark, points):
    rows = [(f"k{i}", [1.0, float(i)], "a", 1) for i in range(20)] + [("k3", [9.0, 9.0], "last", 2)]
    assert put(spark, points, rows) and put(spark, points, rows)
    got = points.read().collect()
    assert len(got) == 20 and len({r.point_id for r in got}) == 20 and labels(points)["k3"] == "last"
    before = {b.bucket: b.folder for b in points.version()[1]}
    assert put(spark, points, [("k3", [0.0, 1.0], "new", 1)])
    after = {b.bucket: b.folder for b in points.version()[1]}
    assert sum(before[b] != after[b] for b in before) == 1  # one key, one bucket
    assert labels(points)["k3"] == "new" and labels(points, 3)["k3"] == "last" and len(labels(points)) == 20
    assert not put(spark, points, []) and points.version()[0] == 4


def test_a_write_that_breaks_off_leaves_the_old_version(spark, points, monkeypatch):
    put(spark, points, [("a", [1.0, 0.0], "old", 1), ("b", [1.0, 1.0], "old", 1)])
    with monkeypatch.context() as m:
        m.setattr(Collection, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            put(spark, points, [("a", [0.0, 1.0], "new", 1)])
    assert labels(points) == {"a": "old", "b": "old"} and points.version()[0] == 2
    put(spark, points, [("a", [0.0, 1.0], "again", 1)])
    assert labels(points) == {"a": "again", "b": "old"}


def test_two_writers_of_one_version(spark, points):
    from pyspark.errors import AnalysisException

    put(spark, points, [("a", [1.0, 0.0], "first", 1)])
    number, rows = points.version()
    with pytest.raises(AnalysisException):
        points._commit(number, [tuple(r)[:6] for r in rows])
    assert labels(points) == {"a": "first"}


def test_what_is_refused(spark, points, tmp_path):
    with pytest.raises(SizeMismatch):
        points.ensure(3)
    with pytest.raises(ValueError):
        points.ensure(0)
    for key, vector in (("a", [1.0]), ("a", None), ("a", [1.0, float("nan")]), (" ", [1.0, 1.0]), (None, [1.0, 1.0])):
        with pytest.raises(ValueError):
            put(spark, points, [(key, vector, "x", 1), ("fine", [1.0, 1.0], "x", 1)])
    assert labels(points) == {} and points.version()[0] == 1
    with pytest.raises(ValueError):
        put(spark, Collection(spark, str(tmp_path / "none"), "label string"), [])
    put(spark, points, [("a", [1.0, 0.0], "x", 1)])
    points.ensure(2)
    assert labels(points) == {"a": "x"}
    points.ensure(3, recreate=True)
    assert labels(points) == {} and points.version()[1][0]["size"] == 3


def test_batches_that_come_again(spark, points, tmp_path):
    assert put(spark, points, [("a", [1.0, 0.0], "0", 1)], batch=0) and put(spark, points, [("a", [1.0, 0.0], "1", 1)], batch=1)
    assert not put(spark, points, [("a", [1.0, 0.0], "again", 1)], batch=0) and not put(spark, points, [("a", [1.0, 0.0], "again", 1)], batch=1)
    put(spark, points, [], batch=2)
    assert labels(points) == {"a": "1"} and points.version()[1][0].batch == 2


def test_indexing_of_changes(spark, tmp_path):
    record = "key string, content_hash string, embedding_text string, ordinal long"
    batches = [
        [("a", "h1", "one", 1), ("b", "h1", "two", 2), ("b", "h2", "three", 3), (None, "h", "x", 4), ("c", "h", " ", 5)],
        [("a", "h1", "one", 6), ("b", "h3", "four", 7), ("d", None, "five", 8)],
        [("a", "h9", "late", 0), ("d", None, "five", 9), ("b", "h2", "three", 10)],
    ]
    texts = []
    made = Collection(spark, str(tmp_path / "index"), COLUMNS)
    made.ensure(64, buckets=2)
    source = lambda: spark.readStream.schema(record).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, record).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        index_changes(source(), made, hashed_vector, str(tmp_path / "checkpoint"))
        texts.append({r.key: (r.content_hash, r.embeddings) for r in made.read().collect()})
    assert texts == [{"a": ("h1", 1), "b": ("h2", 1)}, {"a": ("h1", 1), "b": ("h3", 2), "d": (None, 1)}, {"a": ("h1", 1), "b": ("h2", 3), "d": (None, 1)}]
    index_changes(source(), made, hashed_vector, str(tmp_path / "another"))  # all batches again, under their numbers
    assert {r.key: (r.content_hash, r.embeddings) for r in made.read().collect()} == texts[-1]
    assert [r.vector for r in made.read().where("key = 'b'").collect()] == hashed_vector(["three"])


def test_batches_that_come_again_are_not_worked_on(spark, tmp_path, monkeypatch):
    """A replay compares and embeds nothing; new records are embedded by as many tasks as there are cores, however few bytes they have."""
    from tallgrass.streaming import indexing

    spark.range(400).selectExpr("cast(id as string) as key", "'h' as content_hash", "concat('text ', id) as embedding_text", "id as ordinal").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    made = Collection(spark, str(tmp_path / "index"), COLUMNS)
    made.ensure(64, buckets=2)
    seen, tasks = [], []
    changed, embedded = indexing.changed, indexing.embedded
    monkeypatch.setattr(indexing, "changed", lambda *a: seen.append(1) or changed(*a))
    monkeypatch.setattr(indexing, "embedded", lambda rows, *a: tasks.append(rows.rdd.getNumPartitions()) or embedded(rows, *a))
    for again in range(2):
        source = spark.readStream.schema("key string, content_hash string, embedding_text string, ordinal long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        index_changes(source, made, hashed_vector, str(tmp_path / f"checkpoint-{again}"))
    assert made.read().count() == 400 and len(seen) == 1 and tasks == [spark.sparkContext.defaultParallelism]


def test_misses_as_in_batch(spark, tmp_path):
    """Run after run the rows of ``reset_seen`` and ``reconcile``; runs in pieces, out of order, again, and across restarts."""
    rng = Random(2)
    jobs = [(t, f"u{i}", 10 * t + i, rng.randrange(2), rng.random() < 0.8) for t in range(4) for i in range(9)]
    runs = {r: [(t, f"u{i}") for t in range(4) for i in range(10) if rng.random() < [0.6, 0.02, 0.9, 0.3][(t + r) % 4]] for r in range(1, 5)}
    closing = lambda r: [(t, r, None, sum(x == t for x, _ in runs[r])) for t in sorted({x for x, _ in runs[r]})]
    seen = {r: [(t, r, u, None) for t, u in runs[r]] for r in runs}
    files = [[seen[1][:5], closing(1) + seen[1][5:]], [closing(3), seen[2] + closing(2)], [seen[1] + closing(1), seen[3]], [seen[4] + closing(4), seen[4]]]
    frame = spark.createDataFrame(jobs, "target long, url_key string, job_id long, missing_count int, is_active boolean")
    with state.rocksdb(spark):
        for k, group in enumerate(files):
            for i, rows in enumerate(group):
                spark.createDataFrame(rows, "target long, run long, url_key string, expected long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}{i}"))
            source = spark.readStream.schema("target long, run long, url_key string, expected long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            ev.into_table(state.missed(source, frame), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.run, r.job_id): (r.missing_count, r.is_active, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    now, current, want = F.lit("2024-01-01").cast("timestamp"), frame, {}
    for r in runs:
        found = spark.createDataFrame(runs[r], "target long, url_key string")
        j = current.join(found.withColumn("seen", F.lit(True)), ["target", "url_key"], "left")
        j = j.select("job_id", "target", "url_key", F.when(F.col("seen"), 0).otherwise(F.col("missing_count")).alias("missing_count"), (F.col("seen").isNotNull() | F.col("is_active")).alias("is_active"))
        done = lc.reconcile(j, found, "target", now, misses=2).collect()
        want |= {(r, x.job_id): (x.missing_count, x.is_active, x.outcome) for x in done if x.outcome != "skipped_empty"}
        current = spark.createDataFrame([(x.target, x.url_key, x.job_id, x.missing_count, x.is_active) for x in done], frame.schema)
    assert got == want and {x[2] for x in want.values()} == {"reconciled", "skipped_low_coverage"}


def plain_retries(rows, base, cap, most):
    out = []
    for request in sorted({r[0] for r in rows}):
        attempt, due, over = 0, None, False
        for at, failed in sorted((int(a.timestamp() * 1000 + 0.5), f) for r, a, f in rows if r == request):
            if due is not None and due < at:
                out.append((request, attempt, due, "retry"))
                due = None
            if over or (due is not None and failed):
                continue
            if not failed:
                if attempt:
                    over, due = True, None
                    out.append((request, attempt, at, "done"))
            elif attempt == most:
                over = True
                out.append((request, attempt, at, "given_up"))
            else:
                attempt += 1
                due = at + min(cap, base * 2 ** (attempt - 1)) * 1000
        if due is not None:
            out.append((request, attempt, due, "retry"))
    return sorted(out)


def test_retries_late_and_told_twice(spark, tmp_path):
    """Failures out of order within the watermark, repeated, and after a restart."""
    rng, start = Random(7), datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(rng.randrange(12), start + datetime.timedelta(seconds=rng.randrange(4000)), rng.random() < 0.8) for _ in range(150)]
    rows += [r for r in rows if rng.random() < 0.2]
    rows.sort(key=lambda r: (r[1].timestamp() // 1000, rng.random()))  # late by at most 1000 seconds
    end = [(99, start + datetime.timedelta(days=9), False)]
    for k, part in enumerate((rows[:60], rows[60:120], rows[120:], end)):
        spark.createDataFrame(part, "request_id long, at timestamp, failed boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        source = spark.readStream.schema("request_id long, at timestamp, failed boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        with state.rocksdb(spark):
            ev.into_table(state.retries(source, base=60, cap=100, most=2, late="30 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).select("request_id", "attempt", F.unix_millis("due").alias("due"), "outcome").collect()
    want = plain_retries(rows, 60, 100, 2)
    assert sorted(tuple(r) for r in got) == want and {x[3] for x in want} == {"retry", "done", "given_up"}


def test_a_drained_queue(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1 + (i * 7) % 20)) for i in range(10)]
    for k, part in enumerate((rows[:6], [], [*rows[6:], rows[0]], [])):
        spark.createDataFrame(part, "request_id long, due timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema("request_id long, due timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert state.drained(spark, str(tmp_path / "queue"), "request_id long, due timestamp").count() == 0
    n = state.drain_each(source, str(tmp_path / "queue"), str(tmp_path / "checkpoint"), most=3)
    got = sorted((r.batch, r.due, r.request_id) for r in state.drained(spark, str(tmp_path / "queue"), "request_id long, due timestamp").collect())
    waiting, want = {}, []
    for k, part in enumerate([rows[:6], [], [*rows[6:], rows[0]], []][:n]):
        for i, due in part:
            waiting.setdefault(i, due)
        for i, due in sorted(waiting.items(), key=lambda x: (x[1], x[0]))[:3]:
            want.append((k, due, i))
            del waiting[i]
    assert got == want
