"""Keyed state over streams: misses of jobs from run to run, retries after back-off, and a queue that is drained a little at a time.

State is kept in the checkpoint, by RocksDB or as tables, so a stream that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import merge_each

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Keeps the state of many keys outside the heap; the setting counts when a stream starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


# --- misses ---------------------------------------------------------------------------------

MISSES = "target long, run long, job_id long, url_key string, missing_count int, is_active boolean, outcome string"
_FOUND = "target long, run long, url_key string, expected long"


class Misses:
    """Targets' jobs and how often discovery missed them, as tables beside the checkpoint.

    Kept: the jobs by address, the addresses of runs that aren't complete yet, and the last run of each target that counted. A run is complete when its closing row (without an address,
    with the number of addresses found) and so many addresses are there, in whatever order and batches they come; a run that isn't later than the last is left out. A batch reads what the batch
    before it left, so one that comes again does the same. Every step is a join or an aggregate: a target may have any share of the jobs.
    """

    def __init__(self, discovered: DataFrame, jobs: DataFrame, least_share: float, misses: int):
        self.discovered, self.jobs, self.least_share, self.misses = discovered, jobs, least_share, misses

    def into_table(self, path: str, checkpoint: str) -> None:
        self.path, self.tables = path, f"{checkpoint}/tables"
        merge_each(self.discovered, self._batch, checkpoint)

    def _batch(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{self.tables}/{name}")
        new = batch.select("target", "run", "url_key", "expected", F.lit(n).cast("long").alias("batch"))
        jobs = f"{self.tables}/jobs/before"
        if n:
            last = read(f"last/batch={n - 1}", "target long, last long")
            new = new.unionByName(read(f"found/batch={n - 1}", f"{_FOUND}, batch long")).join(last, "target", "left").where("last is null or run > last").drop("last")
            jobs = read(f"at/batch={n - 1}", "jobs string").first().jobs
        else:
            last = spark.createDataFrame([], "target long, last long")
            self.jobs.select("target", "url_key", "job_id", "missing_count", "is_active").write.mode("overwrite").parquet(jobs)
        # of an address told again one row stays, of closing rows that of the latest batch
        new.groupBy("target", "run", "url_key").agg(F.max_by("expected", F.struct("batch", "expected")).alias("expected"), F.max("batch").alias("batch")).write.mode("overwrite").parquet(f"{self.tables}/noted/batch={n}")
        noted = read(f"noted/batch={n}", f"{_FOUND}, batch long")
        runs = noted.groupBy("target", "run").agg(F.count("url_key").alias("seen"), F.max(F.when(F.col("url_key").isNull(), F.col("expected"))).alias("expected"))
        runs = runs.withColumn("open", F.coalesce(F.col("seen") < F.col("expected"), F.lit(True)))
        by = Window.partitionBy("target").orderBy("run")
        runs = runs.withColumn("open", F.max("open").over(by)).where("not open").select("target", "run", "seen", F.row_number().over(by).alias("step"))  # runs count in their order
        runs.write.mode("overwrite").parquet(f"{self.tables}/done/batch={n}")
        done = read(f"done/batch={n}", "target long, run long, seen long, step int")
        for step in range(1, (done.agg(F.max("step")).first()[0] or 0) + 1):
            now = done.where(F.col("step") == step)
            to = f"{self.tables}/jobs/batch={n}-{step}"
            self._counted(spark.read.parquet(jobs), noted.join(now.select("target", "run"), ["target", "run"], "left_semi"), now.select("target", "run", "seen")).write.mode("overwrite").parquet(to)
            spark.read.schema(MISSES).parquet(to).where("outcome is not null").write.mode("overwrite").parquet(f"{self.path}/batch={n}/step={step}")
            jobs = to
        noted.join(done.select("target", "run"), ["target", "run"], "left_anti").write.mode("overwrite").parquet(f"{self.tables}/found/batch={n}")
        last.unionByName(done.groupBy("target").agg(F.max("run").alias("last"))).groupBy("target").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{self.tables}/last/batch={n}")
        spark.createDataFrame([(jobs,)], "jobs string").write.mode("overwrite").parquet(f"{self.tables}/at/batch={n}")

    def _counted(self, jobs: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
        """The jobs after one run of some targets; the others' have no run and no outcome."""
        seen = found.where("url_key is not null").select("target", "url_key", F.lit(True).alias("x"))
        jobs = jobs.select("target", "url_key", "job_id", "missing_count", "is_active").join(seen, ["target", "url_key"], "left").withColumn("x", F.col("x").isNotNull())
        jobs = jobs.withColumn("missing_count", F.when(F.col("x"), F.lit(0)).otherwise(F.col("missing_count"))).withColumn("is_active", F.col("x") | F.col("is_active"))
        active = jobs.groupBy("target").agg(F.count_if("is_active").alias("active"))
        enough = F.col("seen") >= F.greatest(F.lit(1), F.floor(F.col("active") * self.least_share))
        outcome = F.when(F.col("seen") == 0, "skipped_empty").when(enough, "reconciled").otherwise("skipped_low_coverage")
        runs = runs.join(active, "target").select("target", "run", outcome.alias("outcome"))
        jobs = jobs.join(F.broadcast(runs), "target", "left")  # a row a target; a target may have most of the jobs
        missed_now = F.col("outcome").eqNullSafe("reconciled") & F.col("is_active") & ~F.col("x")
        n = F.col("missing_count") + 1
        return jobs.select("target", "run", "job_id", "url_key", F.when(missed_now, n).otherwise(F.col("missing_count")).alias("missing_count"), F.when(missed_now, n < self.misses).otherwise(F.col("is_active")).alias("is_active"), "outcome")


def missed(discovered: DataFrame, jobs: DataFrame, *, least_share: float = 0.25, misses: int = 2) -> Misses:
    """The jobs of a target after each of its runs: target, run, job_id, url_key, missing_count, is_active, outcome; ``events.into_table`` runs it.

    discovered: (target, run, url_key, expected), a stream; jobs: (target, url_key, job_id, missing_count, is_active) before the first run. A job that is seen is active and has no misses; then
    a run counts a miss for each active job that it didn't see, if it saw any and at least ``least_share`` of the active ones, and after ``misses`` a job is inactive.
    """
    return Misses(discovered, jobs, least_share, misses)


# --- retries --------------------------------------------------------------------------------

RETRIES = "request_id long, attempt int, due timestamp, outcome string"
NONE = -(1 << 63)  # stands for the request without an id


def retries(outcomes: DataFrame, *, base: int = 1, cap: int = 300, most: int = 2, late: str = "10 minutes", shares: int = 1024) -> DataFrame:
    """What follows from the outcomes of requests: request_id, attempt, due and outcome (retry, done, given_up).

    outcomes: (request_id, at, failed), a stream. The k-th failure asks for a retry after min(cap, base * 2^(k-1)) seconds, at most ``most`` times; one more failure gives up. A failure while a retry is due is the
    same told again; a success after a failure ends the request and takes back a retry that isn't due before it. Times count in milliseconds; rows later than ``late`` behind the stream are dropped.

    Events wait until the watermark has passed them and are then met in the order of their time, so what comes late or out of order within the watermark changes nothing. Requests are dealt by hash into
    ``shares``, and a share's state travels with its rows, so no request costs a call: the events that wait (request, time in ms doubled, the fault as last bit) and the requests (request, attempts
    so far, when the next is due in ms or 0, whether it is over).
    """

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = state.get if state.exists else (b"", b"")
        waiting = [np.frombuffer(bytes(held[0]), dtype=np.int64).reshape(-1, 2)]
        if not state.hasTimedOut:
            waiting += [part[["id", "code"]].to_numpy(dtype=np.int64) for part in parts]
        every = np.concatenate(waiting)
        ready = every[every[:, 1] <= 2 * now + 1]  # all rows up to the watermark are there
        left = every[every[:, 1] > 2 * now + 1]
        requests = {r[0]: r[1:] for r in np.frombuffer(bytes(held[1]), dtype=np.int64).reshape(-1, 4).tolist()}
        out = []
        for request, code in ready[np.lexsort((ready[:, 1], ready[:, 0]))].tolist():
            at, failed = code >> 1, code & 1
            attempt, due, over = requests.get(request, (0, 0, 0))
            if due and due < at:
                out.append((request, attempt, due, "retry"))
                due = 0
            if over or due and failed:
                pass  # a failure that is told again while its retry is due
            elif not failed:
                if attempt:
                    over, due = 1, 0
                    out.append((request, attempt, at, "done"))
            elif attempt >= most:
                over = 1
                out.append((request, attempt, at, "given_up"))
            else:
                attempt += 1
                due = at + min(cap, base * 2 ** (attempt - 1)) * 1000
            requests[request] = (attempt, due, over)
        for request, (attempt, due, over) in requests.items():
            if due and due <= now:
                out.append((request, attempt, due, "retry"))
                requests[request] = (attempt, 0, over)
        state.update((left.tobytes(), np.array([(r, *x) for r, x in requests.items()], dtype=np.int64).tobytes()))
        ahead = ([int(left[:, 1].min()) >> 1] if len(left) else []) + [due for _, due, _ in requests.values() if due]
        if ahead:
            state.setTimeoutTimestamp(max(min(ahead), now + 1))
        if out:
            ids = pd.Series([x[0] for x in out], dtype="Int64")
            yield pd.DataFrame({"request_id": ids.mask(ids == NONE), "attempt": [x[1] for x in out], "due": pd.to_datetime([x[2] for x in out], unit="ms"), "outcome": [x[3] for x in out]})

    rows = outcomes.select("request_id", "at", "failed").withWatermark("at", late)
    code = F.coalesce(F.unix_millis("at"), F.lit(-(1 << 53))) * 2 + F.coalesce(F.col("failed"), F.lit(False)).cast("long")
    rows = rows.select("at", F.coalesce(F.col("request_id").cast("long"), F.lit(NONE)).alias("id"), code.alias("code")).withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)))
    return rows.groupBy("share").applyInPandasWithState(follow, RETRIES, "waiting binary, requests binary", "append", GroupStateTimeout.EventTimeTimeout)


# --- a queue --------------------------------------------------------------------------------


def drain_each(stream: DataFrame, path: str, checkpoint: str, *, most: int, key: str = "request_id", order: str = "due") -> int:
    """Hands on at most ``most`` requests a trigger, those that wait longest first; the others wait. The number of triggers.

    A trigger n reads what trigger n - 1 left and writes ``taken/batch=n`` and ``waiting/batch=n``, so one that comes again does the same. Of a request that
    comes more than once while it waits one is kept.
    """
    spark, done = stream.sparkSession, []

    def step(batch: DataFrame, n: int) -> None:
        rows = batch
        if n:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/waiting/batch={n - 1}"))
        rows = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("first")).select(key, "first.*").select(*batch.columns)
        rows.write.mode("overwrite").parquet(f"{path}/all/batch={n}")
        rows = spark.read.schema(batch.schema).parquet(f"{path}/all/batch={n}")
        taken = rows.orderBy(order, key).limit(most)
        taken.write.mode("overwrite").parquet(f"{path}/taken/batch={n}")
        rows.join(spark.read.schema(batch.schema).parquet(f"{path}/taken/batch={n}").select(key), key, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/waiting/batch={n}")
        done.append(n)

    merge_each(stream, step, checkpoint)
    return len(done)


def drained(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was handed on, with the trigger that did it."""
    try:
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/taken").parquet(f"{path}/taken")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
