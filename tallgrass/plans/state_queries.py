"""Stored collections of vectors, and streams with keyed state, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.indexing import hashed_vector
from ..sources.collection import Collection
from ..streaming import events as ev
from ..streaming import state
from ..streaming.indexing import COLUMNS, index_changes
from .registry import query, stamp
from .stream_queries import _folder

_UUID = """concat_ws('-', left(h, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', cast(('0x' || substr(h, 17, 1)) as int) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12))"""


@query("vec_collection", f"""with r as (
  select vec_id, case when vec_id % 3 = 0 then 'second' else 'first' end as source, case when vec_id % 3 = 0 then embedding[64] else embedding[1] end as x from embeddings where vec_id % 3 = 0 or vec_id % 2 = 0 or vec_id % 5 = 1)
select {_UUID} as point_id, cast(vec_id as varchar) as key, source, cast(round(x * 1e6) as bigint) as x_e6
from (select *, sha1(unhex('7e19dbd65e8f4c9d9e89589f0d75c001') || encode(cast(vec_id as varchar))) as h from r)""")
def vec_collection(t):
    """Two batches of points, the second over some of the first's keys; then the second again, which changes nothing."""
    made = Collection(t.spark, f"{_folder(t)}/points", "source string, n long")
    made.ensure(64, buckets=8)
    rows = t.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").alias("n"))
    made.upsert(rows.where("n % 2 = 0 or n % 5 = 1").withColumn("source", F.lit("first")), batch=0)
    second = rows.where("n % 3 = 0").withColumn("vector", F.reverse("vector")).withColumn("source", F.lit("second"))
    for _ in range(2):
        made.upsert(second, batch=1)
    return made.read().select("point_id", "key", "source", F.round(F.element_at("vector", 1) * 1e6).cast("long").alias("x_e6"))


@query("str_index_changes", """with r as (select o_custkey as key, year(o_orderdate) as y, arg_max(o_orderpriority, o_orderkey) as content_hash, max(o_orderkey) as ordinal from orders group by 1, 2),
c as (select *, lag(content_hash) over (partition by key order by y) as before, max(ordinal) over (partition by key order by y rows between unbounded preceding and 1 preceding) as latest from r),
walk as (select key, y, content_hash, ordinal, row_number() over (partition by key order by y) as i from r)
select cast(key as varchar) as key, arg_max(content_hash, i) as content_hash, cast(count(*) as bigint) as embeddings, max(ordinal) as ordinal from (
  with recursive g as (select key, i, content_hash, ordinal, true as new from walk where i = 1
    union all select w.key, w.i, case when w.content_hash <> g.content_hash and w.ordinal > g.ordinal then w.content_hash else g.content_hash end, case when w.content_hash <> g.content_hash and w.ordinal > g.ordinal then w.ordinal else g.ordinal end, w.content_hash <> g.content_hash and w.ordinal > g.ordinal
    from g join walk w on w.key = g.key and w.i = g.i + 1) select * from g) where new group by 1""")
def str_index_changes(t):
    """A stream of orders by year; a customer's record is embedded anew where its priority changed. Delivered twice, under the same batch numbers."""
    at = _folder(t)
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("content_hash"), F.col("o_comment").alias("embedding_text") if "o_comment" in t.orders.columns else F.col("o_clerk").alias("embedding_text") if "o_clerk" in t.orders.columns else F.col("o_orderpriority").alias("embedding_text"), F.col("o_orderkey").alias("ordinal"), F.year("o_orderdate").alias("y"))
    years = rows.groupBy("y").count().orderBy("y").collect()
    # as many files for each year, all filled, so that a trigger takes one year; more than one where years have very many rows
    files = max(1, min(8, min((r["count"] for r in years), default=0) // 100_000))
    for r in years:
        year = rows.where(F.col("y").eqNullSafe(F.lit(r.y))).drop("y")
        (year.repartition(files) if files > 1 else year.coalesce(1)).write.parquet(f"{at}/in/{r.y}")
    source = t.spark.readStream.schema(rows.drop("y").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    made = Collection(t.spark, f"{at}/index", COLUMNS)
    made.ensure(64, buckets=8)
    for again in range(2):
        index_changes(source, made, hashed_vector, f"{at}/checkpoint-{again}")
    return made.read().select("key", "content_hash", "embeddings", "ordinal")


_RUNS = (1, 2, 3)


def _seen_sql(r: int) -> str:
    return f"((target + {r}) % 4 = 1 and job_id % 3 <> {r % 3}) or ((target + {r}) % 4 = 2 and job_id % 97 = 0) or ((target + {r}) % 4 = 3 and job_id % 2 = {r % 2})"


def _misses_sql() -> str:
    out = ["j0 as (select k * 10 + n as job_id, s % 40 as target, cast(n % 2 as int) as missing_count, n % 5 <> 0 as is_active from (select l_orderkey as k, l_linenumber as n, min(l_suppkey) as s from lineitem group by 1, 2))"]
    for r in _RUNS:
        out += [
            f"s{r} as (select job_id, target, case when x then 0 else missing_count end as missing_count, x or is_active as is_active, x from (select *, {_seen_sql(r)} as x from j{r - 1}))",
            f"o{r} as (select *, case when found = 0 then null when found < greatest(1, floor(active * 0.25)) then 'skipped_low_coverage' else 'reconciled' end as outcome from (select *, count(*) filter (x) over (partition by target) as found, count(*) filter (is_active) over (partition by target) as active from s{r}))",
            f"j{r} as (select job_id, target, missing_count + m as missing_count, is_active and not (m = 1 and missing_count + 1 >= 2) as is_active, outcome from (select *, case when outcome = 'reconciled' and is_active and not x then 1 else 0 end as m from o{r}))",
        ]
    return f"with {', '.join(out)} " + " union all ".join(f"select target, {r} as run, job_id, missing_count, is_active, outcome from j{r} where outcome is not null" for r in _RUNS)


@query("str_misses", _misses_sql())
def str_misses(t):
    """Three runs of discovery, the first two in one trigger; the third comes after a restart, and the second once more with it."""
    at = _folder(t)
    one = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    jobs = one.select((k * 10 + n).alias("job_id"), (F.col("s") % 40).alias("target"), F.concat(F.lit("u"), k * 10 + n).alias("url_key"), (n % 2).cast("int").alias("missing_count"), (n % 5 != 0).alias("is_active"))
    jobs.write.parquet(f"{at}/jobs")
    jobs = t.spark.read.parquet(f"{at}/jobs")

    def discover(r: int, name: str) -> None:
        seen = jobs.where(_seen_sql(r)).select("target", F.lit(r).cast("long").alias("run"), "url_key", F.lit(None).cast("long").alias("expected"))
        closing = seen.groupBy("target", "run").agg(F.count(F.lit(1)).alias("expected")).select("target", "run", F.lit(None).cast("string").alias("url_key"), "expected")
        closing.unionByName(seen).write.parquet(f"{at}/in/{name}")

    source = lambda: t.spark.readStream.schema("target long, run long, url_key string, expected long").option("recursiveFileLookup", "true").parquet(f"{at}/in")
    for runs in (((1, "1"), (2, "2")), ((2, "again"), (3, "3"))):
        for r, name in runs:
            discover(r, name)
        ev.into_table(state.missed(source(), jobs), f"{at}/out", f"{at}/checkpoint")
    return t.spark.read.schema(state.MISSES).parquet(f"{at}/out").select("target", F.col("run").cast("int").alias("run"), "job_id", "missing_count", "is_active", "outcome")


_BASE, _CAP, _MOST = 3600, 10_000, 2


@query("str_retries", f"""with recursive e as (
  select user_id * 10 + dayofmonth(ts) // 4 as request_id, epoch_us(ts) // 1000 as at_ms, event_type = 'error' as failed from events where event_type in ('error', 'purchase')),
n as (select *, row_number() over (partition by request_id order by at_ms, failed) as i from e),
w as (
  select request_id, 0 as i, 0 as attempt, cast(0 as bigint) as due, false as over, cast([] as struct(attempt int, due bigint, outcome varchar)[]) as out from (select distinct request_id from e)
  union all
  select request_id, i, case when act = 'next' then attempt + 1 else attempt end, case when act = 'next' then at_ms + least({_CAP}, {_BASE} * cast(pow(2, attempt) as bigint)) * 1000 when act in ('done', 'given_up') then 0 else due end, over or act in ('done', 'given_up'),
    list_concat(out, case when act in ('done', 'given_up') then [{{'attempt': attempt, 'due': at_ms, 'outcome': act}}] else [] end)
  from (
    select request_id, i, at_ms, attempt, due, over, out, case when over or (due > 0 and failed) then 'none' when not failed then case when attempt > 0 then 'done' else 'none' end when attempt >= {_MOST} then 'given_up' else 'next' end as act
    from (
      select n.request_id, n.i, n.at_ms, n.failed, w.attempt, case when w.due > 0 and w.due < n.at_ms then 0 else w.due end as due, w.over,
        list_concat(w.out, case when w.due > 0 and w.due < n.at_ms then [{{'attempt': w.attempt, 'due': w.due, 'outcome': 'retry'}}] else [] end) as out
      from w join n on n.request_id = w.request_id and n.i = w.i + 1))),
last as (select * from w qualify row_number() over (partition by request_id order by i desc) = 1),
u as (select request_id, unnest(list_concat(out, case when due > 0 then [{{'attempt': attempt, 'due': due, 'outcome': 'retry'}}] else [] end)) as x from last)
select request_id, x.attempt as attempt, x.due as due_ms, x.outcome as outcome from u""")
def str_retries(t):
    """Errors ask for retries, purchases end them. The events come in three files whose times overlap."""
    at = _folder(t)
    day = F.floor(F.dayofmonth("ts") / 4)
    rows = t.events.where("event_type in ('error', 'purchase')").select((F.col("user_id") * 10 + day).alias("request_id"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed"), "event_id")
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).drop("event_id").write.parquet(f"{at}/in/{k}")
    rows.limit(1).select(F.lit(-1).cast("long").alias("request_id"), F.lit("2030-01-01").cast("timestamp").alias("at"), F.lit(False).alias("failed")).write.parquet(f"{at}/in/end")
    source = t.spark.readStream.schema("request_id long, at timestamp, failed boolean").option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    with state.rocksdb(t.spark):
        ev.into_table(state.retries(source, base=_BASE, cap=_CAP, most=_MOST, late="40 days"), f"{at}/out", f"{at}/checkpoint")
    return t.spark.read.schema(state.RETRIES).parquet(f"{at}/out").select("request_id", "attempt", F.unix_millis("due").alias("due_ms"), "outcome")


def _drain_sql() -> str:
    out = ["w0 as (select 0 as request_id, timestamp '2024-01-01' as due, 0 as b where false)"]
    for b in range(3):
        out += [f"a{b} as (select request_id, due from w{b} union all select event_id, ts from events where event_type = 'error' and event_id % 3 = {b})", f"t{b} as (select request_id, due, {b} as batch from a{b} order by due, request_id limit 200)", f"w{b + 1} as (select request_id, due, 0 as b from a{b} where request_id not in (select request_id from t{b}))"]
    return f"with {', '.join(out)} " + " union all ".join(f"select cast(request_id as bigint) as request_id, strftime(due, '%Y-%m-%d %H:%M:%S') as due, cast(batch as bigint) as batch from t{b}" for b in range(3))


@query("str_drain", _drain_sql())
def str_drain(t):
    """Requests of three triggers, two hundred handed on each time, the oldest first."""
    at = _folder(t)
    rows = t.events.where("event_type = 'error'").select(F.col("event_id").alias("request_id"), F.col("ts").alias("due"))
    for k in range(3):
        rows.where(F.col("request_id") % 3 == k).coalesce(1).write.parquet(f"{at}/in/{k}")
    source = t.spark.readStream.schema("request_id long, due timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    state.drain_each(source, f"{at}/queue", f"{at}/checkpoint", most=200)
    return state.drained(t.spark, f"{at}/queue", "request_id long, due timestamp").select("request_id", stamp(F.col("due")).alias("due"), "batch")
