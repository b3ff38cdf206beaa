"""Streaming queries over events, and sinks read back. A stream runs over all files and its table is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import readers, sinks
from ..streaming import events as ev
from .registry import Tables, query, stamp


def _folder(t: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


def _run(t: Tables, make) -> DataFrame:
    """The stream's output, appended to a table. Events come in two lots in the order of their time, each one trigger whatever files it has and the second after a
    restart, so none is late; a last far-off event closes all windows, as end of input doesn't."""
    at = _folder(t)
    rows = t.events
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
    early = F.coalesce(F.unix_micros("ts") <= F.lit(((ends.low or 0) + (ends.high or 0)) // 2), F.lit(True))
    last = rows.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.lit("2030-01-01").cast("timestamp"), "user_id": F.lit(-1).cast("long")})
    for n, lot in enumerate((rows.where(early), rows.where(~early), last)):
        lot.write.parquet(f"{at}/in/{n}")
        stream = make(t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in"))
        ev.into_table(stream, f"{at}/out", f"{at}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("str_dedupe", "select event_id, event_type from events")
def str_dedupe(t):
    got = _run(t, lambda s: ev.once(s.unionByName(s)))
    return got.where("event_id >= 0").select("event_id", "event_type")


@query("str_tumbling", "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, cast(round(sum(value) * 100) as bigint) as cents from events group by 1, 2")
def str_tumbling(t):
    got = _run(t, lambda s: ev.tumbling(s, "1 day"))
    return got.where("start < '2029-01-01'").select(stamp(F.col("start")).alias("start"), "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("cents"))


@query("str_sliding", "with h as (select date_trunc('day', ts) as d from events), w as (select d as start from h union all select d - interval 1 day from h) select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from w group by 1")
def str_sliding(t):
    got = _run(t, lambda s: ev.sliding(s, "2 days", "1 day"))
    return got.where("start < '2029-01-01'").select(stamp(F.col("start")).alias("start"), "n")


@query("str_session", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, sid")
def str_session(t):
    got = _run(t, lambda s: ev.sessions(s, "6 hours", late="2 days"))
    return got.where("user_id >= 0").select("user_id", stamp(F.col("start")).alias("start"), "n")


@query("str_lease", """with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events),
w as (
  select user_id, event_id, i, true as got, epoch_us(ts) + 86400000000 as until from e where i = 1
  union all
  select e.user_id, e.event_id, e.i, epoch_us(e.ts) >= w.until, case when epoch_us(e.ts) >= w.until then epoch_us(e.ts) + 86400000000 else w.until end from w join e on e.user_id = w.user_id and e.i = w.i + 1)
select event_id, user_id from w where got""")
def str_lease(t):
    """Users' leases of a day."""
    return _run(t, lambda s: ev.leases(s, 86400)).where("event_id >= 0")


@query("snk_csv", "select c_name as title, c_mktsegment as company from customer")
def snk_csv(t):
    at = _folder(t)
    sinks.write_jobs_csv(t.customer.select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("company"), "c_acctbal"), at)
    return t.spark.read.option("header", "true").csv(at).select("title", "company")


@query("snk_json", "select c_custkey, c_name, case when c_custkey % 2 = 0 then c_mktsegment end as segment from customer")
def snk_json(t):
    at = _folder(t)
    sinks.write_records(t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment")), at)
    return readers.read_records(t.spark, at, "c_custkey long, c_name string, segment string")


@query("snk_markdown", "select n_regionkey, string_agg(concat('## ', n, '. ', n_name, chr(10), '- **Link:** u', n_nationkey), chr(10) || chr(10) order by n) as markdown from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as n from nation) group by 1")
def snk_markdown(t):
    rows = t.nation.select("n_regionkey", "n_nationkey", F.col("n_name").alias("title"), F.concat(F.lit("u"), "n_nationkey").alias("job_url"))
    return sinks.jobs_markdown(rows, "n_regionkey", "n_nationkey")


@query("snk_artifacts", "select page_id, sha256(html) as sha256, octet_length(encode(html)) as size_bytes, concat('p:r:html:page-', page_id, ':', left(sha256(html), 16)) as artifact_id from pages")
def snk_artifacts(t):
    a = sinks.artifact(F.lit("p"), F.lit("r"), F.lit("html"), F.concat(F.lit(" Page "), F.col("page_id")), F.col("html"))
    return t.pages.select("page_id", a["sha256"].alias("sha256"), a["size_bytes"].cast("long").alias("size_bytes"), a["artifact_id"].alias("artifact_id"))


@query("snk_fanout", "select page_id, 'html' as kind, length(html) as n from pages union all select page_id, 'error', length(url) from pages where page_id % 3 = 0")
def snk_fanout(t):
    rows = t.pages.select("page_id", "html", F.lit(None).cast("string").alias("text"), F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("error"))
    return sinks.crawl_artifacts(rows, "page_id").select("page_id", "kind", F.length("body").cast("long").alias("n"))


@query("src_targets", "select o_orderkey, case when o_orderkey % 3 = 0 then 'acme' when o_orderkey % 3 = 1 then 'acme_jobs' else 'other' end as target from orders")
def src_targets(t):
    k = F.col("o_orderkey")
    stem = F.when(k % 3 == 0, "acme_20240101T000000Z").when(k % 3 == 1, "acme_jobs_20240101T000000Z").otherwise("other_20240101T000000Z")
    return t.orders.select("o_orderkey", readers.target_of(stem, ["acme", "acme_jobs"]).alias("target"))


@query("src_job_files", "select o_orderkey, o_orderkey % 5 = 0 as is_job_file from orders")
def src_job_files(t):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("file:/data/"), F.when(k % 5 == 0, "jobs/acme.json").when(k % 5 == 1, "matching_1/acme.json").when(k % 5 == 2, "jobs/acme_summary.json").when(k % 5 == 3, "logs/x.json").otherwise("jobs/acme.csv"))
    return t.orders.select("o_orderkey", readers.is_job_file(path).alias("is_job_file"))


@query("src_snapshot", "select s_suppkey, cast(s_suppkey % 10 as int) as memory from supplier where s_suppkey % 3 <> 0")
def src_snapshot(t):
    k = F.col("s_suppkey")
    lines = t.supplier.select(F.concat(k, F.lit(", "), k % 10, F.when(k % 3 == 0, ", odd").otherwise("")).alias("line"))
    return readers.snapshot_rows(lines, "line", ["s_suppkey", "memory"], ["long", "int"])
