"""Upserts, histories, reconciliation and transitions over two states of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import applications, portals, profiles
from ..operators import lifecycle as lc
from .registry import query, stamp

NOW = "2001-08-02 00:00:00"
JOBS_SQL = """cur as (select o_orderkey as job_id, concat('h', o_orderkey % 4) as content_hash, case when o_orderkey % 3 = 0 then cast(o_orderdate as varchar) end as posted_date, 2 as version, o_orderdate as first_seen_at,
  o_orderkey % 3 as missing_count, o_orderkey % 7 <> 0 as is_active, case when o_orderkey % 7 = 0 then 'gone' end as inactive_reason from orders where o_orderkey % 10 < 7),
bat as (select l_orderkey as job_id, concat('h', l_orderkey % 4 + case when l_linenumber > 1 and l_orderkey % 2 = 0 then l_linenumber % 3 else 0 end) as content_hash, case when l_linenumber % 2 = 0 then cast(l_shipdate as varchar) end as posted_date, l_linenumber as ordinal from lineitem where l_orderkey % 10 > 3),
step as (select bat.*, coalesce(lag(bat.content_hash) over (partition by bat.job_id order by ordinal), cur.content_hash) as before, coalesce(cur.version, 0) as version from bat left join cur on cur.job_id = bat.job_id)"""


def now():
    return F.lit(NOW).cast("timestamp")


def _current(t):
    k = F.col("o_orderkey")
    return t.orders.where(k % 10 < 7).select(
        k.alias("job_id"), F.concat(F.lit("h"), k % 4).alias("content_hash"), F.when(k % 3 == 0, stamp(F.col("o_orderdate"))).alias("posted_date"), F.lit(2).alias("version"), F.col("o_orderdate").alias("first_seen_at"),
        F.col("o_orderdate").alias("last_seen_at"), (k % 3).alias("missing_count"), (k % 7 != 0).alias("is_active"), F.when(k % 7 == 0, "gone").alias("inactive_reason"),
    )


def _batch(t):
    """The first line of an order comes once for each (order, line): orders name a job by several lines."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = t.lineitem.where(k % 10 > 3).select(k.alias("job_id"), F.concat(F.lit("h"), k % 4 + F.when((n > 1) & (k % 2 == 0), n % 3).otherwise(0)).alias("content_hash"), F.when(n % 2 == 0, stamp(F.col("l_shipdate"))).alias("posted_date"), n.alias("ordinal"))
    return rows


#: Lines repeat within an order in the driver's table, so each (order, line) counts once: the one with the earliest ship date.
_ONCE = "lineitem where l_orderkey % 10 > 3"
JOBS_SQL = JOBS_SQL.replace("cast(l_shipdate as varchar)", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')").replace("cast(o_orderdate as varchar)", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')").replace(
    f"from {_ONCE}", "from (select l_orderkey, l_linenumber, min(l_shipdate) as l_shipdate from lineitem group by 1, 2) where l_orderkey % 10 > 3"
)


def _batch_once(t):
    once = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"))

    class Once:
        lineitem = once

    return _batch(Once)


_NEXT_SQL = f"""{JOBS_SQL}, last as (select job_id, arg_max(content_hash, ordinal) as new_hash, cast(sum(case when before is null or before = content_hash then 0 else 1 end) as int) as changes, arg_max(posted_date, ordinal) filter (where posted_date is not null) as new_posted from step group by 1),
nxt as (select coalesce(cur.job_id, last.job_id) as job_id, coalesce(new_hash, content_hash) as content_hash, coalesce(new_posted, posted_date) as posted_date, coalesce(version, 1) + coalesce(changes, 0) as version,
  strftime(coalesce(first_seen_at, timestamp '{NOW}'), '%Y-%m-%d %H:%M:%S') as first_seen_at, case when new_hash is not null then 0 else missing_count end as missing_count, case when new_hash is not null then true else is_active end as is_active,
  case when new_hash is null then inactive_reason end as inactive_reason, case when new_hash is null then null when content_hash is null then 'inserted' when changes > 0 then 'changed' else 'unchanged' end as change
  from cur full join last on cur.job_id = last.job_id)"""


@query("ups_current", f"with {_NEXT_SQL} select * from nxt")
def ups_current(t):
    nxt = lc.job_upsert(_current(t), _batch_once(t), now())
    return nxt.withColumn("first_seen_at", stamp(F.col("first_seen_at"))).drop("last_seen_at")


@query("ups_stats", f"with {_NEXT_SQL} select change, count(*) as n from nxt where change is not null group by 1")
def ups_stats(t):
    return lc.job_upsert(_current(t), _batch_once(t), now()).where("change is not null").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("ups_history", f"with {JOBS_SQL}, n as (select *, case when before is null or before <> content_hash then 1 else 0 end as new from step) select job_id, content_hash, v as version from (select job_id, content_hash, new, cast(version + sum(new) over (partition by job_id order by ordinal) as int) as v from n) where new = 1")
def ups_history(t):
    return lc.history(_batch_once(t), _current(t))


@query("ups_generic", "select coalesce(a.k, b.k) as k, case when b.k is not null then b.v else a.v end as v, coalesce(a.c, b.c) as created_at, coalesce(b.p, a.p) as p from (select c_custkey as k, c_name as v, 'old' as c, c_mktsegment as p from customer where c_custkey % 3 <> 0) a full join (select c_custkey as k, lower(c_name) as v, 'new' as c, case when c_custkey % 2 = 0 then 'x' end as p from customer where c_custkey % 2 = 0 or c_custkey % 5 = 0) b on a.k = b.k")
def ups_generic(t):
    k = F.col("c_custkey")
    a = t.customer.where(k % 3 != 0).select(k.alias("k"), F.col("c_name").alias("v"), F.lit("old").alias("created_at"), F.col("c_mktsegment").alias("p"))
    b = t.customer.where((k % 2 == 0) | (k % 5 == 0)).select(k.alias("k"), F.lower("c_name").alias("v"), F.lit("new").alias("created_at"), F.when(k % 2 == 0, "x").alias("p"))
    return lc.upsert(a, b, ["k"], keep_if_null=("p",))


@query("tower_delta", "select o_orderkey as job_id from orders where o_orderkey % 4 = 0 or o_orderkey % 3 = 0")
def tower_delta(t):
    k = F.col("o_orderkey")
    jobs = t.orders.select(k.alias("job_id"), F.concat(F.lit("h"), k).alias("content_hash"))
    towers = t.orders.where(k % 4 != 0).select(k.alias("job_id"), F.when(k % 3 != 0, F.concat(F.lit("h"), k)).alias("content_hash"))
    return lc.needs_tower(jobs, towers).select("job_id")


@query("tower_state", "select o_orderkey as job_id, case when o_orderkey % 2 = 0 and (o_orderkey % 6 = 0 or o_orderkey % 5 = 0) then 'new' else 'h' end as content_hash, case when o_orderkey % 2 = 0 and (o_orderkey % 6 = 0 or o_orderkey % 5 = 0) then 'pending' else 'indexed' end as embedding_status from orders where o_orderkey % 5 <> 0 or o_orderkey % 2 = 0")
def tower_state(t):
    k = F.col("o_orderkey")
    towers = t.orders.where(k % 5 != 0).select(k.alias("job_id"), F.lit("h").alias("content_hash"), F.lit("indexed").alias("embedding_status"))
    batch = t.orders.where(k % 2 == 0).select(k.alias("job_id"), F.when((k % 6 == 0) | (k % 5 == 0), "new").otherwise("h").alias("content_hash"))
    return lc.tower_state(towers, batch)


PLAN_SQL = f"""j as (select o_orderkey as job_id, concat('u', o_custkey) as url_key, o_orderkey % 7 <> 0 as is_active, case when o_orderkey % 11 <> 0 then o_orderdate end as deep, o_orderdate as seen from orders), n as (select *, row_number() over (partition by url_key order by seen desc, job_id desc) as r from j)"""


@query("lif_plan", f"with {PLAN_SQL}, d as (select distinct concat('u', user_id * 11) as url_key from events) select d.url_key, job_id, case when job_id is null then 'new' when not is_active then 'inactive' when deep is null or deep <= timestamp '{NOW}' - interval 60 day then 'due' else 'skip' end as plan from d left join n on n.url_key = d.url_key and r = 1")
def lif_plan(t):
    k = F.col("o_orderkey")
    jobs = t.orders.select(k.alias("job_id"), F.concat(F.lit("u"), "o_custkey").alias("url_key"), (k % 7 != 0).alias("is_active"), F.when(k % 11 != 0, F.col("o_orderdate")).alias("last_deep_scraped_at"), F.col("o_orderdate").alias("last_seen_at"))
    return lc.plan_rescrape(t.events.select(F.concat(F.lit("u"), F.col("user_id") * 11).alias("url_key")), jobs, now(), 60)


REC_SQL = """j as (select l_orderkey * 10 + l_linenumber as job_id, l_suppkey % 40 as target, concat('u', l_orderkey) as url_key, min(l_linenumber) % 4 as missing_count, l_linenumber % 5 <> 0 as is_active from lineitem group by l_orderkey, l_linenumber, l_suppkey),
d as (select distinct target, url_key from j where (target % 4 = 1 and job_id % 3 <> 0) or (target % 4 = 2 and job_id % 97 = 0) or (target % 4 = 3 and job_id % 2 = 0)),
f as (select target, count(*) as found from d group by 1), a as (select target, count(*) as active from j where is_active group by 1),
o as (select j.*, d.url_key is not null as seen, case when found is null then 'skipped_empty' when found < greatest(1, floor(active * 0.25)) then 'skipped_low_coverage' else 'reconciled' end as outcome
  from j left join d on d.target = j.target and d.url_key = j.url_key left join f on f.target = j.target left join a on a.target = j.target)"""


def _reconciled(t):
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.lit(1).alias("one"))
    jobs = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_id"), (F.col("l_suppkey") % 40).alias("target"), F.concat(F.lit("u"), "l_orderkey").alias("url_key"), (F.col("l_linenumber") % 4).alias("missing_count"), (F.col("l_linenumber") % 5 != 0).alias("is_active"))
    m, j = F.col("target") % 4, F.col("job_id")
    seen = jobs.where(((m == 1) & (j % 3 != 0)) | ((m == 2) & (j % 97 == 0)) | ((m == 3) & (j % 2 == 0)))
    return lc.reconcile(jobs, seen, "target", now())


@query("lif_reconcile", f"with {REC_SQL} select job_id, target, missing_count + case when outcome = 'reconciled' and is_active and not seen then 1 else 0 end as missing_count, is_active and not (outcome = 'reconciled' and not seen and missing_count + 1 >= 3) as is_active, outcome from o")
def lif_reconcile(t):
    return _reconciled(t).select("job_id", "target", F.col("missing_count").cast("long").alias("missing_count"), "is_active", "outcome")


@query("lif_deactivate", f"with {REC_SQL} select target, count(*) as gone from o where outcome = 'reconciled' and is_active and not seen and missing_count + 1 >= 3 group by 1")
def lif_deactivate(t):
    return _reconciled(t).where("deactivated_at is not null").groupBy("target").agg(F.count(F.lit(1)).alias("gone"))


@query("lif_reset", "select o_orderkey as job_id, case when o_custkey % 2 = 0 then 0 else o_orderkey % 3 end as missing_count, o_custkey % 2 = 0 or o_orderkey % 5 <> 0 as is_active, case when o_custkey % 2 <> 0 then 'why' end as inactive_reason from orders")
def lif_reset(t):
    k = F.col("o_orderkey")
    jobs = t.orders.select(k.alias("job_id"), F.col("o_custkey").alias("url_key"), (k % 3).alias("missing_count"), (k % 5 != 0).alias("is_active"), F.lit("why").alias("inactive_reason"), F.col("o_orderdate").alias("last_seen_at"))
    return lc.reset_seen(jobs, t.orders.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("url_key")), now()).select("job_id", "missing_count", "is_active", "inactive_reason")


@query("lif_backlog", """with j as (select string_agg(cast(k as varchar), ',' order by k) as ids, count(*) as n from (select distinct p_partkey as k from part order by 1 limit 200)),
c as (select c_custkey from customer where c_custkey % 4 <> 0 and c_custkey % 9 <> 0 order by c_acctbal desc, c_custkey limit 250)
select c_custkey as candidate_id, cast(n as int) as n_jobs, sha256(concat('refresh|', c_custkey, '|', ids)) as request_key from c, j""")
def lif_backlog(t):
    k = F.col("c_custkey")
    people = t.customer.select(k.alias("candidate_id"), F.when(k % 4 == 0, "incomplete").when(k % 3 == 0, "ready").alias("profile_state"), F.col("c_acctbal").alias("updated_at"))
    return lc.backlog(people, t.customer.where(k % 9 == 0).select(k.alias("candidate_id")), t.part.select(F.col("p_partkey").alias("job_id")))


_WAIT = "cast(case when s_suppkey % 3 = 1 then 60 else least(10080, 60 * power(2, least(s_suppkey % 7 + 1, 4))) end as int)"


@query("lif_portal", f"select s_suppkey as portal_id, cast(case s_suppkey % 3 when 1 then 0 when 2 then s_suppkey % 7 + 1 else s_suppkey % 7 end as int) as failures, case when s_suppkey % 3 > 0 then {_WAIT} end as wait_minutes, strftime(case when s_suppkey % 3 = 0 then null when s_suppkey % 3 = 2 and s_suppkey % 7 + 1 >= 5 then null else timestamp '{NOW}' + to_minutes({_WAIT}) end, '%Y-%m-%d %H:%M:%S') as next_run_at, case when s_suppkey % 3 = 2 and s_suppkey % 7 + 1 >= 5 then 'auto_paused' else 'active' end as status from supplier")
def lif_portal(t):
    k = F.col("s_suppkey")
    portals = t.supplier.select(k.alias("portal_id"), (k % 7).alias("failures"), F.lit(60).alias("interval_minutes"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("next_run_at"))
    runs = t.supplier.where(k % 3 > 0).select(k.alias("portal_id"), (k % 3 == 1).alias("succeeded"))
    got = lc.portal_after_run(portals, runs, now())
    return got.withColumn("next_run_at", stamp(F.col("next_run_at")))


@query("lif_lease", "with w as (select user_id % 100 as p, min(event_id) as o from events where event_type = 'click' group by 1) select s_suppkey as portal_id, case when o is not null and (s_suppkey % 2 = 0) then o else s_suppkey end as owner, o is not null and s_suppkey % 2 = 0 as taken from supplier left join w on p = s_suppkey")
def lif_lease(t):
    k = F.col("s_suppkey")
    portals = t.supplier.select(k.alias("portal_id"), k.alias("owner"), F.when(k % 2 == 1, now() + F.make_dt_interval(days=F.lit(1))).alias("lease_until"))
    asked = t.events.where("event_type = 'click'").select((F.col("user_id") % 100).alias("portal_id"), F.col("event_id").alias("owner"), F.col("event_id").alias("asked_at"))
    return lc.take_lease(portals, asked, now(), 30).select("portal_id", "owner", "taken")


@query("lif_profile_edit", "select c_custkey, array_to_string(list_filter(list_value(case when c_custkey % 3 = 0 then 'name' end, case when c_custkey % 2 = 0 then 'segment' end), lambda x: x is not null), ',') as changed, c_custkey % 2 = 0 as reembed from customer")
def lif_profile_edit(t):
    k = F.col("c_custkey")
    changed = lc.changed_fields({"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, {"name": F.when(k % 3 != 0, F.col("c_name")), "segment": F.when(k % 2 == 0, "x").otherwise(F.col("c_mktsegment"))})
    return t.customer.select("c_custkey", F.array_join(changed, ",").alias("changed"), F.array_contains(changed, "segment").alias("reembed"))


@query("prj_overlay", "select c_custkey, c_name, case c_custkey % 3 when 0 then null when 1 then 'over' else c_mktsegment end as c_mktsegment from customer")
def prj_overlay(t):
    k = F.col("c_custkey")
    over = t.customer.where(k % 3 < 2).select("c_custkey", F.create_map(F.lit("c_mktsegment"), F.when(k % 3 == 1, "over"), F.lit("c_name"), F.lit("locked")).alias("values"))
    return lc.overlay(t.customer.select("c_custkey", "c_name", "c_mktsegment"), over, "c_custkey", "values", locked=("c_name",))


@query("lif_first_write", "with e as (select user_id, min(ts) filter (where event_type = 'view') as s, max(ts) filter (where event_type in ('purchase', 'error')) as c, arg_max(case event_type when 'view' then 'running' when 'purchase' then 'succeeded' when 'error' then 'failed' end, epoch_us(ts) * 1000 + event_id % 1000) as n from events where event_type in ('view', 'purchase', 'error') group by 1) select c_custkey as run_id, coalesce(n, 'queued') as status, strftime(s, '%Y-%m-%d %H:%M:%S') as started_on, strftime(c, '%Y-%m-%d %H:%M:%S') as completed_on from customer left join e on user_id = c_custkey")
def lif_first_write(t):
    state = t.customer.select(F.col("c_custkey").alias("run_id"), F.lit("queued").alias("status"), F.lit(None).cast("timestamp").alias("started_on"), F.lit(None).cast("timestamp").alias("completed_on"))
    kind = F.col("event_type")
    events = t.events.where(kind.isin("view", "purchase", "error")).select(F.col("user_id").alias("run_id"), F.when(kind == "view", "running").when(kind == "purchase", "succeeded").otherwise("failed").alias("new_status"), F.col("ts").alias("at"))
    got = lc.first_write(state, events, "run_id")
    return got.withColumns({c: stamp(F.col(c)) for c in ("started_on", "completed_on")})


@query("lif_batch_create", "select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 'skipped_duplicate' when o_totalprice < 100000 then 'skipped_manual' else 'queued' end as run_status from orders")
def lif_batch_create(t):
    """A batch of applications: what was applied for before is skipped, what can't be automated is terminal."""
    saved = t.orders.select(F.lit(1).alias("candidate_id"), F.col("o_orderkey").alias("job_id"), F.lit("u").alias("apply_url"))
    done = t.lineitem.where("l_returnflag = 'R'").select(F.lit(1).alias("candidate_id"), F.col("l_orderkey").alias("job_id"), F.lit("agent_applied").alias("status"), F.lit("u").alias("applied_url")).distinct()
    runs = applications.batch_runs(saved, done).select(F.col("job_id").alias("o_orderkey"), "run_status")
    manual = (F.col("run_status") == "queued") & (F.col("o_totalprice") < 100000)
    return runs.join(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey").select("o_orderkey", F.when(manual, "skipped_manual").otherwise(F.col("run_status")).alias("run_status"))


@query("lif_portal_update", "select s_suppkey, case when s_suppkey % 4 = 0 then 'rejected' when s_suppkey % 2 = 1 then 'draft' else 'active' end as status, s_suppkey % 5 + case when s_suppkey % 4 = 0 then 0 else 1 end as version from supplier")
def lif_portal_update(t):
    """An update holds the version it read; another one rejects it, a changed URL makes a draft."""
    k = F.col("s_suppkey")
    now_ = t.supplier.select(k.alias("portal_id"), F.lit("old").alias("listing_url"), F.lit("active").alias("status"), F.lit(True).alias("is_active"), F.lit("custom").alias("source_platform"), F.lit("never").alias("last_run_status"), (k % 5).alias("version"))
    patches = t.supplier.select(k.alias("portal_id"), F.when(k % 4 == 0, k % 5 - 1).otherwise(k % 5).alias("read_version"), F.when(k % 2 == 1, "new").alias("new_url"))
    got = portals.updated(now_, patches)
    return got.select(F.col("portal_id").alias("s_suppkey"), F.when(F.col("outcome") == "rejected", "rejected").otherwise(F.col("status")).alias("status"), "version")


@query("lif_admin_override", "select o_custkey, array_to_string(l[greatest(1, len(l) - 9):], ',') as kept from (select o_custkey, list(cast(o_orderkey as varchar) order by o_orderkey) as l from orders group by 1)")
def lif_admin_override(t):
    entries = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("l"))
    half = F.floor(F.size("l") / 2).cast("int")
    old, new = F.slice("l", F.lit(1), half), F.slice("l", half + 1, F.size("l"))
    return entries.select("o_custkey", F.array_join(lc.last_entries(old, new), ",").alias("kept"))


@query("lif_queue_guard", "select distinct user_id, cast(floor(value) as bigint) as input from events where event_type = 'view' and not exists (select 1 from events e where e.event_type = 'click' and e.user_id = events.user_id and floor(e.value) = floor(events.value))")
def lif_queue_guard(t):
    rows = t.events.select(F.col("user_id").alias("candidate_id"), F.floor("value").alias("input_hash"), "event_type")
    open_ = rows.where("event_type = 'click'").withColumn("status", F.lit("queued"))
    return profiles.unqueued(rows.where("event_type = 'view'"), open_).toDF("user_id", "input")


@query("lif_primary_link", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_primary from orders")
def lif_primary_link(t):
    return lc.one_primary(t.orders, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "is_primary")


@query("lif_role_resync", "select user_id, role from (select c_custkey as user_id, 'manual' as role from customer where c_custkey % 2 = 0 union select distinct user_id, event_type from events)")
def lif_role_resync(t):
    """Roles from a source replace those it gave before; roles given by hand stay."""
    old = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "manual").otherwise("stale").alias("role"), (F.col("c_custkey") % 2 == 1).alias("sourced"))
    return lc.roles_resynced(old, t.events.select("user_id", F.col("event_type").alias("role")))


@query("lif_finalise_once", "select distinct o_custkey as batch_id from orders where o_custkey % 3 <> 0")
def lif_finalise_once(t):
    told = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("batch_id"))
    return applications.untold(t.orders.select(F.col("o_custkey").alias("batch_id")), told)
