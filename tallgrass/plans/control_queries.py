"""Joins, roll-ups and control-plane queries over orders, lineitem, customers, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control, lifecycle, matching, portals, profiles
from .registry import query, stamp

NOW = "2001-08-02 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("jn_inner", "select l_orderkey, l_linenumber, o_custkey, c_mktsegment from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def jn_inner(t):
    hits = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return hits.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment")


@query("jn_feedback", "select event_id, c_name, n_name from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey where event_type in ('click', 'purchase')")
def jn_feedback(t):
    rows = t.events.where(F.col("event_type").isin("click", "purchase")).join(t.customer, F.col("user_id") == F.col("c_custkey"))
    return rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("event_id", "c_name", "n_name")


@query("jn_left_snapshot", "select c_custkey, coalesce(o_orderpriority, concat('snapshot ', c_mktsegment)) as shown from customer left join (select * from orders where o_orderstatus = 'P') o on o_custkey = c_custkey where c_acctbal > 0 or o_orderkey is not null")
def jn_left_snapshot(t):
    live = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("live"))
    own = t.customer.select("c_custkey", F.concat(F.lit("snapshot "), "c_mktsegment").alias("snapshot"), (F.col("c_acctbal") > 0).alias("kept"))
    return control.live_or_snapshot(own, live, "c_custkey").select("c_custkey", "shown")


@query("jn_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def jn_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("jn_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def jn_anti(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn_url_any", """with k as (select o_orderkey, unnest(list_value(concat('u', o_orderkey % 500), concat('u', o_custkey % 500))) as u from orders), m as (select u, max(o_orderkey) as job from k group by 1), d as (select distinct concat('u', event_id % 700) as u from events)
select d.u as url_key, m.job as job_id from d left join m on d.u = m.u""")
def jn_url_any(t):
    """Discovered URLs against any of a job's URLs; of jobs that share one the greatest id counts."""
    keys = F.array(F.concat(F.lit("u"), F.col("o_orderkey") % 500), F.concat(F.lit("u"), F.col("o_custkey") % 500))
    return lifecycle.url_jobs(t.events.select(F.concat(F.lit("u"), F.col("event_id") % 700).alias("url_key")), t.orders.select(F.col("o_orderkey").alias("job_id"), keys.alias("keys")))


@query("jn_left_hide", "select o_orderkey from orders left join (select l_orderkey, l_linestatus as status from lineitem where l_returnflag = 'R' and l_linenumber = 1) a on l_orderkey = o_orderkey where coalesce(status, '') not in ('F')")
def jn_left_hide(t):
    saved = t.orders.select("o_orderkey")
    applied = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("status"), (F.col("l_returnflag") == "R").alias("active"))
    return control.unhandled(saved, applied, ["o_orderkey"], ("F",)).select("o_orderkey")


@query("jn_full_compare_status", "select coalesce(a.k, b.k) as candidate_id, a.n as before, b.n as after from (select o_custkey as k, count(*) as n from orders where o_orderstatus in ('F', 'P') group by 1) a full join (select o_custkey as k, count(*) as n from orders where o_orderstatus in ('O', 'P') group by 1) b on a.k = b.k")
def jn_full_compare_status(t):
    """Sides that together hold every order: begun before, open after, in work on both."""
    n = lambda name, *status: t.orders.where(F.col("o_orderstatus").isin(*status)).groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.count(F.lit(1)).alias(name))
    return n("before", "F", "P").join(n("after", "O", "P"), "candidate_id", "full")


ROLES = [("admin", 1), ("recruiter", 2), ("candidate", 3)]
GRANTS = {"admin": ("read", "write", "grant"), "recruiter": ("read", "write"), "candidate": ("read",)}


def _roles(t):
    return t.spark.createDataFrame(ROLES, "role string, priority int")


@query("jn_cross_grant", "select role, r_name as permission from (values ('admin'), ('recruiter'), ('candidate')) v(role), region where role = 'admin'")
def jn_cross_grant(t):
    """One role times all permissions: both are short fixed lists."""
    return portals.granted(_roles(t), t.region.select(F.col("r_name").alias("permission")), "admin")


@query("jn_theta_grant", "select role, n_name as permission from (values ('admin', 1), ('recruiter', 2), ('candidate', 3)) v(role, priority) join nation on n_regionkey >= priority and n_nationkey in (1, 3, 5, 7, 9)")
def jn_theta_grant(t):
    chosen = t.nation.where(F.col("n_nationkey").isin(1, 3, 5, 7, 9))
    return portals.granted_where(_roles(t), chosen.withColumn("permission", F.col("n_name")), F.col("n_regionkey") >= F.col("priority"))


@query("jn_values_roles", "select c_custkey, role, priority from customer join (values ('admin', 1, 'BUILDING'), ('recruiter', 2, 'MACHINERY'), ('candidate', 3, 'HOUSEHOLD')) v(role, priority, seg) on seg = c_mktsegment")
def jn_values_roles(t):
    v = t.spark.sql("select * from values ('admin', 1, 'BUILDING'), ('recruiter', 2, 'MACHINERY'), ('candidate', 3, 'HOUSEHOLD') as v(role, priority, seg)")
    return t.customer.join(v, F.col("seg") == F.col("c_mktsegment")).select("c_custkey", "role", "priority")


@query("rbac_exists", "select c_custkey as user_id from customer where c_custkey % 3 in (0, 1)")
def rbac_exists(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    roles = users.select("user_id", F.element_at(F.array(*[F.lit(r) for r, _ in ROLES]), (F.col("user_id") % 3 + 1).cast("int")).alias("role"))
    grants = t.spark.createDataFrame([(r, p) for r, ps in GRANTS.items() for p in ps], "role string, permission string")
    return control.permitted(users, roles, grants, "write")


@query("jn_lateral_latest", "with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) select c_custkey, o_orderkey, o_orderstatus from customer left join r on o_custkey = c_custkey and n = 1")
def jn_lateral_latest(t):
    runs = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return control.with_latest(t.customer.select("c_custkey"), runs, "c_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", "o_orderkey", "o_orderstatus")


@query("jn_email_union_all", "select c_custkey as candidate from customer union select o_custkey from orders")
def jn_email_union_all(t):
    """All rows of both sides."""
    direct = t.customer.select(F.col("c_custkey").alias("candidate"))
    return direct.unionByName(t.orders.select(F.col("o_custkey").alias("candidate"))).distinct()


@query("jn_enrich_absent", "select o_orderkey, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then o_orderstatus else c_name end as company from orders join customer on o_custkey = c_custkey")
def jn_enrich_absent(t):
    k = F.col("o_orderkey")
    own = F.when(k % 3 == 0, F.create_map(F.lit("company"), F.lit(None).cast("string"))).when(k % 3 == 1, F.create_map(F.lit("company"), F.col("o_orderstatus"))).otherwise(F.create_map(F.lit("place"), F.lit("x")))
    rows = t.orders.select("o_orderkey", own.alias("fields"))
    details = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return control.fill_absent(rows, details, "o_orderkey", {"company": "c_name"})


@query("jn_priority_mapping", "select s_suppkey, arg_min(p_brand, p_size * 1000000 + p_partkey) as mapped from supplier left join part on p_partkey % 50 = s_suppkey % 50 group by 1")
def jn_priority_mapping(t):
    maps = t.part.select((F.col("p_partkey") % 50).alias("k"), "p_brand", "p_size", "p_partkey")
    best = lifecycle.latest(maps, ["k"], F.col("p_size"), F.col("p_partkey"))
    return t.supplier.withColumn("k", F.col("s_suppkey") % 50).join(best, "k", "left").select("s_suppkey", F.col("p_brand").alias("mapped"))


@query("jn_priority_fallback", """with a as (select o_orderkey as k, min(l_partkey) as f from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 1 and o_orderkey % 2 = 0 group by 1),
b as (select o_orderkey as k, min(l_partkey) as f from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 2 and o_orderkey % 3 = 0 group by 1), c as (select o_orderkey as k, o_custkey as f from orders where o_orderkey % 5 = 0)
select o_orderkey, coalesce(a.f, b.f, c.f) as found, case when a.f is not null then 0 when b.f is not null then 1 when c.f is not null then 2 end as step from orders left join a on a.k = o_orderkey left join b on b.k = o_orderkey left join c on c.k = o_orderkey""")
def jn_priority_fallback(t):
    """An identity by three steps: the first that finds something wins."""
    line = lambda n, by: t.lineitem.where(f"l_linenumber = {n} and l_orderkey % {by} = 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("found"))
    third = t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.col("o_custkey").alias("found"))
    return lifecycle.prioritised(t.orders.select("o_orderkey"), "o_orderkey", [line(1, 2), line(2, 3), third], "found")


@query("jn_ambiguous", "select lower(c_mktsegment) as email, count(*) as users, count(*) > 1 as ambiguous from customer group by 1")
def jn_ambiguous(t):
    return lifecycle.shares(t.customer.select(F.lower("c_mktsegment").alias("email")), "email")


STATUS_SQL = "case l_linenumber % 5 when 0 then 'queued' when 1 then 'submitted' when 2 then 'skipped' when 3 then 'failed' else 'running' end"
ROLLUP_SQL = f"""s as (select l_orderkey, {STATUS_SQL} as s from lineitem), g as (select l_orderkey, count(*) filter (where s = 'queued') as queued, count(*) filter (where s = 'running') as running, count(*) filter (where s = 'submitted') as submitted,
count(*) filter (where s = 'skipped') as skipped, count(*) filter (where s = 'failed') as failed, count(*) as total from s group by 1)"""


def _rollup(t):
    n = F.col("l_linenumber") % 5
    s = F.when(n == 0, "queued").when(n == 1, "submitted").when(n == 2, "skipped").when(n == 3, "failed").otherwise("running")
    return control.batch_rollup(t.lineitem.select("l_orderkey", s.alias("s")), "l_orderkey", "s")


@query("ag_filter_rollup", f"with {ROLLUP_SQL} select *, case when queued + running > 0 then 'running' when failed = total then 'failed' when failed > 0 then 'partial' else 'completed' end as batch_status from g")
def ag_filter_rollup(t):
    return _rollup(t)


@query("ag_notifications", f"with {ROLLUP_SQL} select l_orderkey, concat(submitted, ' of ', total, ' applications submitted, ', skipped, ' skipped, ', failed, ' failed') as notice from g")
def ag_notifications(t):
    r = _rollup(t)
    return r.select("l_orderkey", control.notice({c: F.col(c) for c in r.columns}).alias("notice"))


@query("ag_portal_health", "select cast(sum(case when s_acctbal > 0 then 1 else 0 end) as bigint) as active, cast(sum(case when s_acctbal <= 0 then 1 else 0 end) as bigint) as inactive, count(*) filter (where s_suppkey % 7 = 0) as failing, count(*) filter (where s_suppkey % 2 = 0) as scheduled from supplier")
def ag_portal_health(t):
    return t.supplier.agg(F.count_if(F.col("s_acctbal") > 0).alias("active"), F.count_if(F.col("s_acctbal") <= 0).alias("inactive"), F.count_if(F.col("s_suppkey") % 7 == 0).alias("failing"), F.count_if(F.col("s_suppkey") % 2 == 0).alias("scheduled"))


@query("ag_backfill_totals", "select n_regionkey as target, cast(sum(k) as bigint) as rows, array_to_string(list_sort(list_distinct(list(n_name))), ',') as names from (select n_regionkey, n_name, count(*) as k from nation join customer on c_nationkey = n_nationkey group by 1, 2) group by 1")
def ag_backfill_totals(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("target"), F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return control.backfill_totals(rows).select("target", "rows", F.array_join("names", ",").alias("names"))


@query("ag_text_stats", "select lang, count(text) as n, min(length(text)) as shortest, max(length(text)) as longest, cast(sum(length(text)) as bigint) as chars from documents group by 1")
def ag_text_stats(t):
    n, shortest, longest, mean = matching.length_stats(F.col("text"))
    got = t.documents.groupBy("lang").agg(n, shortest, longest, mean)
    return got.select("lang", "n", "shortest", "longest", F.round(F.col("mean") * F.col("n")).cast("long").alias("chars"))


@query("ag_recommend_status", "select user_id, count(*) filter (where event_type = 'view') as baseline, count(*) filter (where event_type = 'click') as reranked, case when count(*) filter (where event_type = 'click') > 0 then 'llm_ready' when count(*) filter (where event_type = 'view') > 0 then 'baseline_ready' else 'no_matches' end as status from events group by 1")
def ag_recommend_status(t):
    return control.recommendation_status(t.events.select("user_id", F.col("event_type") == "view", F.col("event_type") == "click").toDF("user_id", "is_baseline", "is_reranked"), "user_id")


@query("flt_due", f"select s_suppkey from supplier where s_suppkey % 4 <> 0 and s_suppkey % 3 <> 0 and timestamp '{NOW}' - to_days(s_suppkey::int % 5 - 2) <= timestamp '{NOW}' and (s_suppkey % 5 = 0 or timestamp '{NOW}' - to_hours(s_suppkey % 7 - 3) <= timestamp '{NOW}')")
def flt_due(t):
    k = F.col("s_suppkey")
    portals = t.supplier.select("s_suppkey", F.when(k % 4 != 0, "active").otherwise("paused").alias("status"), (k % 3 != 0).alias("scheduled"), (now() - F.make_dt_interval(days=(k % 5 - 2).cast("int"))).alias("next_run_at"), F.when(k % 5 != 0, now() - F.make_dt_interval(hours=(k % 7 - 3).cast("int"))).alias("lease_until"))
    return control.due(portals, now()).select("s_suppkey")


@query("flt_stale", "select event_id, event_type = 'view' and (event_id % 11 = 0 or epoch(timestamp '2024-01-31') - floor(epoch(ts)) > 86400) as stale from events")
def flt_stale(t):
    status = F.when(F.col("event_type") == "view", "processing").otherwise("done")
    started = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    return t.events.select("event_id", control.stale(status, started, F.lit("2024-01-31").cast("timestamp"), 86400).alias("stale"))


@query("flt_profile_state", "select c_custkey, case when c_custkey % 7 = 0 then 'blocked' when c_custkey % 5 = 0 then 'conflict' when c_custkey % 3 = 0 then 'processing' when c_acctbal < 0 then 'incomplete' else 'ready' end as state from customer")
def flt_profile_state(t):
    k = F.col("c_custkey")
    got = profiles.state(k % 7 != 0, k % 5 != 0, F.when(k % 3 == 0, "queued"), F.when(F.col("c_acctbal") < 0, "incomplete"), F.lit(False))
    return t.customer.select("c_custkey", got.state.alias("state"))


@query("flt_log_sample", "select event_id from events where event_type = 'error' or value > 40 or event_id % 10 = 0")
def flt_log_sample(t):
    """What the request log keeps: failures, slow ones, and each tenth of the rest."""
    return t.events.where((F.col("event_type") == "error") | (F.col("value") > 40) | (F.col("event_id") % 10 == 0)).select("event_id")


@query("flt_patch_errors", "select c_custkey, array_to_string(list_filter(list_value(case when c_custkey % 2 = 0 then 'locked: email' end, case when c_acctbal < 0 or c_acctbal > 6000 then 'range: experience' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'value: segment' end), lambda x: x is not null), ';') as errors from customer")
def flt_patch_errors(t):
    """Rules of a profile patch, as the list of what each row breaks."""
    rules = [F.when(F.col("c_custkey") % 2 == 0, "locked: email"), F.when(~F.col("c_acctbal").between(0, 6000), "range: experience"), F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "value: segment")]
    return t.customer.select("c_custkey", F.array_join(F.filter(F.array(*rules), lambda x: x.isNotNull()), ";").alias("errors"))


@query("srt_newest_n", "select event_id from events order by ts desc, event_id desc limit 100")
def srt_newest_n(t):
    return lifecycle.newest(t.events, "ts", "event_id", 100).select("event_id")


@query("srt_latest_active", "select o_custkey, max(o_orderkey) as o_orderkey from (select *, rank() over (partition by o_custkey order by o_orderdate desc) as r from orders where o_orderstatus <> 'P') where r = 1 group by 1")
def srt_latest_active(t):
    return lifecycle.latest(t.orders.where("o_orderstatus <> 'P'"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("srt_suffix_keys", "with k as (select p_partkey, replace(p_name, ' ', '-') as b from part), n as (select *, row_number() over (partition by b order by p_partkey) as n from k) select p_partkey, case when n = 1 then left(b, 8) else concat(left(b, 8 - length(concat('-', n))), '-', n) end as unique_key from n")
def srt_suffix_keys(t):
    base = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("b"))
    return lifecycle.suffixed(base, "b", "p_partkey", 8).select("p_partkey", "unique_key")


@query("srt_best_payload", "with s as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 5 else 0 end + case when l_quantity > 25 then 3 else 0 end + case when l_tax > 0 then 2 else 0 end as score from lineitem), r as (select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber) as n from s) select l_orderkey, l_linenumber, score from r where n = 1")
def srt_best_payload(t):
    from ..functions.scoring import completeness

    s = completeness({"title": F.col("l_returnflag") == "R", "job_url": F.col("l_quantity") > 25, "summary": F.col("l_tax") > 0}).alias("score")
    return lifecycle.latest(t.lineitem.select("l_orderkey", "l_linenumber", s), ["l_orderkey"], F.desc("score"), F.col("l_linenumber"))


@query("set_operations", "select o_custkey, len(list_filter(a, lambda x: list_contains(b, x))) as overlap, len(list_filter(b, lambda x: not list_contains(a, x))) as new, len(list_filter(a, lambda x: not list_contains(b, x))) as dropped, len(list_distinct(list_concat(a, b))) as all from (select o_custkey, list_distinct(list(o_orderpriority)) as a, list_distinct(list(case when o_orderstatus = 'F' then '1-URGENT' else o_orderpriority end)) as b from orders group by 1)".replace(" as all ", " as every "))
def set_operations(t):
    g = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", "1-URGENT").otherwise(F.col("o_orderpriority"))).alias("b"))
    return g.select("o_custkey", F.size(F.array_intersect("a", "b")).cast("long").alias("overlap"), F.size(F.array_except("b", "a")).cast("long").alias("new"), F.size(F.array_except("a", "b")).cast("long").alias("dropped"), F.size(F.array_union("a", "b")).cast("long").alias("every"))


@query("chunks", "with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) select o_orderkey, cast(floor((rn - 1) / 3) as bigint) as chunk from r")
def chunks(t):
    return lifecycle.chunked(t.orders, "o_custkey", "o_orderkey", 3).select("o_orderkey", "chunk")


@query("role_claims", "select c_custkey, array_to_string(list_sort(list_distinct(list_value(lower(c_mktsegment), 'user', case when c_custkey % 2 = 0 then 'admin' else 'user' end))), ',') as roles from customer")
def role_claims(t):
    claims = [F.array(F.lower("c_mktsegment"), F.lit("user")), F.array(F.when(F.col("c_custkey") % 2 == 0, "admin").otherwise("user"))]
    return t.customer.select("c_custkey", F.array_join(control.claimed_roles(*claims), ",").alias("roles"))


@query("json_merge", """select event_id, cast(json_extract_string(props, '$.k') as bigint) + event_id % 2 as k, event_type as kind from events""")
def json_merge(t):
    """A shallow merge of JSON objects: the right one's keys win."""
    kind = "map<string,string>"
    left = F.from_json("props", kind)
    right = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), (F.get_json_object("props", "$.k").cast("long") + F.col("event_id") % 2).cast("string"))
    merged = F.from_json(F.to_json(lifecycle.json_merged(left, right)), kind)
    return t.events.select("event_id", F.element_at(merged, "k").cast("long").alias("k"), F.element_at(merged, "kind").alias("kind"))


@query("run_durations", "select o_orderkey, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') as started, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') as ended, cast(epoch(max(l_shipdate)) - epoch(min(l_shipdate)) as bigint) as seconds from orders join lineitem on l_orderkey = o_orderkey group by 1")
def run_durations(t):
    g = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return g.select("o_orderkey", stamp(F.col("a")).alias("started"), stamp(F.col("b")).alias("ended"), (F.unix_seconds("b") - F.unix_seconds("a")).alias("seconds"))
