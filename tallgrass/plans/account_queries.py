"""Users, links, overrides and scans: targets of a plan, primary links, identities in order, towers newest first, ids of records, what a match shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import indexing, portals
from ..operators import lifecycle as lc
from ..sources import readers, sinks
from ..streaming import events as ev
from .matching_queries import MATCH_SQL, _matches, training_pairs
from .registry import ORACLE, query, stamp
from .stream_queries import _folder

NOW = "2001-08-02 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


# Jobs of two targets share addresses; a target's plan sees only its own, and those become active again.
_JOBS_SQL = f"""j as (select o_orderkey as job_id, case when o_orderkey % 2 = 0 then 'even' else 'odd' end as target_id, 'https://x.org/' || o_custkey as job_url, o_orderkey % 5 <> 0 as is_active, case when o_orderkey % 3 = 0 then 'parse_failed' else 'active' end as freshness_status, o_orderdate as seen, o_orderkey % 4 as missing_count from orders),
u as (select target_id, job_url, max(job_id) as job_id from j group by 1, 2),
d as (select distinct 'https://x.org/' || user_id * 3 as url from events),
p as (select d.url, j.job_id, j.job_id is null as is_new, coalesce(j.seen < timestamp '{NOW}' - interval 14 day, false) as due, j.job_id is not null and (not j.is_active or j.freshness_status = 'parse_failed') as broken from d left join u on u.job_url = d.url and u.target_id = 'even' left join j on j.job_id = u.job_id)"""


def _planned(t):
    k = F.col("o_orderkey")
    jobs = t.orders.select(
        k.alias("job_id"), F.when(k % 2 == 0, "even").otherwise("odd").alias("target_id"), F.concat(F.lit("https://x.org/"), "o_custkey").alias("job_url"), (k % 5 != 0).alias("is_active"), F.when(k % 3 == 0, "parse_failed").otherwise("active").alias("freshness_status"),
        F.col("o_orderdate").alias("last_seen_at"), F.lit(None).cast("timestamp").alias("last_deep_scraped_at"), F.lit("t").alias("title"), F.lit("c").alias("company"), (k % 4).alias("missing_count"), F.lit("why").alias("inactive_reason"), F.lit("old").alias("last_run_session_id"),
    )
    return lc.planned_target(t.events.select(F.concat(F.lit("https://X.org/"), F.col("user_id") * 3, F.lit("?utm_source=q")).alias("url")), jobs, "even", _now(), F.lit("run"))


@query("plan_target", f"with {_JOBS_SQL} select url, job_id, is_new or due or broken as extract, is_new, due, broken from p")
def plan_target(t):
    return _planned(t)[0]


@query("plan_target_jobs", f"with {_JOBS_SQL}, s as (select distinct job_id from p where job_id is not null) select j.job_id, s.job_id is not null or is_active as is_active, case when s.job_id is null then missing_count else 0 end as missing_count, case when s.job_id is null then freshness_status else 'active' end as freshness_status, case when s.job_id is null then 'why' end as inactive_reason, case when s.job_id is null then 'old' else 'run' end as last_run_session_id from j left join s on s.job_id = j.job_id")
def plan_target_jobs(t):
    return _planned(t)[1].select("job_id", "is_active", "missing_count", "freshness_status", "inactive_reason", "last_run_session_id")


@query("portal_override_saved", """select s_suppkey, case when ok then 'p' || s_suppkey % 3 else 'old' end as profile_name, case when not ok then platform when s_suppkey % 4 = 0 then 'given' when trim(coalesce(platform, '')) <> '' then platform else 'custom_listing' end as source_platform, case when not ok then 'crawl' when s_suppkey % 5 = 0 then 'own' else 'p' || s_suppkey % 3 end as crawl_strategy,
  case when not ok or s_suppkey % 7 = 0 then status else 'ready_for_test' end as status, cast(s_suppkey % 3 + case when ok then 1 else 0 end as int) as version, case when ok then 'x=' || s_suppkey else '' end as overrides, cast(case when ok then least(10, s_suppkey % 12 + 1) else s_suppkey % 12 end as int) as entries, case when ok then 'saved' when s_suppkey % 2 = 0 then 'rejected' end as outcome
from (select *, case when s_suppkey % 7 = 0 then 'paused' else 'draft' end as status, case when s_suppkey % 6 = 0 then 'site' when s_suppkey % 6 = 1 then ' ' end as platform, s_suppkey % 2 = 0 and (s_suppkey % 8 = 0 or s_suppkey % 3 = 1) as ok from supplier)""")
def portal_override_saved(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(
        k.alias("portal_id"), F.when(k % 7 == 0, "paused").otherwise("draft").alias("status"), (k % 3).cast("int").alias("version"), F.lit("old").alias("profile_name"), F.when(k % 6 == 0, "site").when(k % 6 == 1, " ").alias("source_platform"), F.lit("crawl").alias("crawl_strategy"), F.lit(0.5).alias("confidence"),
        F.create_map().cast("map<string,string>").alias("profile_overrides"), F.transform(F.slice(F.sequence(F.lit(0), F.lit(11)), F.lit(1), (k % 12).cast("int")), lambda x: x.cast("string")).alias("entries"),
    )
    given = t.supplier.where(k % 2 == 0).select(k.alias("portal_id"), F.when(k % 8 != 0, 1).alias("read_version"), F.concat(F.lit("p"), k % 3).alias("profile_name"), F.when(k % 4 == 0, "given").otherwise("").alias("source_platform"), F.when(k % 5 == 0, "own").alias("crawl_strategy"), F.create_map(F.lit("x"), k.cast("string")).alias("profile_overrides"), F.lit("new").alias("entry"))
    got = portals.override_saved(rows, given)
    return got.select(F.col("portal_id").alias("s_suppkey"), "profile_name", "source_platform", "crawl_strategy", "status", "version", F.coalesce(F.concat(F.lit("x="), F.element_at("profile_overrides", "x")), F.lit("")).alias("overrides"), F.size("entries").alias("entries"), "outcome")


@query("lif_primary_upsert", """with l as (select o_custkey as u, o_orderkey % 5 as c, min(o_orderkey) as r, min(o_orderkey) % 2 = 0 as p from orders where o_orderkey % 3 <> 0 group by 1, 2),
g as (select o_custkey as u, o_orderkey % 5 as c, o_orderkey as o from orders where o_orderkey % 3 = 0), last as (select u, arg_max(c, o) as c from g group by 1), e as (select u, c, max(o) as o from g group by 1, 2)
select coalesce(l.u, e.u) as u, coalesce(l.c, e.c) as c, coalesce(e.o, l.r) as resume_id, case when last.u is not null then last.c = coalesce(l.c, e.c) else p end as is_primary, e.u is not null or coalesce(l.r % 7 <> 0, true) as is_active, case when e.u is null then 'old' when l.u is null then 'new' else 'old,new' end as metadata,
  case when e.u is not null or (last.u is not null and p and last.c <> coalesce(l.c, e.c)) then 'now' else 'before' end as modified
from l full join e on l.u = e.u and l.c = e.c left join last on last.u = coalesce(l.u, e.u)""")
def lif_primary_upsert(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("user_id"), (k % 5).alias("candidate_id"), k.alias("resume_id"))
    old = rows.where("resume_id % 3 <> 0").groupBy("user_id", "candidate_id").agg(F.min("resume_id").alias("resume_id"))
    old = old.select("*", (F.col("resume_id") % 2 == 0).alias("is_primary"), (F.col("resume_id") % 7 != 0).alias("is_active"), F.create_map(F.lit("a"), F.lit("old")).alias("metadata"), F.lit("2000-01-01").cast("timestamp").alias("modified_on"))
    given = rows.where("resume_id % 3 = 0").select("*", F.create_map(F.lit("b"), F.lit("new")).alias("metadata"), F.col("resume_id").alias("ordinal"))
    got = lc.primary_linked(old, given, _now())
    return got.select(F.col("user_id").alias("u"), F.col("candidate_id").alias("c"), "resume_id", "is_primary", "is_active", F.concat_ws(",", F.try_element_at("metadata", F.lit("a")), F.try_element_at("metadata", F.lit("b"))).alias("metadata"), F.when(F.col("modified_on") == _now(), "now").otherwise("before").alias("modified"))


@query("jn_user_order", """with u as (select c_custkey as user_id, c_nationkey % 3 as org_id, ' M' || c_custkey // 2 || '@X.org' as email, c_custkey % 7 <> 0 as is_active from customer),
m as (select org_id, lower(trim(email)) as mail, min(user_id) as mail_user, count(*) as n from u where is_active group by 1, 2),
l as (select o_orderkey as login, o_custkey as subject, o_orderkey % 3 as org_id, case when o_orderkey % 5 > 0 then 'm' || o_custkey // 2 || '@x.org' end as mail, o_orderkey % 2 = 0 as verified from orders),
r as (select l.*, case when subject % 4 = 0 and login % 3 = 0 then subject end as own, case when subject % 6 = 1 and login % 4 = 0 then subject + 1 end as older, mail_user, n from l left join m on m.org_id = l.org_id and m.mail = l.mail)
select login, coalesce(own, older, case when n = 1 and verified then mail_user end) as user_id, case when own is not null then 'identity' when older is not null then 'legacy' when n = 1 and verified then 'verified_email' end as strategy, case when own is null and older is null then case when n > 1 then 'ambiguous_email' when n = 1 and not verified then 'unverified_email' end end as error from r""")
def jn_user_order(t):
    c, k, s = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    users = t.customer.select(c.alias("user_id"), (F.col("c_nationkey") % 3).alias("org_id"), F.concat(F.lit(" M"), F.floor(c / 2), F.lit("@X.org")).alias("email"), (c % 7 != 0).alias("is_active"))
    logins = t.orders.select(k.alias("login"), F.concat(F.lit("i"), k % 3).alias("issuer"), s.alias("subject"), F.concat(F.lit("r"), k % 4).alias("realm"), (k % 3).alias("org_id"), F.when(k % 5 > 0, F.concat(F.lit("m"), F.floor(s / 2), F.lit("@x.org "))).alias("email"), (k % 2 == 0).alias("verified"))
    people = t.orders.select(s.alias("subject")).distinct()
    identities = people.where("subject % 4 = 0").select(F.lit("i0").alias("issuer"), "subject", F.col("subject").alias("user_id"))
    legacy = people.where("subject % 6 = 1").select(F.lit("r0").alias("realm"), "subject", (F.col("subject") + 1).alias("user_id"))
    return lc.resolved_users(logins, identities, legacy, users)


@query("src_tower_scan", "select row_number() over (order by o_orderdate desc, o_orderkey) as n, o_orderkey from orders where o_orderstatus <> 'F' and o_custkey % 2 = 0 order by o_orderdate desc, o_orderkey limit 100")
def src_tower_scan(t):
    from pyspark.sql import Window

    towers = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "indexed").otherwise("pending").alias("embedding_status"), F.col("o_orderdate").alias("updated_at"))
    got = indexing.scanned(towers, "o_orderkey", only_pending=True, ids=t.orders.where("o_custkey % 2 = 0").select("o_orderkey"), limit=100)
    return got.withColumn("n", F.row_number().over(Window.orderBy(F.desc("updated_at"), "o_orderkey")).cast("long")).select("n", "o_orderkey")


@query("hsh_record", """select o_orderkey, 'tp_' || left(sha256('{"candidate_id": "' || o_clerk || '", "feedback_id": ' || case when o_orderkey % 3 = 0 then 'null' else '"fb_' || o_orderkey || '"' end || ', "job_id": "j\\"' || o_custkey || '", "label": ' || o_orderkey % 2 || '}'), 24) as training_pair_id from (select *, 'c' || o_custkey as o_clerk from orders)""".replace('\\\\"', '\\"'))
def hsh_record(t):
    k = F.col("o_orderkey")
    made = hashing.record_id("tp_", label=k % 2, candidate_id=F.concat(F.lit("c"), "o_custkey"), job_id=F.concat(F.lit('j"'), "o_custkey"), feedback_id=F.when(k % 3 != 0, F.concat(F.lit("fb_"), k)))
    return t.orders.select("o_orderkey", made.alias("training_pair_id"))


@query("match_shared", f"with {MATCH_SQL} select mt.candidate_id, mt.job_id, array_to_string(list_sort(list_intersect(a.skills, j.skills)), ',') as matched_skills from mt join a on a.vec_id = mt.candidate_id join a j on j.vec_id = mt.job_id")
def match_shared(t):
    return _matches(t).select("candidate_id", "job_id", F.array_join("matched_skills", ",").alias("matched_skills"))


@query("match_mean", f"with {MATCH_SQL} select count(*) as matches, cast(round(avg(round(skill_score * 1e6))) as bigint) as mean_skill_e6, cast(round(avg(round(location_score * 1e6))) as bigint) as mean_place_e6 from mt")
def match_mean(t):
    e6 = lambda c: F.round(F.avg(F.round(F.col(c) * 1e6))).cast("long")
    return _matches(t).agg(F.count(F.lit(1)).alias("matches"), e6("skill_score").alias("mean_skill_e6"), e6("location_score").alias("mean_place_e6"))


@query("snk_matches", f"with {MATCH_SQL} select candidate_id, job_id, rank, (select count(*) from mt) as matches from mt")
def snk_matches(t):
    """Matches as written in three forms and read back: flat rows that are at their place in their candidate's group, and the summary's count."""
    at = _folder(t)
    sinks.write_matches(_matches(t), at)
    flat = t.spark.read.schema("candidate_id long, job_id long, rank long").json(f"{at}/matches")
    groups = t.spark.read.schema("candidate_id long, jobs array<long>").json(f"{at}/grouped").select("candidate_id", F.posexplode("jobs").alias("place", "job_id"))
    from pyspark.sql import Window

    nth = (F.row_number().over(Window.partitionBy("candidate_id").orderBy("rank")) - 1).alias("place")
    count = t.spark.read.schema("matches long").json(f"{at}/summary")
    return flat.select("candidate_id", "job_id", "rank", nth).join(groups, ["candidate_id", "job_id", "place"]).join(count).select("candidate_id", "job_id", "rank", "matches")


@query("snk_training_pairs", ORACLE["training_pairs"])
def snk_training_pairs(t):
    """Training pairs as JSON lines, read back."""
    at = _folder(t)
    rows = training_pairs(t)
    sinks.write_records(rows, at)
    return readers.read_records(t.spark, at, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes))


@query("str_append", "select event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events")
def str_append(t):
    """Audit rows appended as they come: the stream ends, more come, it goes on where it was."""
    at = _folder(t)
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.parquet(f"{at}/in/{k}")
        source = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        ev.into_table(source, f"{at}/out", f"{at}/checkpoint")
    got = t.spark.read.schema(rows.schema).parquet(f"{at}/out")
    return got.select("event_id", "user_id", "event_type", stamp(F.col("ts")).alias("at"))
