"""Catalog queries over orders as jobs of customers as companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as c
from .registry import Tables, query, stamp

NOW = "2001-08-02 00:00:00"

JOBS_SQL = """
jobs as (select concat('job-', o_orderkey) as job_id,
  case when o_orderkey % 13 = 0 then 'Untitled  Job' when o_orderkey % 17 = 0 then '  ' when o_orderkey % 19 = 0 then null
    else concat(substr(o_orderpriority, 3), ' ', lower(c_mktsegment)) end as title,
  case when o_orderkey % 23 = 0 then null else c_name end as company,
  case o_orderkey % 5 when 0 then concat(n_name, ' - Remote') when 1 then concat('Hybrid, ', n_name) when 2 then n_name
    when 3 then concat('Hybrid / work from home ', n_name) else '' end as location_text,
  case o_orderstatus when 'F' then 'Full-time' when 'O' then 'Contract' end as employment_type,
  concat('https://ex.com/jobs/', o_orderkey) as job_url,
  case when o_orderkey % 3 = 0 then o_orderdate end as posted_at, o_orderdate + interval 2 day as first_seen_at,
  case when o_orderkey % 7 = 0 then false when o_orderkey % 11 <> 0 then true end as is_active,
  case o_orderkey % 29 when 0 then 'invalid' when 1 then 'ok' end as validation_status,
  list_value(lower(c_mktsegment), substr(o_orderpriority, 3)) as required_skills,
  case when o_orderkey % 2 = 0 then list_value(lower(c_mktsegment), o_orderstatus) end as preferred_skills
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
VISIBLE_SQL = r"""is_active is distinct from false and (validation_status is null or validation_status not in ('invalid', 'invalid_missing_title', 'invalid_missing_company', 'invalid_missing_url'))
  and coalesce(regexp_matches(title, '\S'), false) and coalesce(regexp_matches(company, '\S'), false) and regexp_matches(job_url, '\S')
  and not coalesce(regexp_matches(title, '(?i)^\s*(untitled\s+job|n/a|na|none|null|unknown)\s*$'), false)"""
REMOTE_SQL = r"regexp_matches(location_text, '(?i)\b(remote|work[\s-]?from[\s-]?home|wfh|anywhere)\b')"
HYBRID_SQL = r"regexp_matches(location_text, '(?i)\bhybrid\b')"
AT_SQL = "coalesce(posted_at, first_seen_at)"
DAYS_SQL = {"1d": 1, "3d": 3, "1w": 7, "2w": 14, "3w": 21, "1mo": 30}


def jobs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    segment, priority = F.lower("c_mktsegment"), F.expr("substring(o_orderpriority, 3)")
    place = F.when(k % 5 == 0, F.concat("n_name", F.lit(" - Remote"))).when(k % 5 == 1, F.concat(F.lit("Hybrid, "), "n_name")).when(k % 5 == 2, F.col("n_name")).when(k % 5 == 3, F.concat(F.lit("Hybrid / work from home "), "n_name")).otherwise("")
    return rows.select(
        F.concat(F.lit("job-"), k).alias("job_id"),
        F.when(k % 13 == 0, "Untitled  Job").when(k % 17 == 0, "  ").when(k % 19 == 0, None).otherwise(F.concat(priority, F.lit(" "), segment)).alias("title"),
        F.when(k % 23 != 0, F.col("c_name")).alias("company"), place.alias("location_text"),
        F.when(F.col("o_orderstatus") == "F", "Full-time").when(F.col("o_orderstatus") == "O", "Contract").alias("employment_type"),
        F.concat(F.lit("https://ex.com/jobs/"), k).alias("job_url"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("posted_at"),
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(2))).alias("first_seen_at"), F.when(k % 7 == 0, False).when(k % 11 != 0, True).alias("is_active"),
        F.when(k % 29 == 0, "invalid").when(k % 29 == 1, "ok").alias("validation_status"), F.array(segment, priority).alias("required_skills"),
        F.when(k % 2 == 0, F.array(segment, F.col("o_orderstatus"))).alias("preferred_skills"),
    )


def now():
    return F.lit(NOW).cast("timestamp")


@query("flt_visible", f"with {JOBS_SQL} select job_id, title, company from jobs where {VISIBLE_SQL}")
def flt_visible(t):
    j = jobs(t)
    return j.where(c.visible(j)).select("job_id", "title", "company")


@query("flt_search", f"with {JOBS_SQL} select job_id from jobs where contains(lower(coalesce(title, '')), 'urgent') or contains(lower(coalesce(company, '')), 'urgent') or contains(lower(location_text), 'urgent') or len(list_filter(required_skills, lambda x: contains(lower(x), 'urgent'))) > 0 or len(list_filter(coalesce(preferred_skills, list_value()), lambda x: contains(lower(x), 'urgent'))) > 0")
def flt_search(t):
    j = jobs(t)
    return j.where(c.search(j, " URGENT ")).select("job_id")


for _mode, _sql in {"remote": REMOTE_SQL, "hybrid": HYBRID_SQL, "on_site": rf"regexp_matches(location_text, '\S') and not {REMOTE_SQL} and not {HYBRID_SQL}"}.items():

    @query(f"flt_workmode_{_mode}", f"with {JOBS_SQL} select job_id, location_text from jobs where {_sql}")
    def flt_workmode(t, mode=_mode):
        return jobs(t).where(c.in_modes(F.col("location_text"), c.work_modes([mode]))).select("job_id", "location_text")


@query("flt_exact_in", f"with {JOBS_SQL} select job_id, employment_type from jobs where lower(trim(employment_type)) in ('contract', 'x')")
def flt_exact_in(t):
    return jobs(t).where(c.equals_any(F.col("employment_type"), c.filter_values([" CONTRACT ", "contract", "x"]))).select("job_id", "employment_type")


@query("flt_skills", f"with {JOBS_SQL} select job_id from jobs where len(list_filter(required_skills, lambda x: lower(trim(x)) in ('low', 'p'))) > 0 or len(list_filter(coalesce(preferred_skills, list_value()), lambda x: lower(trim(x)) in ('low', 'p'))) > 0")
def flt_skills(t):
    j = jobs(t)
    return j.where(c.has_skill(j, ["Low", "P"])).select("job_id")


@query("flt_freshness", f"with {JOBS_SQL} select job_id, strftime({AT_SQL}, '%Y-%m-%d %H:%M:%S') as freshness_at from jobs where {AT_SQL} >= timestamp '{NOW}' - interval 14 day")
def flt_freshness(t):
    j = jobs(t)
    return j.where(c.fresh(c.freshness_at(j), c.freshness_choice("2W"), now())).select("job_id", stamp(c.freshness_at(j)).alias("freshness_at"))


@query("flt_older", f"with {JOBS_SQL} select job_id from jobs where {AT_SQL} < timestamp '{NOW}' - interval 30 day")
def flt_older(t):
    j = jobs(t)
    return j.where(c.fresh(c.freshness_at(j), "older_than_1mo", now())).select("job_id")


REQUEST = c.Request(q="household", work_modes=["Remote", "on site", "moon"], employment_types=["full-time", "contract"], freshness="older_than_1mo", limit=60, offset=5)
_DIMS_SQL = {
    "freshness": f"{AT_SQL} < timestamp '{NOW}' - interval 30 day",
    "work_modes": rf"({REMOTE_SQL} or (regexp_matches(location_text, '\S') and not {REMOTE_SQL} and not {HYBRID_SQL}))",
    "employment_types": "coalesce(lower(employment_type) in ('full-time', 'contract'), false)",
}
_Q_SQL = "(contains(lower(title), 'household') or contains(lower(company), 'household') or contains(lower(location_text), 'household') or len(list_filter(list_concat(required_skills, coalesce(preferred_skills, list_value())), lambda x: contains(lower(x), 'household'))) > 0)"
_MATCH_SQL = f"{VISIBLE_SQL} and {_Q_SQL} and " + " and ".join(_DIMS_SQL.values())


@query("flt_composed", f"with {JOBS_SQL} select job_id from jobs where {_MATCH_SQL}")
def flt_composed(t):
    return c.matching(jobs(t), REQUEST, now()).select("job_id")


@query("ag_total", f"with {JOBS_SQL} select count(*) as total from jobs where {_MATCH_SQL}")
def ag_total(t):
    return c.matching(jobs(t), REQUEST, now()).agg(F.count(F.lit(1)).alias("total"))


@query("prj_snapshot", f"with {JOBS_SQL} select job_id, trim(coalesce(title, '')) as title, trim(coalesce(company, '')) as company, trim(location_text) as location_text, job_url as apply_url, employment_type, strftime({AT_SQL}, '%Y-%m-%d %H:%M:%S') as freshness_at, case when posted_at is not null then 'source_posted_date' else 'first_seen_at' end as freshness_source from jobs")
def prj_snapshot(t):
    return c.snapshot(jobs(t)).withColumn("freshness_at", stamp(F.col("freshness_at")))


for _sort, _by in {"newest": f"{AT_SQL} desc nulls last, title nulls first", "oldest": f"{AT_SQL} nulls first, title nulls first", "title_asc": "title nulls first", "title_desc": "title desc nulls last"}.items():

    @query(f"srt_{_sort}", f"with {JOBS_SQL} select job_id, title, company from jobs where {VISIBLE_SQL} order by {_by}, company nulls first, job_id nulls first limit 100")
    def srt(t, sort=_sort):
        j = jobs(t)
        return c.ordered(j.where(c.visible(j)), sort).limit(100).select("job_id", "title", "company")


@query("page_offset", f"with {JOBS_SQL} select job_id, title, company, apply_url from (select job_id, trim(title) as title, trim(company) as company, job_url as apply_url from jobs where {_MATCH_SQL} order by {AT_SQL} desc nulls last, jobs.title nulls first, jobs.company nulls first, job_id limit 60 offset 5)")
def page_offset(t):
    return c.page(jobs(t), REQUEST, now()).select("job_id", "title", "company", "apply_url")


@query("ag_facet_scalar", f"with {JOBS_SQL} select company as value, count(*) as count from jobs where {VISIBLE_SQL} group by 1 order by 2 desc, 1 limit 8")
def ag_facet_scalar(t):
    j = jobs(t)
    return c.scalar_facet(j.where(c.visible(j)), "company")


_SKILL_SET = "list_distinct(list_concat(required_skills, coalesce(preferred_skills, list_value())))"


@query("ag_facet_skills", rf"with {JOBS_SQL} select value, count(*) as count from (select unnest({_SKILL_SET}) as value from jobs where {VISIBLE_SQL}) where regexp_matches(value, '\S') group by 1 order by 2 desc, 1 limit 8")
def ag_facet_skills(t):
    j = jobs(t)
    return c.skill_facet(j.where(c.visible(j)))


_MODE_SQL = rf"case when {HYBRID_SQL} then 'hybrid' when {REMOTE_SQL} then 'remote' when regexp_matches(location_text, '\S') then 'on_site' end"


@query("ag_facet_workmode", f"with {JOBS_SQL} select {_MODE_SQL} as value, count(*) as count from jobs where {_MODE_SQL} is not null group by 1")
def ag_facet_workmode(t):
    return c.work_mode_facet(jobs(t))


_FRESH_SQL = " union all ".join([f"select '{k}' as value, count(*) filter (where {AT_SQL} >= timestamp '{NOW}' - interval {d} day) as count from {{}}" for k, d in DAYS_SQL.items()] + [f"select 'older_than_1mo', count(*) filter (where {AT_SQL} < timestamp '{NOW}' - interval 30 day) from {{}}"])


@query("ag_facet_freshness", f"with {JOBS_SQL} " + _FRESH_SQL.replace("{}", "jobs"))
def ag_facet_freshness(t):
    return c.freshness_facet(jobs(t), now())


def _others(name: str) -> str:
    return " and ".join([f"{VISIBLE_SQL} and {_Q_SQL}", *(p for k, p in _DIMS_SQL.items() if k != name)])


_SIDEWAYS_SQL = " union all ".join(
    [f"select * from (select '{n}' as dimension, {v} as value, count(*) as count from jobs where {_others(n)} and coalesce(regexp_matches({v}, '\\S'), false) group by 2 order by 3 desc, 2 limit 8)" for n, v in (("work_modes", _MODE_SQL), ("employment_types", "employment_type"), ("locations", "location_text"), ("companies", "company"))]
    + [f"select * from (select 'skills' as dimension, value, count(*) as count from (select unnest({_SKILL_SET}) as value from jobs where {_others('skills')}) group by 2 order by 3 desc, 2 limit 8)"]
    + [f"select 'freshness' as dimension, value, count from ({_FRESH_SQL.replace('{}', '(select * from jobs where ' + _others('freshness') + ')')}) where count > 0"]
)


@query("ag_facets_sideways", f"with {JOBS_SQL} {_SIDEWAYS_SQL}")
def ag_facets_sideways(t):
    return c.facets(jobs(t), REQUEST, now())


@query("ag_collection_counts", "select 'orders' as collection, count(*) as n from orders union all select 'documents', count(*) from documents union all select 'events', count(*) from events")
def ag_collection_counts(t):
    one = lambda name: getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n")
    return one("orders").unionByName(one("documents")).unionByName(one("events"))
