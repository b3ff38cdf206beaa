"""Profiles, applications, portals, upserts and sinks: rules with signatures of their own, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import applications as ap
from ..operators import lifecycle as lc
from ..operators import matching as m
from ..operators import portals as po
from ..operators import profiles as pr
from ..sources import readers, sinks
from .registry import query, stamp
from .stream_queries import _folder

NOW = "2001-08-02 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def _case(n: int, values: list, key: str = "c_custkey"):
    """The value at key % n; None beyond the list."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.col(key) % n == i, F.lit(v) if isinstance(v, str) or v is None else v).otherwise(out)
    return out


def _patch():
    phone = _case(5, ["+1 (555) 010-0199", "12", " ", "555-0100-x"])
    years = F.when(F.col("c_custkey") % 7 == 0, "many").otherwise((F.col("c_acctbal") / 100).cast("int").cast("string"))
    fields = {
        "phone": phone, "total_experience_years": years, "remote_preference": _case(4, ["remote", " onsite ", "moon"]), "linkedin_url": _case(3, ["https://x.example/a", "ftp://x.example"]),
        "full_name": _case(6, [F.upper("c_name"), "Someone Else"]), "sha256": F.when(F.col("c_custkey") % 11 == 0, "s"), "hobby": F.when(F.col("c_custkey") % 13 == 0, "chess"), "resume_id": F.when(F.col("c_custkey") % 22 == 0, "r"),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]), lambda x: x["value"].isNotNull())
    return F.map_from_entries(pairs)


_YEARS = "(case when c_custkey % 7 = 0 then null else cast(trunc(c_acctbal / 100) as int) end)"


@query("profile_patch", f"""select c_custkey, array_to_string(list_filter(list_value(case when c_custkey % 6 = 1 then 'name is locked' end, case when c_custkey % 22 = 0 then 'locked: resume_id, sha256' when c_custkey % 11 = 0 then 'locked: sha256' end,
  case when c_custkey % 5 in (1, 3) then 'phone is invalid' end, case when c_custkey % 7 = 0 then 'experience is no number' end, case when {_YEARS} not between 0 and 60 then 'experience is not 0 to 60' end,
  case when c_custkey % 4 = 2 then 'remote_preference is unknown' end, case when c_custkey % 3 = 1 then 'linkedin_url is no web address' end, case when c_custkey % 13 = 0 then 'unknown: hobby' end), lambda x: x is not null), ';') as errors,
  case when c_custkey % 5 = 0 then '+1 (555) 010-0199' when c_custkey % 5 = 1 then '12' when c_custkey % 5 = 3 then '555-0100-x' end as phone, cast(case when {_YEARS} between 0 and 60 then {_YEARS} * 10 end as bigint) as tenths,
  case c_custkey % 4 when 0 then 'remote' when 1 then 'onsite' when 2 then 'moon' end as remote from customer""")
def profile_patch(t):
    rows = t.customer.select("c_custkey", "c_name", _patch().alias("p"))
    new = pr.patched(F.col("p"))
    errors = pr.patch_errors(F.col("p"), F.col("c_name"), F.lit("a@b.example"))
    return rows.select("c_custkey", F.array_join(errors, ";").alias("errors"), new["phone"].alias("phone"), F.round(new["total_experience_years"] * 10).cast("long").alias("tenths"), new["remote_preference"].alias("remote"))


@query("profile_state", """select c_custkey, case when c_custkey % 7 = 0 then 'blocked' when c_custkey % 5 = 0 then 'conflict' when c_custkey % 3 = 0 or c_custkey % 4 = 0 then 'processing' when c_custkey % 11 = 0 then 'incomplete' when c_acctbal < 0 then 'incomplete' else 'ready' end as state,
  case when c_custkey % 7 = 0 or c_custkey % 5 = 0 then 'contact_support' when c_custkey % 3 = 0 or c_custkey % 4 = 0 then 'wait_for_resume_processing' when c_custkey % 11 = 0 then 'retry_resume_upload' when c_acctbal < 0 then 'complete_profile' else 'show_profile' end as action from customer""")
def profile_state(t):
    k = F.col("c_custkey")
    upload = F.when(k % 3 == 0, "Profile_Extracting").when(k % 11 == 0, "FAILED")
    got = pr.state(k % 7 != 0, k % 5 != 0, upload, F.when(k % 4 == 0, "Processing"), F.col("c_acctbal") < 0)
    return t.customer.select("c_custkey", got.alias("s")).select("c_custkey", "s.state", "s.action")


@query("profile_lists", "select o_custkey, array_to_string(list_sort(list(distinct lower(o_orderpriority))), '/') as items from orders group by 1")
def profile_lists(t):
    """Lists from texts: repeated items but for case count once, blanks not at all."""
    raw = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit("  "), "o_orderpriority"))), ";\n, ").alias("raw"))
    return raw.select("o_custkey", F.array_join(F.array_sort(F.transform(pr.normal_list(F.col("raw")), lambda x: F.lower(x))), "/").alias("items"))


@query("profile_texts", """select c_custkey, array_to_string(list_filter(list_value(c_name, c_mktsegment, case when c_custkey % 2 = 0 then concat('Total experience: ', c_custkey % 9, ' years') end, case when c_custkey % 3 = 0 then 'Remote preference: remote' end,
  'Preferred locations: Oslo, Rome'), lambda x: x is not null), chr(10)) as identity_text, concat('Skills: spark, sql', chr(10), 'Domains:') as skills_text, cast(c_custkey % 4 = 0 as bigint) as has_summary from customer""")
def profile_texts(t):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    rows = t.customer.select(
        "c_custkey", F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("current_title"), none.alias("current_company"), F.lit("").alias("location"), F.when(k % 2 == 0, k % 9).alias("total_experience_years"),
        F.when(k % 3 == 0, "remote").alias("remote_preference"), F.array(F.lit("Oslo"), F.lit("Rome")).alias("preferred_locations"), F.array().cast("array<string>").alias("target_roles"), F.array(F.lit("spark"), F.lit("sql")).alias("skills"),
        F.lit(None).cast("array<string>").alias("domains"), F.when(k % 4 == 0, "About").alias("summary"), none.alias("experience_text"), none.alias("education_text"),
    )
    return pr.effective_texts(rows).select("c_custkey", "identity_text", "skills_text", F.col("embedding_text").contains("\n\nAbout\n\nSkills").cast("long").alias("has_summary"))


@query("profile_email", "select c_custkey, c_custkey % 3 <> 2 as accepted, concat('u', c_custkey, '@x.example') as email from customer")
def profile_email(t):
    login = F.concat(F.lit(" U"), "c_custkey", F.lit("@x.example"))
    got = pr.resume_email(_case(3, [F.lower(login), " "] + ["other@x.example"]), login)
    return t.customer.select("c_custkey", got.alias("g")).select("c_custkey", "g.accepted", "g.email")


@query("profile_onboarding", f"""select c_custkey as candidate_id, case when c_custkey % 5 = 0 then 'superseded' when c_custkey % 2 = 0 then 'ready' else 'incomplete' end as profile_state, c_custkey % 5 <> 0 and c_custkey % 2 = 1 as onboarding_required,
  case when c_custkey % 5 = 0 then cast(c_custkey + 1 as varchar) end as superseded_by, case when c_custkey % 2 = 0 then '1999-01-01 00:00:00' else '{NOW}' end as created from customer""")
def profile_onboarding(t):
    k = F.col("c_custkey")
    towers = t.customer.where(k % 2 == 0).select(k.alias("candidate_id"), F.lit("e").alias("email"), F.lit("ready").alias("profile_state"), F.lit(False).alias("onboarding_required"), F.lit(None).cast("string").alias("superseded_by"), F.lit("1999-01-01").cast("timestamp").alias("created_at"))
    users = t.customer.select(k.alias("candidate_id"), F.col("c_name").alias("email"))
    replaced = t.customer.where(k % 5 == 0).select(k.alias("candidate_id"), (k + 1).alias("by"))
    got = pr.superseded(pr.onboarded(towers, users, now()), replaced)
    return got.select("candidate_id", "profile_state", "onboarding_required", "superseded_by", stamp(F.col("created_at")).alias("created"))


@query("profile_match_skills", """select p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_value('ml', case when p_partkey % 3 = 0 then 'spark' end, case when p_partkey % 2 = 0 then 'sql' end, case when p_partkey % 5 = 0 then 'rag' end, lower(p_brand)), lambda x: x is not null))), ',') as skills from part""")
def profile_match_skills(t):
    k = F.col("p_partkey")
    record = F.to_json(F.struct(F.when(k % 2 == 0, "knows SQL, mysqlx").alias("summary"), F.when(k % 3 == 0, "PySpark").alias("headline"), F.when(k % 5 == 0, "an LLMX or RAG now").alias("about")))
    lists = [F.array(F.lit(" Machine  Learning. "), F.col("p_brand")), F.when(k % 3 == 0, F.array(F.lit("Apache Spark")))]
    return t.part.select("p_partkey", F.array_join(pr.matcher_skills(lists, record), ",").alias("skills"))


@query("profile_coercions", "select o_orderkey, case when o_orderkey % 3 > 0 then o_orderstatus end as text, cast(case when o_orderkey % 4 > 0 then o_orderkey % 50 * 10 + 5 end as bigint) as tenths, array_to_string(list_value(o_orderstatus, o_orderpriority), '|') as parts from orders")
def profile_coercions(t):
    k = F.col("o_orderkey")
    number = F.when(k % 4 > 0, F.concat(F.lit("about "), k % 50, F.lit(".5 years, 7"))).otherwise("none")
    parts = F.concat(F.lit(" ,"), "o_orderstatus", F.lit(" ,, "), "o_orderpriority", F.lit(" "))
    return t.orders.select("o_orderkey", pr.as_text(F.when(k % 3 > 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(" \t".strip())).alias("text"), F.round(pr.number_in(number) * 10).cast("long").alias("tenths"), F.array_join(pr.comma_list(parts), "|").alias("parts"))


@query("profile_brief", "select doc_id as candidate_id, case when length(t) <= 1200 then t else concat(rtrim(left(t, 1197)), '...') end as identity_text from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from documents)".replace("\\\\", "\\"))
def profile_brief(t):
    return pr.candidate_brief(t.documents.select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("identity_text")))


@query("profile_by_email", """with w as (select distinct lower(trim(c_mktsegment)) as email from customer where c_custkey % 2 = 0), tw as (select o_orderkey as candidate_id, o_custkey as resume_id, case when o_orderkey % 3 = 0 then 'building' end as email from orders)
select distinct email, candidate_id from (select email, candidate_id from tw union all select lower(c_mktsegment), candidate_id from tw join customer on c_custkey = resume_id) where email in (select email from w)""")
def profile_by_email(t):
    emails = t.customer.select(F.concat(F.lit(" "), F.upper("c_mktsegment")).alias("email"), (F.col("c_custkey") % 2 == 0).alias("verified"))
    towers = t.orders.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("resume_id"), F.when(F.col("o_orderkey") % 3 == 0, "Building ").alias("email"))
    return pr.by_verified_email(emails, towers, t.customer.select(F.col("c_custkey").alias("resume_id"), F.col("c_mktsegment").alias("contact_email")))


@query("application_batch", """with ev as (select user_id, event_id % 40 as job_id, arg_max(event_type, event_id) as s, max(event_id) as e from events group by 1, 2), sv as (select distinct user_id, event_id % 40 as job_id from events where event_type <> 'error')
select sv.user_id as candidate_id, sv.job_id, case when s in ('purchase', 'signup') then 'skipped_duplicate' else 'queued' end as run_status, case s when 'purchase' then 'agent_applied' when 'signup' then 'applied_manually' else 'agent_apply_requested' end as application_status,
  case when sv.job_id % 2 = 0 then concat('u', sv.job_id) when s in ('purchase', 'signup') then concat('old', e) end as apply_url, case when s in ('purchase', 'signup') then 'already_applied' end as error_type from sv left join ev on sv.user_id = ev.user_id and sv.job_id = ev.job_id where sv.user_id % 7 <> 0""")
def application_batch(t):
    job = (F.col("event_id") % 40).alias("job_id")
    saved = t.events.where("event_type <> 'error'").select(F.col("user_id").alias("candidate_id"), job).distinct().withColumn("apply_url", F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("u"), "job_id")).otherwise(""))
    last = t.events.groupBy(F.col("user_id").alias("candidate_id"), job).agg(F.max_by("event_type", "event_id").alias("s"), F.max("event_id").alias("e"))
    status = F.when(F.col("s") == "purchase", " Agent_Applied").when(F.col("s") == "signup", "applied_manually").otherwise("seen")
    old = last.select("candidate_id", "job_id", status.alias("status"), F.concat(F.lit("old"), "e").alias("applied_url"))
    active = t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("candidate_id")).unionByName(t.events.where("user_id % 7 = 0").select(F.col("user_id").alias("candidate_id")))
    return ap.batch_runs(saved, old, active).select("candidate_id", "job_id", "run_status", "application_status", "apply_url", "error_type")


@query("application_decision", """select o_orderkey, case when o_orderkey % 7 = 0 or o_orderkey % 5 = 0 or o_orderkey % 4 = 0 then 'precheck_failed' when o_orderkey % 3 = 0 or o_orderkey % 11 = 0 or o_orderstatus <> 'O' then 'needs_review' end as run_status,
  case when o_orderkey % 7 = 0 or o_orderkey % 5 = 0 or o_orderkey % 4 = 0 then 'agent_failed' when o_orderkey % 3 = 0 or o_orderkey % 11 = 0 or o_orderstatus <> 'O' then 'agent_needs_review' end as application_status,
  case when o_orderkey % 7 = 0 then 'job_not_found' when o_orderkey % 5 = 0 then 'candidate_profile_missing' when o_orderkey % 4 = 0 then 'missing_apply_url' when o_orderkey % 3 = 0 then 'review_before_submit_enabled' when o_orderkey % 22 = 0 then 'captcha' when o_orderkey % 11 = 0 then 'manual_review_required' when o_orderstatus <> 'O' then 'external_submit_disabled' end as error_type from orders""")
def application_decision(t):
    k = F.col("o_orderkey")
    domain = F.when(F.col("o_orderstatus") == "O", "WWW.jobs.example").otherwise("other.example")
    got = ap.decision(k % 7 != 0, k % 5 != 0, F.when(k % 4 != 0, "https://x"), k % 3 == 0, k % 11 != 0, F.when(k % 22 == 0, "captcha"), domain, True, ("jobs.example",))
    return t.orders.select("o_orderkey", got.alias("g")).select("o_orderkey", "g.run_status", "g.application_status", "g.error_type")


@query("application_saved", """with s as (select o_orderkey as job_id, o_custkey as candidate_id, case when o_orderkey % 5 = 0 then 'old' else 'saved' end as status, o_orderkey % 3 > 0 as is_active from orders where o_orderkey % 4 <> 3), e as (select job_id, arg_max(ev, n) as ev from (select l_orderkey as job_id, l_linenumber as n, max(case l_returnflag when 'R' then 'removed' when 'A' then 'submitted' else 'saved' end) as ev from lineitem where l_linenumber <= 3 group by 1, 2) group by 1),
j as (select o_orderkey as job_id, o_custkey as candidate_id, s.status, s.is_active, ev, s.job_id is not null as there from orders o left join s on s.job_id = o_orderkey left join e on e.job_id = o_orderkey)
select candidate_id, job_id, case when ev = 'saved' then 'saved' when ev = 'removed' and is_active then 'removed_from_saved' when ev = 'submitted' and is_active and status = 'saved' then 'agent_applied' else status end as status,
  case when ev = 'saved' then true when ev = 'removed' and is_active then false when ev = 'submitted' and is_active and status = 'saved' then false else is_active end as is_active from j where there or ev = 'saved'""")
def application_saved(t):
    k = F.col("o_orderkey")
    saved = t.orders.where(k % 4 != 3).select(F.col("o_custkey").alias("candidate_id"), k.alias("job_id"), F.when(k % 5 == 0, "old").otherwise("saved").alias("status"), (k % 3 > 0).alias("is_active"))
    kind = F.when(F.col("l_returnflag") == "R", "removed").when(F.col("l_returnflag") == "A", "submitted").otherwise("saved")
    events = t.lineitem.where("l_linenumber <= 3").join(t.orders, F.col("l_orderkey") == k).groupBy(F.col("o_custkey").alias("candidate_id"), k.alias("job_id"), F.col("l_linenumber").alias("at")).agg(F.max(kind).alias("event"))
    return ap.saved_after(saved, events)


@query("application_untold", "select distinct l_orderkey as batch_id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def application_untold(t):
    return ap.untold(t.lineitem.select(F.col("l_orderkey").alias("batch_id")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("batch_id")))


@query("request_log", "select event_id from events where event_id % 9 <> 0 and event_type <> 'signup' and (event_type in ('error', 'purchase') or (event_type = 'click' and event_id % 100 < 5))")
def request_log(t):
    kind = F.col("event_type")
    method = F.when(kind == "signup", "OPTIONS").when(kind == "purchase", "POST").when(kind == "click", "HEAD").otherwise("GET")
    path = F.when(F.col("event_id") % 9 == 0, "/health/").otherwise("/jobs")
    keep = ap.logged(method, path, F.when(kind == "error", 500).otherwise(200), F.col("event_id") % 100 / 100)
    return t.events.where(keep).select("event_id")


@query("portal_update", """select s_suppkey as portal_id, case when s_suppkey % 4 = 3 then null when s_suppkey % 4 = 0 then 'rejected' else 'updated' end as outcome, case when s_suppkey % 4 = 1 then 'draft' else 'active' end as status, s_suppkey % 4 <> 1 as is_active, case when s_suppkey % 4 = 1 then 'unknown' else 'custom' end as source_platform,
  s_suppkey % 5 + case when s_suppkey % 4 in (1, 2) then 1 else 0 end as version from supplier""")
def portal_update(t):
    k = F.col("s_suppkey")
    portals = t.supplier.select(k.alias("portal_id"), F.concat(F.lit("u"), k).alias("listing_url"), F.lit("active").alias("status"), F.lit(True).alias("is_active"), F.lit("custom").alias("source_platform"), F.lit("completed").alias("last_run_status"), (k % 5).alias("version"))
    patches = t.supplier.where(k % 4 != 3).select(k.alias("portal_id"), F.when(k % 4 == 0, k % 5 - 1).otherwise(k % 5).alias("read_version"), F.when(k % 4 == 2, F.concat(F.lit("u"), k)).otherwise("https://new").alias("new_url"))
    return po.updated(portals, patches).select("portal_id", "outcome", "status", "is_active", "source_platform", "version")


@query("portal_override", "select s_suppkey as portal_id, case when s_suppkey % 2 = 0 and s_suppkey % 3 > 0 then 'ready_for_test' when s_suppkey % 3 = 0 then 'paused' else 'active' end as status, s_suppkey % 5 + case when s_suppkey % 2 = 0 then 1 else 0 end as version, least(10, s_suppkey % 14 + case when s_suppkey % 2 = 0 then 1 else 0 end) as kept from supplier")
def portal_override(t):
    k = F.col("s_suppkey")
    old = F.transform(F.slice(F.sequence(F.lit(1), F.lit(14)), F.lit(1), (k % 14).cast("int")), lambda x: x.cast("string"))
    portals = t.supplier.select(k.alias("portal_id"), F.when(k % 3 == 0, "paused").otherwise("active").alias("status"), (k % 5).alias("version"), F.when(k % 2 == 0, old).otherwise(F.slice(old, 1, 10)).alias("entries"))
    got = po.overridden(portals, t.supplier.where(k % 2 == 0).select(k.alias("portal_id"), F.lit("generic").alias("profile_name"), F.lit("e").alias("entry")))
    return got.select("portal_id", "status", "version", F.size("entries").cast("long").alias("kept"))


@query("portal_probe", f"select s_suppkey as portal_id, case when s_suppkey % 4 = 0 then 'active' when s_suppkey % 3 = 0 then 'blocked' when s_suppkey % 5 = 0 then 'needs_review' else 'ready_for_test' end as status, case when s_suppkey % 4 = 0 then 'old' when s_suppkey % 2 = 0 then 'workday' else 'unknown' end as source_platform, case when s_suppkey % 4 = 0 then s_suppkey % 6 else 0 end as failures, case when s_suppkey % 4 > 0 then '{NOW}' end as at from supplier")
def portal_probe(t):
    k = F.col("s_suppkey")
    portals = t.supplier.select(k.alias("portal_id"), F.lit("active").alias("status"), F.lit("old").alias("source_platform"), (k % 6).alias("failures"), F.lit(None).cast("timestamp").alias("last_successful_run_on"), F.lit("never").alias("last_run_status"))
    results = t.supplier.where(k % 4 > 0).select(k.alias("portal_id"), (k % 3 == 0).alias("blocked"), (k % 5).cast("int").alias("discovered"), F.when(k % 2 == 0, "workday").alias("platform"))
    return po.probed(portals, results, now()).select("portal_id", "status", "source_platform", "failures", stamp(F.col("last_successful_run_on")).alias("at"))


@query("portal_health", "select cast(sum(s_suppkey) as bigint) as active, cast(sum(s_suppkey % 4) as bigint) as inactive, count(*) filter (where s_suppkey % 7 > 4 or s_suppkey % 3 = 0) as failing, count(*) filter (where s_suppkey % 2 = 0) as scheduled from supplier")
def portal_health(t):
    k = F.col("s_suppkey")
    return po.health(t.supplier.select(k.alias("active_jobs"), (k % 4).alias("inactive_jobs"), F.greatest(F.lit(0), k % 7 - 4).alias("failures"), F.when(k % 3 == 0, "auto_paused").otherwise("active").alias("status"), (k % 2 == 0).alias("scheduled")))


@query("portal_public", "select s_suppkey as id, s_name as display_name, cast(null as varchar) as metadata from supplier")
def portal_public(t):
    got = po.public(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("display_name"), F.col("s_acctbal").alias("secret")))
    assert got.columns == list(po.PUBLIC)
    return got.select("id", "display_name", "metadata")


_PLAN_SQL = """d as (select distinct concat('https://x.example/', l_partkey % 400) as url from lineitem), jb as (select p_partkey as job_id, concat('https://x.example/', p_partkey % 250) as u1, concat('https://x.example/', p_partkey % 90 + 200) as u2 from part),
k as (select u, max(job_id) as job_id from (select u1 as u, job_id from jb union all select u2, job_id from jb) group by 1), p as (select url, k.job_id, k.job_id is null as is_new, coalesce(k.job_id % 4 = 0, false) as due, coalesce(k.job_id % 5 = 0 or k.job_id % 7 = 0 or k.job_id % 11 = 0, false) as broken from d left join k on k.u = d.url)"""


def _plan(t):
    k = F.col("p_partkey")
    at = lambda n: F.concat(F.lit("https://x.example/"), n)
    day = lambda n: now() - F.make_dt_interval(days=F.lit(n))
    jobs = t.part.select(
        k.alias("job_id"), F.concat(at(k % 250), F.lit("?utm_source=a")).alias("job_url"), at(k % 90 + 200).alias("apply_url"), (k % 5 != 0).alias("is_active"), F.when(k % 7 == 0, "Parse_Failed").otherwise("active").alias("freshness_status"),
        F.col("p_name").alias("title"), F.when(k % 11 == 0, " ").otherwise(F.col("p_brand")).alias("company"), F.when(k % 2 == 0, F.when(k % 4 == 0, day(15)).otherwise(day(14))).alias("last_deep_scraped_at"), day(3).alias("last_seen_at"),
    )
    return lc.plan_details(t.lineitem.select(at(F.col("l_partkey") % 400).alias("url")), jobs, now())


@query("plan_details", f"with {_PLAN_SQL} select url, job_id, is_new or due or broken as extract, is_new, due, broken from p")
def plan_details(t):
    return _plan(t)


@query("plan_summary", f"with {_PLAN_SQL} select count(*) as discovered, count(*) filter (where is_new or due or broken) as to_extract, count(*) filter (where is_new) as new, count(*) filter (where due) as due, count(*) filter (where broken) as broken, count(*) filter (where not (is_new or due or broken)) as skipped from p")
def plan_summary(t):
    return lc.plan_summary(_plan(t))


@query("backfill_order", "select o_orderkey as job_id, case when o_orderkey % 2 = 0 then 0 else case when o_orderkey % 5 > 0 then o_orderkey % 4 + 1 else o_orderkey % 4 end end as missing_count, o_orderkey % 2 = 0 or (o_orderkey % 5 > 0 and o_orderkey % 4 + 1 < 3) as is_active from orders")
def backfill_order(t):
    """What was seen is reset before misses are counted: a job with three misses that is seen again stays active."""
    k = F.col("o_orderkey")
    jobs = t.orders.select(k.alias("job_id"), F.lit("t").alias("target"), k.alias("url_key"), (k % 5 > 0).alias("is_active"), (k % 4).alias("missing_count"), F.lit("gone").alias("inactive_reason"), F.col("o_orderdate").alias("last_seen_at"))
    found = t.orders.where(k % 2 == 0).select(F.lit("t").alias("target"), k.alias("url_key"))
    return lc.backfilled(jobs, found, "target", now()).select("job_id", "missing_count", "is_active")


_RESUMES_SQL = """c as (select c_custkey, concat('res_', left(sha256(cast(c_custkey as varchar)), 24)) as rid, sha256(cast(c_custkey as varchar)) as sha from customer), o as (select * from c where c_custkey % 2 = 0), b as (select * from c where c_custkey % 3 = 0)"""


def _resumes(t):
    k = F.col("c_custkey")
    sha = F.sha2(k.cast("string"), 256)
    rid = F.concat(F.lit("res_"), F.left(sha, F.lit(24)))
    old = F.lit("1999-01-01").cast("timestamp")
    current = t.customer.where(k % 2 == 0).select(rid.alias("resume_id"), sha.alias("sha256"), F.lit("h0").alias("content_hash"), old.alias("first_seen_at"), old.alias("last_seen_at"), F.lit(False).alias("is_active"))
    batch = t.customer.where(k % 3 == 0).select(sha.alias("sha256"), F.when(k % 2 == 0, rid).alias("resume_id"), F.when(k % 4 == 0, "h0").otherwise("h1").alias("content_hash"))
    return lc.resume_upsert(current, batch.unionByName(batch.limit(0)), now())


@query("ups_resume", f"with {_RESUMES_SQL} select coalesce(o.rid, b.rid) as resume_id, case when b.rid is null or b.c_custkey % 4 = 0 then 'h0' else 'h1' end as content_hash, case when o.rid is null then '{NOW}' else '1999-01-01 00:00:00' end as first_seen, b.rid is not null as is_active from o full join b on o.rid = b.rid")
def ups_resume(t):
    return _resumes(t)[0].select("resume_id", "content_hash", stamp(F.col("first_seen_at")).alias("first_seen"), "is_active")


@query("ups_resume_history", f"with {_RESUMES_SQL} select concat('reshist_', b.rid, '_', case when b.c_custkey % 4 = 0 then 'h0' else 'h1' end) as history_id from b left join o on o.rid = b.rid where o.rid is null or b.c_custkey % 4 <> 0")
def ups_resume_history(t):
    return _resumes(t)[1].select("history_id")


@query("ups_candidate_tower", """select c_custkey as candidate_id, case when c_custkey % 2 = 1 then 'Old' when c_custkey % 4 = 0 then 'Kafka,Spark' when c_custkey % 3 = 0 then 'Docker,Kafka' else 'AWS' end as skills,
  case when c_custkey % 2 = 1 then 'old text' when c_custkey % 5 = 0 then 'given' when c_custkey % 4 = 0 then 'Skills: Kafka, Spark' when c_custkey % 3 = 0 then 'Skills: Docker, Kafka' else 'Skills: AWS' end as skills_text, case when c_custkey % 2 = 1 then 1 else 0 end as older from customer""")
def ups_candidate_tower(t):
    k = F.col("c_custkey")
    some = lambda *x: F.array(*map(F.lit, x))
    current = t.customer.select(k.alias("candidate_id"), some("Old").alias("skills"), some("Old").alias("primary_skills"), some("Old").alias("secondary_skills"), F.lit("old text").alias("skills_text"), F.lit("h").alias("content_hash"))
    batch = t.customer.where(k % 2 == 0).select(
        k.alias("candidate_id"), F.when(k % 4 == 0, some("Kafka", "Apache Spark", "kafka")).otherwise(F.array().cast("array<string>")).alias("skills"), F.when(k % 3 == 0, some("Docker")).alias("primary_skills"),
        F.when(k % 3 == 0, some("Kafka")).alias("secondary_skills"), some("aws").alias("raw_skills"), F.when(k % 5 == 0, "given").otherwise(" ").alias("skills_text"), F.lit("h2").alias("content_hash"),
    )
    got = lc.tower_upsert(current, batch)
    return got.select("candidate_id", F.array_join("skills", ",").alias("skills"), "skills_text", F.size("primary_skills").cast("long").alias("older"))


@query("srt_backlog", "select o_orderkey as request_id from orders where o_orderstatus = 'P' order by o_orderpriority desc, o_orderdate, o_orderkey limit 100")
def srt_backlog(t):
    rows = t.orders.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("updated_at"))
    return lc.refresh_next(rows, 1000).select("request_id")


@query("rerank_summary", "select (select count(*) from customer) as candidates, count(distinct user_id) as matched, count(*) as matches, cast(round(avg(event_id % 101) * 1e4) as bigint) as mean_e4, max(event_id % 101) as best, cast(round(avg(event_id % 7) * 1e4) as bigint) as base_e4 from events where event_type = 'click'")
def rerank_summary(t):
    final = t.events.where("event_type = 'click'").select(F.col("user_id").alias("candidate_id"), (F.col("event_id") % 101).alias("final_score"), (F.col("event_id") % 7).alias("baseline_score"))
    s = m.rerank_summary(final, t.customer.select(F.col("c_custkey").alias("candidate_id")))
    e4 = lambda c, n: F.round(F.col(c) * 1e4).cast("long").alias(n)
    return s.select("candidates", "matched", "matches", e4("mean_final", "mean_e4"), F.col("best_final").cast("long").alias("best"), e4("mean_baseline", "base_e4"))


@query("match_top_titles", "select p_brand as title, count(*) as n from lineitem join part on p_partkey = l_partkey group by 1 order by n desc, title limit 10")
def match_top_titles(t):
    return m.top_titles(t.lineitem.select(F.col("l_partkey").alias("job_id")), t.part.select(F.col("p_partkey").alias("job_id"), F.col("p_brand").alias("title")))


@query("vec_payload", "select p_partkey as job_id, p_name as title, 'job' as record_type, 0 as skills, 'e' as embedding_model from part")
def vec_payload(t):
    rows = m.vector_payload(t.part.select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"), "p_size"), "job", "e")
    return rows.select("job_id", "title", "record_type", F.size("required_skills").alias("skills"), "embedding_model")


@query("prj_public_drop", "select c_custkey, c_name from customer")
def prj_public_drop(t):
    """Records without the store's own key."""
    return t.customer.select("c_custkey", "c_name", F.lit("x").alias("_id")).drop("_id")


@query("snk_summary", "select 'acme' as target, 'r1' as run_id, count(distinct url) as discovered_urls, count(*) as attempted_urls, count(*) as extracted_jobs, cast(2.5 as double) as seconds from pages")
def snk_summary(t):
    at = _folder(t)
    sinks.write_run_summary(sinks.run_summary(t.pages, t.pages, "acme", "r1", 2.5), at, "r1", "acme")
    kind = "target string, run_id string, discovered_urls long, attempted_urls long, extracted_jobs long, seconds double"
    both = readers.read_records(t.spark, f"{at}/target=acme/latest", kind).intersect(readers.read_records(t.spark, f"{at}/target=acme/run=r1", kind))
    return both.select(*[c.split(" ")[0] for c in kind.split(", ")])


@query("snk_comparison", "select o_custkey as candidate_id, count(*) as overlap from orders group by 1")
def snk_comparison(t):
    at = _folder(t)
    each = t.orders.groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.count(F.lit(1)).alias("overlap"))
    sinks.write_comparison(t.orders.select("o_custkey", "o_orderkey"), each, each.agg(F.sum("overlap").alias("overlap")), at)
    return t.spark.read.schema("candidate_id long, overlap long").option("header", "true").csv(f"{at}/candidates")


@query("snk_towers", "select c_custkey as candidate_id, c_name as identity_text from customer")
def snk_towers(t):
    at = _folder(t)
    sinks.write_towers(t.customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("identity_text")), at, "r1")
    return readers.read_records(t.spark, f"{at}/latest", "candidate_id long, identity_text string")


@query("snk_quarantine", """select o_orderkey, case when o_totalprice < 100000 then 'cheap' end as reason from orders""")
def snk_quarantine(t):
    good, bad = sinks.quarantined(t.orders.select("o_orderkey", "o_totalprice"), F.col("o_totalprice") >= 100000, F.lit("cheap"))
    back = bad.select(F.from_json("payload", "o_orderkey long").o_orderkey.alias("o_orderkey"), "reason")
    return good.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(back)


@query("snk_event_log", "select event_id, event_type as event, 'r1' as run_session_id from events")
def snk_event_log(t):
    at = _folder(t)
    sinks.write_records(sinks.event_rows(t.events.select("ts", F.col("event_type").alias("event"), "event_id", "user_id"), "r1"), at, mode="append")
    rows = readers.read_records(t.spark, at, "event string, run_session_id string, data string")
    return rows.select(F.get_json_object("data", "$.event_id").cast("long").alias("event_id"), "event", "run_session_id")


@query("snk_jobs", "select p_partkey as job_id, p_name as title from part where p_size > 10")
def snk_jobs(t):
    """A run's jobs under its own folder and as the latest, read back from there."""
    at = _folder(t)
    sinks.write_jobs_json(t.part.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("job_id"), F.col("p_name").alias("title")), at, "r1")
    return readers.read_records(t.spark, f"{at}/latest", "job_id string, title string").select(F.col("job_id").cast("long").alias("job_id"), "title")


@query("src_job_scan", "select p_partkey as job_id, 'acme_jobs' as target, p_name as title from part where p_partkey % 5 = 0")
def src_job_scan(t):
    """Files of JSON arrays: of a known target, of another, of an older run, a summary, and a broken one."""
    k = F.col("p_partkey")
    body = F.when(k % 5 < 4, F.to_json(F.array(F.struct(k.cast("string").alias("job_id"), F.col("p_name").alias("title"))))).otherwise("[{")
    name = F.when(k % 5 == 0, "acme_jobs.json").when(k % 5 == 1, "other.json").when(k % 5 == 2, "acme_20240101T000000Z.json").when(k % 5 == 3, "acme_summary.json").otherwise("acme.json")
    files = t.part.select(body.alias("value"), F.concat(F.lit("file:/data/jobs/"), name).alias("file"))
    return readers.jobs_in(files, ["acme", "acme_jobs"]).select(F.col("job_id").cast("long").alias("job_id"), "target", "title")


@query("src_profiles", "select c_custkey, c_name as headline from customer where c_custkey % 3 > 0")
def src_profiles(t):
    """Profiles without an id or a hash are none."""
    k = F.col("c_custkey")
    rows = t.customer.select(F.when(k % 6 > 0, k.cast("string")).alias("resume_id"), F.when(k % 3 > 0, "s").otherwise("").alias("sha256"), F.col("c_name").alias("headline"))
    return readers.profiles_in(rows).select(F.col("resume_id").cast("long").alias("c_custkey"), "headline")


@query("src_resume_files", "select page_id, length(html) > 0 as filled from pages where page_id % 4 = 1 and page_id % 3 > 0")
def src_resume_files(t):
    """Files by extension and size, without those whose hash is known."""
    k = F.col("page_id")
    path = F.concat(F.lit("file:/r/"), k, F.when(k % 4 == 0, ".txt").when(k % 4 == 1, ".PDF").when(k % 4 == 2, "").otherwise(".pdf"))
    content = F.when(k % 4 == 3, "").otherwise(F.concat(k, F.lit(" "), "html")).cast("binary")
    files = t.pages.select(path.alias("path"), content.alias("content"), F.octet_length(content).alias("length"))
    known = t.pages.where(k % 3 == 0).select(F.sha2(F.concat(k, F.lit(" "), "html").cast("binary"), 256).alias("sha256"))
    got = readers.resumes_in(files, known=known)
    return got.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("page_id"), (F.length("content") > 0).alias("filled"))


@query("flt_valid_jobs", "select p_partkey from part where p_partkey % 3 > 0 and p_partkey % 5 > 0")
def flt_valid_jobs(t):
    from ..operators import payloads

    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.when(k % 3 > 0, F.col("p_name")).otherwise("").alias("title"), F.when(k % 5 > 0, "https://x").alias("job_url"))
    return payloads.valid(rows).select("p_partkey")


@query("str_indexed", "select user_id, max(event_id) as last_event from events group by 1")
def str_indexed(t):
    """Changed keys of each micro-batch merged into an index by key; a batch that comes again changes nothing."""
    from ..streaming import events as ev

    at = _folder(t)
    t.events.select("user_id", "event_id").write.parquet(f"{at}/in")
    source = t.spark.readStream.schema("user_id long, event_id long").parquet(f"{at}/in")

    def merge(batch, n):
        batch.groupBy("user_id").agg(F.max("event_id").alias("last_event")).write.mode("overwrite").parquet(f"{at}/index/batch={n}")

    ev.merge_each(source, merge, f"{at}/checkpoint")
    return t.spark.read.parquet(f"{at}/index").groupBy("user_id").agg(F.max("last_event").alias("last_event"))
