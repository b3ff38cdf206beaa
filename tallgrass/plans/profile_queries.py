"""Towers, résumé parts, payloads and indexing over customers, orders, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indexing, payloads, resumes, towers
from .registry import query


@query("twr_job", """select o_orderkey as job_id, concat('Title: ', o_orderpriority, chr(10), 'Employment type: ', o_orderstatus) as title_text, case when o_orderkey % 2 = 0 then concat('Required skills: sql, ', o_orderstatus, chr(10), 'Summary: needs x') else concat('Required skills: sql, ', o_orderstatus) end as requirements_text,
concat('Title: ', o_orderpriority, ' Employment type: ', o_orderstatus, chr(10), case when o_orderkey % 2 = 0 then concat('Required skills: sql, ', o_orderstatus, ' Summary: needs x') else concat('Required skills: sql, ', o_orderstatus) end, chr(10), 'Responsibilities: do this and that') as embedding_text from orders""")
def twr_job(t):
    k = F.col("o_orderkey")
    jobs = t.orders.select(
        k.alias("job_id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("company"), F.lit("").alias("location_text"), F.col("o_orderstatus").alias("employment_type"), F.lit(None).cast("string").alias("duration"),
        F.array(F.lit(" sql"), F.lit(""), F.col("o_orderstatus")).alias("required_skills"), F.array().cast("array<string>").alias("preferred_skills"), F.when(k % 2 == 0, "needs \n x").alias("summary"),
        F.array(F.lit("do this"), F.lit("and that")).alias("responsibilities"), F.lit(None).cast("string").alias("compensation_text"),
    )
    return towers.job_tower(jobs).select("job_id", "title_text", "requirements_text", "embedding_text")


def _profiles(t):
    k = F.col("c_custkey")
    job = F.struct(F.lit("Data Engineer").alias("title"), F.col("c_mktsegment").alias("company"), F.array(F.lit("built"), F.lit("things")).alias("responsibilities"))
    none = F.lit(None).cast("string")
    return t.customer.select(
        F.sha2(k.cast("string"), 256).alias("sha256"), F.col("c_name").alias("full_name"), none.alias("headline"), F.lit("Engineer").alias("current_title"), F.col("c_mktsegment").alias("current_company"), none.alias("location"),
        F.when(k % 2 == 0, (k % 40).cast("int")).alias("total_experience_years"), F.when(k % 3 == 0, "uses kafka").alias("summary"), F.array(F.lit("py spark"), F.lit("Tools")).alias("skills"), F.array().cast("array<string>").alias("domains"),
        F.array().cast("array<string>").alias("certifications"), F.array(job).alias("experience"), F.array(F.struct(F.lit("BSc").alias("degree"), none.alias("field_of_study"), F.lit("U").alias("institution"))).alias("education"),
    )


_IDENT = "concat(c_name, chr(10), 'Engineer', chr(10), c_mktsegment, case when c_custkey % 2 = 0 then concat(chr(10), 'Total experience: ', c_custkey % 40, ' years') else '' end)"


@query("twr_candidate", f"select concat('cand_', left(sha256(cast(c_custkey as varchar)), 24)) as candidate_id, {_IDENT} as identity_text, concat('Skills: PySpark', case when c_custkey % 3 = 0 then ', Kafka' else '' end) as skills_text, concat('Data Engineer ', c_mktsegment, ' Responsibilities: built things') as experience_text, 'BSc U' as education_text from customer")
def twr_candidate(t):
    # a file of few row groups is few tasks, whatever it holds
    profiles = _profiles(t).repartition("sha256")
    return towers.candidate_tower(profiles).select("candidate_id", "identity_text", "skills_text", "experience_text", "education_text")


@query("twr_parsed", "select concat('cand_', left(sha256(cast(c_custkey as varchar)), 24)) as candidate_id, concat(c_name, ' Engineer ', c_mktsegment) as identity_text, 'Skills: py spark, Tools Domains: Certifications:' as skills_text, concat('Data Engineer | ', c_mktsegment, ' | Responsibilities: built things') as experience_text from customer")
def twr_parsed(t):
    return towers.parsed_tower(_profiles(t)).select("candidate_id", "identity_text", "skills_text", "experience_text")


@query("res_line_kinds", r"select conv_id, turn, regexp_matches(l, '(?i)\b(engineer|analyst)\b') or contains(l, '2019') as is_role, contains(lower(l), 'engine') or contains(lower(l), 'platform') or starts_with(lower(l), 'project:') as is_project from (select conv_id, turn, case turn % 4 when 0 then 'Senior Engineer' when 1 then 'Acme 2019 - Present' when 2 then 'Chat platform' else 'Project: x' end as l from conversations)")
def res_line_kinds(t):
    n = F.col("turn") % 4
    line = F.when(n == 0, "Senior Engineer").when(n == 1, "Acme 2019 - Present").when(n == 2, "Chat platform").otherwise("Project: x")
    return t.conversations.select("conv_id", "turn", resumes.is_role_line(line).alias("is_role"), resumes.is_project_line(line, F.lit(False)).alias("is_project"))


@query("res_span_types", "select event_id, case event_type when 'view' then 'work_experience' when 'click' then 'project' when 'purchase' then 'summary' when 'error' then 'contact' else 'other' end as span_type from events")
def res_span_types(t):
    e = F.col("event_type")
    raw = F.when(e == "view", " Employment History ").when(e == "click", "Projects").when(e == "purchase", "Career-Summary").when(e == "error", "HEADER")
    return t.events.select("event_id", resumes.span_type(raw).alias("span_type"))


@query("res_skill_groups", "with g as (select conv_id, row_number() over (partition by conv_id order by turn) as group_no, role as category, concat('v', turn) as values_text from conversations where turn % 3 <> 0), l as (select conv_id, string_agg(concat('w', turn), ', ' order by turn) as values_text from conversations where turn % 3 = 0 group by 1) select * from g union all select l.conv_id, coalesce((select max(group_no) from g where g.conv_id = l.conv_id), 0) + 1, 'uncategorized', values_text from l")
def res_skill_groups(t):
    line = F.when(F.col("turn") % 3 != 0, F.concat("role", F.lit(" : v"), "turn")).otherwise(F.concat(F.lit("w"), "turn"))
    got = resumes.skill_groups(t.conversations.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")
    return got.withColumn("group_no", F.col("group_no").cast("long"))


@query("res_title_at_company", "select c_custkey, 'Data Engineer' as title, c_name as company, case when c_custkey % 2 = 0 then 'Jan 2020' end as start_date, case when c_custkey % 2 = 0 then 'Present' end as end_date from customer")
def res_title_at_company(t):
    line = F.concat(F.lit("Data Engineer at "), "c_name", F.when(F.col("c_custkey") % 2 == 0, " (Jan 2020 - present).").otherwise(" (remote)"))
    h = resumes.title_at_company(line)
    return t.customer.select("c_custkey", *[h[n].alias(n) for n in ("title", "company", "start_date", "end_date")])


@query("res_role_hints", "with f as (select conv_id, max(turn) as m from conversations group by 1) select conv_id, case when m >= 1 then 'Data Scientist' else 'Aldi, Batavia, IL' end as title, case when m >= 1 then 'Aldi' end as company, case when m >= 1 then 'Batavia, IL' end as location, 'Sep 2023' as start_date, 'Present' as end_date, true as is_current from f")
def res_role_hints(t):
    line = F.when(F.col("turn") == 0, "Aldi, Batavia, IL Sep 2023 - Present").when(F.col("turn") == 1, "Data Scientist").otherwise("x")
    return resumes.role_hints(t.conversations.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")


@query("res_root_profile", "select c_custkey, c_name as full_name, 'Builds things' as headline, concat('a', c_custkey, '@ex.com') as email, case when c_custkey % 2 = 0 then 7.5::double end as total_experience_years, 'SQL/Go' as primary_skills from customer")
def res_root_profile(t):
    body = F.concat(F.lit("\na"), "c_custkey", F.lit("@ex.com | 555-123-4567\n"), "c_name", F.lit("\nBuilds things"), F.when(F.col("c_custkey") % 2 == 0, "\nOver 7.5+ years of work").otherwise(""))
    p = resumes.root_profile(body, F.lit("SQL, Go; sql"))
    return t.customer.select("c_custkey", *[p[n].alias(n) for n in ("full_name", "headline", "email", "total_experience_years")], F.array_join(p["primary_skills"], "/").alias("primary_skills"))


def _items(t):
    none = F.lit(None).cast("string")
    old = F.struct(F.lit("Old").alias("title"), F.col("c_mktsegment").alias("company"), F.lit("2010").alias("start_date"), F.lit("2012").alias("end_date"), F.lit(False).alias("is_current"), F.array().cast("array<string>").alias("responsibilities"))
    new = F.struct(F.when(F.col("c_custkey") % 3 != 0, "New").alias("title"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("company"), none.alias("start_date"), F.when(F.col("c_custkey") % 2 == 0, " PRESENT ").alias("end_date"), F.lit(None).cast("boolean").alias("is_current"), F.array(F.lit("did")).alias("responsibilities"))
    return F.array(old, new)


@query("res_current_role", "select c_custkey, case when c_custkey % 2 = 0 then case when c_custkey % 3 <> 0 then 'New' end else 'Old' end as title from customer")
def res_current_role(t):
    return t.customer.select("c_custkey", resumes.current_role(_items(t)).title.alias("title"))


@query("res_quality", "select c_custkey, array_to_string(list_filter(list_value('no_current_company', case when c_custkey % 3 = 0 then 'project_in_experience' end, 'no_projects', case when c_acctbal < 0 then 'no_years' end, 'no_domains'), lambda x: x is not null), ',') as faults, c_custkey % 3 = 0 or c_acctbal < 0 as critical from customer")
def res_quality(t):
    empty, yes = F.array().cast("array<string>"), F.lit(True)
    profile = {"experience": _items(t), "current_title": F.lit("x"), "current_company": F.lit(None), "projects": empty, "education": F.array(F.lit("e")), "skills": F.array(F.lit("s")), "total_experience_years": F.when(F.col("c_acctbal") >= 0, 1.0), "domains": empty}
    faults = resumes.quality_faults({k: yes for k in ("work", "projects", "education", "skills", "years")}, profile)
    return t.customer.select("c_custkey", F.array_join(faults, ",").alias("faults"), F.arrays_overlap(faults, F.array(*map(F.lit, resumes.CRITICAL))).alias("critical"))


@query("res_merge", "select c_custkey, case when c_custkey % 2 = 0 then c_name else 'again' end as full_name, case when c_custkey % 2 = 0 then 'SQL/Go/Rust' else 'SQL/Rust' end as skills from customer")
def res_merge(t):
    even = F.col("c_custkey") % 2 == 0
    a = t.customer.select("c_custkey", F.when(even, F.col("c_name")).otherwise(" ").alias("full_name"), F.when(even, F.array(F.lit("SQL"), F.lit("Go"))).alias("skills"))
    b = t.customer.select("c_custkey", F.lit("again").alias("full_name"), F.when(even, F.array(F.lit("sql"), F.lit("Rust"))).otherwise(F.array(F.lit("SQL"), F.lit("Rust"))).alias("skills"))
    return resumes.merged_parses(a, b, "c_custkey", ["full_name"], ["skills"]).withColumn("skills", F.array_join("skills", "/"))


@query("json_aliases", "select event_id, event_type as title, concat('p', user_id) as location_text, case when event_id % 2 = 0 then 'd' end as posted_date, case when event_id % 3 = 0 then 'a/b' when event_id % 3 = 1 then 'one' else '' end as skills from events")
def json_aliases(t):
    e = F.col("event_id")
    p = F.concat(F.lit('{"title": "'), "event_type", F.lit('", "location": "p'), "user_id", F.lit('"'), F.when(e % 2 == 0, ', "datePosted": "d"').otherwise(""), F.when(e % 3 == 0, ', "required_skills": ["a", "b"]').when(e % 3 == 1, ', "required_skills": "one"').otherwise(""), F.lit("}"))
    rows = t.events.select("event_id", p.alias("p"))
    f = lambda n: payloads.field(F.col("p"), n)
    return rows.select("event_id", f("title").alias("title"), f("location_text").alias("location_text"), f("posted_date").alias("posted_date"), F.array_join(f("required_skills"), "/").alias("skills"))


@query("json_best_payload", "select event_id, case when event_id % 4 = 3 then null when event_id % 4 = 1 then 'second' else 'first' end as title, case when event_id % 4 = 1 then 'u' else 'fallback' end as job_url, case event_id % 4 when 0 then 8 when 1 then 8 when 2 then 8 else 3 end as score from events")
def json_best_payload(t):
    n = F.col("event_id") % 4
    p = F.when(n == 0, '{"job": {"title": "first"}}').when(n == 1, '{"jobs": [{"summary": "s"}, {"title": "second", "job_url": "u"}]}').when(n == 2, '[{"title": "first"}, {"title": "later"}]').otherwise('{"odd": 1}')
    rows = t.events.select("event_id", p.alias("p"), F.lit("fallback").alias("u"))
    return payloads.best(rows, "event_id", "p", "u").select("event_id", "title", "job_url", "score")


def _towers(t):
    k = F.col("c_custkey")
    return t.customer.select(F.when(k % 11 != 0, k.cast("string")).alias("record_id"), F.when(k % 5 != 0, F.col("c_name")).otherwise(" ").alias("embedding_text"), F.when(k % 3 == 0, "indexed").when(k % 3 == 1, "pending").alias("embedding_status"), F.lit("h").alias("content_hash"))


@query("vec_pending", "select cast(c_custkey as varchar) as record_id from customer where c_custkey % 11 <> 0 and c_custkey % 5 <> 0 and c_custkey % 3 <> 0")
def vec_pending(t):
    return indexing.pending(_towers(t), "record_id").select("record_id")


@query("vec_skipped", "select count(*) filter (where c_custkey % 11 = 0) as no_id, count(*) filter (where c_custkey % 5 = 0) as no_text from customer")
def vec_skipped(t):
    return indexing.skipped(_towers(t), "record_id")


@query("vec_indexed", "select coalesce(case when c_custkey % 11 <> 0 then case when c_custkey % 3 = 0 or c_custkey % 5 <> 0 then 'indexed' when c_custkey % 3 = 1 then 'pending' end else case c_custkey % 3 when 0 then 'indexed' when 1 then 'pending' end end, 'none') as status, count(*) as n from customer group by 1")
def vec_indexed(t):
    rows = _towers(t)
    done = indexing.embedded(indexing.pending(rows, "record_id"), "record_id", indexing.hashed_vector)
    after, _ = indexing.indexed(rows, done, "record_id", F.lit("2024-01-01").cast("timestamp"))
    return after.groupBy(F.coalesce("embedding_status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
