"""Résumés in canonical shape, over the lines of documents: headings, bullets, dates and role lines are put in by line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canonical as ca
from ..operators import documents as d
from .document_queries import LINES_SQL, NORMAL_SQL, _spans
from .registry import query

_TYPES = ("work_experience", "projects", "education", "skills", "summary")

#: Lines with what stands in them; then sections and blocks as plain SQL, roles by recursion.
_SQL = rf"""{LINES_SQL},
put as (
  select doc_id, line_no, printf('L%04d', line_no) as line_id, line_no % 9 = 4 as is_heading, (line_no // 9) % 5 as s,
    case when line_no % 9 = 4 then 'HEADING ' || line_no when line_no % 7 = 0 then left(line, 10) || ' 2019 - 2021' when line_no % 5 = 0 then 'Data engineer' when line_no % 11 = 0 then 'Title: ' || left(line, 12) when line_no % 13 = 0 then 'Master of Arts' when line_no % 6 = 0 then 'Cat: a, b' else left(line, 40) end as core,
    line_no % 3 = 0 and line_no % 9 <> 4 as is_bullet
  from lines),
body as (
  select *, case when is_bullet then '- ' || core else core end as line, case when is_bullet then trim(core) else core end as bare, case when line_no % 7 = 0 and not is_heading then 1 else 0 end as dated,
    sum(case when is_heading then 1 else 0 end) over (partition by doc_id order by line_no) as section_no
  from put),
sec as (
  select *, case when section_no = 0 then 'header' else list_value('work_experience', 'projects', 'education', 'skills', 'summary')[1 + max(case when is_heading then s end) over (partition by doc_id, section_no)] end as section from body),
top as (select doc_id, max(case when section_no = 0 then 1 else 0 end) as led from sec group by 1),
ids as (select distinct doc_id, section_no, section, 'sec_' || lpad(cast(case when section_no = 0 then 0 else section_no + led end as varchar), 3, '0') || '_' || section as section_id from sec join top using (doc_id)),
l as (
  select *, row_number() over (partition by doc_id, section_no order by line_no) as n, len(regexp_extract_all(bare, '\S+')) as n_words, lower(trim(bare)) as low from sec where not is_heading),
role as (
  select doc_id, section_no, n, dated = 1 or (regexp_matches(bare, '(?i)\b(engineer|developer|scientist|analyst|manager|consultant|architect|lead|intern|associate|officer|specialist|administrator|programmer)\b') and n_words <= 12) as starts, dated = 1 as has, is_bullet from l where section = 'work_experience'),
fold as (
  select doc_id, section_no, n, 1 as no, 1 as size, has as dates, is_bullet and not starts as bullets from role where n = 1
  union all
  select r.doc_id, r.section_no, r.n, f.no + case when cut then 1 else 0 end, case when cut then 1 else f.size + 1 end, r.has or (f.dates and not cut), (r.is_bullet and not r.starts) or (f.bullets and not cut)
  from (select f.*, r.starts and not (not f.bullets and f.size <= 3 and (r.has or f.dates)) as cut from fold f join role r on r.doc_id = f.doc_id and r.section_no = f.section_no and r.n = f.n + 1) f
  join role r on r.doc_id = f.doc_id and r.section_no = f.section_no and r.n = f.n + 1),
starts as (
  select *, low <> '' and (starts_with(low, 'title:') or starts_with(low, 'project:') or starts_with(low, 'project title:') or starts_with(low, 'name:') or (not is_bullet and n_words <= 14 and regexp_matches(low, 'chatbot|rag|engine|system|platform|app|application'))) as titled
  from l where section in ('projects', 'education')),
nos as (
  select *, 1 + sum(case when titled and n > 1 then 1 else 0 end) over w as project_no, 1 + sum(case when (is_bullet or dated = 1) and n > 1 then 1 else 0 end) over w as simple_no from starts window w as (partition by doc_id, section_no order by n)),
best as (select *, section = 'projects' and max(project_no) over (partition by doc_id, section_no) > 1 as by_title from nos),
num as (
  select l.doc_id, l.section_no, l.section, l.n, l.line_id, l.line, l.bare, 'role' as kind, fold.no as block_no, 30 as most, 1000000000 as shown, true as by_role from l join fold using (doc_id, section_no, n)
  union all
  select doc_id, section_no, section, n, line_id, line, bare, case section when 'projects' then 'project' else 'education' end, cast(case when by_title then project_no else simple_no end as int), case when by_title then 35 else 25 end, case when by_title then 35 else 25 end, false from best),
nth as (select *, row_number() over (partition by doc_id, section_no, block_no order by n) as k from num where block_no <= 20),
block as (
  select doc_id, section_no, kind, cast(block_no as bigint) as block_no, cast(count(*) filter (k <= shown) as int) as n_lines, arg_min(line_id, k) as first_line, string_agg(case when by_role then bare else line end, chr(10) order by k) filter (k <= most) as evidence
  from nth group by 1, 2, 3, 4)"""


def _rows(t):
    rows = d.lines(t.documents, "doc_id", "text")
    n, line = F.col("line_no"), F.col("line")
    heading = n % 9 == 4
    core = (
        F.when(heading, F.concat(F.lit("HEADING "), n)).when(n % 7 == 0, F.concat(F.left(line, F.lit(10)), F.lit(" 2019 - 2021"))).when(n % 5 == 0, "Data engineer").when(n % 11 == 0, F.concat(F.lit("Title: "), F.left(line, F.lit(12))))
        .when(n % 13 == 0, "Master of Arts").when(n % 6 == 0, "Cat: a, b").otherwise(F.left(line, F.lit(40)))
    )
    bullet = (n % 3 == 0) & ~heading
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), ((F.floor(n / 9) % 5) + 1).cast("int"))
    rows = rows.select("doc_id", "line_no", "line_id", F.when(bullet, F.concat(F.lit("- "), core)).otherwise(core).alias("line"), bullet.alias("is_bullet"), heading.alias("is_heading"), kind.alias("kind"))
    cut = d.sections(rows, "doc_id", "line_no", F.col("is_heading"), F.struct("kind", F.col("line").alias("heading")))
    return cut.withColumn("heading", F.coalesce("section.heading", F.lit("HEADER"))).withColumn("section", F.coalesce("section.kind", F.lit("header"))).drop("kind")


@query("res_canonical", f"with recursive {_SQL} select doc_id, section_id, kind, block_no, section_id || '_' || kind || '_' || lpad(cast(block_no as varchar), 3, '0') as block_id, n_lines, first_line, md5(evidence) as evidence from block join ids using (doc_id, section_no)")
def res_canonical(t):
    each = ca.canonical_resume(_rows(t), "doc_id").select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.section_id", F.explode("s.blocks").alias("b"))
    return each.select("doc_id", "section_id", "b.kind", F.col("b.block_no").alias("block_no"), "b.block_id", F.size("b.lines").alias("n_lines"), F.element_at("b.lines", 1).line_id.alias("first_line"), F.md5("b.evidence_text").alias("evidence"))


@query("res_canonical_sections", f"""with recursive {_SQL}, g as (select doc_id, section_no, count(*) filter (contains(bare, ':')) + max(case when contains(bare, ':') then 0 else 1 end) as n from l where section = 'skills' group by 1, 2)
select sec.doc_id, section_id, ids.section as canonical_type, count(*) filter (not is_heading) as line_count, cast(least(80, count(*) filter (not is_heading)) as int) as shown, cast(coalesce(max(g.n), 0) as int) as skill_groups
from sec join ids on ids.doc_id = sec.doc_id and ids.section_no = sec.section_no left join g on g.doc_id = sec.doc_id and g.section_no = sec.section_no group by 1, 2, 3""")
def res_canonical_sections(t):
    each = ca.canonical_resume(_rows(t), "doc_id").select("doc_id", F.explode("sections").alias("s"))
    return each.select("doc_id", "s.section_id", "s.canonical_type", "s.line_count", F.size("s.lines").alias("shown"), F.size("s.skill_groups").alias("skill_groups"))


@query("res_fallbacks", rf"""with recursive {_SQL},
p as (select doc_id, section_no, block_no, string_split(trim(evidence), chr(10)) as x from block where kind = 'project'),
e as (select doc_id, section_no, block_no, list_transform(list_filter(string_split(trim(evidence), chr(10)), lambda y: trim(y) <> ''), lambda y: trim(y, ' •❖-' || chr(9))) as x from block where kind = 'education')
select doc_id, section_no, block_no, 'project' as kind, left(trim(regexp_replace(trim(x[1]), '(?i)^(title|project|project title|name)\s*:\s*', '')), 180) as one, nullif(left(array_to_string(list_filter(list_transform(x[2:4], lambda y: trim(y)), lambda y: y <> ''), ' '), 250), '') as other
from p where trim(regexp_replace(trim(x[1]), '(?i)^(title|project|project title|name)\s*:\s*', '')) <> ''
union all
select doc_id, section_no, block_no, 'education', list_filter(x, lambda y: not regexp_matches(y, '(?i)\b(B\.?Tech|M\.?Tech|Bachelor|Master|MBA|B\.S\.|M\.S\.|Ph\.?D|degree)\b'))[1], list_filter(x, lambda y: regexp_matches(y, '(?i)\b(B\.?Tech|M\.?Tech|Bachelor|Master|MBA|B\.S\.|M\.S\.|Ph\.?D|degree)\b'))[1] from e where len(x) > 0""")
def res_fallbacks(t):
    blocks = ca.resume_blocks(_rows(t).where("not is_heading"), "doc_id")
    project, school = ca.fallback_project(F.col("evidence_text")), ca.fallback_education(F.col("evidence_text"))
    one = blocks.where("kind = 'project'").select("doc_id", "section_no", "block_no", "kind", project.alias("p")).where("p is not null").select("doc_id", "section_no", "block_no", "kind", F.col("p.name").alias("one"), F.col("p.description").alias("other"))
    two = blocks.where("kind = 'education'").select("doc_id", "section_no", "block_no", "kind", school.alias("p")).where("p is not null")
    return one.unionByName(two.select("doc_id", "section_no", "block_no", "kind", F.col("p.institution").alias("one"), F.col("p.degree").alias("other")))


@query("res_span_blocks", f"""with {NORMAL_SQL}, {LINES_SQL}, s as (select distinct doc_id, span_type, start_line, end_line from normal), t as (select *, row_number() over (partition by doc_id order by span_type, start_line, end_line) as span_no from s)
select t.doc_id, span_no, 'llm_span_' || span_type || '_' || span_no as block_id, cast(count(*) as int) as n, 'L' || lpad(cast(min(line_no) as varchar), 4, '0') as start_line_id, 'L' || lpad(cast(max(line_no) as varchar), 4, '0') as end_line_id, md5(string_agg(line, chr(10) order by line_no)) as evidence
from t join lines on lines.doc_id = t.doc_id and line_no between start_line and least(end_line, start_line + 89) group by 1, 2, 3""")
def res_span_blocks(t):
    from pyspark.sql import Window

    spans = d.normal_spans(*_spans(t), "doc_id", 3).select("doc_id", "span_type", "start_line", "end_line").distinct()
    spans = spans.withColumn("span_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("span_type", "start_line", "end_line"))).withColumn("confidence", F.lit(1.0))
    got = ca.span_blocks(spans, d.lines(t.documents, "doc_id", "text"), "doc_id")
    return got.select("doc_id", F.col("span_no").cast("long").alias("span_no"), "block_id", F.size("lines").alias("n"), "start_line_id", "end_line_id", F.md5("evidence_text").alias("evidence"))


@query("res_retry_merge", """with one as (select o_custkey as k, o_orderkey as o, row_number() over (partition by o_custkey order by o_orderkey) as n, 'T' || o_orderkey % 4 as title, case when o_orderkey % 3 <> 0 then 'C' || o_orderkey % 5 end as company, case when o_orderkey % 7 = 0 then '2020' end as start_date, o_orderkey % 2 as side from orders),
core as (select k, bool_or(side = 0 and company is not null and start_date is not null) as core from one group by 1),
x as (select one.*, lower(title || '|' || coalesce(company, '') || '|' || coalesce(start_date, '')) as id from one join core using (k) where side = 0 or not core),
y as (select *, min(side) over (partition by k, id) as least, row_number() over (partition by k, id, side order by n) as nth from x),
z as (select * from y where side = 0 or (least = 1 and nth = 1)),
items as (select k, string_agg(title || '/' || coalesce(company, '') || '/' || coalesce(start_date, ''), ';' order by side, n) as experience from z group by 1),
people as (select c_custkey as k, case when c_custkey % 4 = 1 then lower(c_mktsegment) when c_custkey % 4 = 2 then c_mktsegment when c_custkey % 4 = 0 then c_mktsegment else lower(c_mktsegment) end as headline, case when c_custkey % 5 = 0 then 'old' else 'new' end as phone, c_mktsegment as skills from customer)
select people.k, headline, phone, skills, coalesce(experience, '') as experience from people left join items using (k)""")
def res_retry_merge(t):
    o = t.orders
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    item = F.struct(F.concat(F.lit("T"), F.col("o_orderkey") % 4).alias("title"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("C"), F.col("o_orderkey") % 5)).alias("company"), F.when(F.col("o_orderkey") % 7 == 0, "2020").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.lit(False).alias("is_current"))
    listed = lambda side: o.withColumn("n", n).where(F.col("o_orderkey") % 2 == side).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("i")))), lambda x: x.i).alias("experience"))
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    none = F.lit(None).cast("string")
    people = t.customer.join(listed(1).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    first = people.select(k.alias("k"), F.when(k % 4 == 3, F.lower(seg)).otherwise(seg).alias("headline"), F.struct(F.lit("old").alias("phone")).alias("contact"), F.array(seg).alias("skills"), "experience")
    people = t.customer.join(listed(0).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    again = people.select(k.alias("k"), F.when(k % 4 == 1, F.lower(seg)).when(k % 4 == 2, " ").otherwise(none).alias("headline"), F.struct(F.when(k % 5 != 0, "new").otherwise(" ").alias("phone")).alias("contact"), F.array(F.lower(seg)).alias("skills"), "experience")
    got = ca.retry_merged(first, again, "k", scalars=("headline",), structs=("contact",), lists=("skills",), items=("experience",))
    shown = F.array_join(F.transform("experience", lambda x: F.concat_ws("/", x.title, F.coalesce(x.company, F.lit("")), F.coalesce(x.start_date, F.lit("")))), ";")
    return got.select("k", "headline", F.col("contact.phone").alias("phone"), F.array_join("skills", ",").alias("skills"), shown.alias("experience"))
