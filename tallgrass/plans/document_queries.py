"""Lines, sections, windows, blocks, spans, skills and dates over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, skills, text
from ..operators import documents as d
from ..operators.canonical import lines_of_spans
from .registry import query, stamp

LINES_SQL = r"""raw as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|\n|\r')) as line, unnest(range(0, len(string_split_regex(coalesce(text, ''), '\r\n|\n|\r')))) as raw_index from documents),
lines as (select doc_id, row_number() over (partition by doc_id order by raw_index) as line_no, raw_index, trim(line) as line from raw where trim(line) <> '')"""


@query("doc_lines", rf"with {LINES_SQL} select doc_id, line_no, concat('L', lpad(cast(line_no as varchar), 4, '0')) as line_id, raw_index, md5(line) as md5, regexp_matches(line, '^\s*(?:[-*•▪▫●◦‣❖]+|\d+[.)])\s*') as is_bullet from lines")
def doc_lines(t):
    return d.lines(t.documents, "doc_id", "text").select("doc_id", "line_no", "line_id", "raw_index", F.md5("line").alias("md5"), "is_bullet")


@query("doc_bullets", rf"with {LINES_SQL} select doc_id, line_no, trim(regexp_replace(concat('- ', line), '^\s*(?:[-*•▪▫●◦‣❖]+|\d+[.)])\s*', '')) as bare from lines")
def doc_bullets(t):
    rows = d.lines(t.documents, "doc_id", "text")
    return rows.select("doc_id", "line_no", text.without_bullet(F.concat(F.lit("- "), "line")).alias("bare"))


TURNS_SQL = "turns as (select conv_id, turn, role, text, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as section_no from conversations)"


@query("doc_sections", f"with {TURNS_SQL}, s as (select *, last_value(case when role = 'user' then concat(role, ' ', turn) end ignore nulls) over (partition by conv_id order by turn) as section from turns) select conv_id, section_no, section, left(string_agg(text, chr(10) order by turn), 300) as body from s group by 1, 2, 3")
def doc_sections(t):
    rows = d.sections(t.conversations, "conv_id", "turn", F.col("role") == "user", F.concat_ws(" ", "role", "turn"))
    return d.section_texts(rows, "conv_id", "turn", "text", 300)


@query("doc_windows", rf"with {LINES_SQL}, n as (select doc_id, max(line_no) as n from lines group by 1), w as (select doc_id, n, unnest(range(0, cast(greatest(0, ceil((n - 20) / 15.0)) as bigint) + 1)) as window_no from n) select doc_id, window_no, window_no * 15 + 1 as first, least(n, window_no * 15 + 20) as last from w")
def doc_windows(t):
    n = d.lines(t.documents, "doc_id", "text").groupBy("doc_id").agg(F.max("line_no").alias("n"))
    return d.windows(n, "doc_id", "n", size=10, overlap=5)


@query("doc_blocks", "with b as (select *, sum(case when role = 'user' or turn = 0 then 1 else 0 end) over (partition by conv_id order by turn) as block_no from conversations) select conv_id, cast(block_no as bigint) as block_no, count(*) as rows, min(turn) as first_turn, max(turn) as last_turn from b group by 1, 2")
def doc_blocks(t):
    rows = d.blocks(t.conversations, "conv_id", "turn", F.col("role") == "user")
    return rows.groupBy("conv_id", "block_no").agg(F.count(F.lit(1)).alias("rows"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("doc_headed_blocks", "with k as (select conv_id, turn, turn % 5 in (0, 1, 3) as header from conversations), s as (select *, case when turn = 0 or (header and not coalesce(lag(header) over (partition by conv_id order by turn), false)) then 1 else 0 end as opens from k) select conv_id, turn, cast(sum(opens) over (partition by conv_id order by turn) as bigint) as block_no from s")
def doc_headed_blocks(t):
    rows = t.conversations.select("conv_id", "turn", F.when((F.col("turn") % 5).isin(0, 1, 3), "header").otherwise("body").alias("kind"))
    return d.headed_blocks(rows, "conv_id", "turn", "kind").select("conv_id", "turn", F.col("block_no").cast("long").alias("block_no"))


SPANS_SQL = """n as (select doc_id, len(string_split(text, ' ')) as n from documents),
spans as (select user_id as doc_id, case event_id % 3 when 0 then 'experience' when 1 then 'project' else 'education' end as span_type, event_id % 37 as start_line, (event_id * 7) % 41 as end_line, round(value, 0) as confidence from events)"""


def _spans(t):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "experience").when(e % 3 == 1, "project").otherwise("education")
    spans = t.events.select(F.col("user_id").alias("doc_id"), kind.alias("span_type"), (e % 37).alias("start_line"), (e * 7 % 41).alias("end_line"), F.round("value", 0).alias("confidence"))
    return spans, t.documents.select("doc_id", F.size(F.split("text", " ")).alias("n"))


NORMAL_SQL = f"{SPANS_SQL}, normal as (select spans.doc_id, span_type, least(start_line, end_line) as start_line, greatest(start_line, end_line) as end_line, confidence from spans join n using (doc_id) where start_line between 1 and n and end_line between 1 and n and confidence >= 3)"


@query("span_normalise", f"with {NORMAL_SQL} select * from normal")
def span_normalise(t):
    return d.normal_spans(*_spans(t), "doc_id", 3)


@query("span_dedupe", f"""with recursive {NORMAL_SQL},
o as (select *, row_number() over (partition by doc_id, span_type order by confidence desc, end_line - start_line desc, start_line, end_line) as i from normal),
k as (
  select doc_id, span_type, start_line, end_line, confidence, i, true as kept, [{{'a': start_line, 'b': end_line}}] as held from o where i = 1
  union all
  select doc_id, span_type, start_line, end_line, confidence, i, free, case when free then list_append(held, {{'a': start_line, 'b': end_line}}) else held end from (
    select o.*, held, len(list_filter(held, lambda h: least(o.end_line, h.b) - greatest(o.start_line, h.a) + 1 >= 0.8::double * least(o.end_line - o.start_line + 1, h.b - h.a + 1))) = 0 as free
    from k join o on o.doc_id = k.doc_id and o.span_type = k.span_type and o.i = k.i + 1))
select doc_id, span_type, start_line, end_line, confidence from k where kept""")
def span_dedupe(t):
    return d.distinct_spans(d.normal_spans(*_spans(t), "doc_id", 3), "doc_id")


@query("span_cap", f"with {NORMAL_SQL}, s as (select distinct doc_id, span_type, start_line, end_line from normal), r as (select *, row_number() over (partition by doc_id, span_type order by start_line, end_line) as nth from s) select doc_id, span_type, start_line, end_line from r where nth <= case span_type when 'experience' then 2 when 'project' then 3 else 1 end")
def span_cap(t):
    rows = d.normal_spans(*_spans(t), "doc_id", 3).select("doc_id", "span_type", "start_line", "end_line").distinct()
    return d.capped_spans(rows, "doc_id", {"experience": 2, "project": 3}, 1)


@query("span_counts", f"with {NORMAL_SQL} select span_type, count(*) as n from normal group by 1")
def span_counts(t):
    return d.normal_spans(*_spans(t), "doc_id", 3).groupBy("span_type").agg(F.count(F.lit(1)).alias("n"))


@query("span_lines", rf"with {NORMAL_SQL}, {LINES_SQL} select span_type, count(*) as n, cast(sum(length(line)) as bigint) as chars from normal join lines on normal.doc_id = lines.doc_id and line_no between start_line and end_line group by 1")
def span_lines(t):
    rows = d.lines(t.documents, "doc_id", "text")
    joined = lines_of_spans(d.normal_spans(*_spans(t), "doc_id", 3), rows, "doc_id")
    return joined.groupBy("span_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


#: Words of the driver's documents that stand in for a vocabulary of skills.
VOCABULARY = ("that", "with", "this", "from", "tion", "pour", "sich", "dans", "eau la", "para")


@query("skills_extract", """select doc_id, array_to_string(list_filter(list_value('eau la', 'dans', 'from', 'para', 'pour', 'sich', 'that', 'this', 'tion', 'with'), lambda v: contains(regexp_replace(concat(' ', regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9+#./-]+', ' ', 'g'), ' '), '[/ ]', '  ', 'g'), concat(' ', replace(v, ' ', '  '), ' '))), ',') as terms from documents""")
def skills_extract(t):
    return t.documents.select("doc_id", F.array_join(skills.terms_in(F.coalesce("text", F.lit("")), VOCABULARY), ",").alias("terms"))


RAW_SKILLS = "case p_partkey % 8 when 0 then ' py  spark ' when 1 then 'CI/CD' when 2 then 'Deployment Platform' when 3 then 'SQL.' when 4 then p_name when 5 then '' when 6 then 'Cloud tools' else 'scikit-learn' end"


@query("skills_canonical", f"""select p_partkey, case p_partkey % 8 when 0 then 'PySpark' when 3 then 'SQL' when 4 then trim(p_name) when 7 then 'scikit-learn' end as skill from part""")
def skills_canonical(t):
    return t.part.select("p_partkey", skills.canonical_skill(F.expr(RAW_SKILLS)).alias("skill"))


@query("skills_unique", """with r as (select p_size, p_partkey, case p_partkey % 4 when 0 then 'PySpark' when 1 then 'Spark' when 2 then 'Kafka' else p_brand end as s from part), f as (select p_size, s, min(p_partkey) as k from r group by p_size, s) select p_size, string_agg(s, ',' order by k) as skills from f group by 1""")
def skills_unique(t):
    raw = F.expr("case p_partkey % 4 when 0 then 'pyspark' when 1 then 'Apache  Spark' when 2 then 'kafka.' else p_brand end")
    lists = t.part.groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", raw.alias("s")))), lambda x: x.s).alias("all"))
    return lists.select("p_size", F.array_join(skills.unique_skills(F.col("all")), ",").alias("skills"))


@query("list_clean", "select o_orderkey, array_to_string(list_filter(list_transform(string_split_regex(concat(o_orderpriority, ', ;', o_orderstatus, '| ', o_orderstatus), '[,;|]\\s*'), lambda x: trim(x)), lambda x: x <> '')[1:3], '/') as items from orders".replace("\\\\s", "\\s"))
def list_clean(t):
    raw = F.concat("o_orderpriority", F.lit(", ;"), "o_orderstatus", F.lit("| "), "o_orderstatus")
    return t.orders.select("o_orderkey", F.array_join(F.slice(text.split_list(raw), 1, 3), "/").alias("items"))


@query("domains_infer", """select doc_id, array_to_string(list_filter(list_value(case when regexp_matches(lower(text), 'rag|langchain|llm|genai|openai|prompt engineering|bedrock') then 'Generative AI/RAG' end,
  case when regexp_matches(lower(text), 'data scientist|data science|machine learning|pytorch|tensorflow|scikit|opencv|pyspark|mlflow|model') then 'Data Science' end,
  case when regexp_matches(lower(text), 'mlflow|dvc|bentoml|zenml|docker|kubernetes|github actions|jenkins|terraform|torch-serve') then 'MLOps' end,
  case when regexp_matches(lower(text), 'aws|azure|aws bedrock|hugging face|cloud') then 'Cloud AI' end,
  case when regexp_matches(lower(text), 'bank|sbi|fraud|financial') then 'Banking/Financial Services' end,
  case when regexp_matches(lower(text), 'react|next\\.js|node|express|fastapi|mongodb|frontend|backend') then 'Full Stack Web Development' end,
  case when regexp_matches(lower(text), 'react|next\\.js|javascript|typescript|tailwind|frontend') then 'Frontend Engineering' end,
  case when regexp_matches(lower(text), 'fastapi|node|express|api|mongodb|mysql|backend') then 'Backend Engineering' end), lambda x: x is not null), ';') as domains from documents""".replace("\\\\", "\\"))
def domains_infer(t):
    return t.documents.select("doc_id", F.array_join(skills.domains(F.col("text")), ";").alias("domains"))


_K = "cast(json_extract_string(props, '$.k') as bigint)"


@query("date_parse", f"""select event_id, strftime(case event_id % 8 when 0 then ts - to_minutes({_K}) when 1 then ts - to_hours({_K}) when 2 then date_trunc('day', ts - to_days(cast({_K} as int))) when 3 then date_trunc('day', ts - to_days(cast({_K} * 7 as int)))
  when 4 then date_trunc('day', ts) when 5 then date_trunc('day', ts - interval 1 day) when 6 then date_trunc('day', ts) end, '%Y-%m-%d %H:%M:%S') as posted_at from events""")
def date_parse(t):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id") % 8
    raw = F.when(e == 0, F.concat(k, F.lit(" minutes ago"))).when(e == 1, F.concat(F.lit("Posted "), k, F.lit(" Hours ago"))).when(e == 2, F.concat(k, F.lit(" day old"))).when(e == 3, F.concat(k, F.lit("weeks"))).when(e == 4, " Posted  Today ").when(e == 5, "yesterday").when(e == 6, F.date_format("ts", "d MMM yyyy")).otherwise("soon")
    return t.events.select("event_id", stamp(dates.posted_at(raw, F.col("ts"))).alias("posted_at"))


@query("date_range", "select o_orderkey, concat('Jan ', year(o_orderdate)) as start_date, case when o_orderkey % 2 = 0 then 'Present' else concat('October ', year(o_orderdate) + 1) end as end_date, o_orderkey % 2 = 0 as is_current from orders")
def date_range(t):
    y = F.year("o_orderdate")
    raw = F.concat(F.lit("Role at X (Jan "), y, F.when(F.col("o_orderkey") % 2 == 0, " – present").otherwise(F.concat(F.lit(" to October "), y + 1)), F.lit(")"))
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in dates.date_range(raw).items()])


@query("schedule_minutes", "select s_suppkey, cast(greatest(15, least(10080, case s_suppkey % 6 when 0 then 60 when 1 then 6 * 60 when 2 then 2 * 1440 when 3 then s_suppkey when 4 then 5 else 1440 end)) as int) as minutes from supplier")
def schedule_minutes(t):
    k = F.col("s_suppkey")
    raw = F.when(k % 6 == 0, "hourly").when(k % 6 == 1, "every_6h").when(k % 6 == 2, "every 2 days").when(k % 6 == 4, "Every 5 min").when(k % 6 == 5, "odd")
    return t.supplier.select("s_suppkey", dates.schedule_minutes(raw, F.when(k % 6 == 3, k.cast("int"))).alias("minutes"))


@query("run_times", "select event_id, strftime(ts + interval 90 minute, '%Y-%m-%d %H:%M:%S') as next_run_at, strftime(ts, '%Y%m%dT%H%M%SZ') as run_id, epoch_us(ts) - epoch_us(date_trunc('day', ts)) as since_midnight_us from events")
def run_times(t):
    ts = F.col("ts")
    seconds = dates.seconds_between(F.date_trunc("day", ts), ts)
    return t.events.select("event_id", stamp(dates.next_run(ts, F.lit(90))).alias("next_run_at"), dates.run_stamp(ts).alias("run_id"), F.round(seconds * 1_000_000).cast("long").alias("since_midnight_us"))
