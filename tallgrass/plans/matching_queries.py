"""Vector search, scores, rankings and training pairs over embeddings, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import json_block
from ..operators import feedback
from ..operators import matching as m
from .registry import query

VECTORS_SQL = """v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), q as (select * from v where vec_id % 100 = 0),
s as (select q.vec_id as query_id, v.vec_id as row_id, list_reduce(list_prepend(cast(0 as double), list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), lambda a, b: a + b)
  / (sqrt(list_reduce(list_prepend(cast(0 as double), list_transform(q.e, lambda p: p * p)), lambda a, b: a + b)) * sqrt(list_reduce(list_prepend(cast(0 as double), list_transform(v.e, lambda p: p * p)), lambda a, b: a + b))) as score from q, v),
hits as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from s qualify rank <= 10)"""


def _hits(t, k=10):
    v = t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    q = v.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "vector")
    return m.top_k(q, v, k)


@query("vec_topk", f"with {VECTORS_SQL} select query_id, row_id, rank, cast(round(score * 1e6) as bigint) as score_e6 from hits")
def vec_topk(t):
    return _hits(t).select("query_id", "row_id", F.col("rank").cast("long").alias("rank"), F.round(F.col("score") * 1e6).cast("long").alias("score_e6"))


@query("vec_valid", "select vec_id, case when vec_id % 50 = 0 then 'empty' when vec_id % 51 = 0 then 'size' end as fault from embeddings")
def vec_valid(t):
    e = F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 0)).when(F.col("vec_id") % 51 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return m.valid_vectors(t.embeddings.select("vec_id", e.alias("e")), "e", 64).select("vec_id", "fault")


MATCH_SQL = f"""{VECTORS_SQL}, a as (select vec_id, list_value(concat('s', label % 3), concat('t', vec_id % 4), 'u') as skills, case vec_id % 4 when 0 then 'Austin, TX' when 1 then 'Remote - Austin' when 2 then 'New York' end as location from v),
mt as (select query_id as candidate_id, row_id as job_id, rank, score as vector_score, len(list_filter(j.skills, lambda x: list_contains(c.skills, x))) / 3.0::double as skill_score,
  case when c.location is null or j.location is null then 0.0::double when contains(lower(c.location), lower(j.location)) or contains(lower(j.location), lower(c.location)) then 1.0
   else len(list_intersect(list_distinct(regexp_extract_all(lower(c.location), '[a-z]{{3,}}')), list_distinct(regexp_extract_all(lower(j.location), '[a-z]{{3,}}')))) / least(len(list_distinct(regexp_extract_all(lower(c.location), '[a-z]{{3,}}'))), len(list_distinct(regexp_extract_all(lower(j.location), '[a-z]{{3,}}'))))::double end as location_score
  from hits join a c on c.vec_id = query_id join a j on j.vec_id = row_id where row_id % 7 <> 0)"""


def _matches(t):
    v = F.col("vec_id")
    place = F.when(v % 4 == 0, "Austin, TX").when(v % 4 == 1, "Remote - Austin").when(v % 4 == 2, "New York")
    people = t.embeddings.select(v, F.array(F.concat(F.lit("s"), F.col("label") % 3), F.concat(F.lit("t"), v % 4), F.lit("u")).alias("skills"), place.alias("location"))
    hits = _hits(t).select(F.col("query_id").alias("candidate_id"), F.col("row_id").alias("job_id"), "score", "rank")
    return m.baseline(hits, people.where(v % 7 != 0).withColumnRenamed("vec_id", "job_id"), people.withColumnRenamed("vec_id", "candidate_id"))


_E6 = "cast(round((0.82 * vector_score + 0.13 * least(1.0, skill_score) + 0.05 * location_score) * 1e6) as bigint)"


@query("match_baseline", f"with {MATCH_SQL} select candidate_id, job_id, rank, cast(round(skill_score * 1e6) as bigint) as skill_e6, cast(round(location_score * 1e6) as bigint) as place_e6, {_E6} as score_e6 from mt")
def match_baseline(t):
    e6 = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return _matches(t).select("candidate_id", "job_id", F.col("rank").cast("long").alias("rank"), e6("skill_score").alias("skill_e6"), e6("location_score").alias("place_e6"), e6("score").alias("score_e6"))


@query("match_summary", f"with {MATCH_SQL} select count(*) as matches, count(distinct candidate_id) as candidates, cast(round(max({_E6}) / 100.0) as bigint) as best_e4 from mt")
def match_summary(t):
    s = m.summary(_matches(t))
    return s.select("matches", "candidates", F.round(F.round(F.col("best_score") * 1e6) / 100).cast("long").alias("best_e4"))


@query("grouped_matches", f"with {MATCH_SQL} select candidate_id, string_agg(cast(job_id as varchar), ',' order by rank) as jobs from mt group by 1")
def grouped_matches(t):
    return m.grouped(_matches(t)).select("candidate_id", F.array_join(F.col("jobs").cast("array<string>"), ",").alias("jobs"))


RERANK_SQL = f"{MATCH_SQL}, r as (select candidate_id, job_id, rank as baseline_rank, (job_id * 37) % 101 as final_score from mt where (candidate_id + job_id) % 5 <> 0), f as (select *, row_number() over (partition by candidate_id order by final_score desc, baseline_rank, job_id) as final_rank from r qualify final_rank <= 5)"


def _reranked(found):
    base = found.select("candidate_id", "job_id", F.col("rank").alias("baseline_rank"))
    results = base.where((F.col("candidate_id") + F.col("job_id")) % 5 != 0).select("candidate_id", "job_id", (F.col("job_id") * 37 % 101).alias("final_score"))
    return m.rerank(base, results, 5)


@query("rank_final", f"with {RERANK_SQL} select candidate_id, job_id, baseline_rank, final_score, final_rank, baseline_rank - final_rank as delta from f")
def rank_final(t):
    ranked, _ = _reranked(_matches(t))
    long = lambda c: F.col(c).cast("long").alias(c)
    return ranked.select("candidate_id", "job_id", long("baseline_rank"), "final_score", long("final_rank"), (F.col("baseline_rank") - F.col("final_rank")).cast("long").alias("delta"))


@query("rank_unscored", f"with {MATCH_SQL} select candidate_id, job_id from mt where (candidate_id + job_id) % 5 = 0")
def rank_unscored(t):
    return _reranked(_matches(t))[1].select("candidate_id", "job_id")


COMPARE_SQL = f"""{RERANK_SQL}, b as (select candidate_id, job_id, row_number() over (partition by candidate_id order by rank) as r1 from mt qualify r1 <= 5),
x as (select coalesce(b.candidate_id, f.candidate_id) as candidate_id, r1, final_rank as r2 from b full join f on b.candidate_id = f.candidate_id and b.job_id = f.job_id),
cmp as (select candidate_id, count(*) filter (where r1 is not null and r2 is not null) as overlap, count(*) filter (where r1 is null) as new, count(*) filter (where r2 is null) as dropped, count(*) filter (where r1 > r2) as moved_up, count(*) filter (where r1 < r2) as moved_down, count(*) filter (where r1 = r2) as same, count(*) filter (where r1 is not null and r2 is not null) * 100 / 10.0::double as overlap_percent from x group by 1)"""


def _compared(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("candidate_id").orderBy("rank"))
    found = _matches(t)
    base = found.withColumn("n", n).where("n <= 5").select("candidate_id", "job_id", F.col("n").alias("rank"))
    return m.compare(base, _reranked(found)[0].select("candidate_id", "job_id", F.col("final_rank").alias("rank")))


@query("rank_compare", f"with {COMPARE_SQL} select * from cmp")
def rank_compare(t):
    return _compared(t)


@query("compare_summary", f"with {COMPARE_SQL} select count(*) as candidates, cast(sum(overlap) as bigint) as overlap, cast(sum(new) as bigint) as new, cast(sum(dropped) as bigint) as dropped, cast(round(avg(overlap_percent) * 1000) as bigint) as mean_percent_e3 from cmp")
def compare_summary(t):
    s = m.compare_summary(_compared(t))
    return s.select("candidates", "overlap", "new", "dropped", F.round(F.col("mean_percent") * 1000).cast("long").alias("mean_percent_e3"))


@query("score_fallback", "select vec_id, cast(round((60 + 35 * greatest(0.0, least(1.0, (vec_id / 500.0::double - 0.45) / 0.27))) * 1e4) as bigint) as score_e4 from embeddings")
def score_fallback(t):
    return t.embeddings.select("vec_id", F.round(scoring.fallback(F.col("vec_id") / 500.0) * 1e4).cast("long").alias("score_e4"))


@query("score_clamp", "select event_id, case when event_id % 4 = 0 then 0 else cast(greatest(0, least(100, trunc(value * 3 - 20))) as int) end as score from events")
def score_clamp(t):
    raw = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise((F.col("value") * 3 - 20).cast("string"))
    return t.events.select("event_id", scoring.whole_score(raw).alias("score"))


FEEDBACK_SQL = "l as (select user_id, event_id % 40 as job_id, arg_max(event_type, event_id) as label, max(event_id) as last from events group by 1, 2)"


def _feedback(t):
    return t.events.select(F.col("user_id").alias("candidate_id"), (F.col("event_id") % 40).alias("job_id"), F.col("event_type").alias("label"), F.col("event_id").alias("created_at"))


@query("fb_latest", f"with {FEEDBACK_SQL} select user_id as candidate_id, job_id, label, last as created_at from l")
def fb_latest(t):
    return feedback.latest_labels(_feedback(t))


LABELS = {"purchase": 1, "signup": 1, "click": 1, "error": 0}


@query("fb_to_binary", f"with {FEEDBACK_SQL} select case when label = 'error' then 0 else 1 end as target, count(*) as n from l where label <> 'view' group by 1")
def fb_to_binary(t):
    return feedback.binary(feedback.latest_labels(_feedback(t)), LABELS).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("training_pairs", f"with {FEEDBACK_SQL} select concat('pair_', left(sha256(concat(l.user_id, '|', l.job_id)), 24)) as training_pair_id, c_name as candidate_text, p_name as job_text, case when label = 'error' then 0 else 1 end as target from l join customer on c_custkey = user_id join part on p_partkey = job_id where label <> 'view'")
def training_pairs(t):
    people = t.customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("candidate_text"))
    jobs = t.part.select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("job_text"))
    return feedback.training_pairs(feedback.latest_labels(_feedback(t)), people, jobs, LABELS).select("training_pair_id", "candidate_text", "job_text", "target")


@query("json_llm_parse", "select user_id, cast(json_extract_string(props, '$.k') as bigint) as job_id, min(event_id) as first_event from events where cast(json_extract_string(props, '$.k') as bigint) < 50 group by 1, 2")
def json_llm_parse(t):
    """Answers are lists of objects; only expected ids count, the first of each."""
    answer = F.concat(F.lit('```json\n[{"job_id": '), F.get_json_object("props", "$.k"), F.lit(', "score": 7}, {"job_id": null}, {"odd": 1}]\n```'))
    rows = t.events.select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("at"), json_block(answer).alias("answer"))
    expected = t.spark.range(50).select(F.col("id").alias("job_id"))
    got = feedback.parsed_results(rows, expected)
    return got.select(F.col("candidate_id").alias("user_id"), "job_id", F.col("at").alias("first_event"))
