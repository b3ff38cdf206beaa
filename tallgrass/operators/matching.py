"""Matching: exact cosine search, blended scores, ranks, comparison of rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..session import kept


#: Products that a task holds at a time: 4 MB of them, however large batches and the set of queries are.
CELLS = 1 << 19


def valid_vectors(df: DataFrame, column: str, size: int) -> DataFrame:
    """Adds ``fault``: null, or why a vector can't be indexed."""
    v = F.col(column)
    return df.withColumn("fault", F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.size(v) != size, "size").when(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))), "not a number"))


def top_k(queries: DataFrame, rows: DataFrame, k: int, *, most_queries: int = 20_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, row_id, score, rank): the exact k nearest by cosine, ties by row_id.

    ``queries`` is a stated set. Its vectors are measured and dealt by hash into groups of about ``most_queries`` or ``most_bytes``, whichever is less, each of which is sent to all
    tasks and meets all rows in turn; a query's group is known from its id, so what is sent is bounded whatever the set. A task scores a batch of rows against a group by one
    matrix product and keeps k a query of each batch, ties included, before the shuffle. Of several groups one is held at a time, its hits written before the next is sent. Vectors without a length have no score.
    """
    if most_queries < 1:
        raise ValueError(f"groups of {most_queries} queries can't meet any row")
    held = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    groups = max(1, -(-held["n"] // most_queries), -(-held["n"] * max(1, held["size"] or 1) * 8 // most_bytes))
    group = F.pmod(F.xxhash64("query_id", F.lit("group")), F.lit(groups))
    if groups == 1:
        return _top_k(queries, rows, k)[0]
    parts = []
    for g in range(groups):  # one after the other, each written before the next is sent
        found, sent = _top_k(queries.where(group == g), rows, k)
        parts.append(kept(found))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def _unit(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` numbers as rows of length 1; a row of NaN for those that are null, of another size or without a length."""
    whole = np.asarray(pc.equal(pc.list_value_length(vectors), size).fill_null(False))
    out = np.full((len(vectors), size), np.nan)
    if whole.any():
        out[whole] = vectors.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _top_k(queries: DataFrame, rows: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    ids = asked["query_id"].combine_chunks() if asked.num_rows else pa.array([], asked.schema.field("query_id").type)
    vectors = asked["vector"].combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.float64()))
    size = pc.max(pc.list_value_length(vectors)).as_py() or 0
    sent = queries.sparkSession.sparkContext.broadcast((ids, _unit(vectors, size) if asked.num_rows and size else None))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = sent.value
        if unit is None:
            return
        for b in batches:
            if not b.num_rows:
                continue
            own = _unit(b.column("vector"), size)
            step = max(1, CELLS // b.num_rows)
            for low in range(0, len(unit), step):
                scores = own @ unit[low : low + step].T
                scores[np.isnan(scores)] = -np.inf
                # of each query the k best of the batch and all that score within rounding of the last of them
                last = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
                row, of = np.nonzero((scores >= last - 1e-12) & (scores > -np.inf))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(low + of)), b.column("row_id").take(pa.array(row)), pa.array(scores[row, of])], ["query_id", "row_id", "score"])

    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["row_id"]
    scored = rows.select("row_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(nearest, f"query_id {kinds[0]}, row_id {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k), sent


def baseline(hits: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hits with their job's and candidate's attributes and the blended score; ranks are those of the search, so gaps stay where a job is gone.

    hits: candidate_id, job_id, score, rank; jobs: job_id, skills, location; candidates: candidate_id, skills, location.
    """
    j = jobs.select("job_id", F.col("skills").alias("job_skills"), F.col("location").alias("job_location"))
    c = candidates.select("candidate_id", F.col("skills").alias("own_skills"), F.col("location").alias("own_location"))
    rows = hits.join(j, "job_id").join(c, "candidate_id")
    share, place = scoring.overlap(F.col("job_skills"), F.col("own_skills")), scoring.place_score(F.col("own_location"), F.col("job_location"))
    return rows.select("candidate_id", "job_id", "rank", F.col("score").alias("vector_score"), share.alias("skill_score"), place.alias("location_score"), scoring.blended(F.col("score"), share, place).alias("score"), F.array_sort(F.array_intersect("job_skills", "own_skills")).alias("matched_skills"))


def summary(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("candidate_id").alias("candidates"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score"))


def final_rank(reranked: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best of each candidate by score, then baseline rank, then job."""
    rank = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("final_score"), "baseline_rank", "job_id"))
    return reranked.withColumn("final_rank", rank).where(F.col("final_rank") <= keep)


def rerank(baseline_rows: DataFrame, results: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(ranked, unscored): baseline rows with a scorer's result, and those it said nothing of."""
    scored = baseline_rows.join(results, ["candidate_id", "job_id"])
    return final_rank(scored, keep), baseline_rows.join(results, ["candidate_id", "job_id"], "left_anti")


def compare(base: DataFrame, other: DataFrame, shown: int = 10) -> DataFrame:
    """For each candidate of either ranking: overlap, new and dropped jobs, moves, and the overlap as a percentage of ``shown``."""
    a = base.select("candidate_id", "job_id", F.col("rank").alias("r1"))
    b = other.select("candidate_id", "job_id", F.col("rank").alias("r2"))
    both = a.join(b, ["candidate_id", "job_id"], "full")
    up = F.count_if(F.col("r1") > F.col("r2"))
    return both.groupBy("candidate_id").agg(
        F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("overlap"), F.count_if(F.col("r1").isNull()).alias("new"), F.count_if(F.col("r2").isNull()).alias("dropped"),
        up.alias("moved_up"), F.count_if(F.col("r1") < F.col("r2")).alias("moved_down"), F.count_if(F.col("r1") == F.col("r2")).alias("same"),
        (F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()) * 100 / shown).alias("overlap_percent"),
    )


def grouped(matches: DataFrame) -> DataFrame:
    """(candidate_id, jobs): the jobs of each candidate in the order of rank."""
    return matches.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_id"))), lambda x: x.job_id).alias("jobs"))


def length_stats(c: Column) -> list[Column]:
    n = F.length(c)
    return [F.count(c).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean")]


def top_titles(matches: DataFrame, titles: DataFrame, most: int = 10) -> DataFrame:
    """(title, n): the commonest titles of matched jobs, ties by title."""
    return matches.join(titles, "job_id").groupBy("title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(most)


def rerank_summary(final: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row about a re-ranking: candidates, those with a match, matches, means and maxima of both scores to six digits, 0 without any."""
    score = lambda f, c: F.round(F.coalesce(f(c), F.lit(0.0)), 6)
    both = candidates.select("candidate_id").distinct().agg(F.count(F.lit(1)).alias("candidates"))
    sums = final.agg(
        F.count_distinct("candidate_id").alias("matched"), F.count(F.lit(1)).alias("matches"), score(F.avg, "final_score").alias("mean_final"), F.coalesce(F.max("final_score").cast("double"), F.lit(0.0)).alias("best_final"),
        score(F.avg, "baseline_score").alias("mean_baseline"), score(F.max, "baseline_score").alias("best_baseline"),
    )
    return both.join(F.broadcast(sums))


def compare_summary(compared: DataFrame) -> DataFrame:
    """Totals of a comparison, and the mean over candidates of the overlap's percentage."""
    return compared.agg(F.count(F.lit(1)).alias("candidates"), *[F.sum(c).alias(c) for c in ("overlap", "new", "dropped")], F.avg("overlap_percent").alias("mean_percent"))


def vector_payload(rows: DataFrame, kind: str, model: str) -> DataFrame:
    """What is stored beside a job's or a candidate's vector; absent lists are empty."""
    fields = {
        "job": ("job_id", "job_tower_id", "target_id", "title", "company", "location_text", "job_url", "apply_url", "source_content_hash", "required_skills", "preferred_skills"),
        "candidate": ("candidate_id", "resume_id", "full_name", "email", "phone", "location", "current_title", "current_company", "total_experience_years", "source_content_hash", "skills", "domains"),
    }[kind]
    lists = ("required_skills", "preferred_skills", "skills", "domains")
    empty = F.array().cast("array<string>")
    value = lambda c: (F.coalesce(F.col(c), empty) if c in lists else F.col(c)) if c in rows.columns else empty if c in lists else F.lit(None).cast("string")
    return rows.select(F.lit(kind).alias("record_type"), *[value(c).alias("candidate_name" if c == "full_name" else c) for c in fields], F.lit(model).alias("embedding_model"))
