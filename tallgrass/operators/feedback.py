"""Feedback, training pairs and scorers' answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import prefixed_id
from .lifecycle import latest


def latest_labels(rows: DataFrame) -> DataFrame:
    """The last label of each candidate and job; the label is no part of the key, so a new one replaces the old."""
    return rows.groupBy("candidate_id", "job_id").agg(F.max_by("label", "created_at").alias("label"), F.max("created_at").alias("created_at"))


def binary(rows: DataFrame, labels: dict[str, int]) -> DataFrame:
    """Adds target; rows whose label says neither are dropped."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("label"))
    return rows.withColumn("target", target).where("target is not null")


def training_pairs(rows: DataFrame, candidates: DataFrame, jobs: DataFrame, labels: dict[str, int]) -> DataFrame:
    """Labelled pairs with both texts; pairs that lack either are dropped."""
    joined = binary(rows, labels).join(candidates, "candidate_id").join(jobs, "job_id")
    return joined.withColumn("training_pair_id", prefixed_id("pair_", F.col("candidate_id"), F.col("job_id")))


def parsed_results(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(candidate_id, job_id, score, at) of a scorer's answers: known jobs only, the first answer for each."""
    items = F.from_json("answer", "array<struct<job_id:long,score:double>>")
    rows = answers.select("candidate_id", "at", F.explode(items).alias("r")).select("candidate_id", "at", "r.job_id", "r.score")
    known = rows.where("job_id is not null").join(expected, "job_id", "left_semi")
    return latest(known, ["candidate_id", "job_id"], F.col("at"))
