"""Stored records: scans, projections, recommendations, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.hashing import content_hash
from ..functions.text import brief, brief_list
from .lifecycle import upsert


def active(rows: DataFrame, key: str, newest: str, *, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Active rows, only some ids if given, newest first, at most ``limit``."""
    out = rows.where("is_active")
    if ids is not None:
        out = out.join(ids.select(key).distinct(), key, "left_semi")
    out = out.orderBy(F.desc_nulls_last(newest), key)
    return out if limit is None else out.limit(limit)


def by_id(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The row of each wanted id, nulls where there is none."""
    return wanted.select(key).distinct().join(rows, key, "left")


def discovered_urls(runs: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """(key, urls) of each run: those its summary lists, or its jobs' URLs if it lists none."""
    own = jobs.groupBy(key).agg(F.array_sort(F.collect_set(urls.canonical(F.col("job_url")))).alias("job_urls"))
    listed = F.when(F.size(F.coalesce("discovered", F.array().cast("array<string>"))) > 0, F.array_sort(urls.canonical_list(F.col("discovered"))))
    return runs.join(own, key, "left").select(key, F.coalesce(listed, "job_urls", F.array().cast("array<string>")).alias("urls"))


def safe_urls(found: DataFrame, key: str, url: str, hosts: list[str] | None = None) -> DataFrame:
    """(key, safe, rejected): how many distinct URLs of each key may be fetched, and how many not."""
    bad = urls.unsafe_reason(F.col(url)).isNotNull()
    if hosts is not None:
        bad = bad | ~urls.allowed(urls.host(F.col(url)), hosts)
    each = found.select(key, urls.canonical(F.col(url)).alias("u"), bad.alias("bad")).distinct()
    return each.groupBy(key).agg(F.count_if(~F.col("bad")).alias("safe"), F.count_if("bad").alias("rejected"))


def merged_payload(index: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """An index's payload under the stored row: stored values win where there are any."""
    j = index.alias("i").join(stored.alias("s"), key, "left")
    return j.select(key, *[F.coalesce(F.col(f"s.{f}"), F.col(f"i.{f}")).alias(f) for f in fields])


def job_brief(title: Column, company: Column, skills: Column, summary: Column) -> Column:
    """What a scorer sees of a job, each field cut to its length."""
    return F.struct(brief(title, 120).alias("title"), brief(company, 80).alias("company"), brief_list(skills, 200).alias("skills"), brief(summary, 300).alias("summary"))


def matching_input(**fields: Column) -> Column:
    """A hash that changes when what matching reads changes."""
    return content_hash(**fields)


def recommendations(rows: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """Scored rows of the newest runs by rank, with the live job or, where it is gone, the row's own snapshot; jobs that aren't visible drop.

    rows: run_id, rank, job_id, status, snapshot_title; jobs: job_id, title, visible.
    """
    shown = rows.where("status = 'llm_scored'").join(jobs, "job_id", "left")
    shown = shown.withColumn("title", F.coalesce("title", "snapshot_title")).where(F.coalesce("visible", F.lit(True)) & (F.coalesce("title", F.lit("")) != ""))
    return shown.orderBy(F.desc("run_id"), "rank", "job_id").limit(limit).select("run_id", "rank", "job_id", "title")


def match_upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(current, batch, ["match_run_id", "candidate_id", "job_id"])


def urls_known(found: DataFrame, jobs: DataFrame, columns: list[str]) -> DataFrame:
    """Jobs with any of some URL columns, raw or canonical, among those found; each job once."""
    keys = found.select(urls.canonical(F.col("url")).alias("u")).where("u <> ''").distinct()
    each = jobs.select("job_id", F.explode(F.array_distinct(F.transform(F.array(*columns), urls.canonical))).alias("u"))
    return jobs.join(each.join(keys, "u", "left_semi").select("job_id").distinct(), "job_id", "left_semi")
