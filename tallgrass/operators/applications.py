"""Applications: batches, decisions before a submission, what a run does to saved jobs, summaries told once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses after which nobody applies again, paths and methods that the request log leaves out or keeps.
TERMINAL = ("agent_applied", "applied_manually")
QUIET_PATHS = ("/health", "/docs", "/redoc", "/openapi.json", "/favicon.ico")
CHANGES = ("POST", "PUT", "PATCH", "DELETE")


def batch_runs(saved: DataFrame, applications: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Runs of a new batch: (candidate_id, job_id, run_status, application_status, apply_url, apply_strategy, error_type).

    A saved job that was applied for is skipped as a duplicate and keeps its application's status and, without one of its own, URL; others are queued. Candidates with a
    batch that is still active get no new one. saved: candidate_id, job_id, apply_url; applications: candidate_id, job_id, status, applied_url.
    """
    rows = saved if active is None else saved.join(active.select("candidate_id").distinct(), "candidate_id", "left_anti")
    j = rows.join(applications.select("candidate_id", "job_id", F.lower(F.trim("status")).alias("before"), "applied_url"), ["candidate_id", "job_id"], "left")
    done = F.coalesce(F.col("before").isin(*TERMINAL), F.lit(False))
    own = F.nullif(F.col("apply_url"), F.lit(""))
    return j.select(
        "candidate_id", "job_id", F.when(done, "skipped_duplicate").otherwise("queued").alias("run_status"), F.when(done, F.col("before")).otherwise("agent_apply_requested").alias("application_status"),
        F.when(done, F.coalesce(own, "applied_url")).otherwise(own).alias("apply_url"), F.when(done, "already_applied").alias("apply_strategy"), F.when(done, "already_applied").alias("error_type"),
    )


def decision(job: Column, profile: Column, apply_url: Column, review: Column, can_submit: Column, refusal: Column, domain: Column, enabled: bool, domains: tuple[str, ...]) -> Column:
    """(run_status, application_status, error_type) of a run before it submits anything; all null where it may submit.

    job and profile say whether they are there, refusal is why the domain's strategy can't submit.
    """
    said = lambda run, app, error: F.struct(F.lit(run).alias("run_status"), F.lit(app).alias("application_status"), (error if isinstance(error, Column) else F.lit(error)).alias("error_type"))
    failed, look = ("precheck_failed", "agent_failed"), ("needs_review", "agent_needs_review")
    host = F.replace(F.lower(F.coalesce(domain, F.lit(""))), F.lit("www."), F.lit(""))
    open_ = host.isin(*domains) if enabled and domains else F.lit(False)
    return (
        F.when(~F.coalesce(job, F.lit(False)), said(*failed, "job_not_found")).when(~F.coalesce(profile, F.lit(False)), said(*failed, "candidate_profile_missing"))
        .when(F.coalesce(apply_url, F.lit("")) == "", said(*failed, "missing_apply_url")).when(F.coalesce(review, F.lit(False)), said(*look, "review_before_submit_enabled"))
        .when(~F.coalesce(can_submit, F.lit(False)), said(*look, F.coalesce(refusal, F.lit("manual_review_required")))).when(~open_, said(*look, "external_submit_disabled"))
    )


def saved_after(saved: DataFrame, events: DataFrame) -> DataFrame:
    """Saved jobs after events (candidate_id, job_id, event): nothing is deleted.

    'removed' hides an active row, 'submitted' one that is active and saved, 'saved' brings any row back or makes a new one. Of a row's events the one
    with the greatest ``at`` counts. saved: candidate_id, job_id, status, is_active.
    """
    keys = ["candidate_id", "job_id"]
    last = events.groupBy(*keys).agg(F.max_by("event", "at").alias("event"))
    j = saved.withColumn("there", F.lit(True)).join(last, keys, "full")
    there, event, active = F.coalesce("there", F.lit(False)), F.coalesce("event", F.lit("")), F.coalesce("is_active", F.lit(False))
    back = event == "saved"
    gone = F.when((event == "removed") & active, "removed_from_saved").when((event == "submitted") & active & (F.col("status") == "saved"), "agent_applied")
    out = j.where(there | back).select(*keys, F.when(back, "saved").otherwise(F.coalesce(gone, "status")).alias("status"), F.when(back, True).otherwise(active & gone.isNull()).alias("is_active"))
    return out


def untold(batches: DataFrame, notices: DataFrame, key: str = "batch_id") -> DataFrame:
    """Batches without a summary notice, each once: what may be finalised now."""
    return batches.select(key).distinct().join(notices.select(key), key, "left_anti")


def logged(method: Column, path: Column, status: Column, draw: Column, *, gets: bool = False, rate: float = 0.05) -> Column:
    """Whether a request is kept: failures and changes always, quiet paths never, reads only if asked for, and then by ``draw`` (0 to 1) below ``rate``."""
    bare = F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))
    sampled = draw < max(0.0, min(rate, 1.0))
    return F.when((method == "OPTIONS") | bare.isin(*QUIET_PATHS), False).when((status >= 500) | method.isin(*CHANGES), True).when((method == "GET") & F.lit(not gets), False).otherwise(sampled)
