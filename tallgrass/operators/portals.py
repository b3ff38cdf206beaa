"""Portals under administration: updates under a version, overrides, probes, health, what the public sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import last_entries

# What a portal shows of itself.
PUBLIC = (
    "id", "organization_id", "portal_key", "target_id", "display_name", "listing_url", "canonical_listing_url", "normalized_host", "allowed_hosts", "source_platform", "source_platform_confidence", "crawl_strategy",
    "profile_name", "configuration_json", "configuration_version", "status", "last_run_status", "is_active", "failure_streak", "schedule_expression", "scheduler_enabled", "refresh_interval_minutes", "next_run_at",
    "last_run_started_on", "last_successful_run_on", "last_failed_run_on", "deactivate_after_misses", "min_discovery_coverage_ratio", "max_consecutive_failures_before_pause", "detail_retry_attempts", "last_health_status",
    "last_health_checked_on", "last_alert_on", "alert_status", "max_pages_per_run", "max_jobs_per_run", "request_rate_limit_per_minute", "crawl_timeout_seconds", "created_on", "modified_on", "metadata",
)


def public(portals: DataFrame) -> DataFrame:
    """The public columns in their order; those a table lacks are null."""
    return portals.select(*[F.col(c) if c in portals.columns else F.lit(None).cast("string").alias(c) for c in PUBLIC])


def updated(portals: DataFrame, patches: DataFrame) -> DataFrame:
    """Portals after patches (portal_id, read_version, new_url), with ``outcome``: updated, rejected or null.

    A patch that read another version is rejected. Another URL makes a draft that is inactive, of an unknown platform and never run. The version grows by one.
    portals: portal_id, listing_url, status, is_active, source_platform, last_run_status, version.
    """
    j = portals.join(patches.select("portal_id", "read_version", "new_url"), "portal_id", "left")
    asked = F.col("read_version").isNotNull()
    ok = asked & (F.col("read_version") == F.col("version"))
    url = F.coalesce("new_url", F.lit(""))
    moved = ok & (url != "") & ~F.col("new_url").eqNullSafe(F.col("listing_url"))
    new = {"listing_url": F.col("new_url"), "status": F.lit("draft"), "is_active": F.lit(False), "source_platform": F.lit("unknown"), "last_run_status": F.lit("never")}
    columns = [F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else (F.col(c) + ok.cast("int")).alias(c) if c == "version" else F.col(c) for c in portals.columns]
    return j.select(*columns, F.when(ok, "updated").when(asked, "rejected").alias("outcome"))


def overridden(portals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Portals after an administrator's override (portal_id, profile_name, entry): ready for a test unless blocked or paused, the version one more, the
    last ten entries kept. portals: portal_id, status, version, entries."""
    j = portals.join(overrides.select("portal_id", F.col("profile_name").alias("new_profile"), "entry"), "portal_id", "left")
    got = F.col("entry").isNotNull()
    status = F.when(got & ~F.col("status").isin("blocked", "paused"), "ready_for_test").otherwise(F.col("status"))
    kept = F.when(got, last_entries(F.col("entries"), F.array("entry"))).otherwise(F.col("entries"))
    return j.select("portal_id", status.alias("status"), (F.col("version") + got.cast("int")).alias("version"), kept.alias("entries"), F.when(got, F.col("new_profile")).alias("profile_name"))


def override_saved(portals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Portals after administrators' overrides, with ``outcome`` (saved, rejected, null): profile, platform, strategy and the map of profile overrides are the new ones, confidence is full, the status is ready for a test unless
    blocked or paused, the version one more, and an entry joins the last nine. An override that was made from another version is rejected and changes nothing.

    portals: portal_id, status, version, profile_name, source_platform, crawl_strategy, confidence, profile_overrides, entries; overrides: portal_id, read_version (or null: any), profile_name, source_platform,
    crawl_strategy, profile_overrides, entry; one of a portal. A blank platform stays, or is ``custom_listing`` where none was; a blank strategy is the profile's name.
    """
    names = ("profile_name", "source_platform", "crawl_strategy", "profile_overrides")
    j = portals.join(overrides.select("portal_id", "read_version", "entry", F.lit(True).alias("asked"), *[F.col(c).alias(f"new_{c}") for c in names]), "portal_id", "left")
    ok = F.coalesce("asked", F.lit(False)) & (F.col("read_version").isNull() | (F.col("read_version") == F.col("version")))
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    kind = dict(portals.dtypes)["profile_overrides"]
    new = {
        "profile_name": F.col("new_profile_name"), "source_platform": F.coalesce(filled("new_source_platform"), filled("source_platform"), F.lit("custom_listing")), "crawl_strategy": F.coalesce(filled("new_crawl_strategy"), F.col("new_profile_name")), "confidence": F.lit(1.0),
        "profile_overrides": F.coalesce("new_profile_overrides", F.create_map().cast(kind)), "status": F.when(F.col("status").isin("blocked", "paused"), F.col("status")).otherwise("ready_for_test"), "version": F.col("version") + 1, "entries": last_entries(F.col("entries"), F.array("entry")),
    }
    return j.select(*[F.when(ok, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in portals.columns], F.when(ok, "saved").when(F.col("asked"), "rejected").alias("outcome"))


def probe_status(blocked: Column, discovered: Column) -> Column:
    """What a probe says of a portal."""
    return F.when(F.coalesce(blocked, F.lit(False)), "blocked").when(F.coalesce(discovered, F.lit(0)) > 0, "ready_for_test").otherwise("needs_review")


def probed(portals: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Portals after probes (portal_id, blocked, discovered, platform): status, platform, no failures, and when it was."""
    j = portals.join(results.select("portal_id", F.lit(True).alias("probed"), "blocked", "discovered", "platform"), "portal_id", "left")
    got = F.coalesce("probed", F.lit(False))
    new = {"status": probe_status(F.col("blocked"), F.col("discovered")), "source_platform": F.coalesce("platform", F.lit("unknown")), "failures": F.lit(0), "last_successful_run_on": now, "last_run_status": F.lit("completed")}
    return j.select(*[F.when(got, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in portals.columns])


def health(portals: DataFrame) -> DataFrame:
    """(active, inactive, failing, scheduled): sums of jobs, portals that fail or are paused for it, portals with a schedule."""
    return portals.agg(F.sum("active_jobs").alias("active"), F.sum("inactive_jobs").alias("inactive"), F.count_if((F.col("failures") > 0) | (F.col("status") == "auto_paused")).alias("failing"), F.count_if("scheduled").alias("scheduled"))


def granted(roles: DataFrame, permissions: DataFrame, role: str) -> DataFrame:
    """One role with all permissions; both are lists that are kept by hand."""
    return roles.where(F.col("role") == role).select("role").join(F.broadcast(permissions.select("permission")))


def granted_where(roles: DataFrame, permissions: DataFrame, condition: Column) -> DataFrame:
    """Roles with the permissions that a condition over both gives them; roles are a list that is kept by hand."""
    return permissions.join(F.broadcast(roles), condition).select("role", "permission")
