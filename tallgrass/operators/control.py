"""Control plane: roles, latest runs, batch roll-ups, portals, saved jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import latest


def permitted(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permission: str) -> DataFrame:
    """Users with some role that grants a permission, each once."""
    granting = role_permissions.where(F.col("permission") == permission).select("role").distinct()
    return users.join(user_roles.join(granting, "role", "left_semi").select("user_id"), "user_id", "left_semi")


def with_latest(portals: DataFrame, runs: DataFrame, key: str, *order: Column) -> DataFrame:
    """Portals with their newest run, or nulls."""
    return portals.join(latest(runs, [key], *order), key, "left")


def batch_rollup(runs: DataFrame, key: str, status: str) -> DataFrame:
    """Counts by status for each batch, and the batch's own status."""
    counts = {s: F.count_if(F.col(status) == s) for s in ("queued", "running", "submitted", "skipped", "failed")}
    n = runs.groupBy(key).agg(*[c.alias(s) for s, c in counts.items()], F.count(F.lit(1)).alias("total"))
    open_ = F.col("queued") + F.col("running") > 0
    whole = F.when(open_, "running").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return n.withColumn("batch_status", whole)


def notice(row: dict[str, Column]) -> Column:
    """One line about a batch."""
    return F.format_string("%d of %d applications submitted, %d skipped, %d failed", row["submitted"], row["total"], row["skipped"], row["failed"])


def due(portals: DataFrame, now: Column) -> DataFrame:
    """Active, scheduled portals whose time has come and that nobody holds."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    return portals.where((F.col("status") == "active") & F.col("scheduled") & (F.col("next_run_at") <= now) & free)


def unhandled(saved: DataFrame, applications: DataFrame, keys: list[str], hidden: tuple[str, ...]) -> DataFrame:
    """Saved jobs without an application in a hidden status; only active applications count."""
    a = applications.where("active").select(*keys, "status")
    return saved.join(a, keys, "left").where(~F.coalesce("status", F.lit("")).isin(*hidden))


def stale(status: Column, started: Column, now: Column, limit: int) -> Column:
    """Processing for longer than the limit (a minute at least), or since nobody knows when."""
    return (status == "processing") & (started.isNull() | (F.unix_seconds(now) - F.unix_seconds(started) > max(60, limit)))


def fill_absent(row: DataFrame, details: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Fields of ``details`` where a row's map has no such key; a null that is there stays."""
    j = row.join(details, key, "left")
    own = F.col("fields")
    return j.select(key, *[F.when(F.map_contains_key(own, k), F.element_at(own, k)).otherwise(F.col(c)).alias(k) for k, c in fields.items()])


def live_or_snapshot(own: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """``shown`` of each row: what is live, else its own snapshot; a row that isn't kept is only shown while something is live."""
    j = own.join(live.select(key, "live"), key, "left")
    return j.where(F.col("kept") | F.col("live").isNotNull()).withColumn("shown", F.coalesce("live", "snapshot"))


def claimed_roles(*claims: Column) -> Column:
    """The roles of all claims of a token, each once, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*claims))))


def recommendation_status(matches: DataFrame, key: str) -> DataFrame:
    """(key, baseline, reranked, status) of each candidate: re-ranked matches count before baseline ones."""
    n = matches.groupBy(key).agg(F.count_if("is_baseline").alias("baseline"), F.count_if("is_reranked").alias("reranked"))
    return n.withColumn("status", F.when(F.col("reranked") > 0, "llm_ready").when(F.col("baseline") > 0, "baseline_ready").otherwise("no_matches"))


def backfill_totals(rows: DataFrame) -> DataFrame:
    """(target, rows, names) over the parts (target, name, rows) of a backfill; names in order, each once."""
    return rows.groupBy("target").agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_set("name")).alias("names"))
