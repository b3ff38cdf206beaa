"""A log of edits of profiles, folded in order: what each edit changed, what it means for matching, and the profile at any edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields whose change makes a profile match differently.
IMPACT = (
    "location", "total_experience_years", "skills", "domains", "current_title", "current_company", "target_roles", "preferred_locations", "remote_preference", "employment_type", "seniority_level", "summary",
)


def edit_log(profiles: DataFrame, edits: DataFrame, key: str, order: str, fields: tuple[str, ...], *, impact: tuple[str, ...] = IMPACT) -> DataFrame:
    """A row for each edit that says anything: key, order, version, changed, impacting, refresh, hash_before, hash_after, parsed and after.

    profiles: key, version and the fields as parsed; edits: key, order, updates (a map of field to text, null to clear). Edits overlay the parsed profile: of each field the last one that names it
    counts, a null too. The version grows with every edit that names a field, whether or not it changes one. ``impacting`` are the changed fields that matching reads; ``refresh`` says that the
    hash over those differs, so vectors and recommendations are stale. ``parsed`` is the profile before the first edit, kept as it was; ``after`` the profile after this one. Fields beyond ``fields`` are left out;
    edits of profiles that aren't there have no row.
    """
    known = F.map_filter("updates", lambda k, v: k.isin(*fields))
    rows = edits.select(key, order, known.alias("updates")).where(F.size("updates") > 0)
    parsed = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    j = rows.join(profiles.select(key, F.col("version").alias("first_version"), parsed.alias("parsed")), key)
    by = Window.partitionBy(key).orderBy(order)
    said = lambda f: F.when(F.map_contains_key("updates", f), F.struct(F.element_at("updates", f).alias("v")))
    # whether a field was named so far, and what it was named last; a null is a value, so it is wrapped
    up_to = {"after": by.rowsBetween(Window.unboundedPreceding, 0), "before": by.rowsBetween(Window.unboundedPreceding, -1)}
    state = lambda when: F.struct(*[F.when(F.last(said(f), ignorenulls=True).over(up_to[when]).isNotNull(), F.last(said(f), ignorenulls=True).over(up_to[when]).v).otherwise(F.col(f"parsed.{f}")).alias(f) for f in fields])
    folded = j.withColumns({"after": state("after"), "before": state("before"), "version": (F.coalesce("first_version", F.lit(0)) + F.row_number().over(by)).cast("int")})
    read = [f for f in sorted(fields) if f in impact]
    digest = lambda s: F.sha2(F.to_json(F.struct(*[F.col(f"{s}.{f}").alias(f) for f in read]), {"ignoreNullFields": "false"}), 256) if read else F.lit("")
    differs = lambda names: F.filter(F.array(*[F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    out = folded.withColumns({"changed": differs(sorted(fields)), "impacting": differs(read), "hash_before": digest("before"), "hash_after": digest("after")})
    return out.select(key, order, "version", "changed", "impacting", (F.col("hash_before") != F.col("hash_after")).alias("refresh"), "hash_before", "hash_after", "parsed", "after")


def profiles_at(profiles: DataFrame, log: DataFrame, key: str, order: str, fields: tuple[str, ...], at: Column | None = None) -> DataFrame:
    """(key, version, fields, edited): each profile after its last edit, or after its last one up to ``at``. One without an edit is as it was parsed."""
    upto = log if at is None else log.where(F.col(order) <= at)
    last = upto.groupBy(key).agg(F.max_by(F.struct("version", "after"), order).alias("last"))
    j = profiles.select(key, "version", *fields).join(last, key, "left")
    got = F.col("last").isNotNull()
    return j.select(key, F.when(got, F.col("last.version")).otherwise(F.col("version")).alias("version"), *[F.when(got, F.col(f"last.after.{f}")).otherwise(F.col(f).cast("string")).alias(f) for f in fields], got.alias("edited"))
