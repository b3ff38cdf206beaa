"""Next states of current tables: upserts, histories, missing rows, transitions.

Each function takes a table's state and what came in and returns the next state, from full joins or from a union and windows;
nothing is updated in place, so a step can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skills import unique_skills
from ..functions.urls import canonical


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], *, once: tuple[str, ...] = ("created_at",), keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows of either side; a batch row wins but for the columns of ``once`` (first insert) and null values of ``keep_if_null``."""
    a, b = current.alias("a"), batch.withColumn("in_batch", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    columns = []
    for c in current.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}") if c in batch.columns else F.col(f"a.{c}")
        if c in keys or c in keep_if_null and c not in once:
            columns.append(F.coalesce(new, old).alias(c))
        elif c in once:
            columns.append(F.coalesce(old, new).alias(c))
        else:
            columns.append(F.when(F.col("b.in_batch"), new).otherwise(old).alias(c))
    return joined.select(*columns)


def job_upsert(current: DataFrame, batch: DataFrame, now: Column, carried: tuple[str, ...] = (), beside: tuple[str, ...] = ()) -> DataFrame:
    """The next job table with ``change``: inserted, changed, unchanged, or null for rows the batch doesn't name.

    current: job_id, content_hash, posted_date, version, first_seen_at, last_seen_at, missing_count, is_active, inactive_reason; batch: job_id,
    content_hash, posted_date, ordinal. A batch may name a job more than once: rows apply in the order of ``ordinal``, so
    the last one's values stay and the version grows by the number of changes on the way. A job that is named takes the columns ``carried`` from its last row
    as they are; those ``beside`` stay as in ``current``.
    """
    by = Window.partitionBy("job_id").orderBy("ordinal")
    steps = batch.join(current.select("job_id", F.col("content_hash").alias("old_hash")), "job_id", "left")
    before = F.coalesce(F.lag("content_hash").over(by), F.col("old_hash"))
    steps = steps.withColumn("changed", F.when(before.isNull(), 0).when(before != F.col("content_hash"), 1).otherwise(0))
    last = steps.groupBy("job_id").agg(F.max_by("content_hash", "ordinal").alias("new_hash"), F.sum("changed").alias("changes"), F.max_by("posted_date", F.when(F.col("posted_date").isNotNull(), F.col("ordinal"))).alias("new_posted"), *([F.max_by(F.struct(*carried), "ordinal").alias("new")] if carried else []))
    j = current.join(last, "job_id", "full")
    named, fresh = F.col("new_hash").isNotNull(), F.col("content_hash").isNull()
    return j.select(
        "job_id", F.coalesce("new_hash", "content_hash").alias("content_hash"), F.coalesce("new_posted", "posted_date").alias("posted_date"),
        (F.coalesce("version", F.lit(1)) + F.coalesce("changes", F.lit(0))).cast("int").alias("version"), F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(named, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(named, 0).otherwise(F.col("missing_count")).alias("missing_count"),
        F.when(named, True).otherwise(F.col("is_active")).alias("is_active"), F.when(~named, F.col("inactive_reason")).alias("inactive_reason"),
        F.when(named & fresh, "inserted").when(named & (F.col("changes") > 0), "changed").when(named, "unchanged").alias("change"),
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in carried], *beside,
    )


def history(batch: DataFrame, current: DataFrame) -> DataFrame:
    """One row for each new version in a batch: (job_id, content_hash, version), in the order of ordinal."""
    by = Window.partitionBy("job_id").orderBy("ordinal")
    steps = batch.join(current.select("job_id", F.col("content_hash").alias("old_hash"), "version"), "job_id", "left")
    before = F.coalesce(F.lag("content_hash").over(by), F.col("old_hash"))
    new = steps.withColumn("new", (before.isNull() | (before != F.col("content_hash"))).cast("int"))
    numbered = new.withColumn("version", (F.coalesce("version", F.lit(0)) + F.sum("new").over(by)).cast("int")).where("new = 1")
    return numbered.select("job_id", "content_hash", "version")


def plan_rescrape(discovered: DataFrame, jobs: DataFrame, now: Column, refresh_days: int) -> DataFrame:
    """For each discovered URL: (url_key, job_id, plan): new, inactive, due or skip. The newest job of a URL counts."""
    newest = Window.partitionBy("url_key").orderBy(F.desc("last_seen_at"), F.desc("job_id"))
    known = jobs.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")
    j = discovered.select("url_key").distinct().join(known, "url_key", "left")
    due = F.col("last_deep_scraped_at").isNull() | (F.col("last_deep_scraped_at") <= now - F.make_dt_interval(days=F.lit(refresh_days)))
    return j.select("url_key", "job_id", F.when(F.col("job_id").isNull(), "new").when(F.col("is_active").eqNullSafe(False), "inactive").when(due, "due").otherwise("skip").alias("plan"))


def reconcile(jobs: DataFrame, discovered: DataFrame, target: str, now: Column, *, least_share: float = 0.25, misses: int = 3) -> DataFrame:
    """Counts a miss for each active job of a target that discovery didn't see; from ``misses`` on it is inactive.

    A target with nothing discovered, or with fewer than ``least_share`` of its active jobs (at least 1), is left as it is; ``outcome`` says
    so. jobs: job_id, target, url_key, is_active, missing_count; discovered: target, url_key.
    """
    seen = discovered.select(target, "url_key").distinct().withColumn("seen", F.lit(True))
    found = seen.groupBy(target).agg(F.count(F.lit(1)).alias("found"))
    active = jobs.where("is_active").groupBy(target).agg(F.count(F.lit(1)).alias("active"))
    j = jobs.join(seen, [target, "url_key"], "left").join(found, target, "left").join(active, target, "left")
    outcome = F.when(F.col("found").isNull(), "skipped_empty").when(F.col("found") < F.greatest(F.lit(1), F.floor(F.col("active") * least_share)), "skipped_low_coverage").otherwise("reconciled")
    missed = (outcome == "reconciled") & F.col("is_active") & F.col("seen").isNull()
    count = F.when(missed, F.col("missing_count") + 1).otherwise(F.col("missing_count"))
    gone = missed & (count >= misses)
    return j.select("job_id", target, "url_key", count.alias("missing_count"), F.when(gone, False).otherwise(F.col("is_active")).alias("is_active"), F.when(gone, now).alias("deactivated_at"), outcome.alias("outcome"))


def reset_seen(jobs: DataFrame, discovered: DataFrame, now: Column) -> DataFrame:
    """Discovered jobs are active again, without misses and reasons."""
    seen = discovered.select("url_key").distinct().withColumn("seen", F.lit(True))
    j, s = jobs.join(seen, "url_key", "left"), F.col("seen").isNotNull()
    return j.select("job_id", "url_key", F.when(s, 0).otherwise(F.col("missing_count")).alias("missing_count"), F.when(s, True).otherwise(F.col("is_active")).alias("is_active"), F.when(~s, F.col("inactive_reason")).alias("inactive_reason"), F.when(s, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def needs_tower(jobs: DataFrame, towers: DataFrame) -> DataFrame:
    """Jobs without a tower or with another hash than their tower's."""
    t = towers.select("job_id", F.col("content_hash").alias("tower_hash"))
    return jobs.join(t, "job_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("tower_hash"))).drop("tower_hash")


def tower_state(towers: DataFrame, batch: DataFrame) -> DataFrame:
    """Towers after a batch: a new or other hash waits for indexing, the same hash keeps its state."""
    b = batch.select("job_id", F.col("content_hash").alias("new_hash"))
    j = towers.join(b, "job_id", "full")
    same = F.col("new_hash").isNull() | F.col("new_hash").eqNullSafe(F.col("content_hash"))
    return j.select("job_id", F.coalesce("new_hash", "content_hash").alias("content_hash"), F.when(same, F.col("embedding_status")).otherwise("pending").alias("embedding_status"))


def backlog(candidates: DataFrame, open_requests: DataFrame, jobs: DataFrame, *, most_candidates: int = 250, most_jobs: int = 200) -> DataFrame:
    """Refresh requests for eligible candidates without an open one, newest first; job ids in order, at most ``most_jobs``."""
    fit = candidates.where(F.col("candidate_id").isNotNull() & ~F.col("profile_state").eqNullSafe("incomplete"))
    fresh = fit.join(open_requests.select("candidate_id"), "candidate_id", "left_anti").orderBy(F.desc("updated_at"), "candidate_id").limit(most_candidates)
    ids = jobs.select("job_id").distinct().orderBy("job_id").limit(most_jobs).agg(F.array_sort(F.collect_list("job_id")).alias("job_ids"))
    return fresh.join(F.broadcast(ids)).select("candidate_id", F.size("job_ids").alias("n_jobs"), F.sha2(F.concat_ws("|", F.lit("refresh"), F.col("candidate_id").cast("string"), F.array_join("job_ids", ",")), 256).alias("request_key"))


def portal_after_run(portals: DataFrame, runs: DataFrame, now: Column, pause_after: int = 5) -> DataFrame:
    """Portals after their runs: success clears the streak, failure backs off by interval * 2^min(streak + 1, 4), at most a week, and pauses a portal at ``pause_after``."""
    j = portals.join(runs.select("portal_id", "succeeded"), "portal_id", "left")
    ok, ran = F.col("succeeded"), F.col("succeeded").isNotNull()
    streak = F.when(ran & ok, 0).when(ran, F.col("failures") + 1).otherwise(F.col("failures"))
    wait = F.when(ok, F.col("interval_minutes")).otherwise(F.least(F.lit(10080), F.col("interval_minutes") * F.pow(F.lit(2), F.least(F.col("failures") + 1, F.lit(4))))).cast("int")
    paused = ran & ~ok & (streak >= pause_after)
    return j.select("portal_id", streak.cast("int").alias("failures"), F.when(ran, wait).alias("wait_minutes"), F.when(ran & ~paused, now + F.make_dt_interval(mins=wait)).when(~ran, F.col("next_run_at")).alias("next_run_at"), F.when(paused, "auto_paused").otherwise(F.col("status")).alias("status"))


def take_lease(portals: DataFrame, wanted: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Portals with a lease for each asker that came first, where no other lease is still on."""
    by = Window.partitionBy("portal_id").orderBy("asked_at", "owner")
    first = wanted.withColumn("nth", F.row_number().over(by)).where("nth = 1").select("portal_id", F.col("owner").alias("new_owner"))
    j = portals.join(first, "portal_id", "left")
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    got = F.col("new_owner").isNotNull() & free
    return j.select("portal_id", F.when(got, F.col("new_owner")).otherwise(F.col("owner")).alias("owner"), F.when(got, now + F.make_dt_interval(mins=F.lit(minutes))).otherwise(F.col("lease_until")).alias("lease_until"), got.alias("taken"))


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Names of the fields whose values differ, null counting as a value."""
    return F.filter(F.array(*[F.when(~old[k].eqNullSafe(new[k]), F.lit(k)) for k in sorted(old)]), lambda x: x.isNotNull())


def overlay(base: DataFrame, overrides: DataFrame, key: str, values: str, locked: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with a map of overrides: a key that is there wins even with a null value; locked fields stay."""
    j = base.join(overrides.select(key, F.col(values).alias("over")), key, "left")
    pick = lambda c: F.when(F.map_contains_key("over", c), F.element_at("over", c)).otherwise(F.col(c))
    return j.select(*[F.col(c) if c == key or c in locked else pick(c).alias(c) for c in base.columns])


def first_write(state: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Status and times after events (status, at): the first start stays, the last status and end count."""
    e = events.groupBy(key).agg(F.min(F.when(F.col("new_status") == "running", F.col("at"))).alias("s"), F.max(F.when(F.col("new_status").isin("succeeded", "failed"), F.col("at"))).alias("c"), F.max_by("new_status", "at").alias("n"))
    return state.join(e, key, "left").select(key, F.coalesce("n", "status").alias("status"), F.coalesce("started_on", "s").alias("started_on"), F.coalesce("c", "completed_on").alias("completed_on"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("nth_of_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth_of_key = 1").drop("nth_of_key")


def prioritised(left: DataFrame, key: str, steps: list[DataFrame], found: str) -> DataFrame:
    """The hit of the first step that has one; each step is (key, found). Of hits within a step the smallest counts."""
    every = None
    for i, s in enumerate(steps):
        one = s.select(key, found, F.lit(i).alias("step"))
        every = one if every is None else every.unionByName(one)
    best = latest(every.where(F.col(found).isNotNull()), [key], F.col("step"), F.col(found))
    return left.join(best, key, "left")


def suffixed(df: DataFrame, base: str, order: str, most: int = 80) -> DataFrame:
    """Adds unique_key: the key, then key-2, key-3, ... within ``most`` characters."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    tail = F.concat(F.lit("-"), n.cast("string"))
    return df.withColumn("unique_key", F.when(n == 1, F.left(base, F.lit(most))).otherwise(F.concat(F.left(base, F.lit(most) - F.length(tail)), tail)))


def last_entries(old: Column, new: Column, most: int = 10) -> Column:
    """The last ``most`` items of two lists one after the other."""
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), new)
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - most + 1), F.lit(most))


# States of a job whose details have to be read again.
FAILED = ("detail_extract_failed", "parse_failed", "validation_failed", "inactive", "missing_in_latest_scrape")


def jobs_by_url(jobs: DataFrame, columns: tuple[str, ...] = ("canonical_job_url", "job_url", "source_url", "apply_url"), order: str = "job_id") -> DataFrame:
    """(url_key, job_id) of each canonical URL in any of the columns; of jobs that share one the greatest counts."""
    keys = jobs.select(F.col(order).alias("job_id"), F.explode(F.array(*[canonical(F.col(c)) for c in columns if c in jobs.columns])).alias("url_key"))
    return keys.where("coalesce(url_key, '') <> ''").groupBy("url_key").agg(F.max("job_id").alias("job_id"))


def planned_target(discovered: DataFrame, jobs: DataFrame, target: str, now: Column, session: Column, **limits) -> tuple[DataFrame, DataFrame]:
    """(plan, jobs) of one target's discovery: the plan of ``plan_details`` against the target's own jobs, and all jobs with those that the plan saw active again, without misses or
    reasons, and seen now by this session. Another target's job under the same address is none of the plan's. Nothing discovered changes nothing."""
    mine = jobs.where(F.col("target_id") == target)
    plan = plan_details(discovered, mine, now, **limits)
    seen = plan.where("job_id is not null").select("job_id").distinct().withColumn("seen", F.lit(True))
    j = jobs.join(seen, "job_id", "left")
    new = {"last_seen_at": now, "last_run_session_id": session, "freshness_status": F.lit("active"), "missing_count": F.lit(0), "is_active": F.lit(True), "inactive_reason": F.lit(None), "deactivated_at": F.lit(None)}
    return plan, j.select(*[F.when(F.col("seen"), new[c].cast(kind)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c, kind in jobs.dtypes])


def plan_details(discovered: DataFrame, jobs: DataFrame, now: Column, *, refresh_days: int = 14, force: bool = False) -> DataFrame:
    """(url, job_id, extract, is_new, due, broken) of each discovered URL in canonical form.

    A known job's details are read again if it is inactive, failed or incomplete (``broken``), or its last deep look is over ``refresh_days`` old (``due``); a URL may be
    both. jobs: job_id, its URLs, is_active, freshness_status, title, company, last_deep_scraped_at, last_seen_at.
    """
    by_url = jobs_by_url(jobs)
    urls = discovered.select(canonical(F.col("url")).alias("url_key")).where("coalesce(url_key, '') <> ''").distinct()
    j = urls.join(by_url, "url_key", "left").join(jobs.drop("url_key"), "job_id", "left")
    known, none = F.col("job_id").isNotNull(), F.lit("")
    deep = F.coalesce("last_deep_scraped_at", "last_seen_at")
    due = known & F.coalesce(deep < now - F.make_dt_interval(days=F.lit(max(1, refresh_days))), F.lit(False))
    empty = lambda c: F.trim(F.coalesce(c, none)) == ""
    broken = known & (F.col("is_active").eqNullSafe(False) | F.lower(F.coalesce("freshness_status", none)).isin(*FAILED) | empty("title") | empty("company"))
    return j.select(F.col("url_key").alias("url"), "job_id", (~known | due | broken | F.lit(force)).alias("extract"), (~known).alias("is_new"), due.alias("due"), broken.alias("broken"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts of a plan by reason; a URL that is due and broken counts in both."""
    n = lambda c, name: F.count_if(c).alias(name)
    return plan.agg(F.count(F.lit(1)).alias("discovered"), n(F.col("extract"), "to_extract"), n(F.col("is_new"), "new"), n(F.col("due"), "due"), n(F.col("broken"), "broken"), n(~F.col("extract"), "skipped"))


def backfilled(jobs: DataFrame, discovered: DataFrame, target: str, now: Column, **limits) -> DataFrame:
    """Jobs after a backfill: what was discovered is active again first, then what was not counts a miss. jobs: as in ``reconcile``, with
    inactive_reason and last_seen_at; discovered: target, url_key."""
    reset = reset_seen(jobs, discovered, now)
    again = reset.join(jobs.select("job_id", target), "job_id")
    return reconcile(again, discovered, target, now, **limits).join(reset.select("job_id", "last_seen_at"), "job_id")


def resume_upsert(current: DataFrame, batch: DataFrame, now: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles, history) after a batch of parsed profiles: one row a résumé, first seen once, and a history row for each new content.

    current: resume_id, sha256, content_hash, first_seen_at, last_seen_at, is_active; batch: sha256, resume_id (or null), content_hash. A row without
    a hash is dropped; without an id it gets one from its hash. Of rows of one résumé the last in ``order`` counts, without an order that of the greatest
    content hash.
    """
    rows = batch.where("coalesce(sha256, '') <> ''").withColumn("resume_id", F.coalesce("resume_id", F.concat(F.lit("res_"), F.left("sha256", F.lit(24)))))
    last = F.struct(order, "content_hash") if order else F.col("content_hash")
    rows = rows.groupBy("resume_id").agg(F.max_by("content_hash", last).alias("content_hash"), F.max_by("sha256", last).alias("sha256"))
    new = rows.select("resume_id", "sha256", "content_hash", now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit(True).alias("is_active"))
    changed = rows.join(current.select("resume_id", F.col("content_hash").alias("old")), "resume_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("old")))
    told = changed.select(F.concat(F.lit("reshist_"), "resume_id", F.lit("_"), F.left("content_hash", F.lit(16))).alias("history_id"), "resume_id", "sha256", "content_hash")
    return upsert(current, new, ["resume_id"], once=("first_seen_at",)), told


def tower_upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Candidate towers after a batch: skills from the first list that has any, a text for them where there is none, older lists emptied.

    batch: candidate_id, skills, primary_skills, secondary_skills, raw_skills, skills_text, content_hash.
    """
    empty = F.array().cast("array<string>")
    some = lambda *c: unique_skills(F.concat(*[F.coalesce(F.col(x), empty) for x in c]))
    own, older, raw = some("skills"), some("primary_skills", "secondary_skills"), some("raw_skills")
    made = batch.withColumn("chosen", F.when(F.size(own) > 0, own).when(F.size(older) > 0, older).otherwise(raw))
    text = F.when((F.trim(F.coalesce("skills_text", F.lit(""))) == "") & (F.size("chosen") > 0), F.concat(F.lit("Skills: "), F.array_join("chosen", ", "))).otherwise(F.coalesce("skills_text", F.lit("")))
    return upsert(current, made.select("candidate_id", F.col("chosen").alias("skills"), empty.alias("primary_skills"), empty.alias("secondary_skills"), text.alias("skills_text"), "content_hash"), ["candidate_id"], once=())


def roles_resynced(old: DataFrame, given: DataFrame) -> DataFrame:
    """Roles (user_id, role) after a source gave its own again: those it gave before go, those given by hand stay."""
    return old.where("not sourced").select("user_id", "role").unionByName(given.select("user_id", "role")).distinct()


def one_primary(links: DataFrame, key: str, *order: Column) -> DataFrame:
    """Links with ``is_primary``: for each key the first one in an order, and no other."""
    return links.withColumn("is_primary", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def refresh_next(requests: DataFrame, most: int) -> DataFrame:
    """Pending requests by priority, then those that have waited longest; at most 1 to 100."""
    return requests.where("status = 'pending'").orderBy(F.desc_nulls_last("priority"), F.asc_nulls_first("updated_at"), "request_id").limit(max(1, min(most, 100)))


def newest(rows: DataFrame, at: str, key: str, asked: int, most: int = 500) -> DataFrame:
    """The newest rows, 1 to ``most`` of them."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(max(1, min(most, asked)))


def url_jobs(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """(url_key, job_id) of found keys against any key of a job (job_id, keys); of jobs that share one the greatest counts."""
    known = keyed.select("job_id", F.explode("keys").alias("url_key")).groupBy("url_key").agg(F.max("job_id").alias("job_id"))
    return found.select("url_key").distinct().join(known, "url_key", "left")


def shares(rows: DataFrame, key: str, users: str = "users") -> DataFrame:
    """(key, users, ambiguous): how many rows an identity has; more than one is an error for whoever looks it up."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(users)).withColumn("ambiguous", F.col(users) > 1)


def json_merged(left: Column, right: Column) -> Column:
    """A shallow merge of two maps: the right one's keys win."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def chunked(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Adds ``chunk``: rows of a key in an order, ``size`` to a chunk, from 0."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("chunk", F.floor((n - 1) / size).cast("long"))


def primary_linked(links: DataFrame, given: DataFrame, now: Column) -> DataFrame:
    """Links (user_id, candidate_id, resume_id, is_primary, is_active, metadata, modified_on) after users were linked anew (user_id, candidate_id, resume_id, metadata, ordinal).

    The last link given to a user is its primary one, active, with the new résumé and the old metadata under the new; a user's other primary links lose that, with the time. Links of users that were given
    none, and other users' links to the same candidate, stay as they were.
    """
    last = latest(given, ["user_id"], F.desc("ordinal")).select("user_id", "candidate_id", F.col("resume_id").alias("new_resume"), F.col("metadata").alias("new_metadata"), F.lit(True).alias("given"))
    every = given.groupBy("user_id", "candidate_id").agg(F.max_by(F.struct("resume_id", "metadata"), "ordinal").alias("g"))
    every = every.join(last.select("user_id", "candidate_id", "given"), ["user_id", "candidate_id"], "left")
    j = links.join(every, ["user_id", "candidate_id"], "full").join(last.select("user_id", F.lit(True).alias("relinked")), "user_id", "left")
    named, chosen = F.col("g").isNotNull(), F.coalesce("given", F.lit(False))
    lost = F.coalesce("relinked", F.lit(False)) & ~chosen & F.coalesce("is_primary", F.lit(False))
    empty = F.create_map().cast(dict(links.dtypes)["metadata"])
    return j.select(
        "user_id", "candidate_id", F.when(named, F.col("g.resume_id")).otherwise(F.col("resume_id")).alias("resume_id"), F.when(F.col("relinked"), chosen).otherwise(F.col("is_primary")).alias("is_primary"), F.when(named, True).otherwise(F.col("is_active")).alias("is_active"),
        F.when(named, json_merged(F.coalesce("metadata", empty), F.coalesce("g.metadata", empty))).otherwise(F.col("metadata")).alias("metadata"), F.when(named | lost, now).otherwise(F.col("modified_on")).alias("modified_on"),
    )


def resolved_users(logins: DataFrame, identities: DataFrame, legacy: DataFrame, users: DataFrame) -> DataFrame:
    """(login, user_id, strategy, error) of each login: by identity (issuer, subject), else by the older (realm, subject), else by a verified e-mail of an active user of its organisation.

    Two active users of one e-mail are an error, and so is an e-mail that is a user's while the login's isn't verified; such a login has no user. One that nothing names is new (strategy null).
    logins: login, issuer, subject, realm, org_id, email, verified; identities: issuer, subject, user_id; legacy: realm, subject, user_id; users: user_id, org_id, email, is_active.
    """
    mail = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    by_mail = users.where("is_active").groupBy("org_id", mail(F.col("email")).alias("mail")).agg(F.min("user_id").alias("mail_user"), F.count(F.lit(1)).alias("mail_users"))
    one = lambda df, keys, name: df.groupBy(*keys).agg(F.min("user_id").alias(name))
    j = logins.withColumn("mail", mail(F.col("email"))).join(one(identities, ["issuer", "subject"], "own"), ["issuer", "subject"], "left")
    j = j.join(one(legacy, ["realm", "subject"], "older"), ["realm", "subject"], "left").join(by_mail, ["org_id", "mail"], "left")
    found, verified = F.coalesce("own", "older"), F.coalesce("verified", F.lit(False))
    error = F.when(found.isNull() & (F.col("mail_users") > 1), "ambiguous_email").when(found.isNull() & (F.col("mail_users") == 1) & ~verified, "unverified_email")
    user = F.when(found.isNotNull(), found).when(error.isNull(), F.col("mail_user"))
    strategy = F.when(F.col("own").isNotNull(), "identity").when(F.col("older").isNotNull(), "legacy").when(error.isNull() & F.col("mail_user").isNotNull(), "verified_email")
    return j.select("login", user.alias("user_id"), strategy.alias("strategy"), error.alias("error"))
