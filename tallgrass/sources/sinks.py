"""Tables as files: postings, matches, records, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns of a postings CSV, and what of an artifact's content is kept.
CSV_COLUMNS = ("title", "company", "location_text", "employment_type", "job_url", "apply_url", "posted_date", "job_reference", "summary")
MOST_ARTIFACT_CHARS = 2_000_000


def write_jobs_json(jobs: DataFrame, path: str, run_id: str) -> None:
    """A run's postings under its own folder, and again as the latest."""
    jobs.write.mode("overwrite").json(f"{path}/runs/run_session_id={run_id}")
    jobs.write.mode("overwrite").json(f"{path}/latest")


def write_jobs_csv(jobs: DataFrame, path: str) -> None:
    """The nine columns, whatever else there is; absent ones are empty."""
    cells = [F.col(c).cast("string") if c in jobs.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]
    jobs.select(*cells).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def jobs_markdown(jobs: DataFrame, group: str, order: str) -> DataFrame:
    """(group, markdown): a numbered section for each posting of a group, in order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    line = lambda label, c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.concat(F.lit(f"- **{label}:** "), F.col(c)))
    body = F.concat_ws("\n", F.concat(F.lit("## "), n.cast("string"), F.lit(". "), F.coalesce("title", F.lit("Untitled"))), *[line(label, c) for label, c in (("Company", "company"), ("Location", "location_text"), ("Link", "job_url")) if c in jobs.columns])
    parts = jobs.select(group, n.alias("n"), body.alias("body")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("p"))
    return parts.select(group, F.array_join(F.transform("p", lambda x: x.body), "\n\n").alias("markdown"))


def write_records(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """Matches in three forms: grouped by candidate, one a line, and a summary."""
    from ..operators.matching import grouped, summary

    grouped(matches).write.mode("overwrite").json(f"{path}/grouped")
    write_records(matches, f"{path}/matches")
    summary(matches).write.mode("overwrite").json(f"{path}/summary")


def artifact(portal: Column, run: Column, category: Column, name: Column, content: Column) -> dict[str, Column]:
    """Content cut to its limit, its hash and size, and an id that the same content gets again."""
    from ..functions.text import slug

    kept = F.left(F.coalesce(content, F.lit("")), F.lit(MOST_ARTIFACT_CHARS))
    sha = F.sha2(kept, 256)
    key = F.left(F.concat_ws(":", portal, run, category, slug(name, "a-z0-9._", "-", 120), F.left(sha, F.lit(16))), F.lit(512))
    return {"artifact_id": key, "sha256": sha, "size_bytes": F.octet_length(kept), "truncated": F.length(content) > MOST_ARTIFACT_CHARS, "content": kept}


def crawl_artifacts(results: DataFrame, key: str) -> DataFrame:
    """One row for each part of a crawl result that isn't null: html, text, error, screenshot."""
    parts = [F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("body")) for k in ("html", "text", "error", "screenshot") if k in results.columns]
    return results.select(key, F.explode(F.array(*parts)).alias("p")).where("p.body is not null").select(key, "p.kind", "p.body")


def write_run_summary(run: DataFrame, path: str, run_id: str, target: str) -> None:
    """A run's one row about itself, under its own name and as the latest of its target."""
    for name in (f"target={target}/run={run_id}", f"target={target}/latest"):
        write_records(run, f"{path}/{name}")


def run_summary(discovered: DataFrame, extracted: DataFrame, target: str, run_id: str, seconds: float, attempted: int | None = None) -> DataFrame:
    """(target, run_id, discovered_urls, attempted_urls, extracted_jobs, seconds); without a number of attempts it is that of extracted jobs."""
    n = extracted.agg(F.count(F.lit(1)).alias("extracted_jobs"))
    found = discovered.select("url").distinct().agg(F.count(F.lit(1)).alias("discovered_urls"))
    both = found.join(F.broadcast(n))
    tried = F.col("extracted_jobs") if attempted is None else F.lit(attempted).cast("long")
    return both.select(F.lit(target).alias("target"), F.lit(run_id).alias("run_id"), "discovered_urls", tried.alias("attempted_urls"), "extracted_jobs", F.lit(float(seconds)).alias("seconds"))


def write_comparison(rows: DataFrame, candidates: DataFrame, summary: DataFrame, path: str) -> None:
    """A comparison of rankings: job by job and candidate by candidate as CSV, the totals as JSON."""
    for name, df in (("jobs", rows), ("candidates", candidates)):
        df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/{name}")
    write_records(summary, f"{path}/summary")


def write_towers(towers: DataFrame, path: str, run_id: str) -> None:
    """Candidate towers as JSON lines, under the run and as the latest."""
    for name in (f"runs/run={run_id}", "latest"):
        write_records(towers, f"{path}/{name}")


def quarantined(payloads: DataFrame, valid: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that pass, and those that don't with their reason and whole payload as JSON."""
    ok = F.coalesce(valid, F.lit(False))
    bad = payloads.where(~ok).select(F.to_json(F.struct(*payloads.columns)).alias("payload"), reason.alias("reason"))
    return payloads.where(ok), bad


def event_rows(events: DataFrame, run_id: str) -> DataFrame:
    """Rows of an event log: when, what, of which run, and the rest as JSON."""
    rest = [c for c in events.columns if c not in ("ts", "event")]
    return events.select("ts", "event", F.lit(run_id).alias("run_session_id"), F.to_json(F.struct(*rest)).alias("data"))
