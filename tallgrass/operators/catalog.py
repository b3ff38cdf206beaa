"""The job catalog: what is visible, filters, sorts, pages and facets.

A catalog table has job_id, title, company, location_text, employment_type, apply_url, job_url, source_url, url,
description, summary, required_skills, preferred_skills, skills, posted_at, first_seen_at, created_at, is_active,
catalog_visible, validation_status; columns that are absent count as null.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled

# Fixed values of the catalog: timelines in days, sorts, work modes, statuses and titles that hide a row.
FRESHNESS = {"1d": 1, "3d": 3, "1w": 7, "2w": 14, "3w": 21, "1mo": 30, "older_than_1mo": None}
SORTS = ("newest", "oldest", "title_asc", "title_desc")
WORK_MODES = {"remote": "remote", "hybrid": "hybrid", "on_site": "on_site", "onsite": "on_site", "on-site": "on_site", "on site": "on_site"}
REMOTE = r"\b(remote|work[\s-]?from[\s-]?home|wfh|anywhere)\b"
HYBRID = r"\bhybrid\b"
BAD_STATUS = ("invalid", "invalid_missing_title", "invalid_missing_company", "invalid_missing_url")
PLACEHOLDERS = r"(?i)^\s*(untitled\s+job|n/a|na|none|null|unknown)\s*$"
MOST_FILTER_VALUES, MOST_FACET_VALUES = 12, 8


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _filled(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def _any(tests: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def freshness_at(df: DataFrame) -> Column:
    return F.coalesce(*[_has(df, c, "timestamp") for c in ("posted_at", "first_seen_at", "created_at")])


def visible(df: DataFrame) -> Column:
    """Active and visible unless said otherwise (null is not false), no bad status, some title, company and address, no placeholder title."""
    named = lambda *names: _any(_filled(_has(df, n)) for n in names)
    return (
        ~_has(df, "is_active", "boolean").eqNullSafe(False)
        & ~_has(df, "catalog_visible", "boolean").eqNullSafe(False)
        & (_has(df, "validation_status").isNull() | ~_has(df, "validation_status").isin(*BAD_STATUS))
        & named("title", "job_title")
        & named("company", "company_name", "employer")
        & named("job_url", "apply_url", "source_url", "url")
        & ~_any(F.coalesce(_has(df, n).rlike(PLACEHOLDERS), F.lit(False)) for n in ("title", "job_title"))
    )


def snapshot(df: DataFrame) -> DataFrame:
    """One compact row for each job, from whichever of the alternative columns is filled."""
    trimmed = lambda *names: F.trim(F.coalesce(first_filled(*[_has(df, n) for n in names]), F.lit("")))
    return df.select(
        "job_id", trimmed("title", "job_title").alias("title"), trimmed("company", "company_name", "employer").alias("company"),
        trimmed("location_text", "location").alias("location_text"), first_filled(*[_has(df, n) for n in ("apply_url", "job_url", "source_url", "url")]).alias("apply_url"),
        _has(df, "employment_type").alias("employment_type"), freshness_at(df).alias("freshness_at"),
        F.when(_has(df, "posted_at", "timestamp").isNotNull(), "source_posted_date").otherwise("first_seen_at").alias("freshness_source"),
    )


def search(df: DataFrame, text: str | None) -> Column:
    """A literal, whatever its case, inside any of nine texts or of the items of three lists."""
    needle = (text or "").strip().lower()
    if not needle:
        return F.lit(True)
    inside = lambda c: F.coalesce(F.lower(c).contains(needle), F.lit(False))
    texts = ("title", "job_title", "company", "company_name", "employer", "location", "location_text", "description", "summary")
    lists = ("required_skills", "preferred_skills", "skills")
    return _any([*(inside(F.col(c)) for c in texts if c in df.columns), *(F.coalesce(F.exists(F.col(c), inside), F.lit(False)) for c in lists if c in df.columns)])


def filter_values(values: Iterable[str | None] | None) -> list[str]:
    """Spaces collapsed, blanks out, the first of each but for case, at most twelve."""
    kept: dict[str, str] = {}
    for v in (" ".join(str(v or "").split()) for v in values or ()):
        if v:
            kept.setdefault(v.casefold(), v)
    return list(kept.values())[:MOST_FILTER_VALUES]


def work_modes(values: Iterable[str] | None) -> list[str]:
    return list(dict.fromkeys(m for v in filter_values(values) if (m := WORK_MODES.get(v.casefold()))))


def freshness_choice(value: str | None) -> str:
    v = (value or "").strip().lower()
    return v if v in FRESHNESS else ""


def sort_choice(value: str | None) -> str:
    v = (value or "").strip().lower()
    return v if v in SORTS else "newest"


def in_modes(place: Column, modes: list[str]) -> Column:
    """A place may be remote and hybrid at once; on site is a filled place that is neither."""
    remote, hybrid = (F.coalesce(place.rlike(f"(?i){p}"), F.lit(False)) for p in (REMOTE, HYBRID))
    tests = {"remote": remote, "hybrid": hybrid, "on_site": _filled(place) & ~remote & ~hybrid}
    return _any(tests[m] for m in modes) if modes else F.lit(True)


def equals_any(c: Column, values: list[str]) -> Column:
    """Equal to one of the values but for case and outer space."""
    return F.coalesce(F.lower(F.trim(c)).isin(*[v.lower() for v in values]), F.lit(False)) if values else F.lit(True)


def has_skill(df: DataFrame, values: list[str]) -> Column:
    if not values:
        return F.lit(True)
    return _any(F.coalesce(F.exists(F.col(c), lambda x: equals_any(x, values)), F.lit(False)) for c in ("required_skills", "preferred_skills", "skills") if c in df.columns)


def fresh(at: Column, choice: str, now: Column) -> Column:
    """Not older than the timeline says; older than thirty days for the last one. A null time is in none."""
    if not choice:
        return F.lit(True)
    cut = now - F.make_dt_interval(days=F.lit(FRESHNESS[choice] or 30))
    return F.coalesce(at < cut if FRESHNESS[choice] is None else at >= cut, F.lit(False))


@dataclass
class Request:
    """What a catalog page is asked for; unknown choices fall back, as the normalisers say."""

    q: str | None = None
    freshness: str | None = None
    work_modes: list[str] = field(default_factory=list)
    employment_types: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    sort: str = "newest"
    limit: int = 50
    offset: int = 0


def dimensions(df: DataFrame, r: Request, now: Column) -> dict[str, Column]:
    """One predicate for each dimension of a request."""
    return {
        "freshness": fresh(freshness_at(df), freshness_choice(r.freshness), now),
        "work_modes": in_modes(F.col("location_text"), work_modes(r.work_modes)),
        "employment_types": equals_any(F.col("employment_type"), filter_values(r.employment_types)),
        "locations": equals_any(F.col("location_text"), filter_values(r.locations)),
        "companies": equals_any(F.col("company"), filter_values(r.companies)),
        "skills": has_skill(df, filter_values(r.skills)),
    }


def matching(df: DataFrame, r: Request, now: Column, but: str | None = None) -> DataFrame:
    """Visible rows that the search and all dimensions (``but`` one) let through."""
    tests = [p for k, p in dimensions(df, r, now).items() if k != but]
    return df.where(functools.reduce(operator.and_, tests, visible(df) & search(df, r.q)))


def ordered(df: DataFrame, sort: str | None) -> DataFrame:
    """Null sorts lowest. The job's id breaks all ties."""
    at = freshness_at(df)
    by = {"newest": [at.desc_nulls_last(), F.col("title").asc_nulls_first()], "oldest": [at.asc_nulls_first(), F.col("title").asc_nulls_first()], "title_asc": [F.col("title").asc_nulls_first()], "title_desc": [F.col("title").desc_nulls_last()]}
    return df.orderBy(*by[sort_choice(sort)], F.col("company").asc_nulls_first(), F.col("job_id").asc_nulls_first())


def page(df: DataFrame, r: Request, now: Column) -> DataFrame:
    """The rows of a page, checked once more on their snapshot, so a page may be shorter than its limit."""
    rows = ordered(matching(df, r, now), r.sort).offset(max(0, r.offset)).limit(min(100, max(1, r.limit or 50)))
    shown = snapshot(rows)
    return shown.where(_filled(F.col("title")) & ~F.col("title").rlike(PLACEHOLDERS) & (F.col("company") != "") & _filled(F.col("apply_url")))


def scalar_facet(df: DataFrame, column: str, most: int = MOST_FACET_VALUES) -> DataFrame:
    """(value, count) of filled values, commonest first, then by value."""
    return df.where(_filled(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(most)


def skill_facet(df: DataFrame, most: int = MOST_FACET_VALUES) -> DataFrame:
    """As scalar_facet, over the set of each row's three lists."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(_has(df, c, "array<string>"), empty) for c in ("required_skills", "preferred_skills", "skills")]
    return scalar_facet(df.select(F.explode(functools.reduce(F.array_union, lists)).alias("skill")), "skill", most)


def work_mode(place: Column) -> Column:
    """One mode for a place, hybrid before remote before on site."""
    return F.when(place.rlike(f"(?i){HYBRID}"), "hybrid").when(place.rlike(f"(?i){REMOTE}"), "remote").when(place.rlike(r"\S"), "on_site")


def work_mode_facet(df: DataFrame) -> DataFrame:
    return df.select(work_mode(F.col("location_text")).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def freshness_facet(df: DataFrame, now: Column) -> DataFrame:
    """Rows of each timeline from one pass; timelines hold one another."""
    at = freshness_at(df)
    sums = df.agg(*[F.count_if(fresh(at, c, now)).alias(c) for c in FRESHNESS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).alias("count")) for c in FRESHNESS])).alias("f")).select("f.*")


def _tagged(values: Column, label: Column) -> Column:
    return F.transform(values, lambda v: F.struct(label, v.alias("value")))


def facets(df: DataFrame, r: Request, now: Column) -> DataFrame:
    """(dimension, value, count) of all facets, each without its own dimension's filter.

    The base rows are read once: each row is tagged with the dimensions whose other filters it passes, exploded to its
    facet values, and counted in one aggregate.
    """
    tests = dimensions(df, r, now)
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(_has(df, c, "array<string>"), empty) for c in ("required_skills", "preferred_skills", "skills")]
    one = lambda c: F.when(_filled(c), F.array(c)).otherwise(empty)
    at = freshness_at(df)
    values = {
        "freshness": F.filter(F.array(*[F.when(fresh(at, c, now), F.lit(c)) for c in FRESHNESS]), lambda x: x.isNotNull()),
        "work_modes": one(work_mode(F.col("location_text"))),
        "employment_types": one(F.col("employment_type")),
        "locations": one(F.col("location_text")),
        "companies": one(F.col("company")),
        "skills": F.filter(functools.reduce(F.array_union, lists), _filled),
    }
    base = df.where(visible(df) & search(df, r.q)).withColumns({f"passes_{k}": p for k, p in tests.items()})
    parts = []
    for name, vals in values.items():
        others = functools.reduce(operator.and_, [F.col(f"passes_{k}") for k in tests if k != name], F.lit(True))
        label = F.lit(name).alias("dimension")
        parts.append(_tagged(F.when(others, vals).otherwise(empty), label))
    counts = base.select(F.explode(F.concat(*parts)).alias("f")).groupBy("f.dimension", "f.value").agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("count"), "value"))
    # timelines and work modes have fewer values than that; a plain bound lets each task cut its groups before the shuffle
    return counts.withColumn("place", rank).where(F.col("place") <= MOST_FACET_VALUES).drop("place")
