"""Résumés: line kinds, role hints, skill groups, fallbacks, quality rules, merges of repeated parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import RANGE, date_range
from ..functions.text import contact, split_list, unique_by_lower

# Words of roles and of projects, names of span types, what a critical fault says.
ROLE = r"(?i)\b(engineer|developer|scientist|analyst|manager|consultant|architect|lead|intern|associate|officer|specialist|administrator|programmer)\b"
PROJECT_STARTS = ("title:", "project:", "project title:", "name:")
PROJECT_WORDS = ("chatbot", "rag", "engine", "system", "platform", "app", "application")
SPAN_TYPES = ("work_experience", "project", "education", "certification", "language", "skills", "summary", "contact", "achievement", "other")
SPAN_ALIASES = {
    "experience": "work_experience", "professional_experience": "work_experience", "employment": "work_experience", "employment_history": "work_experience", "work_history": "work_experience",
    "role": "work_experience", "job": "work_experience", "work_role": "work_experience", "projects": "project", "project_experience": "project", "educational": "education", "academic": "education",
    "academics": "education", "certifications": "certification", "certificate": "certification", "languages": "language", "technical_skills": "skills", "core_skills": "skills",
    "profile": "summary", "professional_summary": "summary", "career_summary": "summary", "header": "contact",
}
YEARS = r"(?i)(\d{1,2}(?:\.\d+)?)\+?\s+years"


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def is_role_line(c: Column) -> Column:
    return c.rlike(RANGE) | (c.rlike(ROLE) & (n_words(c) <= 12))


def is_project_line(c: Column, bullet: Column) -> Column:
    low = F.lower(F.trim(c))
    starts, words = F.lit(False), F.lit(False)
    for s in PROJECT_STARTS:
        starts = starts | low.startswith(s)
    for w in PROJECT_WORDS:
        words = words | low.contains(w)
    return (low != "") & (starts | (~bullet & (n_words(c) <= 14) & words))


def span_type(c: Column) -> Column:
    """A span's type under its usual name; unknown ones are 'other'."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("other")))), "[^a-z_]+", "_"), "^_+|_+$", "")
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPAN_ALIASES.items() for x in kv]), low), low)
    return F.when(named.isin(*SPAN_TYPES), named).otherwise("other")


def skill_groups(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, group_no, category, values_text): a group for each 'category: values' line, and one of all other lines at the end."""
    colon = F.col(line).contains(":")
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    named = rows.where(colon).select(key, n.alias("group_no"), F.trim(F.substring_index(line, ":", 1)).alias("category"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("values_text"))
    loose = rows.where(~colon).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), ", ").alias("values_text"))
    counts = named.groupBy(key).agg(F.max("group_no").alias("n"))
    rest = loose.join(counts, key, "left").select(key, (F.coalesce("n", F.lit(0)) + 1).alias("group_no"), F.lit("uncategorized").alias("category"), "values_text")
    return named.unionByName(rest)


def title_at_company(c: Column) -> dict[str, Column]:
    """Title, company and dates of 'title at company (dates)'."""
    regex = r"(?i)^(.+?)\s+at\s+(.+?)\s*\(([^)]+)\)\.?\s*$"
    part = lambda n: F.nullif(F.trim(F.regexp_extract(c, regex, n)), F.lit(""))
    return {"title": part(1), "company": part(2), **date_range(F.regexp_extract(c, regex, 3))}


def role_hints(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, title, company, location, ...): of the first line with dates in each block, with its neighbours.

    A neighbour that reads like a role is the title and the dated line is company and place; else the dated line is the
    title and the next line company and place.
    """
    by = Window.partitionBy(key).orderBy(order)
    near = rows.select(key, order, F.col(line).alias("here"), F.lead(line).over(by).alias("next"), F.lag(line).over(by).alias("last"))
    dated = near.where(F.col("here").rlike(RANGE)).withColumn("nth", F.row_number().over(by)).where("nth = 1")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("here", RANGE, ""), r"^[\s|,-]+", ""), r"[\s|,-]+$", "")
    role = lambda c: F.coalesce(F.col(c).rlike(ROLE) & (n_words(F.col(c)) <= 12), F.lit(False))
    title = F.when(role("next"), F.trim("next")).when(role("last"), F.trim("last"))
    place = F.when(title.isNotNull(), bare).otherwise(F.trim("next"))
    found = dated.select(key, F.coalesce(title, F.nullif(bare, F.lit(""))).alias("title"), place.alias("place"), *[c.alias(n) for n, c in date_range(F.col("here")).items()])
    tail = F.nullif(F.trim(F.regexp_replace("place", "^[^,]*,?", "")), F.lit(""))
    return found.select(key, "title", F.trim(F.substring_index("place", ",", 1)).alias("company"), tail.alias("location"), "start_date", "end_date", "is_current")


def root_profile(c: Column, skills_text: Column) -> dict[str, Column]:
    """Name, headline, contact, years and skills without a model: the first filled lines that hold no address or phone."""
    signals = contact(c)
    plain = F.filter(signals["head_lines"], lambda x: ~x.contains("@") & ~x.rlike(r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"))
    return {
        "full_name": F.left(F.try_element_at(plain, F.lit(1)), F.lit(120)), "headline": F.left(F.try_element_at(plain, F.lit(2)), F.lit(160)), "email": signals["email"], "phone": signals["phone"],
        "total_experience_years": F.nullif(F.regexp_extract(c, YEARS, 1), F.lit("")).try_cast("double"), "primary_skills": unique_by_lower(F.slice(split_list(skills_text), 1, 35)),
    }


def current_role(items: Column) -> Column:
    """The first item that is current or ends at 'present', else the first one."""
    now = F.filter(items, lambda e: e.is_current.eqNullSafe(True) | (F.lower(F.trim(F.coalesce(e.end_date, F.lit("")))) == "present"))
    return F.when(F.size(now) > 0, F.try_element_at(now, F.lit(1))).otherwise(F.try_element_at(items, F.lit(1)))


def quality_faults(has: dict[str, Column], profile: dict[str, Column]) -> Column:
    """Rules that a parse breaks: what its source has (sections, years) and the profile lacks."""
    strong = F.exists(profile["experience"], lambda e: e.title.isNotNull() & e.company.isNotNull() & (e.start_date.isNotNull() | e.is_current.eqNullSafe(True)))
    loose = F.exists(profile["experience"], lambda e: e.title.isNull() & e.company.isNull() & (F.size(e.responsibilities) > 0))
    rules = [
        (has["work"] & ~strong, "no_strong_role"), (has["work"] & profile["current_title"].isNull(), "no_current_title"), (has["work"] & profile["current_company"].isNull(), "no_current_company"),
        (has["work"] & loose, "project_in_experience"), (has["projects"] & (F.size(profile["projects"]) == 0), "no_projects"), (has["education"] & (F.size(profile["education"]) == 0), "no_education"),
        (has["skills"] & (F.size(profile["skills"]) == 0), "no_skills"), (has["years"] & profile["total_experience_years"].isNull(), "no_years"), (F.size(profile["domains"]) == 0, "no_domains"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules]), lambda x: x.isNotNull())


CRITICAL = ("no_strong_role", "project_in_experience", "no_years")


def merged_parses(first: DataFrame, again: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """A first parse filled from a second one: its values stay unless empty, lists are joined, the first of each but for case."""
    j = first.alias("x").join(again.alias("y"), key, "full")
    own = lambda c: F.coalesce(F.when(F.trim(F.col(f"x.{c}").cast("string")) != "", F.col(f"x.{c}")), F.col(f"y.{c}"))
    empty = F.array().cast("array<string>")
    both = lambda c: unique_by_lower(F.concat(F.coalesce(F.col(f"x.{c}"), empty), F.coalesce(F.col(f"y.{c}"), empty)))
    return j.select(key, *[own(c).alias(c) for c in scalars], *[both(c).alias(c) for c in lists])
