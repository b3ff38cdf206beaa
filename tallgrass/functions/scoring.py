"""Scores of matches as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of the blended score, and weights of a payload's completeness.
VECTOR, SKILLS, PLACE = 0.82, 0.13, 0.05


def overlap(job: Column, candidate: Column) -> Column:
    """Share of a job's skills that a candidate has; 0 without skills."""
    return F.when(F.size(job) > 0, F.size(F.array_intersect(job, candidate)) / F.size(job)).otherwise(0.0)


def place_score(a: Column, b: Column) -> Column:
    """1 where one place's text holds the other, else the shared words of three letters or more over the smaller set."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([a-z]{3,})"), 1))
    least = F.least(F.size(tokens(x)), F.size(tokens(y)))
    shared = F.size(F.array_intersect(tokens(x), tokens(y)))
    filled = a.isNotNull() & b.isNotNull() & (x != "") & (y != "")
    return F.when(~filled, 0.0).when(x.contains(y) | y.contains(x), 1.0).when(least > 0, shared / least).otherwise(0.0)


def blended(vector: Column, skills: Column, place: Column) -> Column:
    return VECTOR * vector + SKILLS * F.least(F.lit(1.0), skills) + PLACE * place


def fallback(score: Column) -> Column:
    """60 to 95 over similarities of 0.45 to 0.72."""
    return 60 + 35 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - 0.45) / 0.27))


def whole_score(text: Column) -> Column:
    """0 to 100 from a text; 0 where it is no number."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(text.try_cast("double").cast("int"), F.lit(0))))


def completeness(filled: dict[str, Column]) -> Column:
    """How complete an extracted payload is: the sum of the weights of its filled fields."""
    weights = {"title": 5, "job_url": 3, "summary": 2, "location_text": 1, "employment_type": 1, "responsibilities": 2, "required_skills": 2}
    return sum((F.when(filled[k], w).otherwise(0) for k, w in weights.items() if k in filled), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of doubles of one length, summed in order; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
