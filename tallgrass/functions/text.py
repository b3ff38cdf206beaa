"""Text as columns. All functions take and return columns and stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s is ASCII only unless (?U) is set.
SPACES = r"(?U)\s+"

# Patterns of contact signals and of section names.
# An e-mail's name begins where its run of characters does, or where the e-mail before ended: a run without @ is read once, not once from each place.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
SECTIONS = ("summary", "experience", "education", "skills", "projects", "certifications")
BULLET = r"^\s*(?:[-*•▪▫●◦‣❖]+|\d+[.)])\s*"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty: `a or b or c`."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def compact(c: Column) -> Column:
    """NUL as a space, each run of white space as one space, no white space at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\x00", " "), SPACES, " "))


def compact_lines(c: Column) -> Column:
    """Collapses blanks inside lines and more than two line ends in a row; keeps line breaks."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(lines, r" *\n *", "\n"), r"\n{3,}", "\n\n").alias("lines")


def head_and_tail(c: Column, most: int, head: float, marker: str) -> Column:
    """A text of over ``most`` characters as its head and its tail around a marker; a plain prefix where the marker leaves no room."""
    if most <= len(marker) + 20:
        return F.left(c, F.lit(most))
    room = most - len(marker)
    first = int(room * head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(first)), F.lit(marker), F.right(c, F.lit(room - first))))


def brief(c: Column, most: int) -> Column:
    """Compact text with a closing ellipsis where it is cut."""
    t = compact(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(max(0, most - 3)))), F.lit("...")))


def brief_list(c: Column, most: int) -> Column:
    return brief(F.array_join(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")), "; "), most)


def slug(c: Column, alphabet: str = "a-z0-9", joiner: str = "-", most: int = 80, fallback: str = "item") -> Column:
    """Lower-cased, runs outside ``alphabet`` as one ``joiner``, no joiner at the ends, cut to ``most``; ``fallback`` if empty."""
    body = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), f"[^{alphabet}]+", joiner)
    body = F.left(F.regexp_replace(body, f"^[{joiner}]+|[{joiner}]+$", ""), F.lit(most))
    return F.coalesce(F.nullif(body, F.lit("")), F.lit(fallback))


def email(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def clean(c: Column, most: int) -> Column:
    return F.nullif(F.left(compact(c), F.lit(most)), F.lit(""))


def json_block(c: Column) -> Column:
    """The JSON in a model's answer: code fences off, then the outermost braces."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(json)?\s*", ""), r"\s*```$", ""))
    return F.when(bare.startswith("{") | bare.startswith("["), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def header(c: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\W+", ""), r"[\s:\-]+$", "")
    return F.upper(F.regexp_replace(body, r"\s+", " "))


def is_bullet(c: Column) -> Column:
    return c.rlike(BULLET)


def without_bullet(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BULLET, ""))


def quality(c: Column) -> dict[str, Column]:
    """Signals of how well a text was recognised, and a verdict."""
    t = F.coalesce(c, F.lit(""))
    chars = F.length(t)
    alnum = chars - F.length(F.translate(t, ALNUM, ""))
    ratio = F.when(chars > 0, alnum / chars).otherwise(F.lit(0.0))
    odd = F.length(t) - F.length(F.replace(t, F.lit("\ufffd"), F.lit("")))
    sections = once(F.lower(t), lambda low: sum((low.contains(s).cast("int") for s in SECTIONS), F.lit(0)))
    return {
        "char_count": chars,
        "alnum_permille": F.floor(ratio * 1000).cast("long"),
        "replacement_chars": odd,
        "email_count": F.regexp_count(t, F.lit(EMAIL)),
        "phone_count": F.regexp_count(t, F.lit(PHONE)),
        "section_hits": sections,
        "verdict": F.when(chars < 200, "poor").when(ratio < 0.45, "poor").when((chars < 800) | (sections == 0), "fair").otherwise("good"),
    }


def contact(c: Column) -> dict[str, Column]:
    """The first twelve filled lines, the first e-mail and the first phone."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return {
        "head_lines": F.slice(lines, 1, 12),
        "email": F.nullif(F.lower(F.regexp_extract(c, f"({EMAIL})", 1)), F.lit("")),
        "phone": F.nullif(F.trim(F.regexp_extract(c, f"({PHONE})", 1)), F.lit("")),
    }


def string_list(c: Column) -> Column:
    """Trimmed items without blanks; null as an empty list."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def split_list(c: Column) -> Column:
    return string_list(F.split(c, r"[,;|]\s*"))


def keep_first(c: Column, key: Callable[[Column], Column]) -> Column:
    """Strings of a list, the first for each key, in order. A fold, so that the list is computed once."""
    pairs = F.transform(c, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    kept = F.aggregate(pairs, none, lambda s, p: F.when(F.exists(s, lambda q: q.k == p.k), s).otherwise(F.concat(s, F.array(p))))
    return F.transform(kept, lambda p: p.v)


def unique_by_lower(c: Column, most: int | None = None) -> Column:
    """The first of items that are equal but for case, in order; at most ``most`` of them."""
    kept = keep_first(c, F.lower)
    return F.slice(kept, 1, most) if most else kept
