"""Résumés in one canonical shape: sections, blocks of evidence with the ids of their lines, what can be said of a block without a parse, and the merge of two parses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import RANGE
from ..functions.text import unique_by_lower, without_bullet
from .resumes import is_project_line, is_role_line, role_hints, skill_groups, title_at_company

MOST_BLOCKS = 20
#: Lines that a section and the blocks of each kind hold, their bullets, and the lines that make a role's evidence.
SECTION_LINES, ROLE_EVIDENCE, ROLE_BULLETS = 80, 30, 18
PROJECT_LINES, PROJECT_BULLETS, SIMPLE_LINES = 35, 12, 25
SPAN_LINES, SPAN_CONTEXT, SPAN_BULLETS = 90, 15, 20
#: Kinds of section and the blocks they are cut into.
KINDS = {"work_experience": "role", "projects": "project", "education": "education", "certifications": "certifications", "achievements": "achievements", "languages": "languages", "skills": "skill"}


def with_signs(rows: DataFrame) -> DataFrame:
    """Adds ``bare`` (the line without its bullet) and ``dates`` (all ranges in it) to rows of line and is_bullet."""
    return rows.withColumn("bare", F.when(F.col("is_bullet"), without_bullet(F.col("line"))).otherwise(F.col("line"))).withColumn("dates", F.regexp_extract_all("line", F.lit(RANGE), 0))


_LINE = ("line_no", "line_id", "bare", "is_bullet", "dates", "line")


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct(*_LINE)))


def _shown(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(x.line_id.alias("line_id"), x.bare.alias("text"), x.is_bullet.alias("is_bullet"), x.dates.alias("date_ranges")))


def _joined(lines: Column, field: str, most: int) -> Column:
    return F.array_join(F.transform(F.slice(lines, 1, most), lambda x: x[field]), "\n")


# --- spans ----------------------------------------------------------------------------------


def lines_of_spans(spans: DataFrame, rows: DataFrame, key: str, *, most: int | None = None, size: int = 64) -> DataFrame:
    """Each span's columns with each line in it (at most its first ``most``).

    Lines are dealt into bins of ``size`` and spans meet the bins that they reach, so a document of a million lines is spread over
    its bins and what is compared grows with what comes out.
    """
    last = F.col("end_line") if most is None else F.least("end_line", F.col("start_line") + most - 1)
    reach = spans.withColumn("last_line", last).where("start_line <= last_line")
    binned = reach.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("last_line") / size))))
    return binned.join(rows.withColumn("bin", F.floor(F.col("line_no") / size)), [key, "bin"]).where("line_no between start_line and last_line").drop("bin", "last_line")


def span_blocks(spans: DataFrame, rows: DataFrame, key: str, prefix: str = "span") -> DataFrame:
    """A block of evidence for each span that holds a line: block_id, source_section, span_type, confidence, ids of the first and last line, lines, context_lines, bullets, date_ranges, has_date_evidence, evidence_text.

    spans: key, span_no, span_type, start_line, end_line, confidence and, if there, label; rows: key, line_no, line_id, line, is_bullet.
    """
    label = F.coalesce("label", F.lit("LLM_DISCOVERED_SPAN")) if "label" in spans.columns else F.lit("LLM_DISCOVERED_SPAN")
    held = lines_of_spans(spans.withColumn("source_section", label), with_signs(rows), key, most=SPAN_LINES)
    packed = held.groupBy(key, "span_no", "source_section", "span_type", "confidence").agg(_in_order().alias("l"))
    lines = F.col("l")
    return packed.select(
        key, "span_no", F.concat_ws("_", F.lit(f"llm_{prefix}"), "span_type", "span_no").alias("block_id"), "source_section", "span_type", "confidence", F.element_at(lines, 1).line_id.alias("start_line_id"), F.element_at(lines, -1).line_id.alias("end_line_id"), _shown(lines).alias("lines"),
        _shown(F.slice(F.filter(lines, lambda x: ~x.is_bullet), 1, SPAN_CONTEXT)).alias("context_lines"), _shown(F.slice(F.filter(lines, lambda x: x.is_bullet), 1, SPAN_BULLETS)).alias("bullets"),
        unique_by_lower(F.flatten(F.transform(lines, lambda x: x.dates))).alias("date_ranges"), F.exists(lines, lambda x: F.size(x.dates) > 0).alias("has_date_evidence"), F.trim(_joined(lines, "line", SPAN_LINES)).alias("evidence_text"),
    )


# --- sections and blocks --------------------------------------------------------------------


def _role_numbers(rows: DataFrame, key: str) -> DataFrame:
    """Adds block_no to the lines of work sections: a role begins where a line reads like one, unless the block so far is a header of at most three lines without bullets, and dates
    are on this line or were before it.

    A fold, as each answer depends on the block so far; lines stream through it in order and it holds four numbers.
    """
    fields = [f"`{n}` {kind}" for n, kind in rows.dtypes]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, no, n, bullets, dated = None, 0, 0, False, False
        for b in batches:
            where = list(zip(b.column(key).to_pylist(), b.column("section_no").to_pylist(), strict=True))
            flags = zip(*(b.column(c).to_pylist() for c in ("starts", "dated", "is_bullet")), strict=True)
            out = np.empty(b.num_rows, np.int64)
            for i, (here, (starts, has_dates, bullet)) in enumerate(zip(where, flags, strict=True)):
                if here != at:
                    at, no, n, bullets, dated = here, 1, 0, False, False
                elif starts and not (not bullets and n <= 3 and (has_dates or dated)):
                    no, n, bullets, dated = no + 1, 0, False, False
                n += 1
                dated = dated or has_dates
                bullets = bullets or (bullet and not starts)
                out[i] = no
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "block_no"])

    return rows.repartition(key).sortWithinPartitions(key, "section_no", "line_no").mapInArrow(fold, ", ".join([*fields, "block_no long"]))


def resume_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Blocks of evidence of all sections but skills, at most twenty a section: key, section_no, kind, block_no, lines, bullets, context_lines, date_ranges, has_date_evidence, evidence_text.

    Work is cut where roles begin, projects where a line reads like a title (into simple blocks where none or one does), the others where a bullet or a line with dates begins something new.
    rows: key, section_no, section, line_no, line_id, line, is_bullet; headings left out.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    signs = with_signs(rows).withColumn("kind", F.try_element_at(kinds, F.col("section"))).where("kind is not null and kind <> 'skill'").withColumn("dated", F.size("dates") > 0)
    work = _role_numbers(signs.where("kind = 'role'").withColumn("starts", is_role_line(F.col("bare"))), key)
    by = Window.partitionBy(key, "section_no").orderBy("line_no")
    other = signs.where("kind <> 'role'").withColumn("starts", is_project_line(F.col("bare"), F.col("is_bullet")))
    other = other.withColumn("later", F.row_number().over(by) > 1).withColumn("project_no", F.sum((F.col("starts") & F.col("later")).cast("long")).over(by) + 1).withColumn("simple_no", F.sum(((F.col("is_bullet") | F.col("dated")) & F.col("later")).cast("long")).over(by) + 1)
    titled = F.max("project_no").over(Window.partitionBy(key, "section_no")) > 1
    other = other.withColumn("titled", titled).withColumn("block_no", F.when((F.col("kind") == "project") & F.col("titled"), F.col("project_no")).otherwise(F.col("simple_no")))
    every = work.withColumn("titled", F.lit(True)).unionByName(other.select(*work.columns, "titled")).where(F.col("block_no") <= MOST_BLOCKS)
    fields = F.struct(*_LINE, "starts")
    packed = every.groupBy(key, "section_no", "kind", "block_no", "titled").agg(F.array_sort(F.collect_list(fields)).alias("l"))
    role, project, lines = F.col("kind") == "role", (F.col("kind") == "project") & F.col("titled"), F.col("l")
    most = F.when(role, F.size(lines)).when(project, PROJECT_LINES).otherwise(SIMPLE_LINES)
    kept = F.slice(lines, F.lit(1), most)
    bullets = F.filter(kept, lambda x: x.is_bullet & ~(role & x.starts))
    return packed.select(
        key, "section_no", "kind", "block_no", _shown(kept).alias("lines"), _shown(F.slice(bullets, F.lit(1), F.when(role, ROLE_BULLETS).when(project, PROJECT_BULLETS).otherwise(0))).alias("bullets"),
        _shown(F.when(role, F.filter(kept, lambda x: ~x.is_bullet)).otherwise(F.slice(kept, 1, 0))).alias("context_lines"), F.array_distinct(F.flatten(F.transform(kept, lambda x: x.dates))).alias("date_ranges"), F.exists(kept, lambda x: F.size(x.dates) > 0).alias("has_date_evidence"),
        F.when(role, _joined(lines, "bare", ROLE_EVIDENCE)).when(project, _joined(lines, "line", PROJECT_LINES)).otherwise(_joined(lines, "line", SIMPLE_LINES)).alias("evidence_text"),
    )


def canonical_resume(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_count, section_count, header_lines, sections): each résumé as one nested row.

    A section has section_id, canonical_type, original_heading, line_count, its first eighty lines and its blocks or skill groups, each with an id. rows: key, line_no, line_id, line, is_bullet, is_heading,
    section_no (0 before the first heading), section (``header`` before it), heading. A heading without lines is a section; a document without lines has no row.
    """
    body = rows.where("not is_heading")
    nth = F.row_number().over(Window.partitionBy(key, "section_no", "is_heading").orderBy("line_no"))
    shown = with_signs(rows).withColumn("nth", nth)
    first = shown.groupBy(key, "section_no", "section", "heading").agg(F.count_if(~F.col("is_heading")).alias("line_count"), F.array_sort(F.collect_list(F.when(~F.col("is_heading") & (F.col("nth") <= SECTION_LINES), F.struct(*_LINE)))).alias("l"))
    led = F.max((F.col("section_no") == 0).cast("int")).over(Window.partitionBy(key))
    number = F.when(F.col("section_no") == 0, 0).otherwise(F.col("section_no") + led)
    first = first.withColumn("section_id", F.concat_ws("_", F.lit("sec"), F.lpad(number.cast("string"), 3, "0"), "section"))
    made = resume_blocks(body, key)
    block = F.struct("block_no", "kind", "lines", "bullets", "context_lines", "date_ranges", "has_date_evidence", "evidence_text")
    made = made.groupBy(key, "section_no").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    skills = body.where("section = 'skills'").select(F.struct(key, "section_no").alias("of"), "line_no", with_bare().alias("bare"))
    groups = skill_groups(skills, "of", "line_no", "bare").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("group_no", "category", "values_text"))).alias("groups"))
    groups = groups.select(F.col(f"of.{key}").alias(key), "of.section_no", "groups")
    whole = first.join(made, [key, "section_no"], "left").join(groups, [key, "section_no"], "left")
    named = F.transform(F.coalesce("blocks", F.array()), lambda b: b.withField("block_id", F.concat_ws("_", "section_id", b.kind, F.lpad(b.block_no.cast("string"), 3, "0"))))
    section = F.struct("section_no", "section_id", F.col("section").alias("canonical_type"), F.col("heading").alias("original_heading"), "line_count", _shown(F.col("l")).alias("lines"), named.alias("blocks"), F.coalesce("groups", F.array()).alias("skill_groups"))
    out = whole.groupBy(key).agg(F.sum(F.col("line_count")).alias("line_count"), F.array_sort(F.collect_list(section)).alias("sections"))
    header = F.filter("sections", lambda s: s.canonical_type == "header")
    return out.select(key, "line_count", F.size("sections").alias("section_count"), F.slice(F.flatten(F.transform(header, lambda s: s.lines)), 1, 20).alias("header_lines"), "sections")


def with_bare() -> Column:
    return F.when(F.col("is_bullet"), without_bullet(F.col("line"))).otherwise(F.col("line"))


# --- without a parse ------------------------------------------------------------------------

# Words of degrees, and how project titles begin.
DEGREE = r"(?i)\b(B\.?Tech|M\.?Tech|Bachelor|Master|MBA|B\.S\.|M\.S\.|Ph\.?D|degree)\b"
PROJECT_NAME = r"(?i)^(title|project|project title|name)\s*:\s*"


def role_block_hints(blocks: DataFrame, key: str) -> DataFrame:
    """(key, title, company, location, start_date, end_date, is_current) of role blocks (key, lines, evidence_text): from 'title at company (dates)', else from the first line with dates and its neighbours."""
    each = blocks.select(key, F.posexplode("lines").alias("nth", "x")).select(key, "nth", F.col("x.text").alias("line"))
    near = role_hints(each, key, "nth", "line").withColumnRenamed("title", "near_title").select(key, "near_title", F.struct("company", "location", "start_date", "end_date", "is_current").alias("near"))
    at = title_at_company(F.col("evidence_text"))
    same = blocks.select(key, *[c.alias(n) for n, c in at.items()]).withColumn("same", F.col("title").isNotNull())
    j = same.join(near, key, "left")
    pick = lambda c, other: F.when(F.col("same"), F.col(c)).otherwise(F.col(other)).alias(c)
    place = F.when(~F.col("same"), F.col("near.location")).alias("location")
    return j.select(key, pick("title", "near_title"), pick("company", "near.company"), place, pick("start_date", "near.start_date"), pick("end_date", "near.end_date"), pick("is_current", "near.is_current"))


def fallback_experience(title: Column, company: Column, location: Column, start: Column, end: Column, is_current: Column, evidence: Column) -> Column:
    """A role from hints, null without any of title, company and dates."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    there = filled(title) | filled(company) | filled(start) | filled(end) | F.coalesce(is_current, F.lit(False))
    return F.when(there, F.struct(company.alias("company"), title.alias("title"), location.alias("location"), start.alias("start_date"), end.alias("end_date"), is_current.alias("is_current"), F.left(evidence, F.lit(1000)).alias("evidence_text")))


def fallback_project(evidence: Column) -> Column:
    """A project: the first line without 'title:' as its name, the next three as its description; null without a name."""
    lines = F.split(F.trim(evidence), "\n")
    name = F.trim(F.regexp_replace(F.trim(F.element_at(lines, 1)), PROJECT_NAME, ""))
    more = F.filter(F.transform(F.slice(lines, 2, 3), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(name != "", F.struct(F.left(name, F.lit(180)).alias("name"), F.nullif(F.left(F.array_join(more, " "), F.lit(250)), F.lit("")).alias("description"), F.left(F.trim(evidence), F.lit(1000)).alias("evidence_text")))


def fallback_education(evidence: Column) -> Column:
    """A degree: the first line with a degree's word, and the first other line as the institution; null without lines."""
    lines = F.transform(F.filter(F.split(F.trim(evidence), "\n"), lambda x: F.trim(x) != ""), lambda x: F.btrim(x, F.lit(" •❖-\t")))
    degree = F.filter(lines, lambda x: x.rlike(DEGREE))
    other = F.filter(lines, lambda x: ~x.rlike(DEGREE))
    return F.when(F.size(lines) > 0, F.struct(F.try_element_at(other, F.lit(1)).alias("institution"), F.try_element_at(degree, F.lit(1)).alias("degree"), F.left(F.trim(evidence), F.lit(1000)).alias("evidence_text")))


# --- two parses -----------------------------------------------------------------------------

IDENTITY = ("name", "title", "company", "institution", "degree", "start_date", "end_date")


def identity(item: Column, fields: list[str]) -> Column:
    """What tells items apart: name, title, company, institution, degree and dates, but for case; those that an item hasn't are blank."""
    return F.concat_ws("|", *[F.lower(F.trim(F.coalesce(item[f].cast("string"), F.lit("")))) if f in fields else F.lit("") for f in IDENTITY])


def retry_merged(first: DataFrame, again: DataFrame, key: str, *, scalars: tuple[str, ...] = (), structs: tuple[str, ...] = (), lists: tuple[str, ...] = (), items: tuple[str, ...] = ("experience", "projects", "education")) -> DataFrame:
    """A parse after its retry: key and all columns named.

    Filled scalars and fields of structs of the retry win, else the first parse's stay. Lists of texts are joined, the first of each but for case. Lists of items are the retry's, then those of the first parse whose
    identity isn't there yet; an empty side changes nothing. A retry's ``experience`` with a role of title, company and a date replaces the first parse's whole. Either side may lack a key. Items are told apart
    by an exploded join on (key, identity), so long lists cost no more than their length.
    """
    a, b = first.alias("a"), again.alias("b")
    j = a.join(b, key, "full")
    filled = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    out = [key]
    for c in scalars:
        out.append(F.coalesce(filled(F.col(f"b.{c}")), F.col(f"a.{c}")).alias(c))
    for c in structs:
        fields = first.schema[c].dataType.names
        out.append(F.struct(*[F.coalesce(filled(F.col(f"b.{c}.{f}")) if dict(first.select(f"{c}.*").dtypes)[f] == "string" else F.col(f"b.{c}.{f}"), F.col(f"a.{c}.{f}")).alias(f) for f in fields]).alias(c))
    for c in lists:
        none = F.array().cast("array<string>")
        out.append(unique_by_lower(F.concat(F.coalesce(F.col(f"a.{c}"), none), F.coalesce(F.col(f"b.{c}"), none))).alias(c))
    whole = j.select(*out)
    for c in items:
        whole = whole.join(_merged_items(first, again, key, c), key, "left")
        kind = first.schema[c].dataType.simpleString()
        whole = whole.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return whole


def _merged_items(first: DataFrame, again: DataFrame, key: str, column: str) -> DataFrame:
    fields = first.schema[column].dataType.elementType.names
    every = None
    for side, rows in ((0, again), (1, first)):
        one = rows.select(key, F.lit(side).alias("side"), F.posexplode(column).alias("nth", "item")).withColumn("item_id", identity(F.col("item"), fields))
        every = one if every is None else every.unionByName(one)
    if column == "experience":
        has = lambda f: F.coalesce(F.trim(F.col(f"item.{f}").cast("string")), F.lit("")) != ""
        current = F.coalesce(F.col("item.is_current"), F.lit(False)) if "is_current" in fields else F.lit(False)
        every = every.withColumn("core", (F.col("side") == 0) & has("company") & has("title") & (has("start_date") | has("end_date") | current))
        every = every.withColumn("core", F.max("core").over(Window.partitionBy(key))).where((F.col("side") == 0) | ~F.col("core"))
    # the retry's items all stay; of the first parse's the first of each identity that the retry hasn't
    groups = every.groupBy(key, "item_id").agg(F.min("side").alias("least"), F.min(F.struct("side", "nth")).alias("best"))
    stays = every.join(groups, [key, "item_id"]).where((F.col("side") == 0) | ((F.col("least") == 1) & (F.struct("side", "nth") == F.col("best"))))
    return stays.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "nth", "item"))), lambda x: x.item).alias(column))
