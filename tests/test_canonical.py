"""Résumé blocks against plain loops, and spans over a very long document."""

from random import Random

from pyspark.sql import functions as F
from tallgrass.operators import canonical as ca
from tallgrass.operators import documents as d

LINES = ["Aldi, Batavia, IL Sep 2023 - Present", "Data Scientist - AI/ML", "- built things", "plain words here", "- Engineer at X (2019 - 2021)", "Lead Developer", "2. wrote docs", "Fifth Third Bank, Cincinnati, OH", "a much longer line that names a manager but has far more than the twelve words"]


def plain_roles(lines):
    out, now = [], None
    for text, bullet, starts, dated in lines:
        if now and starts and not (not now["bullets"] and now["n"] <= 3 and (dated or now["dated"])):
            now = None
        if now is None:
            now = {"n": 0, "bullets": False, "dated": False, "text": []}
            out.append(now)
        now["n"] += 1
        now["dated"] |= dated
        now["bullets"] |= bullet and not starts
        now["text"].append(text)
    return ["\n".join(b["text"]) for b in out]


def test_roles_as_a_plain_loop(spark):
    rng, rows = Random(1), []
    for doc in range(40):
        rows += [(doc, n, f"L{n:04d}", x := rng.choice(LINES), x[0] in "-2", 1, "work_experience") for n in range(1, rng.randrange(2, 25))]
    frame = spark.createDataFrame(rows, "id long, line_no int, line_id string, line string, is_bullet boolean, section_no int, section string")
    signs = ca.with_signs(frame).select("id", "line_no", "bare", "is_bullet", ca.is_role_line(F.col("bare")).alias("s"), (F.size("dates") > 0).alias("d")).collect()
    got = {}
    for r in ca.resume_blocks(frame, "id").orderBy("id", "block_no").collect():
        got.setdefault(r.id, []).append(r.evidence_text)
        assert [x.line_id for x in r.lines] == sorted(x.line_id for x in r.lines) and r.block_no == len(got[r.id])
    for doc in range(40):
        mine = sorted((r for r in signs if r.id == doc), key=lambda r: r.line_no)
        assert got.get(doc, []) == plain_roles([(r.bare, r.is_bullet, r.s, r.d) for r in mine])[:20]
    assert ca.resume_blocks(frame.limit(0), "id").count() == 0


def test_a_whole_resume(spark):
    text = ["Jo Doe", "jo@x.org", "WORK EXPERIENCE", "Data Scientist at Acme (Jan 2020 - Present).", "- models", "PROJECTS", "Title: Search", "finds things", "- fast", "Chatbot platform", "talks", "EDUCATION", "Master of Arts 2001 - 2003", "MIT", "SKILLS", "Languages: Go, SQL", "- Spark", "HOBBIES"]
    types = {"WORK EXPERIENCE": "work_experience", "PROJECTS": "projects", "EDUCATION": "education", "SKILLS": "skills", "HOBBIES": "other"}
    rows = d.lines(spark.createDataFrame([(1, "\n".join(text)), (2, None), (3, "PROJECTS")], "id long, text string"), "id", "text").withColumn("is_heading", F.col("line").isin(*types))
    kinds = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    rows = d.sections(rows, "id", "line_no", F.col("is_heading"), F.struct(kinds[F.col("line")].alias("kind"), F.col("line").alias("heading")))
    rows = rows.withColumn("heading", F.coalesce("section.heading", F.lit("HEADER"))).withColumn("section", F.coalesce("section.kind", F.lit("header")))
    got = {r.id: r for r in ca.canonical_resume(rows, "id").collect()}
    assert set(got) == {1, 3} and [s.section_id for s in got[3].sections] == ["sec_001_projects"] and got[3].line_count == 0
    one = got[1]
    assert [s.section_id for s in one.sections] == ["sec_000_header", "sec_002_work_experience", "sec_003_projects", "sec_004_education", "sec_005_skills", "sec_006_other"]
    assert [x.text for x in one.header_lines] == ["Jo Doe", "jo@x.org"] and (one.line_count, one.section_count) == (13, 6)
    work, projects, school, skills = one.sections[1:5]
    assert [b.block_id for b in work.blocks] == ["sec_002_work_experience_role_001"] and [x.text for x in work.blocks[0].bullets] == ["models"] and work.blocks[0].date_ranges == ["Jan 2020 - Present"]
    assert [b.evidence_text for b in projects.blocks] == ["Title: Search\nfinds things\n- fast", "Chatbot platform\ntalks"]
    assert [b.evidence_text for b in school.blocks] == ["Master of Arts 2001 - 2003\nMIT"]
    assert [(g.category, g.values_text) for g in skills.skill_groups] == [("Languages", "Go, SQL"), ("uncategorized", "Spark")]
    blocks = ca.resume_blocks(rows.where("not is_heading"), "id")
    assert blocks.where("kind = 'project'").orderBy("block_no").select(ca.fallback_project(F.col("evidence_text")).alias("p")).first().p[:2] == ("Search", "finds things - fast")
    assert blocks.where("kind = 'education'").select(ca.fallback_education(F.col("evidence_text")).alias("p")).first().p[:2] == ("MIT", "Master of Arts 2001 - 2003")


def test_roles_without_a_parse(spark):
    blocks = [(1, ["Data Scientist at Acme (Jan 2020 - Present)."]), (2, ["Aldi, Batavia, IL Sep 2023 - Present", "Data Scientist - AI/ML"]), (3, ["Senior Analyst Jan 2020 - Aug 2023", "Fifth Third Bank, Cincinnati, OH"]), (4, ["nothing here"])]
    frame = spark.createDataFrame([(i, [(x,) for x in lines], "\n".join(lines)) for i, lines in blocks], "id long, lines array<struct<text string>>, evidence_text string")
    j = ca.role_block_hints(frame, "id").join(frame.select("id", "evidence_text"), "id")
    made = ca.fallback_experience(*[F.col(c) for c in ("title", "company", "location", "start_date", "end_date", "is_current", "evidence_text")])
    got = {r.id: r.e and tuple(r.e)[:6] for r in j.select("id", made.alias("e")).collect()}
    assert got == {
        1: ("Acme", "Data Scientist", None, "Jan 2020", "Present", True), 2: ("Aldi", "Data Scientist - AI/ML", "Batavia, IL", "Sep 2023", "Present", True),
        3: ("Fifth Third Bank", "Senior Analyst", "Cincinnati, OH", "Jan 2020", "Aug 2023", False), 4: None,
    }


def test_spans_of_a_document_of_a_million_lines(spark):
    rows = spark.range(1, 1_000_001).select(F.lit(7).cast("long").alias("id"), F.col("id").cast("int").alias("line_no"), F.lit("x").alias("line"))
    spans = spark.createDataFrame([(7, k, k * 991 + 1, k * 991 + k % 200) for k in range(1000)] + [(8, 0, 1, 5)], "id long, span_no int, start_line int, end_line int")
    got = ca.lines_of_spans(spans, rows, "id").groupBy("span_no").agg(F.count("*").alias("n"), F.min("line_no").alias("first")).collect()
    assert {r.span_no: (r.n, r.first) for r in got} == {k: (k % 200, k * 991 + 1) for k in range(1000) if k % 200}
    assert ca.lines_of_spans(spans, rows, "id", most=3).groupBy("span_no").count().agg(F.max("count")).first()[0] == 3


ITEM = "array<struct<title: string, company: string, start_date: string, end_date: string, is_current: boolean>>"


def test_a_retry(spark):
    role = lambda t, c=None, s=None, now=None: (t, c, s, None, now)
    schema = f"id long, name string, skills array<string>, experience {ITEM}, projects array<struct<name: string, url: string>>, education array<struct<institution: string>>"
    first = spark.createDataFrame([(1, "Jo", ["Go"], [role("A"), role("A"), role("B ", "x")], [("p", "u1")], []), (2, " ", None, [role("A")], None, [("MIT",)]), (3, "x", [], [], [], [])], schema)
    again = spark.createDataFrame([(1, "", ["go", "SQL"], [role("b", "X"), role("C")], [("P ", "u2"), ("q", None)], None), (2, "Al", ["R"], [role("Z", "y", None, True)], [], [("mit",), ("mit",)]), (4, "new", None, None, None, None)], schema)
    got = {r.id: r for r in ca.retry_merged(first, again, "id", scalars=("name",), lists=("skills",)).collect()}
    assert (got[1].name, got[1].skills, [e.title for e in got[1].experience], [(p.name, p.url) for p in got[1].projects]) == ("Jo", ["Go", "SQL"], ["b", "C", "A"], [("P ", "u2"), ("q", None)])
    assert (got[2].name, [e.title for e in got[2].experience], [e.institution for e in got[2].education]) == ("Al", ["Z"], ["mit", "mit"])
    assert got[3].experience == [] and got[4].name == "new" and got[4].projects == [] and len(got) == 4
