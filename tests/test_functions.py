"""Worked values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tallgrass.functions import dates, hashing, scoring, skills, text, urls
from tallgrass.operators import catalog, documents, lifecycle, matching
from tallgrass.sources import readers, sinks


def value(spark, column, **row):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]) if row else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://Ex.com/Jobs/1/?utm_source=a&Page=2&ref=z#top", "https://ex.com/Jobs/1?Page=2"),
        ("https://ex.com", "https://ex.com/"),
        ("/jobs/1/", "/jobs/1"),
        ("https://ex.com/a?x=&y=1", "https://ex.com/a?x=&y=1"),
        ("  ", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, urls.canonical(F.lit(url).cast("string"))) == want


NOW = dt.datetime(2026, 6, 20, 12)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Posted Today", "2026-06-20 00:00"), ("5 hours ago", "2026-06-20 07:00"), ("30 minutes ago", "2026-06-20 11:30"), ("3 days ago", "2026-06-17 00:00"), ("2 weeks ago", "2026-06-06 00:00"),
        ("1 month ago", "2026-05-21 00:00"), ("30+ days ago", None), ("06/18/2026", None), ("12 month contract", "2025-06-25 00:00"), ("2026-06-18T10:00:00+02:00", "2026-06-18 08:00"), ("18 Jun 2026", "2026-06-18 00:00"),
        ("3/6/2026", "2026-06-03 00:00"), ("soon", None), (None, None),
    ],
)
def test_posting_dates(spark, raw, want):
    got = value(spark, F.date_format(dates.posted_at(F.lit(raw).cast("string"), F.lit(NOW)), "yyyy-MM-dd HH:mm"))
    assert got == want


def test_schedules(spark):
    for raw, minutes in (("hourly", 60), ("every_6h", 360), ("every 2 days", 2880), ("every 5 min", 15), (None, 1440)):
        assert value(spark, dates.schedule_minutes(F.lit(raw).cast("string"))) == minutes
    assert value(spark, dates.schedule_minutes(F.lit("hourly"), F.lit(120))) == 120


def test_place_scores(spark):
    for a, b, want in (("Austin, TX", "Remote - Austin", 1.0), ("Texas", "Austin, Texas", 1.0), ("New York", "Newark", 0.0), (None, "x", 0.0)):
        assert value(spark, scoring.place_score(F.lit(a).cast("string"), F.lit(b))) == want
    assert abs(value(spark, scoring.blended(F.lit(0.8), F.lit(0.4), F.lit(0.0))) - 0.708) < 1e-12


def test_skills(spark):
    listed = F.array(*map(F.lit, ("Python", "python ", "Generative AI Technologies", "CI/CD", "Cloud tools", "Go", " - ", "py spark")))
    assert value(spark, skills.unique_skills(listed)) == ["Python", "Go", "PySpark"]
    assert value(spark, skills.terms_in(F.lit("Uses apache spark, C++ and Node.js; pythonic"))) == ["apache spark", "node.js", "spark"]
    assert value(spark, skills.domains(F.lit("FastAPI on AWS"))) == ["Cloud AI", "Full Stack Web Development", "Backend Engineering"]


def test_texts(spark):
    assert value(spark, text.compact(F.lit(" a\x00b\n  c "))) == "a b c"
    assert value(spark, text.json_block(F.lit('say {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}'
    assert value(spark, text.split_list(F.lit("a, b;; c | d"))) == ["a", "b", "c", "d"]
    assert value(spark, text.slug(F.lit("  Héllo, World! "))) == "h-llo-world"
    assert value(spark, text.head_and_tail(F.lit("x" * 70 + "y" * 60), 100, 0.75, "[..]")) == "x" * 70 + "y" * 2 + "[..]" + "y" * 24
    assert value(spark, text.unique_by_lower(F.array(*map(F.lit, ("A", "b", "a", "B", "c"))), 2)) == ["A", "b"]


def test_identities(spark):
    import uuid

    assert value(spark, hashing.uuid5(F.lit("https://ex.com/1"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://ex.com/1"))
    a = value(spark, hashing.content_hash(b=F.lit(1), a=F.lit("x")))
    assert a == value(spark, hashing.content_hash(a=F.lit("x"), b=F.lit(1)))


def test_hosts_and_safety(spark):
    hosts = ["*.example.com", "ex.org"]
    for h, want in (("a.example.com", True), ("example.com", False), ("ex.org", True), ("b.ex.org", False)):
        assert value(spark, urls.allowed(F.lit(h), hosts)) is want
    for u, bad in (("http://127.0.0.1/", True), ("http://localhost/", True), ("http://10.0.0.1/a", True), ("https://8.8.8.8/#x", False), ("https://ex.com:8443/", True)):
        assert (value(spark, urls.unsafe_reason(F.lit(u))) is not None) is bad
    assert value(spark, urls.resolved(F.lit("https://ex.com/a/b?x=1"), F.lit("c"))) == "https://ex.com/a/c"


def test_request_normalisers():
    assert catalog.work_modes(["On-site", "REMOTE", "invalid"]) == ["on_site", "remote"]
    assert catalog.freshness_choice("5y") == "" and catalog.sort_choice("odd") == "newest"
    assert catalog.filter_values([" a  b ", "A B", "", None, *map(str, range(20))])[:2] == ["a b", "0"]
    assert len(catalog.filter_values(map(str, range(20)))) == 12


def test_hybrid_counts_once_but_matches_twice(spark):
    place = F.lit("Hybrid - Remote")
    assert value(spark, catalog.work_mode(place)) == "hybrid"
    assert value(spark, catalog.in_modes(place, ["remote"])) and value(spark, catalog.in_modes(place, ["hybrid"]))


def test_windows_end_with_the_document(spark):
    got = [(r["first"], r["last"]) for r in documents.windows(spark.createDataFrame([(1, 100), (2, 0), (3, 80)], "k int, n int"), "k", "n").orderBy("k", "first").collect()]
    assert got == [(1, 80), (66, 100), (1, 80)]


def test_low_coverage_is_left_alone(spark):
    jobs = spark.createDataFrame([(i, "t", f"u{i}", True, 2) for i in range(10)], "job_id int, target string, url_key string, is_active boolean, missing_count int")
    for n, outcome, active in ((1, "skipped_low_coverage", 10), (2, "reconciled", 2)):
        seen = spark.createDataFrame([("t", f"u{i}") for i in range(n)], "target string, url_key string")
        got = lifecycle.reconcile(jobs, seen, "target", F.lit(NOW))
        assert {r.outcome for r in got.collect()} == {outcome} and got.where("is_active").count() == active
    none = lifecycle.reconcile(jobs, seen.limit(0), "target", F.lit(NOW))
    assert {r.outcome for r in none.collect()} == {"skipped_empty"}


def test_too_many_queries_are_refused(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    with pytest.raises(ValueError):
        matching.top_k(v, v.withColumnRenamed("query_id", "row_id"), 1, most_queries=0)


def test_many_queries_meet_all_rows_in_groups(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)] + [(None, [1.0, 2.0, 3.0])], "query_id long, vector array<double>")
    rows = v.where("query_id is not null").withColumnRenamed("query_id", "row_id")
    want, got = (sorted(map(str, matching.top_k(v, rows, 3, most_queries=n).collect())) for n in (100, 7))
    assert got == want and len(got) == 41 * 3


def test_job_files(spark, tmp_path):
    (tmp_path / "a" / "matches").mkdir(parents=True)
    (tmp_path / "a" / "acme.json").write_text('[{"title": "T", "job_url": "u", "extra": 1}, {"title": "S"}]')
    (tmp_path / "a" / "acme_20240101T000000Z.json").write_text('[{"title": "old"}]')
    (tmp_path / "a" / "acme_summary.json").write_text('[{"title": "no"}]')
    (tmp_path / "a" / "matches" / "acme.json").write_text('[{"title": "no"}]')
    (tmp_path / "a" / "bad.json").write_text("{oops")
    got = readers.read_jobs(spark, str(tmp_path), ["acme", "bad"])
    assert sorted((r.title, r.target, r.run_id) for r in got.collect()) == [("S", "acme", None), ("T", "acme", None)]
    assert readers.read_jobs(spark, str(tmp_path), ["acme"], latest_only=False).count() == 3


def test_records_and_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n[1]\n{bad\n\n{"a": 2, "b": "x"}\n')
    assert sorted((r.a, r.b) for r in readers.read_records(spark, str(tmp_path / "r.jsonl"), "a long, b string").collect()) == [(1, None), (2, "x")]
    (tmp_path / "cv").mkdir()
    for name, body in (("a.PDF", b"x"), ("b.docx", b""), ("c.txt", b"y"), ("d.pdf", b"z")):
        (tmp_path / "cv" / name).write_bytes(body)
    got = readers.read_resumes(spark, str(tmp_path / "cv"))
    assert got.count() == 2 and readers.read_resumes(spark, str(tmp_path / "cv"), known=got.limit(1)).count() == 1


def test_word_files(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    cell = lambda x: f"<w:tc>{p(x)}</w:tc>"
    body = f"{p('Title')}<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>{p('End')}"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/footer1.xml", f'<w:ftr xmlns:w="{w}">{p("Foot")}</w:ftr>')
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/")[-1]: r.text for r in documents.docx_text(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.docx": "Title\n| A | B |\n| --- | --- |\n| 1 | 2 |\nEnd\nFoot", "b.docx": None}


def test_written_files(spark, tmp_path):
    jobs = spark.createDataFrame([("T", "C", "r1")], "title string, company string, run string")
    sinks.write_jobs_json(jobs, str(tmp_path), "r1")
    assert spark.read.json(f"{tmp_path}/latest").count() == spark.read.json(f"{tmp_path}/runs").count() == 1
    assert "run_session_id" in spark.read.json(f"{tmp_path}/runs").columns
    matches = spark.createDataFrame([(1, 5, 2, 0.5), (1, 6, 1, 0.9)], "candidate_id long, job_id long, rank int, score double")
    sinks.write_matches(matches, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m/grouped").first()["jobs"] == [6, 5]


def test_settings():
    assert readers.overlaid({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}, {"b": None}) == {"a": {"x": 1, "y": 3}, "b": None}
    assert readers.chosen_targets(["*"], ["a", "b"]) == ["a", "b"] and readers.chosen_targets(["b", "b"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        readers.chosen_targets(["c"], ["a"])


def test_a_second_run_takes_only_new_files(spark, tmp_path):
    from tallgrass.streaming import events as ev

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([(1, NOW, 1, "a", 1.0), (1, NOW, 1, "a", 1.0)], schema).write.parquet(f"{tmp_path}/in/0")
    stream = lambda: ev.once(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    ev.into_table(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    spark.createDataFrame([(1, NOW, 1, "a", 1.0), (2, NOW, 1, "a", 1.0)], schema).write.parquet(f"{tmp_path}/in/1")
    ev.into_table(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_an_address_is_taken_apart_once(spark):
    """The canonical form evaluates each pattern once; nested repeats made identities cost many times the reading of their rows."""
    made = spark.createDataFrame([(" HTTPS://A.Org/x/?utm_source=a&b#c ",), ("/p//",), (None,), ("http://a.org",)], "u string").select(urls.canonical(F.col("u")).alias("c"))
    assert [r.c for r in made.collect()] == ["https://a.org/x?b=", "/p", "", "http://a.org/"]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 4


def test_a_skill_is_made_once(spark):
    """A skill's name evaluates each pattern once, however many rules look at it."""
    made = spark.createDataFrame([(" Py  Spark. ",), ("Tools",), (None,)], "s string").select(skills.canonical_skill(F.col("s")).alias("c"))
    assert [r.c for r in made.collect()] == ["PySpark", None, None]
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 2


def test_spans_are_chosen_without_a_frame_for_each_document(spark):
    """Documents of any number pass in sorted batches; what was kept of one isn't held against the next."""
    made = spark.createDataFrame([(k, kind, 1, 10, 3.0 + i) for k in (1, 2, None) for kind in "ab" for i in range(3)], "doc long, span_type string, start_line int, end_line int, confidence double")
    got = documents.distinct_spans(made, "doc")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(k, kind, 1, 10, 5.0) for k in (1, 2, None) for kind in "ab"], key=str)
    assert "InPandas" not in got._jdf.queryExecution().analyzed().toString()


def test_text_without_mails_is_read_once(spark):
    """A run of name characters without @ costs its length; an e-mail may begin where the one before ended."""
    long = "a" * 300_000
    made = spark.createDataFrame([(long,), ("a@b.co_c@d.org x@y.zz é1!",), (None,)], "t string")
    q = text.quality(F.col("t"))
    got = [tuple(r) for r in made.select(q["email_count"], q["alnum_permille"], q["char_count"]).collect()]
    assert got == [(0, 1000, 300_000), (3, 560, 25), (0, 0, 0)]
    assert value(spark, text.contact(F.lit("a@b.co_c@d.org"))["email"]) == "a@b.co"
