"""Plans of a target, overrides, links, users and ids on real rows."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F
from tallgrass.functions.hashing import record_id
from tallgrass.operators import indexing, portals
from tallgrass.operators import lifecycle as lc
from tallgrass.operators import matching as m
from tallgrass.operators import profiles as pr

OLD = datetime.datetime(2024, 1, 1)


def now():
    return F.lit("2024-06-01").cast("timestamp")


def test_a_plan_knows_only_its_target(spark):
    schema = "job_id string, target_id string, job_url string, is_active boolean, freshness_status string, title string, company string, last_deep_scraped_at timestamp, last_seen_at timestamp, missing_count int, inactive_reason string"
    rows = [("a", "t", "https://x/1", False, "inactive", "T", "C", OLD, OLD, 3, "gone"), ("b", "u", "https://x/2", False, "inactive", "T", "C", OLD, OLD, 3, "gone"), ("c", "t", "https://x/3/", True, "active", "T", "C", datetime.datetime(2024, 5, 31), OLD, 0, None)]
    jobs = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([(u,) for u in ("https://X/1?utm_source=a", "https://x/2", "https://x/3", None, " ")], "url string")
    plan, after = lc.planned_target(found, jobs, "t", now(), F.lit("s"))
    assert {r.url: (r.job_id, r.extract, r.is_new, r.due, r.broken) for r in plan.collect()} == {"https://x/1": ("a", True, False, True, True), "https://x/2": (None, True, True, False, False), "https://x/3": ("c", False, False, False, False)}
    got = {r.job_id: (r.is_active, r.missing_count, r.inactive_reason, r.last_seen_at.year, r.last_seen_at.month) for r in after.collect()}
    assert got == {"a": (True, 0, None, 2024, 6), "b": (False, 3, "gone", 2024, 1), "c": (True, 0, None, 2024, 6)}
    assert {tuple(r) for r in lc.planned_target(found.limit(0), jobs, "t", now(), F.lit("s"))[1].collect()} == {tuple(r) for r in jobs.collect()}


def test_overrides_under_a_version(spark):
    portal = "portal_id int, status string, version int, profile_name string, source_platform string, crawl_strategy string, confidence double, profile_overrides map<string,string>, entries array<string>"
    rows = spark.createDataFrame([(i, s, 4, "old", p, "c", 0.2, {"a": "b"}, [str(k) for k in range(n)]) for i, s, p, n in ((1, "draft", "site", 12), (2, "paused", None, 0), (3, "draft", "site", 1), (4, "ok", "site", 1), (5, "blocked", " ", 3))], portal)
    given = [(1, 4, "new", "", " ", {"x": "y"}, "e"), (2, None, "new", None, "deep", None, "e"), (3, 3, "new", "p", "s", {}, "e"), (5, 4, "new", None, None, {}, "e")]
    got = {r.portal_id: r for r in portals.override_saved(rows, spark.createDataFrame(given, "portal_id int, read_version int, profile_name string, source_platform string, crawl_strategy string, profile_overrides map<string,string>, entry string")).collect()}
    one, two, three, four, five = (got[i] for i in range(1, 6))
    assert (one.status, one.version, one.profile_name, one.source_platform, one.crawl_strategy, one.confidence, one.profile_overrides, one.outcome) == ("ready_for_test", 5, "new", "site", "new", 1.0, {"x": "y"}, "saved")
    assert one.entries == [*map(str, range(3, 12)), "e"] and (two.status, two.source_platform, two.crawl_strategy, two.profile_overrides) == ("paused", "custom_listing", "deep", {})
    assert (three.outcome, three.version, three.profile_name, three.entries) == ("rejected", 4, "old", ["0"]) and four.outcome is None and four.version == 4 and five.source_platform == "custom_listing" and five.status == "blocked"


def test_one_primary_link(spark):
    link = "user_id string, candidate_id string, resume_id string, is_primary boolean, is_active boolean, metadata map<string,string>, modified_on timestamp"
    old = [("u", "a", "r1", True, True, {"k": "1", "l": "1"}, OLD), ("u", "b", "r2", False, False, None, OLD), ("v", "a", "r3", True, True, None, OLD), ("w", "c", "r4", True, True, {}, OLD)]
    given = [("u", "a", "r9", {"k": "2"}, 1), ("u", "b", "r8", {"m": "3"}, 2), ("w", "c", "r5", None, 1), ("x", "n", None, {"q": "1"}, 1)]
    rows = lc.primary_linked(spark.createDataFrame(old, link), spark.createDataFrame(given, "user_id string, candidate_id string, resume_id string, metadata map<string,string>, ordinal int"), now()).collect()
    got = {(r.user_id, r.candidate_id): (r.resume_id, r.is_primary, r.is_active, r.metadata, r.modified_on.month) for r in rows}
    assert got == {
        ("u", "a"): ("r9", False, True, {"k": "2", "l": "1"}, 6), ("u", "b"): ("r8", True, True, {"m": "3"}, 6), ("v", "a"): ("r3", True, True, None, 1), ("w", "c"): ("r5", True, True, {}, 6), ("x", "n"): (None, True, True, {"q": "1"}, 6),
    }


def test_users_by_identity_then_legacy_then_mail(spark):
    users = spark.createDataFrame([("A", "o", " A@x.org ", True), ("B", "o", "b@x.org", True), ("B2", "o", "B@X.org", True), ("C", "o", "c@x.org", False), ("D", "p", "a@x.org", True)], "user_id string, org_id string, email string, is_active boolean")
    identities, legacy = spark.createDataFrame([("i", "1", "Z"), ("i", "2", "Y")], "issuer string, subject string, user_id string"), spark.createDataFrame([("r", "1", "L"), ("r", "3", "M")], "realm string, subject string, user_id string")
    logins = [(1, "i", "1", "r", "o", "b@x.org", False), (2, "j", "3", "r", "o", None, None), (3, "j", "4", "r", "o", "A@X.ORG", True), (4, "j", "4", "r", "o", "a@x.org", False), (5, "j", "4", "r", "o", "b@x.org", True), (6, "j", "4", "r", "o", "c@x.org", True), (7, None, None, None, None, " ", None), (8, "j", "4", "r", "p", "a@x.org", True)]
    got = {r.login: (r.user_id, r.strategy, r.error) for r in lc.resolved_users(spark.createDataFrame(logins, "login int, issuer string, subject string, realm string, org_id string, email string, verified boolean"), identities, legacy, users).collect()}
    assert got == {1: ("Z", "identity", None), 2: ("M", "legacy", None), 3: ("A", "verified_email", None), 4: (None, None, "unverified_email"), 5: (None, None, "ambiguous_email"), 6: (None, None, None), 7: (None, None, None), 8: ("D", "verified_email", None)}


def test_tower_scans(spark):
    towers = spark.createDataFrame([("a", "indexed", 3), ("b", None, 1), ("c", "pending", 2), ("d", "pending", 2), (" ", "pending", 9)], "id string, embedding_status string, updated_at int")
    ids = lambda **k: [r.id for r in indexing.scanned(towers, "id", **k).collect()]
    assert ids() == [" ", "a", "c", "d", "b"] and ids(only_pending=True, limit=2) == [" ", "c"]
    assert ids(ids=spark.createDataFrame([("b",), ("d",), ("d",), (" ",), (None,)], "id string")) == ["d", "b"]


def test_record_ids_as_json_has_them(spark):
    rows = [("c\"1", 5, None, True), ("é\\\n", None, "x", False), (None, -1, "", None)]
    made = record_id("fb_", job_id=F.col("j"), candidate_id=F.col("c"), source=F.col("s"), on=F.col("o"))
    got = [r[0] for r in spark.createDataFrame(rows, "c string, j int, s string, o boolean").coalesce(1).select(made).collect()]
    text = [json.dumps({"candidate_id": c, "job_id": j, "source": s, "on": o}, sort_keys=True, ensure_ascii=False) for c, j, s, o in rows]
    assert got == ["fb_" + hashlib.sha256(x.encode()).hexdigest()[:24] for x in text]


def test_groups_of_queries_are_one_answer(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "row_id long, vector array<double>")
    queries = rows.where("row_id % 5 = 0").withColumnRenamed("row_id", "query_id")
    whole, parts = ({(r.query_id, r.row_id, r["rank"]) for r in m.top_k(queries, rows, 3, most_queries=n).collect()} for n in (1000, 15))
    assert whole == parts and len(whole) == 120


def test_patches_with_two_faults(spark):
    cases = [
        ({"full_name": "Other", "phone": "12"}, ["name is locked", "phone is invalid"]), ({"full_name": "", "name": "Other"}, ["name is locked"]), ({"full_name": " ", "name": "Other"}, []), ({"full_name": "jo doe", "email": "X@x.org"}, []),
        ({"name": "Jo  Doe", "email": "y@x.org", "sha256": "1", "resume_id": "2"}, ["email is locked", "locked: resume_id, sha256"]), ({"total_experience_years": "61", "hobby": "z", "github_url": "ftp://x"}, ["experience is not 0 to 60", "github_url is no web address", "unknown: hobby"]), ({}, []), (None, []),
    ]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p map<string,string>")
    got = {r.i: r.e or [] for r in rows.select("i", pr.patch_errors(F.col("p"), F.lit("Jo Doe"), F.lit("x@x.org")).alias("e")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_the_last_parse_of_a_resume_counts(spark):
    current = spark.createDataFrame([("r1", "s1", "h1", OLD, OLD, True)], "resume_id string, sha256 string, content_hash string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean")
    batch = spark.createDataFrame([("s1", "r1", "h9", 1), ("s2", "r1", "h2", 2), (None, "r2", "h", 3), ("a" * 30, None, "h5", 4)], "sha256 string, resume_id string, content_hash string, n int")
    after, told = lc.resume_upsert(current, batch, now(), "n")
    assert {(r.resume_id, r.sha256, r.content_hash, r.first_seen_at.month) for r in after.collect()} == {("r1", "s2", "h2", 1), ("res_" + "a" * 24, "a" * 30, "h5", 6)}
    assert {r.history_id for r in told.collect()} == {"reshist_r1_h2", f"reshist_res_{'a' * 24}_h5"}
    assert {r.content_hash for r in lc.resume_upsert(current, batch, now())[0].where("resume_id = 'r1'").collect()} == {"h9"}
