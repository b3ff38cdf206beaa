"""Edit logs, schema checks and term search against plain versions."""

import datetime
import re
from decimal import Decimal
from random import Random

from pyspark.sql import functions as F
from tallgrass.functions import skills
from tallgrass.operators import edits, payloads
from tallgrass.operators import profiles as pr


def test_three_edits_in_a_row(spark):
    profiles = spark.createDataFrame([("a", 2, "Berlin", None, "1"), ("b", None, None, "x", "2")], "id string, version int, location string, summary string, phone string")
    rows = [("a", 1, {"location": "Paris"}), ("a", 2, {"phone": "9", "email": "no"}), ("a", 3, {"location": None, "summary": None}), ("a", 4, {"email": "no"}), ("a", 5, {}), ("b", 1, {"summary": "x"}), ("c", 1, {"summary": "y"})]
    log = edits.edit_log(profiles, spark.createDataFrame(rows, "id string, n int, updates map<string,string>"), "id", "n", ("location", "summary", "phone"))
    got = {(r.id, r.n): r for r in log.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("a", 3), ("b", 1)}
    assert [(got["a", n].version, got["a", n].changed, got["a", n].impacting, got["a", n].refresh) for n in (1, 2, 3)] == [(3, ["location"], ["location"], True), (4, ["phone"], [], False), (5, ["location"], ["location"], True)]
    assert got["a", 3].parsed.location == "Berlin" and got["a", 3].after == (None, None, "9") and got["a", 1].hash_after == got["a", 2].hash_before == got["a", 2].hash_after != got["a", 1].hash_before
    assert (got["b", 1].version, got["b", 1].changed, got["b", 1].refresh) == (1, [], False)
    at = lambda n: {r.id: tuple(r)[1:] for r in edits.profiles_at(profiles, log, "id", "n", ("location", "summary", "phone"), None if n is None else F.lit(n)).collect()}
    assert at(0) == {"a": (2, "Berlin", None, "1", False), "b": (None, None, "x", "2", False)}
    assert at(1)["a"] == (3, "Paris", None, "1", True) and at(None)["a"] == (5, None, None, "9", True)


SCHEMA = {"title": "text?", "n": "number", "on": "bool?", "tags": ["text"], "inner": {"x": "text", "deep": {"ids": ["number"]}}}
GOOD = '"n": 1, "inner": {"x": "y", "deep": {"ids": [1, 2.5]}}'


def test_payloads_against_a_schema(spark):
    cases = [
        (f'{{"title": "t", "tags": ["a"], "more": [1], {GOOD}}}', None), (f"{{{GOOD}}}", None), (f'{{"title": 1, "on": 7, {GOOD}}}', "$.title"), (f'{{"on": "true", {GOOD}}}', "$.on"), ('{"n": null}', "$.n"), ("{}", "$.n"), ("[]", "$"), ("7", "$"), ("nope", "$"), (None, "$"), ('"text"', "$"),
        (f'{{"tags": ["a", null], {GOOD}}}', "$.tags[1]"), (f'{{"tags": [["a"]], {GOOD}}}', "$.tags[0]"), (f'{{"tags": "a", {GOOD}}}', "$.tags"), (f'{{"tags": null, {GOOD}}}', "$.tags"),
        ('{"n": 1}', "$.inner"), ('{"n": 1, "inner": []}', "$.inner"), ('{"n": 1, "inner": {"x": "y"}}', "$.inner.deep"), ('{"n": 1, "inner": {"x": "y", "deep": {"ids": [1, "2"]}}}', "$.inner.deep.ids[1]"), ('{"n": 1, "inner": {"deep": {}}}', "$.inner.x"),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, p string").select("i", payloads.checked(F.col("p"), SCHEMA).alias("c")).collect()
    for r in got:
        assert r.c.fault == cases[r.i][1], (cases[r.i], r.c)
        assert (r.c.value is None) == (r.c.fault is not None)
    one = next(r.c.value for r in got if r.i == 0)
    assert (one.title, one.n, one.on, one.tags, one.inner.x, one.inner.deep.ids) == ("t", 1.0, None, ["a"], "y", [1.0, 2.5])


def test_nested_values_as_json(spark):
    row = [(datetime.date(2024, 2, 3), {7: [(Decimal("1.50"), b"ab")]}, [datetime.datetime(2024, 1, 1, 2, 3, 4, 5), None], None)]
    df = spark.createDataFrame(row, "day date, by_key map<int,array<struct<d: decimal(5,2), raw: binary>>>, times array<timestamp>, gone struct<x: date>")
    assert df.select(payloads.plain_json(df, "times", "day", "by_key", "gone")).first()[0] == '{"by_key":{"7":[{"d":1.5,"raw":"YWI="}]},"day":"2024-02-03","gone":null,"times":["2024-01-01T02:03:04.000005Z",null]}'


def plain_terms(text, vocabulary):
    flat = " " + re.sub(r"[^a-zA-Z0-9+#./-]+", " ", text.lower()) + " "
    return [t for t in sorted(vocabulary, key=lambda t: (-len(t), t)) if re.search(rf"(?<![a-zA-Z0-9+#.-]){re.escape(t)}(?![a-zA-Z0-9+#.-])", flat)]


def test_terms_as_a_search_each(spark):
    rng, parts = Random(2), [*skills.KNOWN, "x", "java-", "sql.", "ci", "cd", "/", " / ", "//", "\n", ", ", "é", "github", "actions", "C++", "no", "Spark", "power  bi"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "/", "; "]) for _ in range(rng.randrange(20))) for _ in range(500)] + ["", " ", "r"]
    vocabulary = (*skills.KNOWN, "a b c", "c++", "x / y")
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", skills.terms_in(F.col("t"), vocabulary).alias("f")).collect()
    assert all(r.f == plain_terms(texts[r.i], vocabulary) for r in got)
    mined = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pr.matcher_skills([], F.col("t")).alias("f")).collect()
    for r in mined:
        low = texts[r.i].lower()
        assert r.f == sorted({pr.MATCHER_SYNONYMS.get(t, t) for t in pr.MATCHER_TERMS if re.search(rf"(?<![a-z0-9+#.-]){re.escape(t)}(?![a-z0-9+#.-])", low)})
