"""What a task holds is bounded; what is asked of a payload is asked once."""

from random import Random

from pyspark.sql import functions as F
from tallgrass.operators import matching, payloads


def test_products_held_at_a_time(spark, monkeypatch):
    rng = Random(3)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)], "row_id long, vector array<double>").coalesce(1)
    asked = rows.select(F.col("row_id").alias("query_id"), "vector").where("query_id < 30")
    get = lambda: sorted(tuple(r) for r in matching.top_k(asked, rows, 3).select("query_id", "row_id", "rank").collect())
    whole = get()
    monkeypatch.setattr(matching, "CELLS", 200)
    assert get() == whole and len(whole) == 90


def test_payload_paths_are_read_once(spark):
    made = spark.createDataFrame([('{"job": {"title": "a"}}',), ('{"data": {"jobs": [{"title": "b"}, {"title": "c"}]}}',), ('[{"title": "d"}]',), ('{"jobs": []}',), ("x",), (None,), ('{"record": "r"}',), (' {"items": [1]}',)], "p string")
    got = made.select(payloads.candidates(F.col("p")).alias("c"))
    assert [r.c for r in got.collect()] == [['{"title":"a"}'], ['{"title":"b"}', '{"title":"c"}'], ['{"title":"d"}'], ['{"jobs": []}'], [], [], ['{"record": "r"}'], []]
    assert got._jdf.queryExecution().analyzed().toString().count("get_json_object") == 8
