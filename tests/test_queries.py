"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from tallgrass.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(rows):
    return sorted(repr([f"{v:.10g}" if isinstance(v, float) else v for _, v in sorted(r.items())]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(r.asDict() for r in got.collect()) == plain(dict(zip(want.columns, r, strict=True)) for r in want.fetchall())


def test_every_query_is_registered_with_sql_or_tested_here():
    assert set(QUERIES) == set(ORACLE)


def test_span_dedupe(spark):
    from tallgrass.plans.document_queries import _spans
    from tallgrass.plans.registry import Tables
    from tallgrass.operators.documents import normal_spans

    every = {}
    for r in normal_spans(*_spans(Tables(spark, SF)), "doc_id", 3).collect():
        every.setdefault(r.doc_id, []).append(r)
    want = []
    for spans in every.values():
        kept = []
        for s in sorted(spans, key=lambda s: (-s.confidence, -(s.end_line - s.start_line), s.start_line, s.end_line, s.span_type)):
            size = s.end_line - s.start_line + 1
            over = [min(s.end_line, k.end_line) - max(s.start_line, k.start_line) + 1 >= 0.8 * min(size, k.end_line - k.start_line + 1) for k in kept if k.span_type == s.span_type]
            if not any(over):
                kept.append(s)
        want += kept
    assert plain(r.asDict() for r in QUERIES["span_dedupe"](spark, SF).collect()) == plain(r.asDict() for r in want)


def test_lease(spark):
    rows = sorted(((r.ts, r.event_id, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect()), key=lambda r: r[:2])
    until, want = {}, set()
    for ts, event, user in rows:
        if user not in until or (ts - until[user]).total_seconds() >= 86400:
            until[user] = ts
            want.add((event, user))
    assert {(r.event_id, r.user_id) for r in QUERIES["str_lease"](spark, SF).collect()} == want
