"""Edits of profiles as a log, payloads against a schema, and known terms in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skills
from ..operators import edits, payloads
from .registry import query

_FIELDS = ("location", "phone", "summary")

# A customer's orders are its edits: by key they name a place, a phone, a summary, clear one, or name what can't be edited.
_LOG = """p as (select c_custkey as k, 3 as version, c_mktsegment as location, c_phone as phone, cast(null as varchar) as summary from customer),
e as (select o_custkey as k, o_orderkey as o, case when o_orderkey % 5 in (0, 1) then 1 else 0 end as has_l, case when o_orderkey % 5 = 0 then o_orderpriority end as l, case when o_orderkey % 3 = 0 then 1 else 0 end as has_p, 'p' || o_orderkey % 4 as ph,
  case when o_orderkey % 7 = 0 then 1 else 0 end as has_s, case when o_orderkey % 14 = 0 then o_orderstatus end as s from orders),
n as (select * from e where has_l + has_p + has_s > 0),
f as (
  select n.*, p.version + row_number() over w as v, p.location as l0, p.phone as p0, p.summary as s0,
    sum(has_l) over w as nl, sum(has_p) over w as np, sum(has_s) over w as ns, row_number() over w as i from n join p using (k) window w as (partition by k order by o)),
g as (
  select f.*, case when nl = 0 then l0 else (select l from f x where x.k = f.k and x.has_l = 1 and x.nl = f.nl) end as la, case when np = 0 then p0 else (select ph from f x where x.k = f.k and x.has_p = 1 and x.np = f.np) end as pa, case when ns = 0 then s0 else (select s from f x where x.k = f.k and x.has_s = 1 and x.ns = f.ns) end as sa from f),
h as (select *, case when i = 1 then l0 else lag(la) over w end as lb, case when i = 1 then p0 else lag(pa) over w end as pb, case when i = 1 then s0 else lag(sa) over w end as sb from g window w as (partition by k order by o)),
r as (
  select k, o, cast(v as int) as version, concat_ws(',', case when lb is distinct from la then 'location' end, case when pb is distinct from pa then 'phone' end, case when sb is distinct from sa then 'summary' end) as changed,
    concat_ws(',', case when lb is distinct from la then 'location' end, case when sb is distinct from sa then 'summary' end) as impacting, lb is distinct from la or sb is distinct from sa as refresh, l0 as parsed_location, la, pa, sa from h)"""


def _log(t):
    k = F.col("o_orderkey")
    profiles = t.customer.select(F.col("c_custkey").alias("k"), F.lit(3).alias("version"), F.col("c_mktsegment").alias("location"), F.col("c_phone").alias("phone") if "c_phone" in t.customer.columns else F.concat(F.lit("ph"), "c_custkey").alias("phone"), F.lit(None).cast("string").alias("summary"))
    pair = lambda test, name, value: F.when(test, F.create_map(F.lit(name), value.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    updates = F.map_concat(
        pair((k % 5).isin(0, 1), "location", F.when(k % 5 == 0, F.col("o_orderpriority"))), pair(k % 3 == 0, "phone", F.concat(F.lit("p"), k % 4)), pair(k % 7 == 0, "summary", F.when(k % 14 == 0, F.col("o_orderstatus"))), pair(k % 11 == 0, "email", F.lit("no"))
    )
    changes = t.orders.select(F.col("o_custkey").alias("k"), k.alias("o"), updates.alias("updates"))
    return profiles, edits.edit_log(profiles, changes, "k", "o", _FIELDS)


def _sql(columns: list[str]) -> str:
    return _LOG if "c_phone" in columns else _LOG.replace("c_phone as phone", "'ph' || c_custkey as phone")


@query("lif_edit_log", f"with {_sql([])} select k, o, version, changed, impacting, refresh, parsed_location, coalesce(la, 'none') as location, coalesce(pa, 'none') as phone, coalesce(sa, 'none') as summary from r")
def lif_edit_log(t):
    _, log = _log(t)
    after = lambda f: F.coalesce(F.col(f"after.{f}"), F.lit("none")).alias(f)
    return log.select("k", "o", "version", F.array_join("changed", ",").alias("changed"), F.array_join("impacting", ",").alias("impacting"), "refresh", F.col("parsed.location").alias("parsed_location"), *[after(f) for f in _FIELDS])


@query("lif_profiles_at", f"with {_sql([])}, last as (select * from r where o <= 4000 qualify row_number() over (partition by k order by o desc) = 1) select p.k, coalesce(last.version, p.version) as version, coalesce(case when last.k is null then p.location else la end, 'none') as location, coalesce(case when last.k is null then p.phone else pa end, 'none') as phone, coalesce(sa, 'none') as summary, last.k is not null as edited from p left join last on last.k = p.k")
def lif_profiles_at(t):
    profiles, log = _log(t)
    got = edits.profiles_at(profiles, log, "k", "o", _FIELDS, at=F.lit(4000))
    return got.select("k", "version", *[F.coalesce(f, F.lit("none")).alias(f) for f in _FIELDS], "edited")


_PAYLOAD = """case o_orderkey % 9 when 0 then '{"title": "a", "required_skills": ["x", 7, null]}' when 1 then '{"title": 5}' when 2 then '[1]' when 3 then '{"title": "b", "nested": {"n": "x"}}' when 4 then '{"required_skills": null}' when 5 then 'no json {' when 6 then '{"title": null, "extra": [1, {}], "company": "' || o_orderstatus || '"}'
  when 7 then '{"responsibilities": "one"}' else '{"title": "t' || o_orderkey || '", "required_skills": ["a", "' || o_orderpriority || '"], "job_reference": "r"}' end"""


@query("json_checked", """select o_orderkey, case o_orderkey % 9 when 0 then '$.required_skills[1]' when 1 then '$.title' when 2 then '$' when 4 then '$.required_skills' when 5 then '$' when 7 then '$.responsibilities' end as fault,
  case o_orderkey % 9 when 3 then 'b' when 8 then 't' || o_orderkey end as title, case when o_orderkey % 9 = 6 then o_orderstatus end as company, case o_orderkey % 9 when 3 then '' when 6 then '' when 8 then 'a,' || o_orderpriority end as skills from orders""")
def json_checked(t):
    got = t.orders.select("o_orderkey", payloads.checked(F.expr(_PAYLOAD), payloads.POSTING).alias("c"))
    return got.select("o_orderkey", "c.fault", F.col("c.value.title").alias("title"), F.col("c.value.company").alias("company"), F.array_join("c.value.required_skills", ",").alias("skills"))


@query("json_plain", """select o_orderkey, '{"at":{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","time":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"},"by_key":{"' || o_custkey || '":[{"d":"' || strftime(o_orderdate, '%Y-%m-%d') || '","none":null}]},"status":"' || o_orderstatus || '"}' as json from orders""")
def json_plain(t):
    at = F.struct(F.col("o_orderdate").cast("timestamp").alias("time"), F.to_date("o_orderdate").alias("day"))
    nested = F.create_map(F.col("o_custkey"), F.array(F.struct(F.lit(None).cast("string").alias("none"), F.to_date("o_orderdate").alias("d"))))
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), at.alias("at"), nested.alias("by_key"))
    return rows.select("o_orderkey", payloads.plain_json(rows, "status", "at", "by_key").alias("json"))


_TERMS = ", ".join(f"'{x}'" for x in sorted(skills.KNOWN, key=lambda x: (-len(x), x)))
_EXTRA = "case doc_id % 4 when 0 then ' Uses Python/SQL, CI/CD;  GitHub\nActions' when 1 then ' node.js c++ java. javascript' when 2 then ' r/R (Spark) apache-spark Apache  Spark' else '' end"


@query("skills_known", f"""with d as (select doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '') || {_EXTRA.replace(chr(10), "' || chr(10) || '")}), '[^a-z0-9+#./-]+', ' ', 'g')) || ' ' as f from documents)
select doc_id, array_to_string(list_filter([{_TERMS}], lambda v: contains(replace(replace(f, '/', ' / '), ' ', '  '), ' ' || replace(replace(v, '/', ' / '), ' ', '  ') || ' ')), ',') as terms from d""")
def skills_known(t):
    return t.documents.select("doc_id", F.array_join(skills.terms_in(F.concat(F.coalesce("text", F.lit("")), F.expr(_EXTRA.replace("\n", "\\n")))), ",").alias("terms"))
