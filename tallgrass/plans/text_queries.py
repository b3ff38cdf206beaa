"""Text, identity, URL and page queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text, urls
from ..operators import lifecycle, web
from .registry import query

SPACES_SQL = r"trim(regexp_replace(replace(coalesce(text, ''), chr(0), ' '), '\s+', ' ', 'g'))"


@query("txt_compact", f"select doc_id, {SPACES_SQL} as compact from documents")
def txt_compact(t):
    return t.documents.select("doc_id", text.compact(F.col("text")).alias("compact"))


@query("txt_keep_lines", r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as md5 from documents")
def txt_keep_lines(t):
    return t.documents.select("doc_id", F.md5(text.compact_lines(F.col("text"))).alias("md5"))


@query("txt_truncate", "select doc_id, case when length(text) <= 600 then text else concat(left(text, 437), chr(10) || '[...]' || chr(10), right(text, 156)) end as cut from documents")
def txt_truncate(t):
    return t.documents.select("doc_id", text.head_and_tail(F.col("text"), 600, 437.5 / 593, "\n[...]\n").alias("cut"))


@query("txt_window_trim", "select doc_id, case when length(text) <= 400 then text else concat(left(text, 277), ' .. ', right(text, 119)) end as cut from documents")
def txt_window_trim(t):
    return t.documents.select("doc_id", text.head_and_tail(F.col("text"), 400, 0.7, " .. ").alias("cut"))


@query("txt_brief", f"select doc_id, case when length(c) <= 120 then c else concat(rtrim(left(c, 117)), '...') end as brief from (select doc_id, {SPACES_SQL} as c from documents)")
def txt_brief(t):
    return t.documents.select("doc_id", text.brief(F.col("text"), 120).alias("brief"))


@query("txt_brief_list", "select conv_id, case when length(c) <= 60 then c else concat(rtrim(left(c, 57)), '...') end as roles from (select conv_id, string_agg(role, '; ' order by turn) as c from conversations group by 1)")
def txt_brief_list(t):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role)
    return t.conversations.groupBy("conv_id").agg(roles.alias("r")).select("conv_id", text.brief_list(F.col("r"), 60).alias("roles"))


for _name, _alphabet, _joiner, _most in (("portal", "a-z0-9", "-", 80), ("artifact", "a-z0-9._", "-", 120), ("file", "a-z0-9_", "_", 140), ("upload", "a-z0-9.", "-", 180), ("run", "a-z0-9", "_", 80)):

    @query(f"txt_slug_{_name}", f"select doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '[^{_alphabet}]+', '{_joiner}', 'g'), '^[{_joiner}]+|[{_joiner}]+$', '', 'g'), {_most}), ''), 'item') as slug from documents")
    def txt_slug(t, alphabet=_alphabet, joiner=_joiner, most=_most):
        return t.documents.select("doc_id", text.slug(F.col("text"), alphabet, joiner, most).alias("slug"))


@query("txt_email", "select c_custkey, nullif(lower(trim(concat(' ', c_name, '@Ex.com '))), '') as email from customer")
def txt_email(t):
    return t.customer.select("c_custkey", text.email(F.concat(F.lit(" "), "c_name", F.lit("@Ex.com "))).alias("email"))


@query("txt_clean", f"select doc_id, nullif(left({SPACES_SQL}, 80), '') as clean from documents")
def txt_clean(t):
    return t.documents.select("doc_id", text.clean(F.col("text"), 80).alias("clean"))


@query("txt_json_block", "select event_id, props as block, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def txt_json_block(t):
    """Answers with fences, with words around, and bare."""
    e = F.col("event_id") % 3
    said = F.when(e == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" Done."))).otherwise(F.col("props"))
    return t.events.select("event_id", text.json_block(said).alias("block")).withColumn("k", F.get_json_object("block", "$.k").cast("long"))


@query("txt_header", r"select conv_id, turn, md5(upper(regexp_replace(regexp_replace(regexp_replace(trim(replace(text, 'ß', 'ss')), '^[^A-Za-z0-9_]+', ''), '[\s:\-]+$', ''), '\s+', ' ', 'g'))) as header_md5 from conversations")
def txt_header(t):
    """The sharp s has no upper case that all engines agree on."""
    return t.conversations.select("conv_id", "turn", F.md5(text.header(F.replace("text", F.lit("ß"), F.lit("ss")))).alias("header_md5"))


@query("txt_quality", r"""
select doc_id, length(t) as char_count, case when length(t) > 0 then cast(floor(cast(length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) as double) / length(t) * 1000) as bigint) else 0 end as alnum_permille,
  length(t) - length(replace(t, chr(65533), '')) as replacement_chars, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as email_count,
  len(regexp_extract_all(t, '\+?\d[\d\s().-]{7,}\d')) as phone_count,
  cast(contains(lower(t), 'summary') as int) + cast(contains(lower(t), 'experience') as int) + cast(contains(lower(t), 'education') as int) + cast(contains(lower(t), 'skills') as int) + cast(contains(lower(t), 'projects') as int) + cast(contains(lower(t), 'certifications') as int) as section_hits,
  case when length(t) < 200 then 'poor' when cast(length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) as double) / length(t) < 0.45 then 'poor' else 'fair' end as verdict
from (select doc_id, coalesce(text, '') as t from documents)""")
def txt_quality(t):
    # a file of few row groups is few tasks, whatever it holds
    rows = t.documents.select("doc_id", "text").repartition("doc_id")
    return rows.select("doc_id", *[c.alias(n) for n, c in text.quality(F.col("text")).items()])


@query("txt_contact", r"""
select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:12], '|') as head,
  nullif(lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')), '') as email, nullif(trim(regexp_extract(text, '\+?\d[\d\s().-]{7,}\d')), '') as phone
from documents""")
def txt_contact(t):
    c = text.contact(F.col("text"))
    return t.documents.select("doc_id", F.array_join(c["head_lines"], "|").alias("head"), c["email"].alias("email"), c["phone"].alias("phone"))


@query("hsh_sha256", f"select doc_id, sha256({SPACES_SQL}) as sha from documents")
def hsh_sha256(t):
    return t.documents.select("doc_id", F.sha2(text.compact(F.col("text")), 256).alias("sha"))


@query("hsh_content", """select o_orderkey, sha256(concat('{"cust":', o_custkey, ',"status":"', o_orderstatus, '","summary":null}')) as sha from orders""")
def hsh_content(t):
    return t.orders.select("o_orderkey", hashing.content_hash(status=F.col("o_orderstatus"), cust=F.col("o_custkey"), summary=F.lit(None).cast("string")).alias("sha"))


@query("hsh_identity", "select o_orderkey, case when o_orderkey % 2 = 0 then concat('t|url|https://ex.com/', o_orderkey) else concat('t|fallback||', lower(o_orderpriority), '|', o_custkey, '|', lower(o_orderstatus)) end as identity from orders")
def hsh_identity(t):
    url = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" https://ex.com/"), "o_orderkey", F.lit("/ ")))
    key = hashing.job_identity(F.lit("t"), url, F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.lit(None).cast("string"))
    return t.orders.select("o_orderkey", key.alias("identity"))


@query("hsh_prefixed", "select c_custkey, concat('cand_', left(sha256(concat(c_custkey, '|', c_name)), 24)) as candidate_id from customer")
def hsh_prefixed(t):
    return t.customer.select("c_custkey", hashing.prefixed_id("cand_", F.col("c_custkey"), F.col("c_name")).alias("candidate_id"))


@query("hsh_uuid5", """with d as (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) as h from customer)
select c_custkey, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (position(substr(h, 17, 1) in '0123456789abcdef') - 1) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) as point_id from d""")
def hsh_uuid5(t):
    return t.customer.select("c_custkey", hashing.uuid5(F.col("c_name")).alias("point_id"))


CANON_SQL = r"""concat(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#(.*))?$', 1)), '://', lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#(.*))?$', 2)),
  case when regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) in ('', '/') then '/' else rtrim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') end,
  case when q <> '' then concat('?', q) else '' end)"""
PAGES_SQL = r"""p as (select *, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not (lower(split_part(x, '=', 1)) in ('fbclid', 'gclid', 'gbraid', 'wbraid', 'mc_cid', 'mc_eid', 'igshid', 'ref', 'ref_src', 'source') or starts_with(lower(x), 'utm_'))), '&') as q from pages)"""


@query("url_canonical", f"with {PAGES_SQL} select page_id, {CANON_SQL} as canonical from p")
def url_canonical(t):
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("url_list", f"with {PAGES_SQL} select page_id % 10 as g, count(distinct {CANON_SQL}) as n from p group by 1")
def url_list(t):
    grouped = t.pages.groupBy((F.col("page_id") % 10).alias("g")).agg(F.collect_list("url").alias("urls"))
    return grouped.select("g", F.size(urls.canonical_list(F.col("urls"))).cast("long").alias("n"))


@query("url_simple", "select page_id, rtrim(trim(url), '/') as simple from pages")
def url_simple(t):
    return t.pages.select("page_id", urls.without_slash(F.col("url")).alias("simple"))


@query("url_link", "select page_id, rtrim(regexp_replace(url, '#.*$', ''), '/') as link from pages")
def url_link(t):
    return t.pages.select("page_id", urls.link(F.col("url")).alias("link"))


@query("url_domain", "select page_id, replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), 'www.', '') as domain from pages")
def url_domain(t):
    return t.pages.select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("url_page_param", r"select page_id, case when regexp_matches(url, '[?&]page=\d*') then regexp_replace(url, '([?&]page=)\d*', '\1' || '7') else concat(url, case when contains(url, '?') then '&' else '?' end, 'page=7') end as next from pages")
def url_page_param(t):
    return t.pages.select("page_id", urls.page_number(F.col("url"), F.lit(7)).alias("next"))


@query("url_apply_chain", "select p_partkey, coalesce(nullif(case when p_partkey % 2 = 0 then '' end, ''), nullif(case when p_partkey % 3 = 0 then concat('https://a/', p_partkey) end, ''), 'https://b') as apply_url from part")
def url_apply_chain(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", text.first_filled(F.when(k % 2 == 0, F.lit("")), F.when(k % 3 == 0, F.concat(F.lit("https://a/"), k)), F.lit("https://b")).alias("apply_url"))


@query("url_unsafe", r"""
select s_suppkey, case s_suppkey % 9 when 0 then 'private address' when 1 then 'localhost' when 2 then 'private address' when 3 then 'scheme' when 4 then 'port' when 5 then 'credentials' when 6 then 'private address' end as reason from supplier""")
def url_unsafe(t):
    made = F.element_at(F.array(*map(F.lit, ("http://10.1.2.3/x", "http://a.localhost/", "https://192.168.1.9", "ftp://ex.com", "https://ex.com:8080/", "https://u:p@ex.com/", "http://127.0.0.1:80/", "https://ex.com/", "https://8.8.8.8/#a"))), (F.col("s_suppkey") % 9 + 1).cast("int"))
    return t.supplier.select("s_suppkey", urls.unsafe_reason(made).alias("reason"))


@query("web_allowlist", "select page_id, coalesce(h like '%.example.com' or h = 'blog.ththan.example.net', false) as allowed from (select page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as h from pages)")
def web_allowlist(t):
    return t.pages.select("page_id", urls.allowed(urls.host(F.col("url")), ["*.example.com", "blog.ththan.example.net"]).alias("allowed"))


TITLE_SQL = r"nullif(left(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>\s*(.*?)\s*</title>', 1), '\s+', ' ', 'g')), 300), '')"


@query("web_title", f"select page_id, {TITLE_SQL} as title from pages")
def web_title(t):
    return t.pages.select("page_id", web.title(F.col("html")).alias("title"))


@query("web_links", r"""
with p as (select page_id, rtrim(regexp_replace(url, '#.*$', ''), '/') as self, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) as root,
  regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1) as hrefs from pages),
u as (select page_id, self, unnest(list_distinct(list_transform(hrefs, lambda h: rtrim(regexp_replace(concat(root, h), '#.*$', ''), '/')))) as link from p)
select page_id, cast(count(link) filter (where link <> self) as bigint) as n_links, min(link) filter (where link <> self) as first_link, max(link) filter (where link <> self) as last_link from u group by 1
union all select page_id, 0, null, null from pages where page_id not in (select page_id from u)""")
def web_links(t):
    found = web.links(t.pages)
    return found.select("page_id", F.size("links").cast("long").alias("n_links"), F.array_min("links").alias("first_link"), F.array_max("links").alias("last_link"))


@query("web_signals", r"select page_id, contains(lower(html), 'load more') or contains(lower(html), 'show more jobs') or contains(lower(html), 'view more jobs') as has_load_more, contains(lower(url), '?page=') or regexp_matches(lower(html), '(?:rel=[\x22\x27]next[\x22\x27]|aria-label=[\x22\x27][^\x22\x27]*next)') as has_next, len(regexp_extract_all(lower(html), '[?&](?:amp;)?page=\\d+')) as page_links from pages".replace("\\\\d", "\\d"))
def web_signals(t):
    return t.pages.select("page_id", *[c.alias(n) for n, c in web.signals(F.col("url"), F.col("html")).items()])


@query("web_classify", r"""
select page_id, case r.m when 0 then 'blocked_or_protected' when 1 then 'workday' when 2 then 'greenhouse' when 3 then 'custom_listing' else case when contains(url, '#') then 'custom_spa' else 'custom_listing' end end as platform,
  case r.m when 0 then 'generic_listing' when 1 then 'workday' when 2 then 'generic_listing' when 3 then 'load_more_button' else case when contains(url, '#') then 'hash_route_spa' when contains(url, '?page=') then 'paginated_anchor' else 'generic_listing' end end as profile
from (select page_id, case when page_id % 6 = 3 then replace(url, '#', '') else url end as url, page_id % 6 as m from pages) r""")
def web_classify(t):
    """Pages with markers put in, as the driver's pages carry none."""
    m = F.col("page_id") % 6
    marked = F.concat("html", F.when(m == 0, "please verify you are HUMAN").when(m == 1, "Workday").when(m == 2, "GreenHouse").when(m == 3, "Load more jobs").otherwise(""))
    url = F.when(m == 3, F.replace("url", F.lit("#"), F.lit(""))).otherwise(F.col("url"))
    got = t.pages.select("page_id", url.alias("url"), marked.alias("html")).select("page_id", web.classify(F.col("url"), F.col("html")).alias("c"))
    return got.select("page_id", "c.platform", "c.profile")


@query("web_fingerprint_dup", "select sha256(text) as fingerprint, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def web_fingerprint_dup(t):
    return t.documents.groupBy(web.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("web_stall", """
with s as (select user_id, cast(floor(epoch(ts) / 86400) as bigint) as day, event_type from events), f as (select user_id, event_type, min(day) as day from s group by 1, 2),
r as (select s.user_id, s.day, count(distinct f.event_type) as fresh from (select distinct user_id, day from s) s left join f on f.user_id = s.user_id and f.day = s.day group by 1, 2),
g as (select *, sum(case when fresh > 0 then 1 else 0 end) over (partition by user_id order by day) as run, sum(fresh) over (partition by user_id order by day) as total from r),
i as (select *, sum(case when fresh = 0 then 1 else 0 end) over (partition by user_id, run order by day) as idle from g),
st as (select user_id, min(day) filter (where idle >= 3) as stop, max(day) as last from i group by 1)
select i.user_id, max(day) as last_round, cast(max(total) as bigint) as items, any_value(stop is not null) as stalled from i join st on i.user_id = st.user_id where day <= coalesce(stop, last) group by 1""")
def web_stall(t):
    rounds = t.events.select("user_id", F.floor(F.unix_seconds("ts") / 86400).cast("long").alias("day"), "event_type")
    return web.stalled(rounds, ["user_id"], "day", "event_type", 3)


@query("web_catalog_slice", rf"""with {PAGES_SQL}, d as (select *, row_number() over (partition by {CANON_SQL} order by page_id) as n from p)
select replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), 'www.', '') as value, count(*) as count from d where n = 1 and {TITLE_SQL} is not null group by 1 order by 2 desc, 1 limit 8""")
def web_catalog_slice(t):
    """Pages as a catalog: canonical, each once, with a title, counted by host."""
    rows = t.pages.withColumn("canonical", urls.canonical(F.col("url")))
    once = lifecycle.latest(rows, ["canonical"], F.col("page_id"))
    titled = once.where(web.title(F.col("html")).isNotNull())
    return titled.groupBy(urls.domain(F.col("url")).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(8)
