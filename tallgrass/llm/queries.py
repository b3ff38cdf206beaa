"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .collocations import collocations
from .common import table
from .conversations import repaired_conversations
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .licenses import license_scan
from .minhash_dedup import near_dedup
from .mixing import mix
from .substring_dedup import repeated_passages
from .suffix_dedup import repeated_bytes
from .token_counts import token_counts
from .token_output import tokens_written_and_read
from .toxicity import severity, train


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), every=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=4, letters_only=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 finds of the base phrases."""
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op8."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round(F.col("target") * 1000).cast("long").alias("target_e3"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_output": op9_token_output,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bpe": op12_bpe,
    "op13_collocations": op13_collocations,
    "license_base": license_base,
    "mixing_targets": mixing_targets,
}

#: Lower-cases A-Z only.
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of an ASCII string, a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda d, e: xor(d >> 1, case when d & 1 = 1 then 3988292384 else 0 end))))"""
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    #: Backwards from the last row: for each state (nothing read, system read, user read, assistant read) the cheapest (cost, audit, repaired turns) of the rest.
    "op11_conversation_repair": f"""
with recursive b as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind from conversations),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(range(case when kind = 0 then 0 when kind = 3 then 2 else 1 end)) from b)),
r as (
  select *, rtrim(text, {_WHITE}) as solid, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
s as (
  select *, left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair, row_number() over (partition by conv_id, role, text order by i) > 1 as again from r),
f as (
  select *, solid = '' as blank, solid <> '' and again as duplicate, solid <> '' and not again and right(solid, 1) not in ('.', '!', '?') as truncated,
    row_number() over (partition by conv_id order by i desc) as back
  from s),
t as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
    count(*) filter (truncated) as truncated, count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from f group by 1),
v as (
  select conv_id, n, 0 as back, {{'c': 0, 'a': '', 'r': ''}} as v0, {{'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} as v1, {{'c': 3, 'a': 'I', 'r': chr(10) || 'assistant:'}} as v2, {{'c': 0, 'a': '', 'r': ''}} as v3 from t
  union all
  select conv_id, n, back, least(w0, i2, j3), least(w1, i2, j3), least(w2, i3), least(w3, i2) from (
    select *, {{'c': w2.c + 3, 'a': 'I' || w2.a, 'r': chr(10) || 'user:' || w2.r}} as i2, {{'c': w3.c + 3, 'a': 'I' || w3.a, 'r': chr(10) || 'assistant:' || w3.r}} as i3,
      {{'c': w3.c + 6, 'a': 'II' || w3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || w3.r}} as j3
    from (
      select v.conv_id, n, f.back, m,
        least({{'c': v0.c + 4, 'a': 'D' || v0.a, 'r': v0.r}}, case when not m and x = 's' then {{'c': v1.c + more, 'a': 'K' || v1.a, 'r': chr(10) || role || ':' || text || v1.r}} end, case when not m and x = 'u' then {{'c': v2.c + more, 'a': 'K' || v2.a, 'r': chr(10) || role || ':' || text || v2.r}} end, case when not m then {{'c': v2.c + 3 + more, 'a': 'R' || v2.a, 'r': chr(10) || 'user:' || text || v2.r}} end) as w0,
        least({{'c': v1.c + 4, 'a': 'D' || v1.a, 'r': v1.r}}, case when not m and x = 'u' then {{'c': v2.c + more, 'a': 'K' || v2.a, 'r': chr(10) || role || ':' || text || v2.r}} end, case when not m then {{'c': v2.c + 3 + more, 'a': 'R' || v2.a, 'r': chr(10) || 'user:' || text || v2.r}} end) as w1,
        least({{'c': v2.c + 4, 'a': 'D' || v2.a, 'r': v2.r}}, case when not m and x = 'a' then {{'c': v3.c + more, 'a': 'K' || v3.a, 'r': chr(10) || role || ':' || text || v3.r}} end, case when not m then {{'c': v3.c + 3 + more, 'a': 'R' || v3.a, 'r': chr(10) || 'assistant:' || text || v3.r}} end) as w2,
        least({{'c': v3.c + 4, 'a': 'D' || v3.a, 'r': v3.r}}, case when not m and x = 'u' then {{'c': v2.c + more, 'a': 'K' || v2.a, 'r': chr(10) || role || ':' || text || v2.r}} end, case when not m then {{'c': v2.c + 3 + more, 'a': 'R' || v2.a, 'r': chr(10) || 'user:' || text || v2.r}} end) as w3
      from v join (select conv_id, back, blank or duplicate as m, left(role, 1) as x, role, text, case when truncated then 3 else 0 end as more from f) f
        on f.conv_id is not distinct from v.conv_id and f.back = v.back + 1))),
e as (select * from v where back = n)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(v0.c, 0)::bigint as cost, coalesce(v0.a, '') as audit, sha256(coalesce(substr(v0.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join t on t.conv_id is not distinct from o.conv_id left join e on e.conv_id is not distinct from o.conv_id""",
    "op1_decontaminate": rf"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents),
items as (select item_id, {_WORDS.format('text')} as w from benchmark where item_id is not null),
wins as (
  select distinct item_id, array_to_string(w[i:i + 9], ' ') as win, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct n from wins),
pos as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select doc_id, i, pos.n, item_id from pos join wins using (win)),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on d.doc_id = hits.doc_id left join its on d.doc_id = its.doc_id""",
    "license_base": rf"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents),
b as (select * from (values (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) as v(p, label)),
h as (select doc_id, i - 1 as i, label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), b where w[i] = p[1] and w[i:i + len(p) - 1] = p)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(count(h.i) as bigint) as n_base, min(h.i) as first_word, max(h.i) as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from d left join h on h.doc_id = d.doc_id group by d.doc_id, w""",
    "mixing_targets": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::double as size, [5, 2, 1][1 + ((row_number() over (order by source nulls last)) - 1) % 3]::double as w from d group by 1),
o as (select *, sum(size) over () as total, sum(w) over () as all_w, row_number() over (order by 3 * size / w, source nulls last) as k from s),
c as (select *, coalesce(sum(3 * size) over (order by k rows between unbounded preceding and 1 preceding), 0) as capped, coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) as capped_w from o),
l as (select arg_min((total - capped) / (all_w - capped_w), k) filter ((total - capped) / (all_w - capped_w) <= 3 * size / w) as level from c)
select doc_id, d.size, cast(s.size as bigint) as source_size, cast(round(least(3 * s.size, level * w) * 1000) as bigint) as target_e3 from d join s on s.source is not distinct from d.source, l""",
    "op10_minhash_dedup": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, array_to_string(w[i:i + 3], ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0))),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 80 * (na.n + nb.n - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from d union select e.b, r.c from r join e on e.a = r.doc_id),
m as (select doc_id, min(c) as component_id from r group by 1)
select m.doc_id, coalesce(n.n, 0) as n_shingles, component_id, m.doc_id = component_id as kept from m left join n on n.doc_id = m.doc_id""",
    "op13_collocations": rf"""
with p as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
  from documents),
t as (select lang, cast(sum(len(w)) as bigint) as n from p group by 1),
f as (
  select lang, phrase, any_value(size) as size, count(*) as a from (
    select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase
    from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from p, (select unnest([1, 2, 3]) as size) where len(w) >= size))
  group by 1, 2),
c as (select lang, phrase, size, a, string_split(phrase, ' ') as w from f where size > 1 and a >= 10),
cuts as (
  select lang, phrase, size, a, k, array_to_string(w[1:k], ' ') as one, array_to_string(w[k + 1:], ' ') as other
  from (select *, unnest(range(1, size)) as k from c)),
s as (
  select cuts.lang, cuts.phrase, cuts.size, cuts.a, k, x.a as l, y.a as r, cast(cast(1000000 as hugeint) * cuts.a * cuts.a // (cast(x.a as hugeint) * y.a) as bigint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = one join f y on y.lang = cuts.lang and y.phrase = other
  qualify row_number() over (partition by cuts.lang, cuts.phrase order by score, k) = 1),
o as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where size = 3),
m as (select lang, phrase, max(a) as a from o group by 1, 2)
select s.lang, row_number() over (partition by s.lang order by score desc, s.a desc, s.phrase) as rank, s.phrase, s.a, l, r, n, score
from s join t on t.lang = s.lang left join m on m.lang = s.lang and m.phrase = s.phrase
where m.a is null or 100 * m.a < 50 * s.a
qualify rank <= 2000""",
    "op3_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)""",
}
