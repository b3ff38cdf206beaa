"""Identities and content hashes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact
from .urls import without_slash


def content_hash(**fields: Column) -> Column:
    """sha256 of a JSON object with sorted keys and nulls kept. Stable here; a number's text is Spark's."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def prefixed_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(length)))


def job_identity(target: Column, url: Column, title: Column, company: Column, location: Column, reference: Column) -> Column:
    """The URL if there is one, else reference, title, company and place."""
    low = lambda c: F.lower(compact(c))
    address = without_slash(url)
    return F.when(address != "", F.concat_ws("|", target, F.lit("url"), address)).otherwise(F.concat_ws("|", target, F.lit("fallback"), low(reference), low(title), low(company), low(location)))


#: Fixed value: the name space of URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """A version-5 UUID from SHA-1, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def record_id(prefix: str, **fields: Column) -> Column:
    """A prefix and 24 digits of the hash of a JSON object with sorted keys, nulls kept and a space after commas and colons, as feedback and training pairs are named."""
    names = sorted(fields)
    text = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6), F.lit("null"))
    value = lambda c: F.when(c.isNull(), "null").otherwise(text(c))
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), value(fields[n])) for n in names])
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), F.lit(24)))
