"""URLs as columns: canonical form, parts, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# Query parameters that only track.
TRACKING_PREFIX = "utm_"
TRACKING = ("fbclid", "gclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "source")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#(.*))?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 5 query, 7 fragment; empty where absent."""
    return F.regexp_extract(F.trim(url), _PARTS, n)


def kept_query(query: Column) -> Column:
    """The query's pairs without tracking ones, in their order; a key without '=' gets an empty value."""
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~name(p).startswith(TRACKING_PREFIX))
    return F.array_join(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")


def canonical(url: Column) -> Column:
    """Lower-cased scheme and host, path without closing slashes (the root keeps its one), query without tracking, no
    fragment. Without scheme or host the text itself without closing slashes; null or blank as empty.

    Pairs are kept as written: they aren't decoded and encoded again.
    """

    def joined(p: Column) -> Column:
        path = F.when(p.path.isin("", "/"), "/").otherwise(F.regexp_replace(p.path, "/+$", ""))
        query = F.when(p.query == "", "").otherwise(once(kept_query(p.query), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
        whole = F.concat(F.lower(p.scheme), F.lit("://"), F.lower(p.host), path, query)
        return F.when((p.scheme != "") & (p.host != ""), whole).otherwise(F.regexp_replace(p.raw, "/+$", ""))

    parts = lambda raw: F.struct(raw.alias("raw"), *[part(raw, n).alias(name) for n, name in ((1, "scheme"), (2, "host"), (3, "path"), (5, "query"))])
    return once(F.trim(F.coalesce(url, F.lit(""))), lambda raw: F.when(raw == "", "").otherwise(once(parts(raw), joined)))


def canonical_list(urls: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(urls, canonical), lambda u: u != ""))


def without_slash(url: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")


def link(url: Column) -> Column:
    """Without fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(part(url, 2), r":\d+$", ""))


def domain(url: Column) -> Column:
    """The host without any 'www.'."""
    return F.replace(host(url), F.lit("www."), F.lit(""))


def resolved(base: Column, href: Column) -> Column:
    """A link target seen on a page at ``base``: absolute, scheme-relative, root-relative or in the page's folder."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, part(base, 3), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def page_number(url: Column, n: Column, name: str = "page") -> Column:
    """The URL of another page: the parameter replaced, or added."""
    there = url.rlike(rf"[?&]{name}=\d*")
    swapped = F.regexp_replace(url, rf"([?&]{name}=)\d*", F.concat(F.lit("$1"), n.cast("string")))
    added = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(f"{name}="), n.cast("string"))
    return F.when(there, swapped).otherwise(added)


def allowed(host_column: Column, hosts: list[str]) -> Column:
    """Exact hosts, or '*.suffix' for sub-domains but not the suffix itself."""
    tests = [host_column.endswith(h[1:]) & (host_column != h[2:]) if h.startswith("*.") else host_column == h for h in (x.strip().lower() for x in hosts)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be fetched, null if it may; names aren't resolved."""
    h, port = host(url), F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    octets = F.split(h, r"\.")
    number = lambda i: F.try_element_at(octets, F.lit(i)).try_cast("int")
    ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inner = (
        number(1).isin(0, 10, 127) | (number(1) >= 224) | ((number(1) == 169) & (number(2) == 254)) | ((number(1) == 172) & number(2).between(16, 31))
        | ((number(1) == 192) & (number(2) == 168)) | ((number(1) == 100) & number(2).between(64, 127))
    )
    return (
        F.when(F.length(url) > 2048, "too long")
        .when(~F.lower(part(url, 1)).isin("http", "https"), "scheme")
        .when(part(url, 2).contains("@"), "credentials")
        .when(h == "", "no host")
        .when((h == "localhost") | h.endswith(".localhost") | (h == "localhost.localdomain"), "localhost")
        .when((port != "") & ~port.isin("80", "443"), "port")
        .when(ip & inner, "private address")
    )
