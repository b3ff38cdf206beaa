"""Pages: titles, links, portal classes, fingerprints, discovery rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

# Markers of blocked pages and of load-more controls, in lower case.
BLOCKED = ("captcha", "verify you are human", "access denied", "cf-chl-", "cloudflare ray id", "unusual traffic", "robot check")
LOAD_MORE = ("load more jobs", "load more", "show more jobs", "view more jobs")
NEXT = r"(?:rel=[\"']next[\"']|aria-label=[\"'][^\"']*next)"


def title(html: Column) -> Column:
    """The page's title, spaces collapsed, at most 300 characters; null if none."""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1)
    return F.nullif(F.left(F.trim(F.regexp_replace(raw, r"\s+", " ")), F.lit(300)), F.lit(""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+)"), 1)


def anchors(html: Column) -> Column:
    """(href, text) of each anchor."""
    whole = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), 1)
    one = lambda a: F.struct(F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), F.trim(F.regexp_replace(F.regexp_extract(a, r"(?is)>(.*)</a>", 1), r"<[^>]+>", "")).alias("text"))
    return F.transform(whole, one)


def links(pages: DataFrame, *, contains: str = "", words: tuple[str, ...] = (), hosts: list[str] | None = None, exclude: Column | None = None) -> DataFrame:
    """(page_id, links): absolute links in order, each once.

    A link stays if its host is allowed, it isn't the page itself or excluded, and it holds ``contains`` or its anchor's text
    holds one of ``words``.
    """
    found = pages.select("page_id", "url", F.posexplode(anchors(F.col("html"))).alias("at", "a"))
    absolute = urls.link(urls.resolved(F.col("url"), F.col("a.href")))
    rows = found.withColumn("link", absolute).where(F.col("link").rlike("^https?://"))
    told = F.col("link").contains(contains) if contains else F.lit(not words)
    for w in words:
        told = told | F.lower("a.text").contains(w.lower())
    rows = rows.where(told & (F.col("link") != urls.link(F.col("url"))))
    if hosts is not None:
        rows = rows.where(urls.allowed(urls.host(F.col("link")), hosts))
    if exclude is not None:
        rows = rows.where(~exclude)
    ordered = F.array_sort(F.collect_list(F.struct("at", "link")))
    got = rows.groupBy("page_id").agg(F.array_distinct(F.transform(ordered, lambda x: x.link)).alias("links"))
    return pages.select("page_id").join(got, "page_id", "left").select("page_id", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def signals(url: Column, html: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(html, F.lit("")))
    more = F.lit(False)
    for m in LOAD_MORE:
        more = more | low.contains(m)
    return {"has_load_more": more, "has_next": F.lower(url).contains("?page=") | low.rlike(NEXT), "page_links": F.regexp_count(low, F.lit(r"[?&](?:amp;)?page=\d+"))}


def classify(url: Column, html: Column) -> Column:
    """(platform, profile, confidence in hundredths, needs review): the first rule that holds."""
    all_ = F.lower(F.concat_ws("\n", url, F.coalesce(html, F.lit(""))))
    h = urls.host(url)
    blocked = F.lit(False)
    for m in BLOCKED:
        blocked = blocked | all_.contains(m)
    s = signals(url, html)
    row = lambda platform, profile, confidence, review: F.struct(F.lit(platform).alias("platform"), F.lit(profile).alias("profile"), F.lit(confidence).alias("confidence"), F.lit(review).alias("review"))
    return (
        F.when(blocked, row("blocked_or_protected", "generic_listing", 99, True))
        .when(h.contains("workday") | all_.contains("workday"), row("workday", "workday", 94, True))
        .when(all_.contains("jobdiva"), row("jobdiva", "jobdiva", 96, True))
        .when(h.contains("greenhouse.io") | all_.contains("greenhouse"), row("greenhouse", "generic_listing", 89, False))
        .when(h.contains("lever.co"), row("lever", "generic_listing", 90, False))
        .when(h.contains("ashbyhq.com") | all_.contains("ashby"), row("ashby", "generic_listing", 83, False))
        .when(url.contains("#") | all_.contains("hash-router") | all_.contains("hash route"), row("custom_spa", "hash_route_spa", 74, True))
        .when(s["has_load_more"], row("custom_listing", "load_more_button", 70, True))
        .when(s["has_next"], row("custom_listing", "paginated_anchor", 66, True))
        .otherwise(row("custom_listing", "generic_listing", 50, True))
    )


def fingerprint(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def stalled(rounds: DataFrame, keys: list[str], order: str, item: str, patience: int) -> DataFrame:
    """Where discovery stops for each of ``keys``: the first round after ``patience`` rounds without anything new.

    rounds: one row for each item seen in a round. Returns keys, last_round, items (distinct until then) and stalled.
    """
    first = rounds.groupBy(*keys, item).agg(F.min(order).alias("new_in"))
    seen = rounds.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("n"))
    fresh = first.groupBy(*keys, F.col("new_in").alias(order)).agg(F.count(F.lit(1)).alias("fresh"))
    grown = seen.join(fresh, [*keys, order], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    by = Window.partitionBy(*keys).orderBy(order)
    run = F.sum(F.when(F.col("fresh") > 0, 1).otherwise(0)).over(by)
    runs = grown.withColumn("run", run)
    idle = F.sum(F.when(F.col("fresh") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "run").orderBy(order))
    marked = runs.withColumn("idle", idle).withColumn("total", F.sum("fresh").over(by))
    stop = marked.groupBy(*keys).agg(F.min(F.when(F.col("idle") >= patience, F.col(order))).alias("stop"), F.max(order).alias("last"))
    out = marked.join(stop, keys).where(F.col(order) <= F.coalesce("stop", "last"))
    return out.groupBy(*keys).agg(F.max(order).alias("last_round"), F.max("total").alias("items"), F.first(F.col("stop").isNotNull()).alias("stalled"))
