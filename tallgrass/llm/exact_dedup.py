"""Exact duplicates by distributed most-significant-digit radix partitioning.

A digit is a run of bytes, longer from level to level (64, 256, 1024, ...). Each level splits the
groups that the level before has left by the next digit; a group that is single, or whose texts
have ended, is done. Equality of texts is decided by the bytes themselves, never by a digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def collapsed(text: str = "text") -> Column:
    """A text with each run of spaces and tabs to carriage returns as one space, null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", first: int = 64, widen: int = 4) -> DataFrame:
    """Returns key, keep_id, group_size, kept and text_sha256 for each row of ``docs``.

    Texts are equal when ``collapsed`` makes them the same bytes. Of equal texts the row with the
    smallest key stays; a null key comes after all others, and of rows that also share the key one
    stays (the first in input order). A null text is an empty one. Other columns are ignored; no rows
    give no rows.

    Each level aggregates (group, digit) with partial sums, so a digit shared by a third of all rows
    is one row a task; texts then meet only the groups of two or more, in a left join whose large
    side Spark may split. A text moves while its group is open and is dropped once it is done.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    body = collapsed(text)
    # numbers of rows are drawn once, so that no task that runs again draws others
    rows = base = scratch.put(docs.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.sha2(body, 256).alias("sha"), F.lit(0).cast("long").alias("group"), body.cast("binary").alias("rest")))
    done: list[DataFrame] = []
    width = first
    while True:
        split = rows.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        groups = split.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("next"), F.min("id").alias("keep"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("stays"))
        shared = scratch.put(groups.where("n > 1"))
        met = split.join(shared.hint("merge"), ["group", "digit"], "left")
        alone = F.col("n").isNull()
        over = alone | (F.octet_length("digit") < width)
        step = scratch.put(
            met.select(
                "id", "row", "sha", F.col("next").alias("group"), F.coalesce("n", F.lit(1)).alias("n"),
                F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"), (alone | (F.col("row") == F.col("stays"))).alias("kept"),
                over.alias("over"), F.when(~over, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            )
        )
        scratch.drop(shared, *([base] if width == first else []))
        done.append(step.where("over").select("id", "keep", "n", "kept", "sha"))
        rows = step.where("not over").select("id", "row", "sha", "group", "rest")
        if rows.isEmpty():
            break
        width *= widen
    every = reduce(DataFrame.unionByName, done)
    return every.select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
