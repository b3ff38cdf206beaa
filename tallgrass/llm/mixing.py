"""Mixing sources to target weights by entropy balancing.

Each document gets a rate exp(lambda * size / mean size) of its source's lambda, at most ``most``; of all
rates that meet the source's token target these have the least relative entropy to taking every document
once. The dual is convex and has one unknown for each source; Newton steps on its logarithm, kept within a
bracket, are aggregated over a histogram (source, size, documents), as documents of one source and size share
a rate. Rates are rounded to copies with the error in tokens carried from large sizes to small ones.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str = "text") -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, total), one row for each source.

    Weights repeat over sources in code-point order, null last. A target stops at ``most`` times its source's size;
    what is over goes to the others by weight, until none is above. Only sums come to the driver.
    """
    ordered = sources.withColumn("place", _places(sources))
    table = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))).drop("place")
    cap = F.col("total") * float(most)
    level: float | None = None
    full = F.lit(False)
    while True:
        row = table.withColumn("full", full).agg(F.sum("total").alias("all"), F.sum(F.when(F.col("full"), cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("w"), F.count_if("full").alias("n")).first()
        if row["w"] is None or row["w"] <= 0:
            break
        share = max(0.0, (row["all"] - row["fixed"]) / row["w"])
        over = F.col("weight") * F.lit(share) > cap
        grown = full | over
        if table.where(~full & over).isEmpty():
            level = share
            break
        # a source that is above once stays at its cap, so the share of the rest only grows
        full = grown if level is None else full | over
    target = F.when(full, cap) if level is None else F.when(full, cap).otherwise(F.col("weight") * F.lit(level))
    return table.withColumn("target", F.coalesce(target, F.lit(0.0)).cast("double")).withColumn("full", full)


def _places(sources: DataFrame) -> Column:
    from pyspark.sql import Window

    return F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1


def solve_rates(hist: DataFrame, targets: DataFrame, scratch: Scratch, most: int, steps: int = 60, near: float = 1e-9) -> DataFrame:
    """Newton steps for every source at once: (key, mean, lambda), lambda null where all rates are ``most``.

    hist: key, size, n; targets: key, total, docs, target, full. Each step is one aggregate over the histogram, with a
    row for each source out; a source that has met its target stands still.
    """
    state = scratch.put(targets.where("total > 0 and not full").select("key", "target", (F.col("total") / F.col("docs")).alias("mean"), F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("met")))
    hist = hist.where("size > 0")
    # decimal sums are the same in any order, so reruns agree to the last digit
    total = lambda x: F.sum(x.cast("decimal(28,8)")).cast("double")
    for _ in range(steps):
        c = F.col("size") / F.col("mean")
        z = F.col("x") * c
        free = z < F.lit(float(np.log(most)))
        mass = F.col("n") * F.col("size") * F.when(free, F.exp(F.least(z, F.lit(50.0)))).otherwise(float(most))
        sums = hist.join(state.where("not met"), "key").groupBy("key").agg(total(mass).alias("g"), total(F.when(free, mass * c).otherwise(0.0)).alias("h"))
        g, h, t, x = F.col("g"), F.col("h"), F.col("target"), F.col("x")
        moved = state.join(sums, "key", "left").select(
            "key", "target", "mean", x, (F.col("met") | (F.abs(g - t) <= near * t)).alias("met"), g, h,
            F.when(g < t, x).otherwise(F.col("low")).alias("low"), F.when(g > t, x).otherwise(F.col("high")).alias("high"),
        )
        newton = x + F.log(t / g) * g / F.when(h > 0, h)
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        away = F.when(F.col("low").isNull(), F.col("high") - 1 - F.abs("high")).when(F.col("high").isNull(), F.col("low") + 1 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
        following = scratch.put(moved.select("key", "target", "mean", F.when(F.col("met") | (t <= 0), x).when(inside, newton).otherwise(away).alias("x"), "low", "high", (F.col("met") | (t <= 0)).alias("met")))
        scratch.drop(state)
        state = following
        if state.where("not met").isEmpty():
            break
    return state.select("key", "mean", F.when(F.col("target") > 0, F.col("x")).otherwise(F.lit(float("-inf"))).alias("x"))


def carried(most: int):
    """Copies for each size of a source, from large to small; the tokens that rounding leaves are carried on."""

    def copies(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False, kind="stable")
        rest, out = 0.0, []
        for size, n, rate in zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist(), strict=True):
            if size <= 0:
                out.append(n)  # without words a document stays as it is and weighs nothing
                continue
            want = rate * n * size + rest
            k = min(most * n, max(0, round(want / size)))
            rest = want - k * size
            out.append(k)
        return pd.DataFrame({"key": group["key"], "size": group["size"], "n": group["n"], "copies": out})

    return copies


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: int = 3, text: str = "text", key: str = "doc_id", source: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """For each row: key, size, source_size, target, copies and taken (copies * size), and the columns of ``extra``.

    A null text has size 0; a null source is a source of its own, the last. Documents of size 0 keep
    one copy. Null and repeated keys are kept, one output row for each input row: rows of one source,
    size and key may swap copies. If all texts are empty, targets are 0. No rows give no rows.

    The texts are read once, to be counted. A class (source, size) may hold any share of the rows: it is cut into
    blocks of about 4,000 rows by the keys' hashes, and the class's extra copies go to its blocks by their counts
    and then to the first rows of each block, so no window holds more than a block. What one task holds of a source
    is its distinct sizes.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    named = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = scratch.put(docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), named.alias("key"), word_count(text).alias("size"), F.xxhash64(F.col(key).cast("long"), F.lit(41)).alias("draw"), *[F.col(c).alias(f"extra_{c}") for c in extra]))
    hist = scratch.put(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = scratch.put(hist.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs")))
    targets = scratch.put(source_targets(sums, weights, most))
    rates = solve_rates(hist.select("key", "size", "n"), targets, scratch, most)
    rated = hist.join(targets.select("key", "full"), "key").join(rates, "key", "left")
    rate = F.when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("x") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    classes = scratch.put(rated.select("key", "size", "n", F.coalesce(rate, F.lit(0.0)).alias("rate")).groupBy("key").applyInPandas(carried(most), "key string, size long, n long, copies long"))

    # blocks of a class, and how many of its rows get one copy more than the others
    block = F.pmod(F.col("draw"), F.greatest(F.lit(1), F.ceil(F.col("n") / 4000)).cast("long")).alias("block")
    # classes grow with the sizes there are: they are joined, never sent to all tasks
    placed = rows.join(classes.hint("merge"), ["key", "size"]).withColumn("block", block)
    from pyspark.sql import Window

    counts = placed.groupBy("key", "size", "block", "n", "copies").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.expr("copies - n * (copies div n)")
    share = counts.select("key", "size", "block", F.least(F.greatest(over - before, F.lit(0)), F.col("m")).alias("more"))
    share = share.where("more > 0")
    first = F.row_number().over(Window.partitionBy("key", "size", "block").orderBy("draw", "id"))
    ranked = placed.withColumn("nth", first).join(share.hint("merge"), ["key", "size", "block"], "left")
    got = ranked.withColumn("copies", (F.expr("copies div n") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0)).cast("long"))
    got = got.join(targets.select("key", F.col("total").alias("source_size"), "target"), "key")
    return got.select(F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"extra_{c}").alias(c) for c in extra])
