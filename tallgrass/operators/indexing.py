"""Embedding and indexing of tower records that wait for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uuid5
from ..functions.text import head_and_tail

MOST_CHARS, BATCH = 12_000, 16


def pending(towers: DataFrame, key: str, *, ids: DataFrame | None = None, all_: bool = False) -> DataFrame:
    """Towers to index: filled text and id, not indexed yet unless all are asked for, only some ids if given."""
    rows = towers.where(F.trim(F.coalesce("embedding_text", F.lit(""))) != "").where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    if not all_:
        rows = rows.where(~F.col("embedding_status").eqNullSafe("indexed"))
    return rows if ids is None else rows.join(ids.select(key), key, "left_semi")


def scanned(towers: DataFrame, key: str, *, only_pending: bool = False, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Towers, newest first (ties by key): all or those not indexed yet, only some ids if given, at most ``limit``."""
    rows = towers.where(~F.col("embedding_status").eqNullSafe("indexed")) if only_pending else towers
    if ids is not None:
        rows = rows.join(ids.select(key).where(F.trim(F.col(key).cast("string")) != "").distinct(), key, "left_semi")
    rows = rows.orderBy(F.desc("updated_at"), key)
    return rows.limit(limit) if limit else rows


def skipped(towers: DataFrame, key: str) -> DataFrame:
    """How many towers can't be indexed, by reason."""
    return towers.agg(F.count_if(F.coalesce(F.col(key).cast("string"), F.lit("")) == "").alias("no_id"), F.count_if(F.trim(F.coalesce("embedding_text", F.lit(""))) == "").alias("no_text"))


def embedded(rows: DataFrame, key: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, point_id, vector): ``embed`` gets sixteen texts at a time, each cut around its middle to 12,000 characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["t"].tolist()
            vectors = [v for i in range(0, len(texts), BATCH) for v in embed(texts[i : i + BATCH])]
            if len(vectors) != len(texts) or len({len(v) for v in vectors}) > 1:
                raise ValueError("a vector for each text, all of one size, is needed")
            yield pd.DataFrame({"k": pdf["k"], "v": vectors})

    cut = rows.select(F.col(key).alias("k"), head_and_tail(F.col("embedding_text"), MOST_CHARS, 0.75, "\n...\n").alias("t"))
    kind = dict(rows.dtypes)[key]
    return cut.mapInPandas(run, f"k {kind}, v array<double>").select(F.col("k").alias(key), uuid5(F.col("k").cast("string")).alias("point_id"), F.col("v").alias("vector"))


def hashed_vector(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in for a model: words hashed to signed counts."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * size
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % size] += 1.0 if h >> 31 else -1.0
        out.append(v)
    return out


def indexed(towers: DataFrame, done: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(towers, index state) after ``done`` (key, point_id) was stored."""
    j = towers.join(done.select(key, "point_id"), key, "left")
    got = F.col("point_id").isNotNull()
    after = j.select(*[F.when(got, "indexed").otherwise(F.col(c)).alias(c) if c == "embedding_status" else F.col(c) for c in towers.columns])
    state = j.where(got).select(key, "point_id", "content_hash", now.alias("indexed_at"))
    return after, state
