"""Changed records of a stream into a collection of vectors, each version of a record once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import embedded
from ..session import kept
from ..sources.collection import Collection
from .events import merge_each

#: Beside key and vector: the hash of what was embedded, the order of the record, how often the key was embedded.
COLUMNS = "content_hash string, ordinal long, embeddings long"


def changed(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The last record of each key of a batch, if the index has none of that hash and none that is later; with ``embeddings``, counted on."""
    last = batch.groupBy("key").agg(F.max_by(F.struct("content_hash", "embedding_text", "ordinal"), "ordinal").alias("last")).select(F.col("key").cast("string").alias("key"), "last.*")
    have = stored.select("key", F.col("content_hash").alias("old_hash"), F.col("ordinal").alias("old_ordinal"), F.col("embeddings").alias("before"))
    new = last.join(have, "key", "left").where(F.col("before").isNull() | (~F.col("content_hash").eqNullSafe(F.col("old_hash")) & (F.col("ordinal") > F.col("old_ordinal"))))
    return new.select("key", "content_hash", "embedding_text", "ordinal", (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("embeddings"))


def index_changes(stream: DataFrame, collection: Collection, embed: Callable[[list[str]], list[list[float]]], checkpoint: str) -> None:
    """Runs a stream of records (key, content_hash, embedding_text, ordinal) over all that is there.

    Of each micro-batch only records whose hash differs from the index are embedded, and go in by key. The collection's manifest names the last batch it
    holds, so a batch that comes again after a failure changes nothing and isn't worked on. Records without key or text stay out.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if collection.holds(number):
            return
        filled = batch.where("coalesce(trim(cast(key as string)), '') <> '' and coalesce(trim(embedding_text), '') <> ''")
        # rows are few bytes each and much work, so their number and not their size says how many tasks embed them
        new = kept(changed(filled, collection.read()).repartition(batch.sparkSession.sparkContext.defaultParallelism))
        vectors = embedded(new, "key", embed).drop("point_id")
        collection.upsert(vectors.join(new.drop("embedding_text"), "key"), batch=number)

    merge_each(stream, merge, checkpoint)
