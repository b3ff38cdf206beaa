"""Event streams: de-duplication, windows, sessions, first-come leases.

Beyond what batch needs: each takes a streaming DataFrame with event_id, ts, user_id, event_type, value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 day"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream, in files as they come. ``path`` is a file or a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path if not path.endswith(".parquet") else f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, length: str, late: str = LATE) -> DataFrame:
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str = LATE) -> DataFrame:
    w = F.window("ts", length, step)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def leases(events: DataFrame, seconds: int, late: str = LATE) -> DataFrame:
    """Events that get their user's lease: those that come when the last lease of the user has run out.

    Rows of a trigger are met in the order of ts; state is one time for each user, dropped when it has run out.
    """

    def grant(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        taken = []
        for ts, event in zip(rows["ts"], rows["event_id"], strict=True):
            at = ts.timestamp()
            if until is None or at >= until:
                until = at + seconds
                taken.append((event, key[0]))
        state.update((until,))
        state.setTimeoutTimestamp(int(max(until * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(taken, columns=["event_id", "user_id"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(grant, "event_id long, user_id long", "until double", "append", GroupStateTimeout.EventTimeTimeout)


def into_table(stream, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends. Appended rows go to Parquet under ``path``; the checkpoint makes a second run
    take only what is new. What isn't a DataFrame runs itself (``state.missed``)."""
    if not isinstance(stream, DataFrame):
        stream.into_table(path, checkpoint)
        return
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q.format("parquet").option("path", path).start().awaitTermination()


def merge_each(stream: DataFrame, merge, checkpoint: str) -> None:
    """Calls merge(batch, batch_id) for each micro-batch; a merge by keys makes redelivery harmless."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
