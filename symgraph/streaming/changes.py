"""Structured Streaming counterparts of the file watcher and the session log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symgraph.functions import scalars as S
from symgraph.sources.files import IGNORED


def normalise_events(events: DataFrame) -> DataFrame:
    """(file_path, op, ts): changes and deletions; a move deletes its source and changes its target.

    ``events`` has (path, op, ts, dest); works on batches and streams.
    """
    moved = F.array(F.struct(F.col("path").alias("file_path"), F.lit("deleted").alias("op")), F.struct(F.col("dest").alias("file_path"), F.lit("changed").alias("op")))
    one = F.array(F.struct(F.col("path").alias("file_path"), F.when(F.col("op") == "deleted", "deleted").otherwise("changed").alias("op")))
    x = events.select(F.explode(F.when(F.col("op") == "moved", moved).otherwise(one)).alias("e"), "ts").select("e.file_path", "e.op", "ts")
    return x.filter("file_path is not null")


def accepted(events: DataFrame, ignored: list[str] = IGNORED) -> DataFrame:
    """Events of source files outside ignored folders."""
    return events.filter(~F.col("file_path").rlike(S.glob_to_regex(ignored)) & S.language_of(F.col("file_path")).isNotNull())


def last_per_path(events: DataFrame) -> DataFrame:
    """The last event of each path: a deletion undoes earlier changes and the other way round."""
    return events.groupBy("file_path").agg(F.max_by("op", "ts").alias("op"), F.max("ts").alias("ts"))


def debounced(events: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(file_path, changes, first, last): bursts of events of a path that lie less than ``gap`` apart."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "file_path")
    return w.agg(F.count("*").alias("changes")).select("file_path", "changes", F.col("w.start").alias("first"), F.col("w.end").alias("last"))


def apply_changes(events: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``apply(deleted, changed, batch_id)`` for every micro-batch: deletions first, then changes.

    ``apply`` gets each batch id at least once and must write under it (see Ledger and
    VersionedTables), which makes repeated batches harmless.
    """

    def batch(df: DataFrame, n: int) -> None:
        last = last_per_path(accepted(normalise_events(df))).persist()
        apply(last.filter("op = 'deleted'").select("file_path"), last.filter("op = 'changed'").select("file_path"), n)
        last.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hash_changes(files: DataFrame) -> DataFrame:
    """(file_path, content_hash, action): of a stream of scans those whose hash is not the path's last one.

    The last hash of each path is kept as state: skip when equal, parse when new or other.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        out = []
        for df in batches:
            for h in df.sort_values("ts")["content_hash"]:
                if h is not None and h != old:
                    out.append((key[0], h, "parse" if old is None else "reparse"))
                    old = h
        if old is not None:
            state.update((old,))
        yield pd.DataFrame(out, columns=["file_path", "content_hash", "action"])

    grouped = files.groupBy("file_path")
    return grouped.applyInPandasWithState(step, "file_path string, content_hash string, action string", "last string", "append", GroupStateTimeout.NoTimeout)


def session_log(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The session events without repeated deliveries of an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window of event time; ``late`` null keeps the watermark that events have."""
    events = events.withWatermark("ts", late) if late else events
    w = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
