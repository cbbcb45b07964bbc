"""Incremental maintenance from a stream of changes: each micro-batch is applied to the latest saved
version of the graph and saved as the next.  A batch that was applied before is skipped, so that a
restart after a lost driver gives the same versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evolve import apply_changes, changeset_hash
from ..schema import CodeGraph
from ..sources.files import exists, load, save


def apply_stream(changes: DataFrame, path: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query over streamed (op, path, from_path).  Version 0 must have been saved under
    ``path``/v0; batch n makes v(n + 1).  ``parse`` gives the entities and raw references of changed paths."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        after = f"v{n + 1}"
        if exists(spark, f"{path}/{after}/edges/_SUCCESS"):
            return
        graph: CodeGraph = load(spark, f"{path}/v{n}")
        rows = batch.dropDuplicates(["op", "path"])
        save(apply_changes(graph, rows, *parse(rows)), path, after)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def due(before: tuple[str, str] | None, head: str, changes: DataFrame) -> tuple[str, str] | None:
    """The state (commit, digest of the changes) to remember if there is something to do, None if it is the
    state ``before``.  A caller remembers it after the update succeeded, so that errors are tried again."""
    digest = changeset_hash(changes).first().changeset or ""
    return None if before == (head, digest) else (head, digest)


def reverted(before: DataFrame, now: DataFrame) -> DataFrame:
    """(op, path, from_path): files that were changed (path) and are clean again must be read anew."""
    paths = before.select("path").distinct().join(now.select("path"), "path", "left_anti")
    return paths.select(F.lit("modified").alias("op"), "path", F.lit(None).cast("string").alias("from_path"))


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window_start, event_type, events, value) of a stream or table of events, by event time with a
    bound on lateness."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", F.round("value", 6).alias("value"))
