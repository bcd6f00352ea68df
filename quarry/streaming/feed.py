"""The change feed: classification, debounce, and application to the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classified(events: DataFrame, op: str = "op", is_dir: Column | None = None) -> DataFrame:
    """events with action: sync, remove, watch (a new directory) or reconcile (a watcher error); others go."""
    directory = F.lit(False) if is_dir is None else is_dir
    o = F.col(op)
    action = F.when(o.isin("remove", "rename"), "remove").when(o.isin("write", "create") & ~directory, "sync").when((o == "create") & directory, "watch").when(o == "error", "reconcile")
    return events.withColumn("action", action).where("action is not null")


def debounced(events: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """(path, first_ts, last_ts, n_events, action): quiet periods end a burst; its last event decides.

    Works on a batch and, after withWatermark("ts", ...), on a stream.
    """
    burst = events.groupBy("path", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"), F.max_by("action", F.struct("ts", "action")).alias("action")).drop("w")


def final_state(events: DataFrame) -> DataFrame:
    """(path, action): what the last event of each path asks for."""
    return events.groupBy("path").agg(F.max_by("action", F.struct("ts", "action")).alias("action"))


def stream(events: DataFrame, apply, checkpoint: str, gap: str = "300 milliseconds", late: str = "1 second"):
    """Starts a query that hands each micro-batch of debounced changes to apply(batch, id).

    events: a streaming frame (path, op, ts timestamp). Errors of the watcher come through as
    action reconcile, for which apply should compare the whole tree with the index.
    """
    bursts = debounced(classified(events).withWatermark("ts", late), gap)
    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def applied(index, batch: DataFrame) -> dict[str, int]:
    """Apply a micro-batch (path, action) to a CodeIndex as one version; the last action of a path counts.

    Paths to sync are compared with the tree and extracted, or removed if they have gone; a
    reconcile makes the index compare the whole tree.
    """
    last = batch
    if "last_ts" in batch.columns:  # several bursts of a path may come in one batch
        last = batch.groupBy("path").agg(F.max_by("action", F.struct("last_ts", "action")).alias("action"))
    actions = {r.path: r.action for r in last.collect()}  # changes of one trigger
    if "reconcile" in actions.values():
        index.reconcile_needed = True
    sync = sorted(p for p, a in actions.items() if a == "sync")
    gone = sorted(p for p, a in actions.items() if a == "remove")
    done = index.sync_paths(sync, gone) if sync or gone else {"synced": 0, "removed": 0}
    if index.reconcile_needed:
        index.reconcile()
    return done


def follow(index, events: DataFrame, checkpoint: str, gap: str = "300 milliseconds", late: str = "1 second"):
    """A running query that keeps a CodeIndex in step with a stream (path, op, ts); stop() drops pending bursts."""
    return stream(events, lambda batch, _: applied(index, batch), checkpoint, gap, late)
