"""Streaming sinks: file logs, table results, pool refresh per micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dawnpress.operators.pools import bootstrap_pools, refresh_pools
from dawnpress.session import shared_folder
from dawnpress.sources.snapshots import latest_snapshot, write_snapshot


def log_sink(rows: DataFrame, path: str, checkpoint: str, ts: str | None = "ts", **trigger) -> StreamingQuery:
    """Append rows to a Parquet log, partitioned by UTC day when there is a time column; exactly once by checkpoint."""
    out = rows.withColumn("day", F.to_date(ts)) if ts else rows
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if ts:
        writer = writer.partitionBy("day")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drained(rows: DataFrame) -> DataFrame:
    """Run a stream over all data available now and read back what it wrote to the shared folder."""
    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log_sink(rows, f"{root}/out", f"{root}/checkpoint", ts=None).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


def refresh_pools_on_batch(path: str, day: str = "day_utc"):
    """``foreachBatch`` function that refreshes the pool snapshot from each batch of inventory rows.

    A batch carries the current inventory and its ``day_utc``; counters restart when the stored day differs. Rewriting a
    batch after a failure writes the same version again.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        today = batch.agg(F.max(day)).first()[0]
        old = latest_snapshot(batch.sparkSession, path, before=batch_id)
        if old is None:
            pools = bootstrap_pools(batch)
        else:
            changed = old.select(day).first()[0] != today
            pools = refresh_pools(old.drop(day), batch, day_changed=changed)
        write_snapshot(pools.withColumn(day, F.lit(today)), path, batch_id)

    return refresh
