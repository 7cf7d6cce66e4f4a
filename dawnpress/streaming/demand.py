"""Domain demand over a moving week, for a batch or a stream of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_demand(
    log: DataFrame, days: int = 7, slide_days: int = 1, min_rows: int = 6, ts: str = "ts", late: str | None = None
) -> DataFrame:
    """Demand per (window, source). On a stream pass ``late``: the watermark closes windows and bounds the state."""
    rows = log.withWatermark(ts, late) if late else log
    return (
        rows.where(F.col("topic_name") != "")
        .groupBy(F.window(ts, f"{days} days", f"{slide_days} days").alias("w"), "topic_name")
        .agg(F.count(F.lit(1)).alias("interactions"), F.avg("reward").alias("avg_reward"))
        .where(F.col("interactions") >= min_rows)
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "topic_name",
            "interactions",
            "avg_reward",
            (F.col("avg_reward") * F.sqrt("interactions")).alias("score"),
        )
    )
