"""Versioned Parquet snapshots: a version is complete once its directory is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    done = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done)


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Write the next (or the given) version next to the earlier ones; readers never see a partial one."""
    if version is None:
        known = _versions(df.sparkSession, path)
        version = known[-1] + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def latest_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    versions = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


def known_links_only(pools: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pool rows whose link the inventory still has."""
    return pools.join(inventory.select("link"), "link", "left_semi")


def retain_recent(states: DataFrame, since: float | None = None, keep: int | None = None) -> DataFrame:
    """Sessions updated at ``since`` or later; ``keep`` further asks for no more than so many, the latest ones."""
    if since is not None:
        states = states.where(F.col("updated_at") >= since)
    return states if keep is None else states.orderBy(F.desc("updated_at"), "session_id").limit(keep)


