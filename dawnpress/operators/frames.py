"""Window frames that stay balanced when one key holds a large share of the rows.

``Window.partitionBy(session)`` puts a whole session into one task. The three helpers below give the same
answers from partitions of bounded size:

* ``sequence_number`` ranks inside (key, chunk) and adds the row count of the earlier chunks,
* ``rolling`` evaluates a frame of at most ``back`` earlier rows inside (key, bucket of ``bucket`` rows); the last
  ``back`` rows of a bucket are also sent to the next one, so every frame is complete,
* ``running`` adds the totals of the earlier buckets to a cumulative sum inside the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096


def sequence_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk: Column, name: str = "seq"
) -> DataFrame:
    """1-based position of each row inside its key. ``chunk`` must not decrease along ``order``."""
    tagged = df.withColumn("_chunk", chunk)
    groups = [*keys, "_chunk"]
    local = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*groups, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        tagged.withColumn("_local", local)
        .join(offsets, groups)
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_local", "_before")
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    back: int,
    columns: Mapping[str, Callable[[Window], Column]],
    bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``columns`` (each given the ordered window) whose frames reach at most ``back`` rows back."""
    size = max(bucket, back + 1)
    home = F.floor(F.col(seq) / size)
    spill = F.col(seq) % size >= size - back
    spread = df.withColumn(
        "_bucket", F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    ordered = Window.partitionBy(*keys, "_bucket").orderBy(seq)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(ordered))
    return spread.where(F.col("_bucket") == home).drop("_bucket")


def running(
    df: DataFrame, keys: Sequence[str], seq: str, sums: Mapping[str, Column], bucket: int = BUCKET_ROWS
) -> DataFrame:
    """Add inclusive cumulative sums along ``seq``."""
    tagged = df.withColumn("_bucket", F.floor(F.col(seq) / bucket))
    for name, value in sums.items():
        tagged = tagged.withColumn(f"_in_{name}", value)
    groups = [*keys, "_bucket"]
    inside = Window.partitionBy(*groups).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*groups).agg(*[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums])
    offsets = totals.select(
        *groups, *[F.coalesce(F.sum(f"_tot_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums]
    )
    for name in sums:
        tagged = tagged.withColumn(f"_cum_{name}", F.coalesce(F.sum(f"_in_{name}").over(inside), F.lit(0)))
    joined = tagged.join(offsets, groups)
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_cum_{name}") + F.col(f"_off_{name}"))
    extra = [f"_{kind}_{n}" for kind in ("in", "cum", "off") for n in sums]
    return joined.drop("_bucket", *extra)


def running_max(
    df: DataFrame, keys: Sequence[str], seq: str, name: str, value: Column, bucket: int = BUCKET_ROWS
) -> DataFrame:
    """Add the inclusive running maximum of ``value`` along ``seq``; null until a value occurs."""
    tagged = df.withColumn("_bucket", F.floor(F.col(seq) / bucket)).withColumn("_value", value)
    groups = [*keys, "_bucket"]
    inside = Window.partitionBy(*groups).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tagged.groupBy(*groups).agg(F.max("_value").alias("_top"))
    offsets = tops.select(*groups, F.max("_top").over(earlier).alias("_before"))
    joined = tagged.withColumn("_inside", F.max("_value").over(inside)).join(offsets, groups)
    return joined.withColumn(name, F.greatest("_inside", "_before")).drop("_bucket", "_value", "_inside", "_before")


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key in ``order``.

    The ``rank <= 1`` filter lets Spark prune to one row per key and task before the shuffle, so a hot key costs no
    more than a cold one.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def top_per_key(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], n: int | Column, name: str = "rank"
) -> DataFrame:
    """Keep the first ``n`` rows of each key, numbered from 1 in ``name``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def global_position(df: DataFrame, order: Sequence[str], chunk: Column, name: str = "position") -> DataFrame:
    """0-based position in a total order without a single-partition window over the rows.

    ``chunk`` must not decrease along ``order`` and should have thousands of values at most: only the chunk counts
    pass through one task.
    """
    tagged = df.withColumn("_chunk", chunk)
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return (
        tagged.withColumn("_local", local)
        .join(offsets, "_chunk")
        .withColumn(name, (F.col("_local") - 1 + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_local", "_before")
    )
