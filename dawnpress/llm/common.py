"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnpress.session import shared_folder

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder of this application and read it back.

    This ends the lineage as ``checkpoint()`` does, keeps column pruning for later reads, and survives the loss of any
    executor. The folder belongs to the application; the cluster clears it with its checkpoints.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    path = f"{context.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, rows: int | None = 512) -> DataFrame:
    """Run ``function`` on slices of at most ``rows`` rows of each Arrow batch, or on whole batches if that is None.

    It returns the columns of ``schema`` by name: Python lists, NumPy arrays or Arrow arrays of any common length. Slices keep the
    Python objects made of a batch few.
    """
    kinds = to_arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows):
                yield as_batch(function(batch.slice(at, rows)), kinds)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with a dotted name a field of a struct column."""
    first, *fields = name.split(".")
    values = batch.column(first)
    return pc.struct_field(values, fields) if fields else values


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def as_batch(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in kinds:
        values = columns[field.name]
        arrays.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=kinds)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def partitions_for(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Shuffle partitions so that a task gets about ``rows_per_task`` of ``rows``, at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
