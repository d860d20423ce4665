"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from clientlens.session import scratch_path

# White space that separates words, as a character class of the contract.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id's text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def release_memory() -> None:
    """Hand what a task has freed back to the system: workers live on, and the next task may need other sizes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


# Rows and bytes of a record batch: texts and token lists are long, and a batch is held by the JVM and by Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_BATCH_SETTING, _BYTES_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[Sequence[list]]],
                schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of columns.

    The function sees one iterator of record batches per task and yields, as
    often as it likes, a list with one sequence per output column. Batches have
    at most BATCH_ROWS rows and end with the row that brings them to BATCH_BYTES;
    for that the session's settings are lowered once.
    """
    target = arrow_schema(df.sparkSession, schema)
    df.sparkSession.conf.set(_BYTES_SETTING, str(BATCH_BYTES))
    if not 0 < int(df.sparkSession.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                     for c, f in zip(columns, target, strict=True)], schema=target)
        columns = None
        release_memory()

    return df.mapInArrow(run, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later steps start from files that survive a lost executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
