"""Reading tables in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_table(spark: SparkSession, directory: str, name: str, view: str | None = None) -> DataFrame:
    """Read ``<directory>/<name>.parquet``, optionally naming it as a view."""
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    if view:
        df.createOrReplaceTempView(view)
    return df


def catalog_table(spark: SparkSession, name: str, schema: str | None = None,
                  catalog: str | None = None) -> DataFrame:
    """Read a table by its one-, two- or three-part catalog name."""
    parts = [p for p in (catalog, schema, name) if p]
    return spark.table(".".join(f"`{p}`" for p in parts))


def stream_table(spark: SparkSession, directory: str, schema: StructType,
                 file_glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Follow the parquet files that arrive in ``directory``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)
