"""Patterns over streams: a member whose rows arrive.

Views are DataFrame transformations, so a pattern that is one scan (a star over a stream's rows), joined with
members of tables and filtered, also runs on a streaming DataFrame. What needs all rows (ORDER BY, DISTINCT
without a watermark, path closures) is refused by Structured Streaming itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from graphloom.sources.views import Member, TableSpec, table_member


def stream_member(spark: SparkSession, path: str, schema: StructType, spec: TableSpec, base: str, late: tuple[str, str] | None = None, per_trigger: int = 1000) -> Member:
    """A folder of Parquet files as a stream. late: (time column, how late rows may come) sets a watermark."""
    df: DataFrame = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    if late:
        df = df.withWatermark(*late)
    return table_member(spark, {spec.name: df}, [spec], base)


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that has arrived, appended to a table once; a rerun goes on where the last one ended."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
