"""Tables from files and from memory: several Parquet files as one, Arrow tables,
result rows in CSV, and fetches in chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the columns of a benchmark result row, and of a printed result line
RESULT = "gpu string, num_records long, distribution string, strategy string, total_ms double, run_gen_ms double, merge_ms double, throughput_gbs double, throughput_mrec_s double, merge_passes int, hbm_traffic_gb double, verify string"
LINE = ["gpu", "total_gb", "num_records", "num_runs", "merge_passes", "run_gen_ms", "merge_ms", "total_ms", "gb_s", "h2d_gb", "d2h_gb", "moved_gb", "amplification"]
LINE_FORMAT = "CSV,%s,%.2f,%d,%d,%d,%.2f,%.2f,%.2f,%.4f,%.2f,%.2f,%.2f,%.1f"


def read_parquet(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Several Parquet files or folders of one schema as one table."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def fetch(df: DataFrame, rows: int = 100_000) -> Iterator[list]:
    """The rows in chunks of ``rows``; the driver holds one partition at a time."""
    chunk: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        chunk.append(r)
        if len(chunk) == rows:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def write_results(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result rows with their twelve typed columns; a cell of another type is an
    error."""
    return spark.read.schema(RESULT).option("header", True).option("mode", "FAILFAST").csv(list(paths))


def result_line() -> Column:
    """The printed line of a row with the columns ``LINE``."""
    return F.format_string(LINE_FORMAT, *LINE)
