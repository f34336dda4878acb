"""Deterministic record generators over ``spark.range``. Values follow from the
row id by integer arithmetic, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: a multiplicative hash on 32 bits
MULTIPLIER, MODULUS = 2654435761, 4294967296


def scramble(x: Column, seed: int = 42) -> Column:
    return ((x + seed) * F.lit(MULTIPLIER)) % F.lit(MODULUS)


def distribution(name: str, n: int, seed: int = 42) -> Column:
    """The 32-bit key of row ``id`` among ``n``."""
    i = F.col("id")
    h = scramble(i, seed)
    swap = (i % 40 < 2) & (F.when(i % 2 == 0, i + 1).otherwise(i - 1) < n)
    return {
        "random": h, "sorted": i, "reverse": n - 1 - i, "sequential": i + 1, "all_duplicates": F.lit(42).cast("bigint"),
        # 95 % in place: every 20th pair of neighbours changes places
        "nearly_sorted": F.when(swap, F.when(i % 2 == 0, i + 1).otherwise(i - 1)).otherwise(i),
        # of a pool of 10,000 the k-th with chance 1/(k (k + 1)): the tail of a Zipf law with exponent 2
        "zipf2": F.floor(F.lit(float(MODULUS)) / (h + 1)).cast("bigint") % 10_000,
        "few_unique": h % 1000, "pool10": h % 10, "zipf": F.floor(F.lit(float(n)) / (h % n + 1)).cast("bigint"),
        "two_distinct": F.when(h % 2 == 0, 1).otherwise(2).cast("bigint"), "alternating": F.when(i % 2 == 0, 0).otherwise(255).cast("bigint"),
        "zeros": F.lit(0).cast("bigint"), "ones": F.lit(MODULUS - 1), "skew": F.when(h % 10 < 9, 7).otherwise(h).cast("bigint"),
    }[name]


DISTRIBUTIONS = ["random", "sorted", "reverse", "sequential", "all_duplicates", "nearly_sorted", "few_unique", "pool10", "zipf", "zipf2", "two_distinct", "alternating", "zeros", "ones", "skew"]


def records(spark: SparkSession, n: int, name: str = "random", seed: int = 42) -> DataFrame:
    """``id, key`` (8 hexadecimal digits); the id doubles as payload, so tests
    see lost or repeated rows."""
    return spark.range(n).select("id", F.lpad(F.hex(distribution(name, n, seed)), 8, "0").alias("key"))


def of_cardinality(spark: SparkSession, n: int, distinct: int, seed: int = 42) -> DataFrame:
    """``id, key``: 32-bit keys of ``distinct`` values at most."""
    return spark.range(n).select("id", (scramble(F.col("id"), seed) % distinct).alias("key"))


def full_records(spark: SparkSession, n: int, record_size: int = 120, seed: int = 42) -> DataFrame:
    """``id, rec``: records all of whose bytes vary, as hexadecimal digits."""
    each = [F.lpad(F.hex(F.floor(scramble(F.col("id") * 1009 + p, seed) / 65536).cast("bigint") % 256), 2, "0") for p in range(record_size)]
    return spark.range(n).select("id", F.concat(*each).alias("rec"))


def varying_bytes(spark: SparkSession, n: int, width: int, varying: int, seed: int = 42) -> DataFrame:
    """Keys whose first ``varying`` bytes vary; the others are 0x42."""
    each = [F.lpad(F.hex(F.floor(scramble(F.col("id") * 131 + p, seed) / 65536).cast("bigint") % 256), 2, "0") for p in range(varying)]
    return spark.range(n).select("id", F.concat(*each, F.lit("42" * (width - varying))).alias("key"))


def displaced(df: DataFrame, pos: str, every: int, by: int, n: int) -> Column:
    """Positions of a sorted input in which each ``every``-th row has traded
    places with the row ``by`` after it."""
    p = F.col(pos)
    return F.when((p % every == 0) & (p + by < n), p + by).when((p % every == by % every) & (p >= by) & ((p - by) % every == 0), p - by).otherwise(p)
