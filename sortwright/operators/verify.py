"""Checks of a sort: order and multiset, both needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortwright.operators.adjacent import with_previous


def violations(df: DataFrame, key: str, pos: str, width: int = 1 << 16, descending: bool = False) -> DataFrame:
    """``n_violations, first_pos``: rows that are below (above, if descending)
    their predecessor by ``pos`` (1..n)."""
    bad = F.col("prev") < F.col(key) if descending else F.col("prev") > F.col(key)
    return with_previous(df.select(key, pos), key, pos, width).filter(bad).agg(F.count("*").alias("n_violations"), F.min(pos).alias("first_pos"))


def checksum(c: Column) -> Column:
    """An order-free sum over rows: the first 60 bits of the row's MD5."""
    return F.sum(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("decimal(38,0)"))


def fnv1a64_sum(df: DataFrame, record: str) -> DataFrame:
    """``n, fnv_sum`` (decimal, modulo 2^64): the sum of the records' FNV-1a
    hashes. Multiplication modulo 2^64 has no built-in, so records pass in Arrow
    batches; bytes of one position are hashed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x or b"" for x in b.column(0).to_pylist()]
            h = np.full(len(rows), 0xCBF29CE484222325, np.uint64)
            n = np.array([len(x) for x in rows])
            order = np.argsort(-n, kind="stable")
            for i in range(int(n.max(initial=0))):
                live = order[: int(np.searchsorted(-n[order], -i, "left"))]
                byte = np.frombuffer(bytes(rows[k][i] for k in live), np.uint8).astype(np.uint64)
                h[live] = (h[live] ^ byte) * np.uint64(0x100000001B3)
            yield pa.RecordBatch.from_arrays([pa.array([str(int(h.astype(object).sum()) % 2**64)]), pa.array([len(rows)], pa.int64())], names=["h", "n"])

    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    return df.select(record).mapInArrow(run, "h string, n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")) % two64, F.lit(0).cast("decimal(38,0)")).alias("fnv_sum"))


def multiset_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, diff`` for keys that the two sides don't have equally often."""
    both = a.select(key, F.lit(1).alias("d")).union(b.select(key, F.lit(-1).alias("d")))
    return both.groupBy(key).agg(F.sum("d").alias("diff")).filter("diff <> 0")
