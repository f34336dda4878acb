"""Sharding by a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into shards whose sizes differ by
one at most:

1. The narrow rows (id, size, checksum; no texts) are checkpointed to the
   shared folder, which fixes the source partitions for good.
2. From the partition sizes and the exact shard sizes, the matrix "rows from
   partition p to shard s" is drawn from its exact law (one multivariate
   hypergeometric draw a partition). It has partitions x shards entries, is the
   only thing that reaches the driver, and is broadcast once.
3. Each partition permutes its rows locally and deals them out by its line of
   the matrix.
4. After the exchange every shard is permuted again: each row has a random
   64-bit place, the places are cut into blocks of bounded size, and a row's
   slot is its block's offset plus its rank in the block. No shard is gathered
   in one task.

Law ``rows``: counts at most one apart. Defined cases: null text has size 1 and
the checksum of empty text; null or repeated ids and repeated rows are rows like
any others; an empty table gives an empty result. For the same seed and the
same source partitions the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortwright.llm.common import utf8
from sortwright.operators.storage import shared_dir


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact draws: row p is multivariate hypergeometric from what the shards
    still lack; row sums are ``counts``, column sums differ by one at most."""
    rng = np.random.Generator(np.random.PCG64([seed, 1]))
    total = sum(counts)
    free = np.full(shards, total // shards, np.int64)
    free[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        left, rest = n, int(free.sum())
        for s in range(shards):
            if not left:
                break
            rest -= int(free[s])
            k = hypergeometric(rng, int(free[s]), rest, left)
            out[p, s] = k
            left -= k
        free -= out[p]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good + bad`` are good. numpy's sampler takes
    populations below 1e9; larger ones go by inversion."""
    if not good or not n:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    return _by_inversion(rng.random(), good, bad, n)


def _by_inversion(u: float, good: int, bad: int, n: int) -> int:
    """The value whose cumulated chance first passes ``u``. Chances come from the
    ratios of neighbours, outwards from the mode to 14 standard deviations and 64
    (what is beyond has a chance below 1e-30), so the work grows with the deviation
    and not with the population or the draws."""
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    wide = int(14 * math.sqrt(n * share * (1 - share) * (1 - n / (good + bad)))) + 64
    a, b = max(lo, mode - wide), min(hi, mode + wide)
    k = np.arange(a, b, dtype=np.float64)  # the step from k to k + 1
    step = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(step)))
    chance = np.cumsum(np.exp(logs - logs[mode - a]))
    return a + min(int(np.searchsorted(chance, u * chance[-1], "right")), b - a)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20_240_601, block_rows: int = 4096) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    spark = docs.sparkSession
    shared_dir(spark)
    text = F.coalesce(utf8(F.col("text").cast("string")), F.lit(b""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")).checkpoint()
    sizes = {r["p"]: r["n"] for r in narrow.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    matrix = spark.sparkContext.broadcast(dict(zip(order, communication_matrix([sizes[p] for p in order], shards, seed))))
    blocks = max(1, -(-sum(sizes.values()) // (shards * block_rows)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        mine = matrix.value[p]
        if t.num_rows != int(mine.sum()):
            raise RuntimeError(f"partition {p} has {t.num_rows} rows, counted {mine.sum()}")
        rng = np.random.Generator(np.random.PCG64([seed, 2, p]))
        shard = np.empty(t.num_rows, np.int32)
        shard[rng.permutation(t.num_rows)] = np.repeat(np.arange(shards, dtype=np.int32), mine)
        place = rng.integers(0, 1 << 63, t.num_rows, dtype=np.int64)
        block = (place >> 32) * blocks >> 31
        t = t.append_column("shard", pa.array(shard)).append_column("block", pa.array(block)).append_column("place", pa.array(place))
        yield from t.to_batches()

    dealt = narrow.mapInArrow(deal, "doc_id long, size long, text_crc32 long, shard int, block long, place long")
    rank = Window.partitionBy("shard", "block").orderBy("place", "doc_id", "text_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(rank))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return ranked.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
