"""Files of fixed-width records without a header."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The data files at ``path`` (a file, a folder or a pattern) in order of
    their names, with their sizes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for top in store.globStatus(where) or ():
        for f in store.listStatus(top.getPath()) if top.isDirectory() else (top,):
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen()))
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def read_records(spark: SparkSession, path: str, key_size: int, value_size: int, on_partial: str = "error", block_bytes: int = 32 << 20) -> DataFrame:
    """``rid, key, payload``; ``rid`` is the record's place in the files, taken in
    order of their names. A partial last record of a file is an error, or dropped
    with ``on_partial="drop"``. Tasks read ranges of about ``block_bytes`` themselves,
    as Arrow batches, so no file is held whole; the path needs a scheme that pyarrow's
    file systems know."""
    width, per = key_size + value_size, max(1, block_bytes // (key_size + value_size))
    files, first_block, first_rid = [], [0], [0]
    for name, size in _files(spark, path):
        if size % width and on_partial != "drop":
            raise ValueError(f"{name} has {size} bytes, no multiple of {width}")
        files.append((name, size // width))
        first_block.append(first_block[-1] - (-(size // width) // per))
        first_rid.append(first_rid[-1] + size // width)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for block in b.column(0).to_pylist():
                k = bisect_right(first_block, block) - 1
                name, n = files[k]
                first = (block - first_block[k]) * per
                count = min(per, n - first)
                store, where = fs.FileSystem.from_uri(name if "://" in name else name.replace(":/", ":///", 1))
                with store.open_input_file(where) as f:
                    data = f.read_at(count * width, first * width)
                rec = pa.Array.from_buffers(pa.binary(width), count, [None, pa.py_buffer(data)]).cast(pa.binary())
                rid = pa.array(np.arange(first_rid[k] + first, first_rid[k] + first + count))
                for lo in range(0, count, 50_000):
                    yield pa.RecordBatch.from_arrays([rid.slice(lo, 50_000), rec.slice(lo, 50_000)], names=["rid", "rec"])

    n = first_block[-1]
    df = spark.range(0, n, 1, max(1, min(n, 100_000))).mapInArrow(read, "rid long, rec binary")
    return df.select("rid", F.substring("rec", 1, key_size).alias("key"), F.substring("rec", key_size + 1, value_size).alias("payload"))


def write_records(df: DataFrame, uri: str, key: str = "key", payload: str = "payload") -> None:
    """One headerless file a partition (``part-00000`` on, in the frame's order)
    at a URI that all executors reach. A task writes under a name of its own
    attempt and renames it when whole, so a repeated task leaves one file."""
    body = df.select(F.coalesce(F.col(key), F.lit(b"")).alias("k"), F.coalesce(F.col(payload), F.lit(b"")).alias("v"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path)
        final, own, n = f"{path}/part-{ctx.partitionId():05d}", f"{path}/_attempt-{ctx.taskAttemptId()}", 0
        with store.open_output_stream(own) as out:
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out.write(k + v)
                    n += 1
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    body.mapInArrow(write, "n long").agg(F.sum("n")).collect()
