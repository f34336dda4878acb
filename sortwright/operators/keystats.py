"""Statistics and codecs of binary keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_at(key: Column, p: int) -> Column:
    """The byte at position ``p`` as a number."""
    return F.conv(F.hex(F.substring(key, p + 1, 1)), 16, 10).cast("int")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The keys of each batch as bytes [rows, width]; nulls are left out and
    other lengths are an error."""
    for b in batches:
        keys = b.column(0).drop_null().cast(pa.binary())
        if not len(keys):
            continue
        ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
        if (np.diff(ends) != width).any():
            raise ValueError(f"a key isn't {width} bytes long")
        yield np.frombuffer(keys.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width)


def byte_ranges(df: DataFrame, key: str, width: int) -> DataFrame:
    """``byte_pos, lo, hi`` of every position, exactly. Keys pass in Arrow
    batches, and a task emits one row a position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(width, 255, np.uint8), np.zeros(width, np.uint8)
        for x in _matrices(batches, width):
            np.minimum(lo, x.min(axis=0), out=lo)
            np.maximum(hi, x.max(axis=0), out=hi)
        if (lo <= hi).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["byte_pos", "lo", "hi"])

    return df.select(key).mapInArrow(run, "byte_pos int, lo int, hi int").groupBy("byte_pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def varying(df: DataFrame, key: str, width: int) -> list[int]:
    """Positions whose byte isn't the same in all rows. Never sampled: a byte
    that varies in one row decides that row's place."""
    return [r["byte_pos"] for r in byte_ranges(df, key, width).filter("lo <> hi").orderBy("byte_pos").collect()]


def histogram(df: DataFrame, key: str, width: int) -> DataFrame:
    """``byte_pos, byte, n``. A task counts its keys by itself and emits 256 rows a
    position at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(width * 256, np.int64)
        first = np.arange(width, dtype=np.int32) * 256
        for x in _matrices(batches, width):
            for lo in range(0, len(x), 1 << 14):
                n += np.bincount((x[lo : lo + (1 << 14)] + first).ravel(), minlength=width * 256)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((at // 256).astype(np.int32)), pa.array((at % 256).astype(np.int32)), pa.array(n[at])], names=["byte_pos", "byte", "n"])

    return df.select(key).mapInArrow(run, "byte_pos int, byte int, n long").groupBy("byte_pos", "byte").agg(F.sum("n").alias("n"))


def entropy(df: DataFrame, key: str, width: int) -> DataFrame:
    """``byte_pos, n_distinct, entropy``: Shannon bits of each position."""
    h = histogram(df, key, width)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("byte_pos"))
    return h.withColumn("p", p).groupBy("byte_pos").agg(F.count("*").alias("n_distinct"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def bits_for(span: Column) -> Column:
    """Bits that hold 0..span."""
    return F.when(span > 0, F.ceil(F.log2(span + 1))).otherwise(0).cast("bigint")


def codec_sizes(df: DataFrame, cols: dict[str, Column], escape: int = 254) -> DataFrame:
    """``col, codec, bytes_per_value, bits_per_value, n_distinct, coverage,
    n_escape`` for frame of reference, the same bit packed, a dictionary (both in
    whole bytes), and a one-byte dictionary of the ``escape`` most frequent values with
    nine bytes for each of the others (ties by value). ``coverage`` is the share of
    rows with a dictionary's code."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("col"), c.cast("bigint").alias("v")) for k, c in cols.items()))).alias("x")).select("x.*")
    counts = long.groupBy("col", "v").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "v"))
    # only the first ranks of a column are needed: the window keeps no more of them
    hits = counts.withColumn("r", rank).filter(F.col("r") <= escape).groupBy("col").agg(F.sum("n").alias("hit"))
    stats = counts.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("ndv"), F.sum("n").alias("n")).join(F.broadcast(hits), "col")
    bits, dbits = bits_for(F.col("hi") - F.col("lo")), bits_for(F.col("ndv") - 1)
    coverage = F.col("hit") / F.col("n")
    whole = lambda b: F.greatest(F.lit(1), F.ceil(b / 8)).cast("double")
    mostly = coverage + (1 - coverage) * 9
    one, none = F.lit(1.0), F.lit(0).cast("bigint")
    sizes = {"for": (whole(bits), bits.cast("double"), one, none), "for_bitpack": (bits / 8.0, bits.cast("double"), one, none), "dictionary": (whole(dbits), dbits.cast("double"), one, none), "mostly_dict": (mostly, F.round(mostly * 8, 1), coverage, F.col("n") - F.col("hit"))}
    rows = [F.struct(F.lit(k).alias("codec"), F.round(v, 6).alias("bytes_per_value"), b.alias("bits_per_value"), F.round(c, 6).alias("coverage"), e.alias("n_escape")) for k, (v, b, c, e) in sizes.items()]
    return stats.select("col", F.col("ndv").alias("n_distinct"), F.explode(F.array(*rows)).alias("x")).select("col", "x.*", "n_distinct")


def pack_words(df: DataFrame, value: str, pos: str, bits: int) -> DataFrame:
    """``word, packed``: the values, in the order of ``pos`` (0, 1, ..), ``bits`` each,
    LSB first in 32-bit words. A value gives its part to one word or two; parts of a
    word don't overlap, so their sum is the word."""
    if not 1 <= bits <= 32:
        raise ValueError("a value has 1 to 32 bits")
    v = F.col(value).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    first = F.col(pos).cast("bigint") * bits
    at = (first % 32).cast("int")
    low = F.call_function("shiftleft", v, at).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.call_function("shiftright", v, F.lit(32) - at)
    parts = F.array(F.struct(F.floor(first / 32).alias("word"), low.alias("x")), F.struct((F.floor(first / 32) + 1).alias("word"), F.when(at + bits > 32, high).alias("x")))
    return df.select(F.explode(parts).alias("p")).select("p.*").filter("x is not null").groupBy("word").agg(F.sum("x").alias("packed"))


def unpack_words(words: DataFrame, n: int, bits: int) -> DataFrame:
    """``pos, value`` of the first ``n`` values that ``pack_words`` packed: each
    word meets the values that begin or end in it."""
    per = 32 // bits + 2
    first = F.ceil((F.col("word") * 32 - bits + 1) / bits)
    spots = words.select("word", "packed", F.explode(F.sequence(F.greatest(F.lit(0), first), first + per)).alias("pos"))
    start = F.col("pos") * bits - F.col("word") * 32  # of the value, from the word's first bit
    here = spots.filter((start < 32) & (start + bits > 0) & (F.col("pos") < n))
    down = F.call_function("shiftright", F.col("packed"), F.greatest(start, F.lit(0)).cast("int"))
    up = F.call_function("shiftleft", down, F.greatest(-start, F.lit(0)).cast("int"))
    part = up.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return here.groupBy("pos").agg(F.sum(part).alias("value"))


def bitpack_config(ranges: DataFrame) -> DataFrame:
    """``byte_pos, lo, bits, bit_offset`` in MSB-first order (one row a byte
    position, so the window is as wide as the key)."""
    with_bits = ranges.withColumn("bits", bits_for(F.col("hi") - F.col("lo")))
    before = Window.partitionBy(F.lit(0)).orderBy("byte_pos").rowsBetween(Window.unboundedPreceding, -1)
    return with_bits.select("byte_pos", "lo", "bits", F.coalesce(F.sum("bits").over(before), F.lit(0)).cast("bigint").alias("bit_offset"))


def packed_bits(key: Column, config: list[tuple[int, int, int]]) -> Column:
    """The bit string of a key: each position less its minimum, in its bits."""
    return F.concat(F.lit(""), *(F.lpad(F.bin(byte_at(key, p) - lo), bits, "0") for p, lo, bits in config if bits))


def unpacked(bits: Column, config: list[tuple[int, int, int]]) -> Column:
    """The key (hex) that ``packed_bits`` was made of."""
    out, at = [], 1
    for _, lo, n in config:
        v = F.conv(F.substring(bits, at, n), 2, 10).cast("int") + lo if n else F.lit(lo)
        out.append(F.lpad(F.hex(v.cast("bigint")), 2, "0"))
        at += n
    return F.concat(*out)

