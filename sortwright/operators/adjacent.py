"""Operators on neighbouring rows of an order: offset-value codes, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: 3 bits of flag, 13 bits of 8191 - offset, 16 bits of value
EARLY, DUPLICATE, NORMAL, INITIAL, LATE = 0, 1 << 29, 2 << 29, (3 << 29) | (8191 << 16) | 65535, (4 << 29) | (8191 << 16) | 65535


def with_previous(df: DataFrame, key: str, pos: str, width: int = 1 << 16, prev: str = "prev") -> DataFrame:
    """``df`` with the key of the row before, by ``pos`` (1..n; null for the
    first). Blocks of ``width`` positions are windows of their own, and the first row
    of each meets the last one before it by an equi-join of one row a block."""
    block, p = F.floor((F.col(pos) - 1) / width), F.col(pos)
    last = df.filter(p % width == 0).select((F.floor(p / width)).alias("__block"), F.col(key).alias("__last"))
    inner = df.withColumn("__block", block).withColumn(prev, F.lag(key).over(Window.partitionBy("__block").orderBy(pos)))
    joined = inner.join(last, "__block", "left")
    return joined.withColumn(prev, F.when(p % width == 1, F.col("__last")).otherwise(F.col(prev))).drop("__block", "__last")


def ovc(prev: Column, key: Column, width: int) -> Column:
    """The code of ``key`` against its predecessor (null: the first of a run):
    the two bytes at the first differing even offset."""
    out = F.lit(DUPLICATE).cast("bigint")
    for off in reversed(range(0, width, 2)):
        n = min(2, width - off)
        value = F.conv(F.rpad(F.hex(F.substring(key, off + 1, n)), 4, "0"), 16, 10).cast("bigint")
        out = F.when(F.substring(prev, off + 1, n) != F.substring(key, off + 1, n), value + (NORMAL | (8191 - off) << 16)).otherwise(out)
    return F.when(prev.isNull(), F.lit(INITIAL).cast("bigint")).otherwise(out)


# predicates of a code
def is_initial(code: Column) -> Column:
    return ovc_flag(code) == 3


def is_normal(code: Column) -> Column:
    return ovc_flag(code) == 2


def is_duplicate(code: Column) -> Column:
    return ovc_flag(code) == 1


def is_early(code: Column) -> Column:
    return ovc_flag(code) == 0


def is_late(code: Column) -> Column:
    return ovc_flag(code) == 4


def is_fence(code: Column) -> Column:
    return is_early(code) | is_late(code)


def ovc_flag(code: Column) -> Column:
    return F.shiftright(code, 29).bitwiseAND(F.lit(7).cast("bigint"))


def ovc_offset(code: Column) -> Column:
    return F.lit(8191) - F.shiftright(code, 16).bitwiseAND(F.lit(8191).cast("bigint"))


def ovc_value(code: Column) -> Column:
    return code.bitwiseAND(F.lit(65535).cast("bigint"))
