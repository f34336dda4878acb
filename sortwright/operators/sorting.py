"""Global order without a single-task window and without splitters in the plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortwright.functions import keycodec as kc
from sortwright.operators import verify
from sortwright.operators.storage import written

ROW_BITS = 33  # of monotonically_increasing_id: the row's number in its partition


@dataclass(frozen=True)
class SortConfig:
    """Options of ``sort``. ``keys`` are columns, or none with a ``preset`` that
    takes the key from the first bytes of the binary column ``record``.
    ``partitions`` 0 leaves their number to the session. ``stable`` keeps the
    input's order among equal keys."""

    keys: tuple[str, ...] = ()
    descending: bool = False
    preset: str | None = None
    record: str = "rec"
    partitions: int = 0
    stable: bool = True
    verify: bool = False


def part_of(keys: list[str], cuts: list[tuple]) -> Column:
    """The range a key falls in (equal to a splitter goes right), by a binary
    search written as nested conditions; for a fixed, small number of cuts."""
    value = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])

    def literal(t: tuple) -> Column:
        return F.struct(*(F.lit(x).alias(k) for x, k in zip(t, keys))) if len(keys) > 1 else F.lit(t[0])

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < literal(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def _in_ranges(df: DataFrame, order: list[Column], partitions: int = 0) -> DataFrame:
    placed = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return placed.sortWithinPartitions(*order)


def numbered(df: DataFrame, keys: Sequence[str], descending: bool = False, partitions: int = 0) -> DataFrame:
    """``df`` as a written table in order of ``keys`` with ``__at``: the range
    partition (upper bits) and the row's number in it. One range exchange and a
    spilling sort. The row's place in the input is the last key, so rows of one key
    keep their order and a key with many rows is cut into several ranges. Nulls
    come first (last, if descending)."""
    own = "__own"
    order = [*(F.col(k).desc() if descending else F.col(k).asc() for k in keys), F.col(own).asc()]
    rows = _in_ranges(df.withColumn(own, F.monotonically_increasing_id()), order, partitions).drop(own)
    return written(rows.withColumn("__at", F.monotonically_increasing_id()), "sorted")


def offsets(table: DataFrame, at: str = "__at") -> DataFrame:
    """``__part, __before``: the rows in front of each range, one row a range.
    Reads the numbers only; the window is as long as there are ranges."""
    sizes = table.groupBy(F.shiftright(at, ROW_BITS).alias("__part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))


def ranked(df: DataFrame, keys: Sequence[str], pos: str = "pos", descending: bool = False, partitions: int = 0) -> DataFrame:
    """``df`` with ``pos`` = 1..n in order of ``keys``; equal keys in the order of
    the input. The ranges' offsets are broadcast: 16 bytes a partition, whatever
    the rows."""
    table = numbered(df, keys, descending, partitions)
    row = F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    joined = table.withColumn("__part", F.shiftright("__at", ROW_BITS)).join(F.broadcast(offsets(table)), "__part")
    return joined.withColumn(pos, F.col("__before") + row + 1).drop("__at", "__part", "__before")


def running_sum(df: DataFrame, keys: Sequence[str], group: Column, weight: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` up to the row, in order of ``keys`` inside
    each ``group``, whose rows lie together in that order: summed inside pieces of a
    range, plus what the group has in earlier ranges. A group of any size is never in
    one task."""
    table = numbered(df, keys).withColumn("__part", F.shiftright("__at", ROW_BITS)).withColumn("__group", group)
    upto = F.sum(weight).over(Window.partitionBy("__part", "__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("__part", "__group").agg(F.sum(weight).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return table.withColumn("__upto", upto).join(sizes, ["__part", "__group"]).withColumn(name, (F.col("__upto") + F.col("__before")).cast("bigint")).drop("__part", "__group", "__upto", "__before", "__at")


def in_group_rank(df: DataFrame, key: str, group: Column, pos: str = "in_group") -> DataFrame:
    """``df`` with the rank by ``key`` inside each ``group``, a prefix of ``key``."""
    return running_sum(df, [key], group, F.lit(1), pos)


def ordered(df: DataFrame, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """One range exchange and a spilling sort; equal keys in any order."""
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def sort(df: DataFrame, cfg: SortConfig) -> DataFrame:
    """The public sort: ``df`` in order by ``cfg``. With ``verify`` the order and
    the multiset of keys are checked, and a breach raises."""
    keys = list(cfg.keys)
    if cfg.preset:
        size, _ = kc.PRESETS[cfg.preset]
        df, keys = df.withColumn("__key", kc.chunk(F.col(cfg.record), 0, size)), ["__key"]
    if not keys:
        raise ValueError("a sort needs keys or a preset")
    if cfg.verify:
        out = ranked(df, keys, "__pos", cfg.descending, cfg.partitions)
        key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
        found = verify.violations(out.select("__pos", key.alias("k")), "k", "__pos", descending=cfg.descending).first()
        if found["n_violations"] or verify.multiset_diff(df.select(key.alias("k")), out.select(key.alias("k")), "k").head(1):
            raise RuntimeError(f"the result is no sorted permutation of the input: {found}")
        return ordered(out, ["__pos"]).drop("__pos", "__key")
    own = ["__own"] if cfg.stable else []
    order = [*(F.col(k).desc() if cfg.descending else F.col(k).asc() for k in keys), *map(F.col, own)]
    return _in_ranges(df.withColumn("__own", F.monotonically_increasing_id()) if own else df, order, cfg.partitions).drop("__own", "__key")


def top(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def gather(df: DataFrame, perm: DataFrame, rid: str) -> DataFrame:
    """Rows in the order of a permutation ``(pos, rid)``: an equi-join."""
    return perm.join(df, rid)


def gather_from(sources: Sequence[DataFrame], perm: DataFrame, rid: str) -> DataFrame:
    """The same from several sources: ``perm`` holds ``pos, source, rid``, and a
    row comes from the source of that number."""
    rows = None
    for k, s in enumerate(sources):
        part = s.withColumn("source", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return perm.join(rows, ["source", rid])


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows chosen by a hash of ``key``: the same ones on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
