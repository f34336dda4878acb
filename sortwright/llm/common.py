"""Helpers shared by the training-data operators: shared storage, slices of
Arrow batches, grouped processing of sorted partitions, and connected
components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwright.operators import storage

#: Text bytes that one slice of an Arrow batch holds at most (one row at least).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so a lost executor costs the reread of its split only. The table is deleted by
    ``discard`` or when the session ends."""
    spark = df.sparkSession
    path = storage.new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sortwright_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it later."""
    path = getattr(df, "_sortwright_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as ``words_of`` gives them, one after another, and
    how many each text has (null: none)."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), None, bare))  # an empty text would give an empty word
    return found.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(found), 0).to_numpy().astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ODD = np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=1)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (int(ODD), pow(int(ODD), -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return tuple(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    size = 1 << max(12, (n - 1).bit_length())
    power, inverse = _power_table(size)
    return power[:n], inverse[:n]


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column ``text`` of each slice has about ``limit``
    bytes at most; a longer single row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: From HUB_ROWS rows on, keys with more than one row in HUB_SHARE are joined by broadcast: there are fewer than 200 of them.
HUB_ROWS, HUB_SHARE = 500_000, 200


def hub_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has each ``key`` once with the number
    ``c`` of the ``total`` rows that hold it. Keys of more than a 200th of the rows
    meet by broadcast (fewer than 200 of them), the others by shuffle, so no
    task gets more than that of one key. Up to ``HUB_ROWS`` narrow rows one shuffle
    does, even if all have one key."""
    if total <= HUB_ROWS:
        return rows.join(table.drop("c"), key)
    heavy, light = (table.filter(cond).drop("c") for cond in (F.col("c") > total / HUB_SHARE, F.col("c") <= total / HUB_SHARE))
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(rest)


def head_cut(counts: DataFrame, room: int) -> int:
    """The least ``n`` of the most frequent words: as many as fit into ``room`` in
    steps of 2^(1/8), so that words of one count stay together. 2^62: none fit."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least = 1 << 62
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("s")).collect():
        if r["k"] > room:
            break
        room, least = room - r["k"], r["n"]
    return least


def map_sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """Bring rows of equal ``keys`` together and call ``fn`` with each group as
    an Arrow table. Only one group is held at a time; callers bound its size.
    Far cheaper than one Python call through Spark for each small group."""
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i) for i in at]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                a = c.to_numpy(zero_copy_only=False)
                change[1:] |= a[1:] != a[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                key = tuple(c[lo].as_py() for c in cols) if lo == 0 else None
                if lo or key != last:
                    if held:
                        yield from fn(pa.Table.from_batches(held)) or ()
                    held = []
                held.append(batch.slice(lo, hi - lo))
            last = tuple(c[batch.num_rows - 1].as_py() for c in cols)
        if held:
            yield from fn(pa.Table.from_batches(held)) or ()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def whole_groups(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the long column ``at``: a
    batch's last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(at).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left")) if (key[1:] >= key[:-1]).all() else int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1
        if held and (cut or held[-1].column(at)[0].as_py() != key[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class UnionFind:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph ``edges(a, b)`` of longs, as rows ``(id,
    component)`` where ``component`` is the smallest id reachable; ids without
    an edge don't appear.

    Alternating large-star and small-star steps (each a partial ``min`` per
    node and an equi-join that sets nodes of many edges apart), so neither a
    component nor the edges of its hub are ever gathered in one task, and
    none reaches the driver. Every round is written to the shared folder, and
    the last two are compared by a count and a checksum."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def with_least(e: DataFrame, total: int) -> DataFrame:
        """The smallest neighbour ``m``, or the node itself, beside each edge."""
        small = e.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"), F.count("*").alias("c"))
        return hub_join(e, small, "a", total)

    e = materialize(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = state(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * was[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        joined = with_least(large, large.count())
        small = joined.select("a", F.col("m").alias("b")).union(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = materialize(small, "small")
        now = state(new)
        discard(e)
        discard(large)
        e = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def spare(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column of ``taken`` has it
    (case-insensitively, as Spark resolves names)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def utf8(c: str | Column) -> Column:
    return F.encode(c, "UTF-8")
