"""Embedding near-duplicates by iterative quantisation (ITQ).

1. Equal vectors become one class with a multiplicity.
2. On a bounded sample (``sample_rows``) a rotation is learned that makes the
   signs of the rotated, centred vectors good binary codes: alternate between
   the codes of the rotated sample and the rotation nearest to them (a Procrustes
   step). Several rotations from different starts give one long code.
3. The code is cut into substrings, each the key of one Hamming table. Their
   width follows log2 of the number of classes, and their number the chance that
   a pair just at the threshold shares none (``miss``), measured on pairs made of
   the sample. Centring is left out where that is cheaper.
4. Narrow rows (key, id, code) meet in the tables; entries that have a partner
   within ``radius`` of the code's first bits stay, and only for these the vectors
   follow. A table entry beyond ``chunk`` rows is cut into chunks and the chunks
   meet pairwise, so every pair of the entry is compared in a task of bounded size.
5. The original vectors rerank: cosine in double precision decides. A pair that
   shares several keys counts in the first only. A task emits per class the number
   of links and a spanning forest, never the pairs; connected components follow.

Vectors of one length are compared with each other, each length with a code of
its own; vectors of different lengths have no cosine.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; rows of one
``vec_id`` are one node and a null ``vec_id`` links with nothing and has null
``component_id`` and ``kept``; an empty table gives an empty result; columns other
than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwright.llm.common import UnionFind, connected_components, hub_join, map_sorted_groups, materialize, whole_groups


@dataclass(frozen=True)
class EmbedConfig:
    threshold: float = 0.95
    sample_rows: int = 4096
    rounds: int = 25
    miss: float = 1e-3
    seed: int = 5
    chunk: int = 2048
    slack: float = 6.0


CODE_BITS = 256  # narrow rows carry this much of the code, however many tables there are
MOST_TABLES = 1 << 14


@dataclass
class Codes:
    """``planes`` [dim, bits] after centring; ``tables`` substrings of ``width``."""

    mean: np.ndarray
    planes: np.ndarray
    width: int
    tables: int
    radius: int

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes [n, bytes] and table keys [n, tables]."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        bits = (unit - self.mean) @ self.planes > 0
        keys = bits.reshape(len(x), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))
        packed = np.packbits(bits[:, :CODE_BITS], axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))), keys


def learn_rotation(x: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """ITQ: the rotation that brings the rows of ``x`` nearest to +-1 codes."""
    r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        b = np.where(x @ r > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(x.T @ b)
        r = u @ v
    return r


def _at_threshold(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each row a unit vector whose cosine with it is the threshold."""
    side = rng.normal(size=sample.shape)
    side -= (side * sample).sum(axis=1, keepdims=True) * sample
    side /= np.maximum(1e-300, np.linalg.norm(side, axis=1, keepdims=True))
    return threshold * sample + math.sqrt(1 - threshold**2) * side


def _tables(agree: np.ndarray, width: int, miss: float) -> int:
    """How many tables let pairs, of these shares of equal bits, share no key
    with mean chance ``miss``."""
    alone = np.log1p(-np.minimum(agree**width, 1 - 1e-9))
    need = lambda t: np.exp(t * alone).mean() > miss
    high = 4
    while need(high) and high < MOST_TABLES:
        high *= 2
    low = high // 2
    while high - low > 1:
        low, high = ((low + high) // 2, high) if need((low + high) // 2) else (low, (low + high) // 2)
    return high


def learn_codes(sample: np.ndarray, n: int, cfg: EmbedConfig) -> Codes:
    """``sample``: unit vectors; ``n``: how many vectors the tables will hold.
    Centring gives even codes, but widens the angle of near pairs where vectors
    share a direction; of codes with and without it the cheaper ones are taken,
    each with the tables that the sample's own pairs at the threshold need."""
    dim = sample.shape[1]
    width = min(24, max(6, int(math.log2(max(n, 2))) - 2))
    rng = np.random.default_rng(cfg.seed)
    some = np.tile(sample, (math.ceil(1024 / max(1, len(sample))), 1))
    near = _at_threshold(some, cfg.threshold, rng)
    angle = 1 - math.acos(cfg.threshold) / math.pi  # the agreement of random planes through the origin
    least = max(4, math.ceil(math.log(cfg.miss) / math.log(1 - angle**width)))
    best = None
    for mean in (sample.mean(axis=0), np.zeros(dim)):
        x = sample - mean
        _, s, v = np.linalg.svd(x, full_matrices=False) if len(x) > 1 else (None, np.ones(min(1, dim)), np.eye(dim)[:1])
        basis = v.T if len(v) == dim else np.eye(dim)

        def grow(planes: list[np.ndarray], bits: int, x: np.ndarray = x, basis: np.ndarray = basis) -> list[np.ndarray]:
            while sum(p.shape[1] for p in planes) < bits:
                planes.append(basis @ learn_rotation(x @ basis, cfg.rounds, rng))
            return planes

        planes = grow([], 1024)
        p = np.concatenate(planes, axis=1)
        left, right = (some - mean) @ p > 0, (near - mean) @ p > 0
        tables = max(least, _tables((left == right).mean(axis=1), width, cfg.miss / 2))
        # the chance that two vectors share a key, from the sample
        keys = left[: len(sample), : p.shape[1] // width * width].reshape(len(sample), -1, width) @ (1 << np.arange(width))
        shared = np.mean([((c := np.unique(k, return_counts=True)[1]) * (c - 1)).sum() for k in keys.T]) / max(1, len(sample) * (len(sample) - 1))
        cost = tables * (1 + tables / 100 + n * shared / 16)
        if best is None or cost < best[0]:
            best = cost, mean, grow, planes, tables
    _, mean, grow, planes, tables = best
    planes = np.concatenate(grow(planes, width * tables), axis=1)[:, : width * tables]
    # the bits that differ in a pair at the threshold, with slack
    code = planes[:, :CODE_BITS]
    differ = (((some - mean) @ code > 0) != ((near - mean) @ code > 0)).sum(axis=1)
    radius = int(min(code.shape[1], max(differ.max(initial=0), differ.mean() + cfg.slack * (differ.std() + 1)))) if len(sample) else code.shape[1]
    return Codes(mean, planes, width, tables, radius)


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _links(ids: np.ndarray, v: np.ndarray, keys: np.ndarray, t: int, threshold: float, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row numbers, i < j) whose first common key is in table ``t``;
    with ``side`` only pairs of different sides."""
    out_i, out_j = [], []
    for lo in range(0, len(ids), 512):
        cos = v[lo : lo + 512] @ v.T
        i, j = np.nonzero(cos >= threshold)
        i += lo
        ok = i < j
        i, j = i[ok], j[ok]
        if side is not None:
            ok = side[i] != side[j]
            i, j = i[ok], j[ok]
        if len(i) and t:
            ok = np.ones(len(i), bool)
            for a in range(0, len(i), 1 << 16):
                s = slice(a, a + (1 << 16))
                ok[s] = ~(keys[i[s], :t] == keys[j[s], :t]).any(axis=1)
            i, j = i[ok], j[ok]
        out_i.append(i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, cfg: EmbedConfig = EmbedConfig()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sane = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rest = rows.filter(~sane).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), F.lit(True)).alias("kept"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(1).offsets.to_numpy()
            flat = np.asarray(b.column(1).values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # -0.0 becomes 0.0
            raw = [flat[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends).astype(np.int32)), pa.array(raw, pa.binary()), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())], names=["vec_id", "d", "v", "digest"])

    packed = rows.filter(sane).mapInArrow(pack, "vec_id long, d int, v binary, digest binary")
    narrow = materialize(packed.select("vec_id", "digest"), "vectors")
    classes = materialize(packed.groupBy("digest").agg(F.first("v").alias("v"), F.first("d").alias("d"), F.min("vec_id").alias("rid"), F.count("*").alias("m")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    # one row a length; each length is compared by itself
    lengths = classes.groupBy("d").agg(F.count("*").alias("n"), F.sum("m").alias("rows")).orderBy("d").collect()
    if not lengths:
        return rest
    n_rows, n_classes, found = sum(r["rows"] for r in lengths), sum(r["n"] for r in lengths), None
    for r in lengths:
        part = _links_of_length(classes.filter(F.col("d") == r["d"]), r["n"], r["d"], cfg)
        found = part if found is None else found.unionByName(part)
    found = materialize(found, "found")

    several = narrow.groupBy("vec_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("vec_id")
    of_id = narrow.join(several, "vec_id").distinct().join(classes.select("digest", "cid"), "digest").select("vec_id", "cid")
    same_id = of_id.join(of_id.groupBy("vec_id").agg(F.min("cid").alias("b")), "vec_id").select(F.col("cid").alias("a"), "b")
    comp = connected_components(found.filter("to is not null").select(F.col("cid").alias("a"), F.col("to").alias("b")).union(same_id)).withColumnRenamed("id", "cid")
    links = found.filter("to is null").groupBy("cid").agg(F.sum("n").alias("n"))
    of_class = materialize(classes.select("digest", "cid", "rid", "m").join(links, "cid", "left").join(comp, "cid", "left").select("digest", "rid", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "of-class")
    first = of_class.groupBy("component").agg(F.min("rid").alias("component_id"), F.count("*").alias("c"))
    of_class = hub_join(of_class, first, "component", n_classes).select("digest", "n_links", "component_id", F.col("m").alias("c"))
    linked = hub_join(narrow, of_class, "digest", n_rows).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(rest)


def _links_of_length(classes: DataFrame, n: int, dim: int, cfg: EmbedConfig) -> DataFrame:
    """For the ``n`` classes of one length: rows ``cid, n`` with numbers of
    linked vectors (of several tasks, to be summed), and rows ``cid, to`` with the
    links of spanning forests."""
    order = F.xxhash64("v")
    share = min(1.0, 1.2 * cfg.sample_rows / n)
    sample = classes.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order, "cid").limit(cfg.sample_rows).select("v").collect()
    codes = learn_codes(_unit(np.frombuffer(b"".join(bytes(r["v"]) for r in sample), np.float64).reshape(-1, dim)), n, cfg) if sample else learn_codes(np.eye(dim)[:1], n, cfg)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                packed_bits, keys = codes.of(_unit(_matrix(s.column(0), dim)))
                offsets = pa.array(np.arange(0, (len(keys) + 1) * codes.tables, codes.tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([s.column(1), pa.array([r.tobytes() for r in packed_bits], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.astype(np.int32).reshape(-1)))], names=["cid", "code", "keys"])

    coded = materialize(classes.select("v", "cid").mapInArrow(encode, "cid long, code binary, keys array<int>"), "codes")
    entry = (F.col("t").cast("long") * (1 << 24) + F.col("k")).alias("key")
    tabled = coded.select("cid", "code", F.posexplode("keys").alias("t", "k")).select(entry, "cid", "code")
    large = tabled.groupBy("key").agg(F.count("*").alias("c"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 0):
            key, ids = t["key"].to_numpy(), t["cid"].to_numpy()
            bits = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(len(ids), -1)
            has = np.zeros(len(ids), bool)
            low = np.arange(len(ids))
            for step in range(1, len(ids)):  # each row against the step-th after it in its group
                low = low[: np.searchsorted(low, len(ids) - step)]
                low = low[key[low + step] == key[low]]
                if not len(low):
                    break
                close = np.bitwise_count(bits[low] ^ bits[low + step]).sum(axis=1, dtype=np.int32) <= codes.radius
                has[low[close]] = True
                has[low[close] + step] = True
            if has.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(ids[has])], names=["key", "cid"])

    # entries beyond a chunk pass without this test: their rows all go on
    crowded = materialize(large.filter(f"c > {cfg.chunk}").select("key", "c", F.ceil(F.col("c") / cfg.chunk).cast("int").alias("chunks")), "crowded")
    in_crowd = crowded.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    tested = tabled.join(large.filter(f"c between 2 and {cfg.chunk}").select("key"), "key", "left_semi").select("key", "cid", "code").repartition("key").sortWithinPartitions("key").mapInArrow(near, "key long, cid long").withColumn("chunks", F.lit(1))
    going = tested
    if in_crowd:
        whole = tabled.select("key", "cid").join(crowded.select("key"), "key", "left_semi")
        going = tested.union(hub_join(whole, crowded, "key", in_crowd).select("key", "cid", "chunks"))
    dealt = going.join(coded.select("cid", "keys"), "cid").join(classes.select("cid", "m", "v"), "cid").withColumn("own", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cid", "m", "v", "keys")

    def rerank(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        a, b, t = group["a"][0].as_py(), group["b"][0].as_py(), group["key"][0].as_py() >> 24
        ids, m = group["cid"].to_numpy(), group["m"].to_numpy()
        x = _matrix(group["v"], dim)
        keys = np.array(group["keys"].combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
        i, j = _links(ids, _unit(x), keys, t, cfg.threshold, None if a == b else group["own"].to_numpy())
        if not len(i):
            return
        uf, tree = UnionFind(len(ids)), []
        for p, q in zip(i.tolist(), j.tolist()):
            if uf.union(p, q):
                tree.append((int(ids[p]), int(ids[q])))
        add = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
        at = np.flatnonzero(add)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(add[at].astype(np.int64)), pa.nulls(len(at), pa.int64())], names=["cid", "n", "to"])
        if tree:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in tree], pa.int64()), pa.nulls(len(tree), pa.int64()), pa.array([q for _, q in tree], pa.int64())], names=["cid", "n", "to"])

    return map_sorted_groups(dealt, ["key", "a", "b"], rerank, "cid long, n long, to long")


#: All pairs by cosine in double precision.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.id = v.vec_id
"""
