"""MinHash near-duplicates by SuperMinHash.

1. One pass over the texts computes each document's set of word shingles, a
   128-bit digest of the set, and its SuperMinHash signature, folded to one
   key a band. Only these narrow rows leave the pass.
2. Equal sets become one class (a partial aggregate), so thousands of copies
   cost one representative.
3. Representatives that share a band key meet under the smallest of them (the
   leader). Its group is cut into chunks of bounded size, each with a copy of
   the leader; a chunk counts exact intersections of full shingle sets through
   an inverted index and emits a spanning forest of the confirmed links, never
   the pairs.
4. Connected components join the forests. A leader whose group needed several
   chunks and still spans several components gets a second step that sets
   every member outside its main component against all others, so that no
   candidate pair of different components stays untested.

Keys that many rows share (a set with many copies, a band key, a leader, the hub
of a component) are joined apart from the others (``hub_join``).

Defined cases: null or word-less text has an empty set, links with nothing and
is its own component; fewer words than a shingle give the whole sequence as the
one shingle; rows of one ``doc_id`` that have words are one node, which all of
their texts link; a null ``doc_id`` gets null
``component_id`` and ``kept``; an empty table gives an empty result. Shingles
are compared as 64-bit hashes, sets as 128-bit digests. ``keep_one`` judges texts,
not ids: unlike texts of one ``doc_id`` both stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwright.llm.common import UnionFind, connected_components, hub_join, map_sorted_groups, materialize, mix64, slices, words_of

U = np.uint64


@dataclass(frozen=True)
class NearDupConfig:
    """Similarity is ``num/den``. With ``bands`` x ``rows`` a pair just at the
    threshold is missed with probability (1 - s^rows)^bands: 8e-5 for 0.85
    with 20 x 6, 7e-5 for 0.8 with 24 x 5."""

    shingle: int = 3
    num: int = 85
    den: int = 100
    bands: int = 20
    rows: int = 6
    seed: int = 0x5EED
    chunk_docs: int = 512
    chunk_shingles: int = 400_000

    @property
    def slots(self) -> int:
        return self.bands * self.rows


#: Pipeline stages on word shingles: five words, 0.8.
FIVE_WORDS = NearDupConfig(shingle=5, num=80, bands=24, rows=5)
_h = xxhash.xxh3_64_intdigest


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for t in texts:
        w = words_of(t) if t else []
        if not w:
            out.append(np.empty(0, U))
            continue
        x = np.fromiter(map(_h, w), U, len(w))
        n = min(k, len(w))
        acc = np.full(len(w) - n + 1, n, U)
        for j in range(n):
            acc = mix64(acc * U(0x9E3779B97F4A7C15) + x[j : len(w) - n + 1 + j])
        acc.sort()
        out.append(acc if len(acc) < 2 else acc[np.concatenate(([True], acc[1:] != acc[:-1]))])
    return out


def superminhash(sets: list[np.ndarray], m: int, seed: int) -> np.ndarray:
    """Signatures [len(sets), m] of uint64 (all ones for an empty set).

    Element e draws a permutation p of the slots by Fisher-Yates, one step a
    round; in round j it offers the value j + u (u in [0, 1)) to slot p[j].
    Values of later rounds are larger, so a set stops as soon as all its slots
    hold values below the round's. All sets of a call advance together."""
    sig = np.full((len(sets), m), ~U(0), U)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return sig
    doc = np.repeat(np.arange(len(sets)), sizes)
    e = mix64(np.concatenate(sets) ^ U(seed))
    perm = None
    flat = sig.reshape(-1)
    alive = np.flatnonzero(sizes)
    for j in range(m):
        r = mix64(e + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r >> U(32)) * U(m - j) >> U(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            at = np.arange(len(e))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(flat, doc * m + slot, (U(j) << U(32)) | (r & U(0xFFFFFFFF)))
        done = sig[alive].max(axis=1) < (U(j + 1) << U(32))
        if done.all():
            break
        if done.any() or perm is None:
            keep = np.zeros(len(sets), bool)
            alive = alive[~done]
            keep[alive] = True
            keep = keep[doc]
            if perm is None:
                first = slot[keep]
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(first), 1))
                at = np.arange(len(first))
                perm[at, 0], perm[at, first] = first, perm[at, 0].copy()
            else:
                perm = perm[keep]
            e, doc = e[keep], doc[keep]
    return sig


def band_keys(sig: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    acc = np.broadcast_to(mix64(np.arange(cfg.bands, dtype=U) + U(cfg.seed)), (len(sig), cfg.bands)).copy()
    s = sig.reshape(len(sig), cfg.bands, cfg.rows)
    for j in range(cfg.rows):
        acc = mix64(acc * U(0x9E3779B97F4A7C15) + s[:, :, j])
    return acc.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, th, text``: a text and its hash, which tells texts of one id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def signatures(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """``doc_id, th, n_shingles, digest, bands`` for each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, limit=1 << 20):
            sets = shingle_sets(b.column(2).to_pylist(), cfg.shingle)
            keys = band_keys(superminhash(sets, cfg.slots, cfg.seed), cfg)
            full = np.fromiter((len(s) > 0 for s in sets), bool, len(sets))
            ends = np.concatenate(([0], np.cumsum(np.where(full, cfg.bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].reshape(-1)))], schema=schema)

    return keyed(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, digest binary, bands array<long>")


def forest(rids: np.ndarray, sets: list[np.ndarray], cfg: NearDupConfig, comp: np.ndarray | None = None, fresh: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets. With ``comp`` (known
    components) and ``fresh`` (rows to test), only fresh rows are set against
    the others."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(code, kind="stable")
    posting, start = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code))))
    first = np.concatenate(([0], np.cumsum(n)))
    uf = UnionFind(len(sets))
    if comp is not None:
        head: dict[int, int] = {}
        for i, c in enumerate(comp.tolist()):
            uf.union(head.setdefault(c, i), i)
    edges = []
    for i in range(len(sets)) if fresh is None else np.flatnonzero(fresh).tolist():
        mine = code[first[i] : first[i + 1]]
        lo, ln = start[mine], start[mine + 1] - start[mine]
        ln_sum = int(ln.sum())
        idx = np.repeat(lo - np.concatenate(([0], np.cumsum(ln)[:-1])), ln) + np.arange(ln_sum)
        both = np.bincount(posting[idx], minlength=len(sets))
        for j in np.flatnonzero(cfg.den * both >= cfg.num * (n[i] + n - both)).tolist():
            if j != i and rids[i] != rids[j] and uf.union(i, j):
                edges.append((int(rids[i]), int(rids[j])))
    return edges


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=EDGE)


@dataclass
class Classes:
    """Equal sets as one class: ``sigs`` (rows), ``table`` (digest, cid, rep, c:
    rows), ``links`` between classes, and ``component`` (digest, first: the
    smallest rep of the class's component, c)."""

    sigs: DataFrame
    sane: DataFrame
    table: DataFrame
    component: DataFrame
    n_rows: int
    repeated: bool


def classify(docs: DataFrame, cfg: NearDupConfig, by_id: bool) -> Classes:
    """Components of the documents' classes; with ``by_id`` the classes of one
    ``doc_id`` are linked too."""
    sigs = materialize(signatures(docs, cfg), "sigs")
    sane = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(sane.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("c")).withColumn("__row", F.monotonically_increasing_id()), "classes")
    n_rows, n_classes = classes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # ids with several rows (none where doc_id is unique), and of these the ones with several sets
    again = materialize(sane.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("k")).filter("k > 1"), "again")
    repeated = bool(again.head(1))
    several = again.filter("lo <> hi").select("doc_id")
    # a class is named by its smallest id, so that originals, mostly older than their copies, lead; by its row where classes share ids
    unlike = repeated and bool(several.head(1))
    classes = classes.withColumn("cid", F.col("__row") if unlike else F.col("rep.doc_id")).drop("__row")

    bands = classes.select("cid", "n", F.explode("bands").alias("key"))
    heads = bands.groupBy("key").agg(F.min("cid").alias("leader"), F.count("*").alias("c")).filter("c > 1")
    members = materialize(hub_join(bands, heads, "key", cfg.bands * n_classes).select("leader", "cid", "n").distinct(), "members")
    sizes = members.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / cfg.chunk_docs), F.ceil(F.sum("n") / cfg.chunk_shingles)).cast("int").alias("chunks"), F.count("*").alias("c")).filter("c > 1")
    placed = hub_join(members.select("leader", "cid"), sizes, "leader", members.count())
    own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    spread = F.when(F.col("cid") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    seats = placed.select("leader", "cid", F.explode(spread).alias("chunk"))
    texts = keyed(docs).filter("doc_id is not null")
    if repeated:  # equal rows give one text
        texts = texts.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    # the texts that have a candidate at all, once: documents are shuffled for this only
    reps = placed.select("cid").distinct().join(classes.select("cid", "rep.doc_id", "rep.th"), "cid")
    texts = materialize(texts.join(reps, ["doc_id", "th"]).select("cid", "text"), "candidates")

    def link(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows > 1:
            yield from _edges(forest(group["cid"].to_numpy(), shingle_sets(group["text"].to_pylist(), cfg.shingle), cfg))

    found = map_sorted_groups(texts.join(seats, "cid").select("leader", "chunk", "cid", "text"), ["leader", "chunk"], link, "a long, b long")
    if by_id and unlike:
        of_id = sane.join(several, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "cid"), "digest").select("doc_id", "cid")
        found = found.union(of_id.join(of_id.groupBy("doc_id").agg(F.min("cid").alias("least")), "doc_id").select(F.col("cid").alias("a"), F.col("least").alias("b")))
    edges = materialize(found, "links")
    comp = materialize(connected_components(edges), "comp")

    # leaders with several chunks: what is outside the main component meets all other chunks
    large = placed.filter("chunks > 1").join(comp.withColumnRenamed("id", "cid"), "cid", "left").select("leader", "cid", "chunks", F.coalesce("component", "cid").alias("comp"))
    counts = large.groupBy("leader", "comp").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("leader").agg(F.max(F.struct("k", "comp")).getField("comp").alias("main"), F.count("*").alias("comps"), F.sum("k").alias("c"), F.max("k").alias("most")).filter("comps > 1")
    blocks = F.ceil((F.col("c") - F.col("most")) / cfg.chunk_docs).cast("int")
    mixed = materialize(mixed.select("leader", "main", blocks.alias("blocks"), "c"), "mixed")
    if mixed.head(1):
        large = materialize(hub_join(large, mixed, "leader", mixed.agg(F.sum("c")).first()[0]).withColumn("odd", F.col("comp") != F.col("main")), "large")
        as_member = large.select("leader", own.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cid", "comp", F.lit(False).alias("fresh"))
        as_odd = large.filter("odd").select("leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int").alias("block"), "cid", "comp", F.lit(True).alias("fresh"))

        def relink(group: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from _edges(forest(group["cid"].to_numpy(), shingle_sets(group["text"].to_pylist(), cfg.shingle), cfg, group["comp"].to_numpy(), group["fresh"].to_numpy(zero_copy_only=False)))

        again = texts.join(as_member.union(as_odd), "cid").select("leader", "chunk", "block", "cid", "comp", "fresh", "text")
        more = map_sorted_groups(again, ["leader", "chunk", "block"], relink, "a long, b long")
        comp = materialize(connected_components(edges.union(more)), "comp")
    of_class = materialize(classes.select("digest", "cid", "rep", "c").join(comp.withColumnRenamed("id", "cid"), "cid", "left").select("digest", "rep", "c", F.coalesce("component", "cid").alias("component")), "of-class")
    firsts = of_class.groupBy("component").agg(F.min("rep").alias("first"), F.count("*").alias("c"))
    rows = of_class.withColumnRenamed("c", "rows")
    component = hub_join(rows, firsts, "component", n_classes).select("digest", "rep", "first", F.col("rows").alias("c"))
    return Classes(sigs, sane, classes, component, n_rows, repeated)


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``
    (columns ``doc_id`` and ``text``; others are ignored)."""
    found = classify(docs, cfg, by_id=True)
    of_class = found.component.select("digest", F.col("first.doc_id").alias("component_id"), "c")
    linked = hub_join(found.sane.select("doc_id", "n_shingles", "digest"), of_class, "digest", found.n_rows).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    rest = found.sigs.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.lit(True)).alias("kept"))
    return linked.unionByName(rest)


def keep_one(docs: DataFrame, cfg: NearDupConfig = FIVE_WORDS) -> DataFrame:
    """``docs`` without near-duplicates: of each component of texts the row of
    the smallest ``doc_id`` stays (of that id's texts in it, the one of the smallest
    hash; of rows equal in both, the one whose columns as JSON come first). Rows
    without ``doc_id`` and rows without words stay, repeated or not. All columns and
    types are kept."""
    found = classify(docs, cfg, by_id=False)
    stay = found.component.select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th")).distinct()
    bare = found.sigs.filter("n_shingles = 0 and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    key = [F.col("doc_id").cast("long") == F.col("__id"), F.xxhash64(F.col("text").cast("string")) == F.col("__th")]
    if not found.repeated:
        return docs.join(stay.union(bare), key, "left_semi").unionByName(docs.filter("doc_id is null"))
    once = docs.join(stay, key, "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = once.groupBy(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return one.unionByName(docs.join(bare, key, "left_semi")).unionByName(docs.filter("doc_id is null"))


#: The same links, by comparing all sets that share a shingle.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT sym.b, r.c FROM r JOIN sym ON sym.a = r.id WHERE r.c < sym.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN m ON m.id = n.doc_id
"""
