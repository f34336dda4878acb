"""Benchmark decontamination by greedy string tiling.

Every document is tokenised once against the benchmark's vocabulary. Windows of
``min_match`` tokens that the document shares with a benchmark item are the
seeds; they join the document to its candidate items. A candidate pair whose
seeds cover enough of the item is tiled: Running Karp-Rabin repeatedly finds and
marks the longest unmarked common token strings, so reordered passages count
with all their parts. ``coverage`` is the share of the item's tokens in tiles.

Seeds are sets: a token string that a document repeats counts once, and an item's
places with that string once each, so work and memory grow with the document and
the item, not with the product of their repeats. Hashes only propose matches; tokens
decide.

The benchmark is read in blocks of bounded size (``block_bytes`` of text). Each is
broadcast by itself and a task holds one at a time; one scan of the corpus serves up
to ``scan_blocks`` of them. Documents are never joined with each other and no pair
without a seed is looked at.

Tokens are runs of letters, digits and underscores in lower case. Defined cases:
null or token-less texts and items match nothing; an item shorter than
``min_match`` is matched by its whole token string; repeated rows give repeated
result rows; an empty benchmark or empty documents give an empty result; extra
columns are ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwright.llm.common import mix64, powers, slices

U = np.uint64
BASE = 0x9E3779B97F4A7C15
TOKEN = re.compile(r"\w+").findall


@dataclass(frozen=True)
class DecontamConfig:
    min_match: int = 5
    coverage: float = 0.8
    block_bytes: int = 8 << 20
    scan_blocks: int = 64
    expand: int = 1 << 22


class Side:
    """One side of a tiling: tokens (negative ones match nothing) and what is
    not marked yet."""

    def __init__(self, tokens: list[int] | np.ndarray) -> None:
        self.x = np.asarray(tokens, np.int64)
        self.free = self.x >= 0
        power, self.inverse = powers(len(self.x) + 1)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(mix64(self.x.astype(U)) * power[:-1])))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and Karp-Rabin hashes of the unmarked windows of ``n`` tokens."""
        upto = np.concatenate(([0], np.cumsum(self.free)))
        at = np.flatnonzero(upto[n:] - upto[:-n] == n)
        return at, (self.sums[at + n] - self.sums[at]) * self.inverse[at]


def _common(p: Side, t: Side, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``n`` tokens whose hash is on both sides, in order of place."""
    (i, hi), (j, hj) = p.windows(n), t.windows(n)
    both = np.intersect1d(hi, hj)
    a, b = np.isin(hi, both), np.isin(hj, both)
    return i[a], hi[a], j[b], hj[b]


def greedy_string_tiling(pattern: list[int] | np.ndarray, text: list[int] | np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles ``(pattern start, text start, length)`` of at least ``min_match``
    tokens, longest first, none overlapping another on either side. Equal
    lengths are taken in order of pattern start, then text start.

    Search lengths double while some window is common, then halve down to the longest
    one; all tiles of that length are marked in one pass, and the search goes on below
    it."""
    p, t = Side(pattern), Side(text)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(p.x), len(t.x))
    while most >= min_match and p.free.sum() >= min_match:
        found = _common(p, t, min_match)
        if not len(found[0]):
            break
        low, high = min_match, most + 1  # common at low, not (or not asked for) at high
        step = min_match
        while low + step < high:
            more = _common(p, t, low + step)
            if len(more[0]):
                low, found, step = low + step, more, step * 2
            else:
                high = low + step
        while high - low > 1:
            mid = (low + high) // 2
            more = _common(p, t, mid)
            if len(more[0]):
                low, found = mid, more
            else:
                high = mid
        tiles += _mark(p, t, low, *found)
        most = low - 1
    return tiles


def _mark(p: Side, t: Side, n: int, i: np.ndarray, hi: np.ndarray, j: np.ndarray, hj: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles of ``n`` tokens among the windows, earliest first. Windows and marks of
    the pass are equally long, so a window is hit exactly if one of its ends is."""
    places: dict[int, list[int]] = defaultdict(list)
    for a, h in zip(j.tolist(), hj.tolist()):
        places[h].append(a)
    start: dict[int, int] = defaultdict(int)
    tiles, end = [], 0
    for a, h in zip(i.tolist(), hi.tolist()):
        if a < end:
            continue
        mine, k = places[h], start[h]
        while k < len(mine) and not (t.free[mine[k]] and t.free[mine[k] + n - 1]):
            k += 1
        start[h] = k  # what is marked stays marked
        while k < len(mine):
            b = mine[k]
            if t.free[b] and t.free[b + n - 1] and np.array_equal(p.x[a : a + n], t.x[b : b + n]):
                p.free[a : a + n] = t.free[b : b + n] = False
                tiles.append((a, b, n))
                end = a + n
                break
            k += 1
    return tiles


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(ids) - n + 1), U)
    for j in range(n):
        out = out * U(BASE) + ids[j : len(ids) - n + 1 + j].astype(U) + U(1)
    return out


class Seeds:
    """The index of one benchmark block: its vocabulary, its items' tokens, and for
    each window length the distinct windows with their places, as flat arrays."""

    def __init__(self, items: list[tuple[int, str]], cfg: DecontamConfig) -> None:
        self.cfg, self.vocab, self.items = cfg, {}, []
        by: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in TOKEN((text or "").lower())], np.int64)
            if len(ids):
                n = min(cfg.min_match, len(ids))
                by[n].append((_grams(ids, n), len(self.items)))
                self.items.append((item, ids))
        self.by = {}
        for n, parts in by.items():
            grams = np.concatenate([g for g, _ in parts])
            owner = np.repeat([k for _, k in parts], [len(g) for g, _ in parts])
            place = np.concatenate([np.arange(len(g)) for g, _ in parts])
            order = np.argsort(grams, kind="stable")
            distinct, first = np.unique(grams[order], return_index=True)
            self.by[n] = distinct, np.append(first, len(order)), owner[order], place[order]

    def match(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, int]]]]:
        """``(row, item index, item ids, tiles)`` of each pair over the threshold."""
        get = self.vocab.get
        words = [TOKEN(t.lower()) if t else [] for t in texts]
        ends = np.cumsum([len(w) + 1 for w in words])
        flat = np.fromiter((get(x, -1) for w in words for x in (*w, None)), np.int64, int(ends[-1]) if len(ends) else 0)
        known = np.concatenate(([0], np.cumsum(flat >= 0)))
        pairs: list[tuple[int, int, int]] = []
        hits = {}
        for n, (distinct, first, owner, place) in self.by.items():
            if len(flat) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            g = np.zeros(len(at), U)
            for j in range(n):
                g = g * U(BASE) + flat[at + j].astype(U) + U(1)
            pos = np.searchsorted(distinct, g)
            hit = (pos < len(distinct)) & (distinct[np.minimum(pos, len(distinct) - 1)] == g)
            at, pos = at[hit], pos[hit]
            if not len(at):
                continue
            row = np.searchsorted(ends, at, "right")
            hits[n] = at, pos, row
            pairs += [(r, item, n) for r, item in self._candidates(n, row, pos)]
        for row, item, n in sorted(pairs):
            ids = self.items[item][1]
            at, pos, rows = hits[n]
            lo, hi = np.searchsorted(rows, [row, row + 1])
            own = np.isin(pos[lo:hi], np.searchsorted(self.by[n][0], _grams(ids, n)))
            text, back = _around(flat, at[lo:hi][own], n)
            begin = int(ends[row - 1]) if row else 0
            tiles = [(i, int(back[j]) - begin, k) for i, j, k in greedy_string_tiling(ids, text, n)]
            if sum(k for _, _, k in tiles) >= self.cfg.coverage * len(ids):
                yield row, item, ids, tiles

    def _candidates(self, n: int, row: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (row, item) whose common windows cover enough of the item: tiles
        lie in their union. Rows are taken together while their windows' places in
        the items stay below ``expand``, or alone."""
        _, first, owner, place = self.by[n]
        lengths = np.array([len(ids) for _, ids in self.items])
        key = np.unique(row * np.int64(len(first)) + pos)  # each window of a row once
        row, pos = key // len(first), key % len(first)
        count = first[pos + 1] - first[pos]
        upto, lo = np.cumsum(count), 0
        while lo < len(row):
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + self.cfg.expand, "right")))
            if hi < len(row):  # a row isn't cut
                hi = int(np.searchsorted(row, row[hi], "left"))
                hi = hi if hi > lo else int(np.searchsorted(row, row[lo], "right"))
            c = count[lo:hi]
            at = np.repeat(first[pos[lo:hi]] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            r, item, i = np.repeat(row[lo:hi], c), owner[at], place[at]
            order = np.lexsort((i, item, r))
            r, item, i = r[order], item[order], i[order]
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (item[1:] != item[:-1])))
            adds = np.full(len(i), n)
            adds[:-1] = np.where(new[1:], n, np.minimum(n, i[1:] - i[:-1]))
            start = np.flatnonzero(new)
            reach = np.add.reduceat(adds, start)
            enough = start[reach >= self.cfg.coverage * lengths[item[start]]]
            yield from zip(r[enough].tolist(), item[enough].tolist())
            lo = hi


def _around(flat: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in the windows of ``n`` from the places ``at`` on, a mark that
    matches nothing after each stretch, and where they stand in ``flat``."""
    stretch = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + n)))
    lo, hi = at[stretch], at[np.append(stretch[1:], len(at)) - 1] + n
    size = hi - lo + 1
    back = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text = flat[np.minimum(back, len(flat) - 1)]
    text[np.cumsum(size) - 1] = -2
    return text, back


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``doc_id, item_id, item_tokens, n_tiles, longest_tile, matched_tokens,
    coverage`` for each pair of a document and an item it contains."""
    schema = "doc_id long, item_id long, item_tokens long, n_tiles long, longest_tile long, matched_tokens long, coverage double"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    names = out.columns
    for scan in _scans(benchmark, cfg):

        def run(batches: Iterator[pa.RecordBatch], scan: list[Broadcast] = scan) -> Iterator[pa.RecordBatch]:
            for b, index in _with_each(batches, 1, scan):
                ids = b.column(0).to_pylist()
                rows = []
                for row, item, tokens, tiles in index.match(b.column(1).to_pylist()):
                    covered = sum(n for _, _, n in tiles)
                    rows.append((ids[row], index.items[item][0], len(tokens), len(tiles), max(n for _, _, n in tiles), covered, covered / len(tokens)))
                if rows:
                    types = [pa.int64()] * 6 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        out = out.union(source.mapInArrow(run, schema))
    return out


def _with_each(batches: Iterator[pa.RecordBatch], text: int, scan: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, Seeds]]:
    """Each slice with each block's index; of several blocks one is held at a
    time, and slices are longer so that blocks are loaded less often."""
    for b in slices(batches, text, limit=4 << 20 if len(scan) == 1 else 32 << 20):
        for block in scan:
            yield b, block.value
            if len(scan) > 1:
                block.__dict__.pop("_value", None)


def _scans(benchmark: DataFrame, cfg: DecontamConfig) -> Iterator[list[Broadcast]]:
    """The benchmark's blocks, for as many scans as they need. The driver holds
    one block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n, scan = -(-size // cfg.block_bytes), []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        scan.append(benchmark.sparkSession.sparkContext.broadcast(Seeds([(r["item_id"], r["text"]) for r in rows], cfg)))
        if len(scan) == cfg.scan_blocks or k == n - 1:
            yield scan
            scan = []


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns and
    types are kept. Each row is judged by its own text in one pass."""
    at = docs.columns.index("text")
    for scan in _scans(benchmark, cfg):

        def run(batches: Iterator[pa.RecordBatch], scan: list[Broadcast] = scan) -> Iterator[pa.RecordBatch]:
            last, bad = None, set()
            for b, index in _with_each(batches, at, scan):
                if last is not None and b is not last:
                    yield _without(last, bad)
                    bad = set()
                last = b
                bad.update(row for row, *_ in index.match(b.column(at).to_pylist()))
            if last is not None:
                yield _without(last, bad)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _without(b: pa.RecordBatch, bad: set[int]) -> pa.RecordBatch:
    return b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))
