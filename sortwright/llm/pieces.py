"""SentencePiece encoding by sampled segmentation, and lossless decoding.

A text is escaped (a leading space is added, spaces become U+2581) and cut
wherever two neighbouring characters never stand side by side in any piece: no
piece crosses such a cut, so the lattice of pieces factors there exactly. For
each distinct unit of a window (found by a hash, confirmed by its characters) the
forward filter computes the log mass of every
prefix, many units at once in numpy; units of more than ``LONG`` characters go one by
one and by blocks: only the prefixes' masses are kept, and the walk back finds each
block's pieces again. Backward sampling then walks every occurrence
from its end: the last piece is drawn in proportion to (mass of the prefix before
it) x (its probability). The random numbers are a hash of (seed, row key,
occurrence, step), so a row gets the same segmentation wherever and however
often it is computed.

The vocabulary file has merge ranks, not probabilities: the probability of the
piece of rank r is taken in proportion to (r + ``shift``)^-``theta`` (Zipf's law).
A character that no piece covers is spelled in byte pieces, and so is U+2581
itself, which is why decoding returns the very text.

Defined cases: null text has null ids; empty text has none; a null row key counts
as key 0; a unit may be as long as its text (memory: see ``WINDOW``);
result columns get underscores where the frame has one of their name.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from sortwright.llm.common import mix64, slices, spare

U = np.uint64
#: U+2581 stands for a space; a lone surrogate, which no text holds, for U+2581.
SPACE, RAW = "\u2581", "\ud800"
BASE, GOLD = U(0x100000001B3), U(0x9E3779B97F4A7C15)
#: Units of more characters are treated one by one.
LONG = 64
#: At most so many characters (one unit at least) and units are treated at once, so
#: a text of any length needs memory for one window, its characters and its ids.
WINDOW, UNITS = 1 << 20, 1 << 18
#: Characters that helper arrays cover at once, and rows of the tables of ``forward``.
BLOCK, ROWS = 1 << 15, 1 << 18


@dataclass(frozen=True)
class PieceConfig:
    model: str = ""
    seed: int = 17
    theta: float = 1.0
    shift: float = 20.0
    slice_bytes: int = 1 << 20


def _draw(state: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of 24 bits."""
    return (mix64(state + U(0xD1342543DE82EF95) * np.asarray(step, U)) >> U(40)).astype(np.float32) / np.float32(1 << 24)


def _draws(state: int, step: int) -> Iterator[float]:
    """The draws of one occurrence from ``step`` on, made in blocks."""
    block = 64
    while True:
        yield from _draw(np.full(block, state, U), np.arange(step, step + block)).tolist()
        step, block = step + block, min(4 * block, 1 << 14)


class Lattice:
    """The vocabulary, ready for lookups of many substrings at once."""

    def __init__(self, cfg: PieceConfig) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=cfg.model)
        size = sp.get_piece_size()
        self.bytes_of = [b""] * size
        self.byte_id = np.full(256, -1, np.int32)
        pieces = []
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append((p, i))
                self.bytes_of[i] = p.replace(SPACE, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks byte pieces, so decoding could lose text")
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece crosses a word boundary; the lattice doesn't factor")
        self.longest = max(len(p) for p, _ in pieces)
        hashes = np.array([self._hash(p) for p, _ in pieces], U)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for _, i in pieces], np.int32)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        rank = np.argsort(np.argsort([i for _, i in pieces]))[order]
        mass = (rank + cfg.shift) ** -cfg.theta
        self.logp = np.log(mass / mass.sum())
        self.unseen = float(self.logp.min() - np.log(256))  # a byte piece
        # a piece is found through one of two tables of places: the few that collide in the first go to the second
        self.table = np.full(1 << 20, -1, np.int32)
        rest = []
        for k, at in enumerate((self.hashes * GOLD >> U(44)).tolist()):
            if self.table[at] < 0:
                self.table[at] = k
            else:
                rest.append(k)
        for odd in range(1, 1 << 16, 2):
            self.odd = U((int(GOLD) * odd) & 0xFFFFFFFFFFFFFFFF | 1)
            at = (self.hashes[rest] * self.odd >> U(46)).astype(np.int64)
            if len(set(at.tolist())) == len(rest):
                break
        else:
            raise ValueError("no second table fits")
        self.second = np.full(1 << 18, -1, np.int32)
        self.second[at] = rest
        # characters side by side in some piece; others share no piece (a stray hit only forgoes a cut)
        self.pairs = np.zeros(1 << 22, bool)
        for p, _ in pieces:
            c = np.array([ord(x) for x in p], U)
            self.pairs[self._pair(c)] = True

    @staticmethod
    def _pair(c: np.ndarray) -> np.ndarray:
        return (((c[:-1] << U(32)) | c[1:]) * GOLD >> U(42)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and the pieces' places."""
        k = self.table[(h * GOLD >> U(44)).astype(np.int64)]
        wrong = self.hashes[k] != h
        k2 = self.second[(h[wrong] * self.odd >> U(46)).astype(np.int64)]
        k[wrong] = np.where(self.hashes[k2] == h[wrong], k2, -1)
        at = np.flatnonzero(k >= 0)
        at = at[self.hashes[k[at]] == h[at]]
        return at, k[at]

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def forward(self, code: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For units ``code[first : first + n]``: ``place`` of each unit, ``start``
        of each position, and for each row ``start[i] + place`` (the prefix of
        ``i`` characters) the cumulated shares of the piece lengths 1..longest
        and the piece of each length (-1: none, -2: bytes).

        Rows are position-major with long units first, so each step over all
        units works on contiguous slices."""
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        most = int(n.max())
        live = np.searchsorted(-n[order], -np.arange(most + 1), "right")  # units of at least i characters
        start = np.concatenate(([0], np.cumsum(live)))
        rows, width = int(start[-1]), min(self.longest, most)
        begin = first[order]
        chars = [code[:0], *(code[begin[: int(live[i])] + (i - 1)] for i in range(1, most + 1))]
        cum = np.full((rows, width), 2.0, np.float32)
        piece = np.full((rows, width), -1, np.int32)
        alpha = np.zeros(rows)
        power = [U(pow(int(BASE), k, 1 << 64)) for k in range(width)]
        for i in range(1, most + 1):
            k, lo, w = int(live[i]), int(start[i]), min(i, width)
            x = np.full((w, k), -np.inf)
            h = np.zeros(k, U)
            for m in range(1, w + 1):
                # the hash of the m characters that end at position i
                c = chars[i - m + 1][:k]
                h += (c + U(1)) * power[m - 1]
                at, p = self.find(h)
                x[m - 1, at] = self.logp[p] + alpha[int(start[i - m]) + at]
                piece[lo + at, m - 1] = self.ids[p]
                if m == 1 and len(at) < k:
                    alone = np.flatnonzero(piece[lo : lo + k, 0] < 0)
                    c = np.where(c[alone] == U(ord(RAW)), ord(SPACE), c[alone].astype(np.int64))
                    x[0, alone] = self.unseen * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) + alpha[int(start[i - 1]) + alone]
                    piece[lo + alone, 0] = -2
            top = x.max(axis=0)
            x -= top
            np.exp(x, out=x)
            np.cumsum(x, axis=0, out=x)
            alpha[lo : lo + k] = top + np.log(x[-1])
            x /= x[-1]
            x[-1] = 2.0
            cum[lo : lo + k, :w] = x.T
        return place, start, cum, piece

    def _ending(self, code: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """Of one long unit: from ``ptr[i]`` to ``ptr[i + 1]`` the pieces that end
        with character ``lo + i``, as sizes, log probabilities and ids."""
        found, h = [], np.zeros(hi - lo, U)
        for m in range(1, min(self.longest, hi) + 1):
            skip = max(0, m - 1 - lo)  # positions with fewer than m characters before them
            h[skip:] += (code[lo + skip - m + 1 : hi - m + 1] + U(1)) * U(pow(int(BASE), m - 1, 1 << 64))
            at, p = self.find(h[skip:])
            at += skip
            found.append((at, np.full(len(at), m), self.logp[p], self.ids[p]))
            if m == 1:
                alone = np.setdiff1d(np.arange(hi - lo), at)
                c = code[lo + alone].astype(np.int64)
                c[c == ord(RAW)] = ord(SPACE)
                found.append((alone, np.ones(len(alone), np.int64), self.unseen * (1.0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)), np.full(len(alone), -2)))
        end = np.concatenate([f[0] for f in found])
        order = np.argsort(end, kind="stable")
        ptr = np.concatenate(([0], np.cumsum(np.bincount(end, minlength=hi - lo))))
        return ptr.tolist(), *(np.concatenate([f[k] for f in found])[order].tolist() for k in (1, 2, 3))

    def long_walks(self, code: np.ndarray, states: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each occurrence (by its state) of one long unit the sampled pieces,
        last first, and where they begin. All occurrences walk back through a block
        before the one before it."""
        n, alpha = len(code), np.zeros(len(code) + 1)
        for lo in range(0, n, BLOCK):
            hi, low = min(n, lo + BLOCK), max(0, lo + 1 - self.longest)
            ptr, size, logp, names = self._ending(code, lo, hi)
            mass = alpha[low : lo + 1].tolist()
            for i in range(lo, hi):
                x = [mass[i + 1 - low - size[k]] + logp[k] for k in range(ptr[i - lo], ptr[i - lo + 1])]
                top, total = max(x), 0.0
                for v in x:
                    total += math.exp(v - top)
                mass.append(top + math.log(total))
            alpha[lo + 1 : hi + 1] = mass[lo + 1 - low :]
        ids, begin, at = [array("i") for _ in states], [array("i") for _ in states], [n] * len(states)
        for lo in reversed(range(0, n, BLOCK)):
            low = max(0, lo + 1 - self.longest)
            if lo + BLOCK < n:  # the last block's pieces are at hand
                ptr, size, logp, names = self._ending(code, lo, lo + BLOCK)
                mass = alpha[low : lo + BLOCK + 1].tolist()
            shares: dict[int, list[float]] = {}  # of the positions that a walk comes by
            for o, state in enumerate(states):
                here, draws = at[o], _draws(state, len(ids[o]))
                while here > lo:
                    a, b = ptr[here - 1 - lo], ptr[here - lo]
                    if here not in shares:
                        x = [mass[here - low - size[k]] + logp[k] for k in range(a, b)]
                        top = max(x)
                        shares[here] = list(accumulate([math.exp(v - top) for v in x]))
                    mine = shares[here]
                    k = a + min(bisect_right(mine, next(draws) * mine[-1]), b - a - 1)
                    here -= size[k]
                    ids[o].append(names[k])
                    begin[o].append(here)
                at[o] = here
        return [(np.frombuffer(i, np.int32), np.frombuffer(b, np.int32)) for i, b in zip(ids, begin)]

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """Ids of each (non-empty) text."""
        marked = [SPACE + t.replace(SPACE, RAW).replace(" ", SPACE) for t in texts]
        ends = np.cumsum([len(t) for t in marked])
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        del marked
        cut = np.ones(len(code), bool)
        for lo in range(1, len(code), BLOCK):
            cut[lo : lo + BLOCK] = ~self.pairs[self._pair(code[lo - 1 : lo + BLOCK])]
        cut[ends[:-1]] = True
        first = np.append(np.flatnonzero(cut), len(code))
        del cut
        before = np.searchsorted(first, np.append(0, ends[:-1]))  # units before each text
        own = mix64(keys.astype(np.int64).view(U) ^ mix64(np.array([seed], U)))
        sizes, parts, a = np.zeros(len(texts), np.int64), [], 0
        while a < len(first) - 1:
            b = max(a + 1, min(a + UNITS, int(np.searchsorted(first, first[a] + WINDOW, "right")) - 1))
            row = np.searchsorted(ends, first[a:b], "right")
            state = mix64(own[row] + (np.arange(a, b) - before[row]).astype(U) * GOLD)
            ids, per = self._window(code[first[a] : first[b]], first[a:b] - first[a], np.diff(first[a : b + 1]), state)
            np.add.at(sizes, row, per)
            parts.append(ids)
            a = b
        return np.split(np.concatenate(parts), np.cumsum(sizes)[:-1])

    def _window(self, code: np.ndarray, first: np.ndarray, n: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units ``code[first : first + n]``, one unit after the other,
        and how many each has. ``state`` makes each unit's draws."""
        one, of = self._distinct(code, first, n)
        long = n[one] > LONG
        group = np.full(len(one), -1)
        by_size = np.argsort(-n[one], kind="stable")[int(long.sum()) :]  # so that only the first groups have many steps
        group[by_size] = (np.cumsum(n[one[by_size]]) - 1) // ROWS
        # occurrence o takes steps[o] steps from its end; its first piece is drawn last
        steps = np.zeros(len(of), np.int64)
        got: list[tuple[int | np.ndarray, np.ndarray | int, np.ndarray, np.ndarray]] = []
        for g in range(int(group.max()) + 1):
            mine = np.flatnonzero(group == g)
            if not len(mine):
                continue
            place = np.zeros(len(one), np.int64)
            place[mine], start, cum, piece = self.forward(code, first[one[mine]], n[one[mine]])
            live, step = np.flatnonzero(group[of] == g), 0
            where, at = place[of[live]], n[live]
            while len(live):
                r = start[at] + where
                k = (cum[r] > _draw(state[live], step)[:, None]).argmax(axis=1)
                at = at - (k + 1)
                got.append((step, live, piece[r, k], at.astype(np.int32)))
                steps[live] += 1
                more, step = at > 0, step + 1
                live, where, at = live[more], where[more], at[more]
            del cum, piece
        odd = np.flatnonzero(long[of])
        odd = odd[np.argsort(of[odd], kind="stable")]
        for same in np.split(odd, np.flatnonzero(np.diff(of[odd])) + 1):
            if len(same):  # one long unit at a time
                walks = self.long_walks(code[first[same[0]] : first[same[0]] + n[same[0]]], state[same].tolist())
                for o, (i, b) in zip(same.tolist(), walks):
                    steps[o] = len(i)
                    got.append((np.arange(len(i), dtype=np.int32), o, i, b))
        last = np.cumsum(steps)
        ids, begin = np.empty(int(last[-1]), np.int32), np.empty(int(last[-1]), np.int32)
        while got:
            s, o, i, b = got.pop()
            at = last[o] - 1 - s
            ids[at], begin[at] = i, b
        raw = np.flatnonzero(ids == -2)
        if not len(raw):
            return ids, steps
        unit = np.searchsorted(last, raw, "right")
        chars, which = np.unique(code[first[unit] + begin[raw]], return_inverse=True)
        spelled = [(SPACE if c == RAW else c).encode("utf-8", "surrogatepass") for c in map(chr, chars.tolist())]
        extra = np.array([len(x) for x in spelled])[which]
        table = self.byte_id[np.array([[*x.ljust(4, b"\0")] for x in spelled])]
        count = np.ones(len(ids), np.int64)
        count[raw] = extra
        to = np.cumsum(count) - count
        out = np.empty(int(to[-1] + count[-1]), np.int32)
        out[to] = ids
        for j in range(4):
            sel = np.flatnonzero(extra > j)
            out[to[raw[sel]] + j] = table[which[sel], j]
        np.add.at(steps, unit, extra - 1)
        return out, steps

    @staticmethod
    def _blocks(first: np.ndarray, size: int) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of characters: their slice, the slice of the units that they
        belong to, where these begin in the block, how many characters of it each has,
        and how far each character is into its unit."""
        for lo in range(0, size, BLOCK):
            hi = min(size, lo + BLOCK)
            units = slice(int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi)))
            begin = np.maximum(first[units], lo) - lo
            per = np.diff(np.append(begin, hi - lo))
            yield slice(lo, hi), units, begin, per, np.arange(lo, hi) - np.repeat(first[units], per)

    @classmethod
    def _distinct(cls, code: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct units (by number) and which of them each unit is. Equal
        hashes are confirmed character by character; a unit that only shares
        another's hash is distinct."""
        h = n.astype(U)
        for chars, units, begin, _, rel in cls._blocks(first, len(code)):
            h[units] += np.add.reduceat(mix64(code[chars] + rel.astype(U) * GOLD), begin)
        _, one, of = np.unique(h, return_index=True, return_inverse=True)
        del h
        same = n[one][of] == n
        origin = first[one][of]
        for chars, units, begin, per, rel in cls._blocks(first, len(code)):
            source = np.minimum(np.repeat(origin[units], per) + rel, len(code) - 1)
            same[units] &= np.logical_and.reduceat(code[source] == code[chars], begin)
        odd = np.flatnonzero(~same)
        of[odd] = len(one) + np.arange(len(odd))
        return np.concatenate((one, odd)), of

    def segment(self, texts: list[str | None], keys: np.ndarray, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sizes of all texts' ids, and the ids of the non-empty texts."""
        full = [i for i, t in enumerate(texts) if t]
        parts = self.sample([texts[i] for i in full], keys[full], seed) if full else []
        sizes = np.zeros(len(texts), np.int64)
        sizes[full] = [len(p) for p in parts]
        return sizes, parts

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def lattice(cfg: PieceConfig) -> Lattice:
    return Lattice(cfg)


def default_config(**more) -> PieceConfig:
    import public_tokenizers

    return PieceConfig(model=public_tokenizers.path("piece_bpe_32k.model"), **more)


def encode(docs: DataFrame, cfg: PieceConfig | None = None, ids: str = "piece_ids") -> DataFrame:
    """``docs`` with a column ``ids`` of sampled piece ids. The row key is
    ``doc_id``."""
    cfg, ids = cfg or default_config(), spare(ids, docs.columns)
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    schema = StructType([*docs.schema.fields]).add(ids, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(cfg)
        for b in slices(batches, at, cfg.slice_bytes):
            texts = b.column(at).to_pylist()
            keys = pc.fill_null(b.column(key).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            sizes, parts = lat.segment(texts, keys, cfg.seed)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
            col = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, cfg: PieceConfig | None = None, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that its piece ids spell."""
    cfg, text = cfg or default_config(), spare(text, df.columns)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(cfg)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array([None if x is None else lat.decode(x) for x in s.column(at).to_pylist()], pa.string())], names=[*s.schema.names, text])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(text, "string"))

