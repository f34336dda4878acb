"""PII replaced by keyed, type-consistent surrogates.

1. One pass detects entities and emits each distinct (kind, canonical form) of
   its slice; a shuffle makes the corpus-wide table of distinct entities.
2. Every entity gets a surrogate from a keyed hash: same kind, length, script,
   gender and format (names in scripts without a pool of their own are letters of the
   same script, whatever the gender). The collision check looks for entities of one kind that
   share a surrogate and for surrogates that are entities of the corpus
   themselves; the losers draw again until all are distinct. Later draws may be
   longer or leave their prefix or range, so that a crowded kind has room; only IP
   addresses stay within the 2^32 there are.
3. A second pass over whole texts rewrites them. Surrogates of the first draw
   need no lookup; the redrawn ones are broadcast while they number at most
   ``broadcast_rows``, and beyond it are joined to the documents by text digest.

Equal entities get equal surrogates in all documents (coreference), also when
written in other formats; different ones get different ones (distinctness).

The key has no default: without it anyone could recompute the surrogates.

Defined cases: null text stays null; text without entities stays as it is;
repeated rows are rewritten alike; other columns and extra columns are kept; a text
may hold any number of entities (finds are marked, not compared with each other).
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from sortwright.llm.common import discard, materialize, slices, spare

Span = tuple[int, int, str, str]  # start, end, kind, canonical form
LOWER, UPPER, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


@dataclass(frozen=True)
class PiiConfig:
    key: bytes
    broadcast_rows: int = 200_000
    max_draws: int = 50


def session_key(spark: SparkSession) -> bytes:
    """The session's ``spark.sortwright.pii.secret``; where none is set, a random one
    for this session, so that surrogates of two sessions don't agree."""
    name = "spark.sortwright.pii.secret"
    key = spark.conf.get(name, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(name, key)
    return key.encode()


# -- detection -------------------------------------------------------------

_AT = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+\-]{1,64}\Z")
_DIGIT = re.compile(r"[0-9]\.?[0-9]")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_PHONE = re.compile(r"(?<![\w+])(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])(?:\+1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\w+.-])(?:[3-6]\d{12,18}|[3-6]\d{3}([ -])\d{4}\1\d{4}\1\d{4}|3\d{3}([ -])\d{6}\2\d{5})(?!\w)")
_AWS = re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)")
# the whole value, however long; short ones must hold a digit (see _is_secret)
_SECRET = re.compile(r"(?i)(?<![a-z])(?:(?:token|secret|api[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-/+=.]{8,})|passwo?r?d[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>,;]{6,}))")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")

# fixed values: forms of address by gender
_MALE = {"Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"}
_FEMALE = {"Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"}
_ADDRESSED = re.compile(rf"[{''.join(sorted({x[0] for x in _MALE | _FEMALE}))}](?:{'|'.join(sorted({x[1:] for x in _MALE | _FEMALE}))})\.? [^\W\d_a-z]")
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(_MALE | _FEMALE, reverse=True))})\.? ([^\W\d_a-z][^\W\d_]+)(?: ([^\W\d_a-z][^\W\d_]+))?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split(" ")[0]


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _is_secret(value: str, password: bool) -> bool:
    """Values of 16 characters and more, and shorter ones that no word looks
    like: with a digit, and beside ``password`` only, without a letter."""
    letter, digit = any(map(str.isalpha, value)), any(map(str.isdigit, value))
    return (letter or digit) and (len(value) >= 16 or digit and (letter or password))


def detect(text: str) -> list[Span]:
    """Entities in order, none overlapping another; of overlapping finds the
    kind tried first stays, but a secret stays whole."""
    found: list[Span] = []
    taken = bytearray()

    def add(lo: int, hi: int, kind: str, canon: str) -> None:
        nonlocal taken
        taken = taken or bytearray(len(text))
        if taken.find(1, lo, hi) < 0:
            taken[lo:hi] = b"\x01" * (hi - lo)
            found.append((lo, hi, kind, canon))

    if "@" in text:
        for m in _AT.finditer(text):
            if (left := _LOCAL.search(text, max(0, m.start() - 64), m.start())) and (local := left[0].lstrip(".")):
                lo = m.start() - len(local)
                add(lo, m.end(), "email", text[lo : m.end()].lower())
    for m in _AWS.finditer(text) if "AKIA" in text or "ASIA" in text else ():
        add(m.start(), m.end(), "aws", m[0])
    near: list[list[int]] = []  # only what is near two digits, or digit, dot, digit, can be one of these
    for m in _DIGIT.finditer(text):
        if near and m.start() - 64 <= near[-1][1]:
            near[-1][1] = m.end() + 64
        else:
            near.append([max(0, m.start() - 64), m.end() + 64])

    def each(pattern: re.Pattern) -> Iterator[re.Match]:
        for lo, hi in near:
            yield from pattern.finditer(text, lo, hi)

    if near:
        for m in each(_IP):
            if all(int(x) < 256 for x in m[0].split(".")):
                add(m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))
        for m in each(_PHONE):
            d = _digits(m[0])
            if 8 <= len(d) <= 15:
                add(m.start(), m.end(), "phone", d[1:] if len(d) == 11 and d[0] == "1" else d)
        for m in each(_SSN):
            add(m.start(), m.end(), "ssn", _digits(m[0]))
        for m in each(_CARD):
            add(m.start(), m.end(), "card", _digits(m[0]))
        for m in each(_IBAN):
            add(m.start(), m.end(), "iban", m[0].replace(" ", ""))
    if "=" in text or ":" in text:
        found.sort()
        starts, inside = [x[0] for x in found], set()
        for m in _SECRET.finditer(text):
            value = m[m.lastindex].rstrip(".")
            lo = m.start(m.lastindex)
            hi = lo + len(value)
            if len(value) >= 6 and _is_secret(value, m.lastindex == 2):
                # what was found strictly inside the value is part of it
                k = max(0, bisect_left(starts, lo) - 1)
                within = []
                while k < len(starts) and starts[k] < hi:
                    if found[k][1] > lo:
                        within.append(k)
                    k += 1
                whole = all(lo <= found[k][0] and found[k][1] <= hi and found[k][:2] != (lo, hi) for k in within)
                if within and whole:
                    inside.update(within)
                    taken[lo:hi] = bytes(hi - lo)
                add(lo, hi, "secret", value)
        found = [x for k, x in enumerate(found) if k not in inside]
    for m in _NAME.finditer(text) if _ADDRESSED.search(text) else ():
        kind = "m" if m[1] in _MALE else "f"
        last = 3 if m[3] else 2
        if last == 3:
            add(m.start(2), m.end(2), f"given {kind} {script(m[2])}", m[2].casefold())
        add(m.start(last), m.end(last), f"surname {script(m[last])}", m[last].casefold())
    return sorted(found)


# -- surrogates ------------------------------------------------------------

# fixed values: given names by script and gender; syllables of surnames by script
_GIVEN = {
    "LATIN": {"f": "anna clara emma julia laura lucia maria nora paula sofia", "m": "adrian bruno daniel david emil hugo leon lucas martin victor"},
    "CYRILLIC": {"f": "анна вера дарья елена ирина мария нина ольга", "m": "антон борис денис иван максим олег павел роман"},
    "GREEK": {"f": "άννα ελένη μαρία σοφία", "m": "γιώργος νίκος πέτρος κώστας"},
}
_SYLLABLES = {"LATIN": "ba den fel gar hol kan lin mor nes pol rin sel tor van wel zan", "CYRILLIC": "ба вел гор дан зим кор лин мар нов пол рин сол тар фед хол чер", "GREEK": "βα γορ δαν ζιμ καρ λιν μαρ νικ παλ ριν σολ ταρ φιλ χαλ ψαλ θεο"}


@lru_cache(maxsize=256)
def _page(name: str, first: int) -> str:
    """The letters of a script among the 256 characters from ``first`` on,
    without capitals."""
    some = (chr(c) for c in range(first, first + 256))
    return "".join(c for c in some if unicodedata.category(c) in ("Ll", "Lo") and script(c) == name)


class Draw:
    """An endless keyed stream of choices."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what, self.n, self.pool, self.size = key[:64], "\x1f".join(map(str, what)).encode(), 0, 0, 1

    def below(self, n: int) -> int:
        if self.size < n << 64:
            self.pool = int.from_bytes(hashlib.blake2b(self.what + self.n.to_bytes(4, "big"), key=self.key).digest(), "big")
            self.size, self.n = 1 << 512, self.n + 1
        self.pool, x = divmod(self.pool, n)
        self.size //= n
        return x

    def of(self, items: str | list[str]) -> str:
        return items[self.below(len(items))]

    def like(self, text: str, keep: str = "") -> str:
        """Letters for letters, digits for digits, the rest as it is."""
        return "".join(c if c in keep else self.of(DIGIT) if c.isdigit() else self.of(LOWER) if "a" <= c <= "z" else self.of(UPPER) if "A" <= c <= "Z" else c for c in text)


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the entity's surrogate at this draw."""
    d = Draw(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        mapped = [x if x == "example" or i == len(labels) - 1 else Draw(key, "domain", ".".join(labels[i:])).like(x) for i, x in enumerate(labels)]
        more = attempt // 4
        return f"{d.like(local)[: 64 - more]}{''.join(d.of(LOWER) for _ in range(more))}@{'.'.join(mapped)}"
    if kind == "phone":
        if len(canon) == 10:
            return d.of("23456789") + d.like("00") + d.of("23456789") + d.like("000000")
        kept = max(0, 2 - attempt // 4)
        return canon[:kept] + d.like("0" * (len(canon) - kept)) + d.like("0" * (attempt // 16))
    if kind == "ssn":
        return f"{1 + d.below(665):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}{d.like("0" * (attempt // 16))}"
    if kind == "card":
        body = canon[0] + d.like("0" * (len(canon) - 2 + attempt // 16))
        valid = [c for c in DIGIT if luhn(body + c) == luhn(canon)]
        return body + d.of(valid)
    if kind == "ip":
        a, b, _, _ = (int(x) for x in canon.split("."))
        if attempt >= 4 and ((a, b) in ((192, 168), (169, 254)) or a in (127, 172)):  # a small range widens to a large private one, then to all
            a = 10
        if attempt >= 16:
            head = f"{d.below(256)}.{d.below(256)}"
        elif a in (10, 127):
            head = f"{a}.{d.below(256)}"
        elif (a, b) in ((192, 168), (169, 254)):
            head = f"{a}.{b}"
        elif a == 172 and 16 <= b < 32:
            head = f"172.{16 + d.below(16)}"
        else:
            head = f"{d.of([str(x) for x in range(1, 224) if x not in (10, 127, 169, 172, 192)])}.{d.below(256)}"
        return f"{head}.{d.below(256)}.{1 + d.below(254)}"
    if kind == "aws":
        return canon[:4] + "".join(d.of(DIGIT + UPPER) for _ in range(len(canon) - 4 + attempt // 16))
    if kind == "secret":
        chars = HEX if set(canon) <= set(HEX) else LOWER
        return ("".join(d.of(HEX) for _ in canon) if chars == HEX else d.like(canon)) + "".join(d.of(chars) for _ in range(attempt // 4))
    if kind == "iban":
        body = d.like(canon[4:]) + d.like("0" * (attempt // 16))
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    kind, *rest = kind.split(" ")
    if rest[-1] not in _SYLLABLES and (page := _page(rest[-1], ord(canon[0]) & ~255)):
        return "".join(d.of(page) for _ in range(min(len(canon), 12) + attempt // 4))
    if kind == "given":
        pool = _GIVEN.get(rest[1], _GIVEN["LATIN"])[rest[0]].split(" ")
        # beyond the pool's size compounds keep names distinct
        return "-".join([d.of(pool)] + [d.of(pool) for _ in range(attempt // 4)])
    parts = _SYLLABLES.get(rest[0], _SYLLABLES["LATIN"]).split(" ")
    return "".join(d.of(parts) for _ in range(3 + attempt // 8))


def render(kind: str, original: str, canon: str, new: str) -> str:
    """``new`` in the format that ``original`` has."""
    if kind in ("phone", "ssn", "card"):
        digits = iter(_digits(original)[: len(_digits(original)) - len(canon)] + new)
        return "".join([next(digits) if c.isdigit() else c for c in original]) + "".join(digits)
    if kind == "iban":
        chars = iter(new)
        return "".join([c if c == " " else next(chars) for c in original]) + "".join(chars)
    if kind.startswith(("given", "surname")):
        return new.upper() if original.isupper() and len(original) > 1 else "-".join(x.capitalize() for x in new.split("-")) if original[0].isupper() else new
    if kind == "email" and original.isupper():
        return new.upper()
    return new


def rewrite(text: str, key: bytes, special: dict[tuple[str, str], str]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced, in order."""
    spans = detect(text)
    if not spans:
        return text, []
    out, at = [], 0
    for lo, hi, kind, canon in spans:
        out += [text[at:lo], render(kind, text[lo:hi], canon, special.get((kind, canon)) or surrogate(kind, canon, key))]
        at = hi
    return "".join([*out, text[at:]]), [s[2] for s in spans]


# -- DataFrame operators ---------------------------------------------------


def entities(docs: DataFrame) -> DataFrame:
    """The corpus's distinct ``kind, canon``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            seen = sorted({s[2:] for t in b.column(0).to_pylist() if t for s in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in (0, 1)], names=["kind", "canon"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, canon string").distinct()


def _drawn(key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(k, c, key, n) for k, c, n in rows], pa.string())], names=["kind", "canon", "attempt", "surr"])

    return run


def surrogates(docs: DataFrame, cfg: PiiConfig) -> DataFrame:
    """``kind, canon, attempt, surr``: the surrogate of each distinct entity,
    distinct within a kind and never an entity of the corpus itself."""
    schema = "kind string, canon string, attempt int, surr string"
    ents = materialize(entities(docs), "entities")
    table = materialize(ents.withColumn("attempt", F.lit(0)).mapInArrow(_drawn(cfg.key), schema), "surrogates")
    for _ in range(cfg.max_draws):
        held = table.groupBy("kind", "surr").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n"))
        shared = table.join(held.filter("n > 1"), ["kind", "surr"]).filter(F.struct("attempt", "canon") != F.col("first")).select("kind", "canon", "attempt")
        real = table.join(ents.withColumnRenamed("canon", "surr"), ["kind", "surr"], "left_semi").select("kind", "canon", "attempt")
        losers = materialize(shared.union(real).distinct(), "losers")
        if not losers.head(1):
            return table
        again = losers.withColumn("attempt", F.col("attempt") + 1).mapInArrow(_drawn(cfg.key), schema)
        new = materialize(table.join(losers, ["kind", "canon"], "left_anti").unionByName(again), "surrogates")
        discard(table)
        discard(losers)
        table = new
    raise RuntimeError(f"surrogates still collide after {cfg.max_draws} draws; the largest kind has too few of them")


def replace_pii(docs: DataFrame, cfg: PiiConfig, kinds: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; all columns and types are kept.
    With ``kinds`` a column of that name (underscores are appended where ``docs``
    has one) lists the replaced kinds, in order."""
    kinds = kinds and spare(kinds, docs.columns)
    redrawn = surrogates(docs, cfg).filter("attempt > 0").drop("attempt")
    if redrawn.limit(cfg.broadcast_rows + 1).count() <= cfg.broadcast_rows:
        special = {(r["kind"], r["canon"]): r["surr"] for r in redrawn.collect()}
        return _rewritten(docs, cfg, kinds, docs.sparkSession.sparkContext.broadcast(special), None)
    return _joined(docs, redrawn, cfg, kinds)


def _joined(docs: DataFrame, redrawn: DataFrame, cfg: PiiConfig, kinds: str | None) -> DataFrame:
    """The same with redrawn surrogates joined to documents by text digest."""
    at, digest, own = docs.columns.index("text"), spare("digest", docs.columns), spare("redrawn", docs.columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in b.column(at).to_pylist()], pa.binary())], names=[*b.schema.names, digest])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            rows = [(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")), *x) for t in b.column(0).to_pylist() if t for x in {s[2:] for s in detect(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], names=["digest", "kind", "canon"])

    of_text = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(find, "digest binary, kind string, canon string").distinct()
    lists = of_text.join(redrawn, ["kind", "canon"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "canon", "surr")).alias(own)).withColumnRenamed("digest", digest)
    keyed = docs.mapInArrow(add, StructType([*docs.schema.fields]).add(digest, BinaryType()))
    return _rewritten(keyed.join(lists, digest, "left").select(*(F.col(f"`{c}`") for c in docs.columns), own), cfg, kinds, None, own)


def _rewritten(docs: DataFrame, cfg: PiiConfig, kinds: str | None, shared, own: str | None) -> DataFrame:
    names = [c for c in docs.columns if c != own]
    at = names.index("text")
    schema = StructType([f for f in docs.schema.fields if f.name != own])
    if kinds:
        schema = StructType([*schema.fields]).add(kinds, ArrayType(StringType()))
    key = cfg.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts = b.column(at).to_pylist()
            lists = b.column(len(names)).to_pylist() if own else [None] * len(texts)
            done = [(None, None) if t is None else rewrite(t, key, shared.value if shared else {(x["kind"], x["canon"]): x["surr"] for x in own_list or ()}) for t, own_list in zip(texts, lists)]
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array([d[0] for d in done], cols[at].type)
            if kinds:
                cols.append(pa.array([d[1] for d in done], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
