"""Order-preserving encodings of typed columns as bytes, as Column expressions.

Concatenated encodings compare bytewise as the columns compare in order. All of
it stays in whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO62 = 4611686018427387904
MILE = 1_609_344  # fixed value: millimetres
SIGN = -9223372036854775808


# -- fields as hexadecimal digits: a key is put together of these and turned into bytes once


def digits(c: Column, width: int) -> Column:
    return F.lpad(F.hex(c.cast("bigint")), 2 * width, "0")


def date_digits(c: str, bias: bool = False) -> Column:
    """Days since 1970-01-01; with ``bias`` earlier dates order rightly too."""
    return digits(F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") + (2147483648 if bias else 0), 4)


def cents(c: str) -> Column:
    return F.rint(F.col(c) * 100).cast("bigint")  # halves to even; bround would go through decimals


def decimal_digits(c: str, flip: bool = True) -> Column:
    """Cents: with the sign bit flipped, or with 2^62 added."""
    return digits(cents(c).bitwiseXOR(F.lit(SIGN).cast("bigint")) if flip else cents(c) + F.lit(TWO62), 8)


def timestamp_digits(c: str) -> Column:
    """Microseconds since 1970-01-01 plus 2^62."""
    return digits(F.unix_micros(F.col(c).cast("timestamp")) + F.lit(TWO62), 8)


# -- single fields as bytes


def unsigned(c: str | Column, width: int) -> Column:
    """Big-endian bytes of a value that is at least 0."""
    return F.unhex(digits(F.col(c) if isinstance(c, str) else c, width))


def date(c: str, bias: bool = False) -> Column:
    return F.unhex(date_digits(c, bias))


def decimal(c: str, flip: bool = True) -> Column:
    return F.unhex(decimal_digits(c, flip))


def clamped_digits(c: Column, width: int) -> Column:
    """A number held between 0 and the most that fits; null counts as 0."""
    return digits(F.greatest(F.lit(0), F.least(F.lit(256**width - 1), F.coalesce(c.cast("bigint"), F.lit(0)))), width)


def flag_digits(c: Column, yes: str) -> Column:
    return digits(F.when(c == yes, 1).otherwise(0), 1)


def clamped(c: Column, width: int) -> Column:
    return F.unhex(clamped_digits(c, width))


def flag(c: Column, yes: str) -> Column:
    return F.unhex(flag_digits(c, yes))


@dataclass(frozen=True)
class KeySpec:
    """Named fields ``(column, bytes, digits)`` of a key; their expressions are made
    when the key is, so a layout can be read without a session."""

    fields: tuple[tuple[str, int, Callable[[], Column]], ...]

    @property
    def width(self) -> int:
        return sum(n for _, n, _ in self.fields)

    def key(self) -> Column:
        return F.unhex(F.concat(*(e() for _, _, e in self.fields)))


def _number(name: str, width: int) -> tuple[str, int, Callable[[], Column]]:
    return name, width, lambda: digits(F.col(name), width)


def lineitem_spec() -> KeySpec:
    return KeySpec((
        ("l_returnflag", 1, lambda: F.hex("l_returnflag")), ("l_linestatus", 1, lambda: F.hex("l_linestatus")), ("l_shipdate", 4, lambda: date_digits("l_shipdate")),
        *((c, 8, lambda c=c: decimal_digits(c)) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity")),
        _number("l_orderkey", 8), _number("l_partkey", 4), _number("l_suppkey", 4), _number("l_linenumber", 4),
    ))


def events_spec() -> KeySpec:
    return KeySpec((_number("user_id", 8), ("ts", 8, lambda: timestamp_digits("ts")), _number("event_id", 8)))


def taxi_spec() -> KeySpec:
    """The 66 bytes of a trip record; null numbers count as 0. Amounts are cents and
    distances (in miles) millimetres, plus 2^62."""

    def scaled(c: str, by: int) -> Column:
        return digits(F.rint(F.coalesce(F.col(c), F.lit(0.0)) * by).cast("bigint") + F.lit(TWO62), 8)

    small = (("vendor_id", 1), ("payment_type", 1), ("pickup_location", 2), ("dropoff_location", 2), ("passenger_count", 1), ("ratecode_id", 1))
    return KeySpec((
        *((c, n, lambda c=c, n=n: clamped_digits(F.col(c), n)) for c, n in small),
        ("pickup", 8, lambda: timestamp_digits("pickup")), ("dropoff", 8, lambda: timestamp_digits("dropoff")),
        *((c, 8, lambda c=c, by=by: scaled(c, by)) for c, by in (("fare", 100), ("tip", 100), ("total", 100), ("distance", MILE), ("tolls", 100))),
        ("store_and_forward", 1, lambda: flag_digits(F.col("store_and_forward"), "Y")), ("pad", 1, lambda: F.lit("00")),
    ))


# fixed values: key bytes, payload bytes
PRESETS = {"gensort": (10, 90), "tpch88": (88, 32), "tpch66": (66, 54), "taxi66": (66, 54)}


def chunk(key: Column, offset: int, length: int) -> Column:
    return F.substring(key, offset + 1, length)


def compare(a: Column, b: Column, start: int = 0) -> Column:
    """-1, 0 or 1: the order of two keys' bytes from ``start`` on."""
    a, b = (F.substring(x, start + 1, 1 << 20) for x in (a, b))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def prefix_number(key: Column, offset: int = 0) -> Column:
    """Eight bytes as an unsigned number (decimal, since it may pass 2^63)."""
    return F.conv(F.hex(chunk(key, offset, 8)), 16, 10).cast("decimal(20,0)")


def short_key(high: Column, low: Column) -> Column:
    """The 10-byte key of an unsigned 64-bit number and a 16-bit one."""
    return F.concat(F.unhex(F.lpad(F.conv(high.cast("string"), 10, 16), 16, "0")), unsigned(low, 2))


def zeroed(key: Column, width: int, n: int) -> Column:
    """The key with its first ``n`` bytes set to 0."""
    return F.concat(F.unhex(F.lit("00" * n)), F.substring(key, n + 1, width))


def compact(key: Column, positions: Sequence[int]) -> Column:
    """The bytes at ``positions`` in source order, padded with 0 to 8 bytes."""
    parts = [F.substring(key, p + 1, 1) for p in sorted(positions)]
    return F.concat(*parts, F.unhex(F.lit("00" * (-len(parts) % 8))))
