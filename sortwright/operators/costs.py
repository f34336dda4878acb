"""Cost models of merge sorts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bytes a second of the modelled memory, rows of a first run
PEAK, RUN_ROWS = 2039e9, 512


def runs(n: Column, rows: int = RUN_ROWS) -> Column:
    return F.ceil(n / float(rows))


def passes(n_runs: Column, fan_in: Column) -> Column:
    """Merge passes over so many runs. The logarithm is rounded first, so that
    exact powers don't take one pass more."""
    return F.greatest(F.lit(0), F.ceil(F.round(F.log(n_runs) / F.log(fan_in), 9))).cast("bigint")


def traffic(n_bytes: Column, n_passes: Column) -> Column:
    """Bytes read and written by the passes (a long, so that bytes in an int
    don't overflow)."""
    return n_passes * 2 * n_bytes


def milliseconds(n_bytes: Column, share: float, peak: float = PEAK) -> Column:
    return n_bytes / (peak * share) * 1e3


def merge_sort_ms(n: Column, record: Column, run_rows: int, fan_in: Column, run_gen_gbps: float, merge_gbps: float) -> Column:
    """Run generation reads the data once at its rate; each pass reads and
    writes it at the merge's. Bytes are a long, even if ``n`` and ``record`` are ints."""
    gb = n.cast("bigint") * record / 1e9
    return gb / (run_gen_gbps / 1e3) + traffic(gb, passes(runs(n, run_rows), fan_in)) / (merge_gbps / 1e3)


def human_size(n: Column) -> Column:
    """60000000 as ``60M``, 1500 as ``2K`` (halves to even), 999 as it is."""
    return F.when(n >= 1_000_000, F.concat(F.bround(n / 1e6).cast("bigint").cast("string"), F.lit("M"))).when(n >= 1_000, F.concat(F.bround(n / 1e3).cast("bigint").cast("string"), F.lit("K"))).otherwise(n.cast("bigint").cast("string"))
