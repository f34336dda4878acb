import math
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sortwright.plans import queries

SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 4)
    return int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = queries.queries()[name](spark, SF).toPandas()
    truth = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(truth.columns)
    rows = [sorted((tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr) for d in (ours, truth)]
    assert rows[0] == rows[1]
    assert math.isfinite(len(rows[0]))


@pytest.mark.parametrize("name", ["fan_in_tradeoff", "merge_sort_model"])
def test_bytes_of_many_rows_are_longs(spark, tmp_path, name):
    """36 million rows: their bytes don't fit into an int."""
    pq.write_table(pa.table({"l_orderkey": np.zeros(36_000_000, np.int8)}), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    ours = queries.queries()[name](spark, str(tmp_path)).orderBy("fan_in")
    truth = con.execute(queries.oracle_sql()[name]).df().sort_values("fan_in")
    assert [tuple(map(cell, r)) for r in ours.collect()] == [tuple(map(cell, r)) for r in truth[ours.columns].itertuples(index=False)]
