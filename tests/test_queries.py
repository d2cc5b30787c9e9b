"""Every registered query outside the optional subpackage against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from cairn.plans import queries_history, queries_retrieval, queries_rules, queries_store, queries_tables, registry  # noqa: F401


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else int(v) if v == int(v) else round(float(v), 6)
    return int(v) if isinstance(v, (int, np.integer)) else str(v)


def table(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, sql, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    if name in registry.SQL:
        assert table(got) == table(sql.execute(registry.SQL[name]).df())
    else:
        assert got.columns.size > 0


def test_served_evidence_keeps_its_rules(spark, small):
    found = registry.QUERIES["k2_evidence"](spark, small).toPandas()
    served = found[found.outcome == "served"]
    assert len(served) and served.groupby("query_id").size().max() <= 4 and (served.coverage >= 0.35).all()
    assert not found.duplicated(["query_id", "chunk_id"]).any()
