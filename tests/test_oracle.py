"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from larkspur.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return f"{type(x).__name__}:{x}"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([cell(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "no rows"
    if name in catalog.ORACLE_SQL:
        result = oracle.execute(catalog.ORACLE_SQL[name])
        want = rows([c[0] for c in result.description], result.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        different = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
        assert not different, different[:2]
