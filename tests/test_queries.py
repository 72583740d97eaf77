"""Every registered query of the core library against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from modlens.plans import archives, catalogue  # noqa: F401 (archives registers its queries)

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    r = duck.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted((tuple(plain(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall()), key=repr)


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
