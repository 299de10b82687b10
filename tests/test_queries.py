"""Every relation query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tripleloom.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == cols
        assert norm(got) == norm(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    else:
        assert got
