"""Every registered query vs its oracle on hand-made edge tables."""

import duckdb
import pytest

from ledgerlake.plans import catalog
from tools.check_oracle import canon, close
from tests.edge_tables import RAW_TABLES, build

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def edge_dir(tmp_path_factory):
    return build(str(tmp_path_factory.mktemp("edge")))


@pytest.fixture(scope="module")
def con(edge_dir):
    c = duckdb.connect()
    for t in RAW_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{edge_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_query_matches_oracle(spark, con, edge_dir, name):
    df = QUERIES[name](spark, edge_dir)
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    oc, orr = canon([d[0] for d in res.description], res.fetchall())
    assert sc == oc
    assert len(sr) == len(orr), (sr, orr)
    assert sr == orr or close(sr, orr), [(a, b) for a, b in zip(sr, orr) if a != b][:3]
