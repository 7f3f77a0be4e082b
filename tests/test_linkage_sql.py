"""Every query with an SQL counterpart gives the same rows on the smallest tables."""

import duckdb
import pytest

from kinfold.plans import linkage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return list(frame.columns), sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(linkage.oracle_sql()))
def test_same_rows(spark, duck, sf_small, name):
    got = linkage.queries()[name](spark, sf_small).toPandas()
    spark.catalog.clearCache()
    assert rows(got) == rows(duck.execute(linkage.oracle_sql()[name]).df())


def test_flagship(spark, sf_small):
    assert linkage.flagship(spark, sf_small).columns == ["s1_id", "cand_id", "nkeys"]
