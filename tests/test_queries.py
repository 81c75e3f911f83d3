"""Every query with SQL gives the SQL's rows; the others give rows and a stable schema."""

import duckdb
import pytest

from vastgrain.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(want.columns) == columns
        picked = ", ".join(f'"{c}"' for c in columns)
        assert rows(got) == rows(duck.sql(f"select {picked} from ({ORACLE[name]}) q").fetchall())
    else:
        assert df.schema == QUERIES[name](spark, FOLDER).schema


def test_bitpack_widths_keeps_stored_order_of_ties(spark, tmp_path):
    """Spark reads the larger file first; the rows of the first one come first all the same."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    duckdb.sql(f"copy (select 1::bigint l_orderkey, 1 l_linenumber, 0::bigint l_partkey) to '{folder}/a.parquet'")
    duckdb.sql(f"copy (select * from (values (1::bigint, 1, 1000::bigint), (1, 2, 2000), (300, 1, 7), (300, 1, 9), (300, 2, 5)) v(l_orderkey, l_linenumber, l_partkey)) to '{folder}/b.parquet'")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{folder}/*.parquet'")
    got = QUERIES["bitpack_widths"](spark, str(tmp_path)).collect()
    assert rows(got) == rows(con.sql(ORACLE["bitpack_widths"]).fetchall()) == rows([(0, 11, 11), (2, 3, 3)])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
