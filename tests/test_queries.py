import math

import duckdb
import pytest

import __spark_entry__ as entry
from skein import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for n in TABLES:
        c.execute(f"create view {n} as select * from read_parquet('{sf}/{n}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)


def test_pairs_of_keys_wider_than_their_padding(spark, tmp_path):
    c = duckdb.connect()
    c.execute("create table part as select k::bigint as p_partkey, 'name ' || k as p_name, 'Brand#' || k as p_brand from (values (7), (999999), (1000000), (1234567), (100000), (-5), (null)) v(k)")
    c.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    got = [tuple(r) for r in catalogue.QUERIES["pkg_pairs"](spark, str(tmp_path)).select("document_id", "document_order", "variant", "text").collect()]
    want = c.execute(f"select document_id, document_order, variant, text from ({catalogue.ORACLES['pkg_pairs']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 14


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
