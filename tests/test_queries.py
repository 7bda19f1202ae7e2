import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.plans import registry

DB = duckdb.connect()


@pytest.fixture(scope="module")
def db(sf):
    for f in os.listdir(sf):
        DB.sql(f"create or replace view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return DB


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(v):
    """Values as both engines show them: rounded numbers, lists, texts."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_every_query_with_sql_gives_its_rows(spark, sf, db):
    queries = entry.queries()
    for name, sql in registry.ORACLES.items():
        df = queries[name](spark, sf)
        columns = sorted(df.columns)
        assert columns == sorted(db.sql(sql).columns), name
        got = Counter(tuple(str(plain(x)) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
        names = ", ".join(f'"{c}"' for c in columns)
        want = Counter(tuple(str(plain(x)) for x in r) for r in db.sql(f"SELECT {names} FROM ({sql.strip()})").fetchall())
        assert got == want, (name, list((got - want).items())[:2], list((want - got).items())[:2])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_the_others_run(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    assert df.columns
