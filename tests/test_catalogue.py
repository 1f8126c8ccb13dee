"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from evenkeel.plans import catalogue

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    made = entry.queries()[name](spark, SMALL)
    columns = sorted(made.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
    told = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall())


def test_every_operator_tag_is_of_a_query():
    assert set(catalogue.OPERATORS) == set(catalogue.queries())
    assert len(catalogue.oracle_sql()) >= 0.9 * len(catalogue.queries())


def test_token_distances_of_documents(spark):
    """DuckDB's levenshtein counts bytes, so that this one is held against plain Python."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["distance"], r["pct"]) for r in entry.queries()["token_edit_distance"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        a = (r["text"] or "").split()
        if len(a) > 150:
            continue
        b = [x.replace("the", "a") for i, x in enumerate(a, 1) if i % 7]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert got[r["doc_id"]] == (row[-1], round(100 * row[-1] / len(a), 6) if a else 0.0)
