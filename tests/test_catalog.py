"""Every query of the catalogue against its SQL, on the smallest tables."""

import collections
import os

import pandas as pd
import pytest

from lectern.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events customer orders lineitem part supplier nation region".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def cell(v):
    if v is None or not isinstance(v, (list, tuple)) and pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v


def rows(pdf, columns):
    return collections.Counter(tuple(map(cell, r)) for r in pdf[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(catalog.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_no_python_rows_and_no_cartesian_products(spark):
    for name in ("c4_build_paragraphs", "c11_assign_chapters", "f4_keyword_topk", "h4_collapse_adjacent", "j5_check_quotes", "k1_page_accuracy"):
        plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
