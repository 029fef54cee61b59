"""The driver's contract on the smallest tables, against DuckDB."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from cirrostrat.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    """Rows as (texts and whole numbers, other numbers), in order of the former."""
    out = []
    for r in df[sorted(df.columns)].to_dict("records"):
        values = [None if v is None or v != v else v for v in r.values()]
        real = [isinstance(v, float) and not float(v).is_integer() for v in values]
        whole = [None if x or v is None else v if isinstance(v, (str, bool)) else float(v) for v, x in zip(values, real, strict=True)]
        out.append((tuple(whole), tuple(v if x else None for v, x in zip(values, real, strict=True))))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = c.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for (x, u), (y, v) in zip(a, b, strict=True):
        assert x == y
        assert all((p is None and q is None) or p == pytest.approx(q, abs=2e-5, rel=1e-5) for p, q in zip(u, v, strict=True))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("library", ["zstandard", "regex", "tokenizers", "public_tokenizers"])
def test_queries_without_a_library(library):
    """The ensemble queries are there whatever the training-data operators lack."""
    code = f"import sys; sys.modules[{library!r}] = None\nimport warnings; warnings.simplefilter('ignore')\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(got.stdout.split()[0]) >= len(catalog.QUERIES)
