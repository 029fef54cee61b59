"""Registered queries against their SQL, and the pipeline against what its stages promise."""

import os
import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from cirrostrat.llm import common, registry

from .helpers import DOCS, ODD

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(registry.ORACLE_SQL[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names

    def plain(v):
        return None if pd.isna(v) else v if isinstance(v, (str, bool)) else round(float(v), 9)

    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice(["ka", "to", "mi", "len"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, prose(rng.randrange(30, 200)), "en", "s", None) for i in range(200)]
    rows += [(200 + i, "SPAM!! " * 40, "en", "s", None) for i in range(60)]
    base = rows[3][1].split()
    rows += [(300, rows[5][1], None, None, None), (301, rows[5][1], None, None, None), (302, " ".join(base[:-1] + ["changed"]), None, None, None)]
    item = prose(20)
    rows += [(303, prose(20) + " " + item, None, None, None), (304, prose(900) + " " + item, None, None, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = common.read_table(spark, tables, "documents")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, tables), "test")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "pack" or docs.columns == columns
    quality, exact, near, clean, packed = ids
    assert quality == {*range(200), *range(300, 305)}
    assert quality - exact == {5, 300}
    assert exact - near == {302}
    assert near - clean == {303}
    assert packed == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()} == packed


def test_stages_on_nothing(spark, tables):
    docs = common.read_table(spark, tables, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, tables), "test")
    assert docs.count() == 0


def test_odd_rows_pass_the_stages(spark, tables):
    """Nulls, empty and very long texts and repeated rows, with a column whose name the operators use themselves."""
    docs = common.read_table(spark, tables, "documents").unionByName(spark.createDataFrame([(*r, None, None, None) for r in ODD], DOCS)).selectExpr("*", "doc_id * 2 as score", "text as original")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, before, tables), "test")
        assert after.columns == docs.columns
        assert after.where("not (score <=> doc_id * 2) or not (original <=> text)").count() == 0
        assert after.exceptAll(before).count() == 0, name
        before = after
    exact = common.stored(corpus_pipeline.exact_dedup_stage(spark, docs, tables), "test")
    assert exact.where("coalesce(text, '') = ''").count() == 1 and exact.where("text = 'same text'").count() == 1
    assert exact.where("text = 'same text'").first().doc_id == 5
    near = corpus_pipeline.near_dedup_stage(spark, exact, tables)
    assert near.where("doc_id in (7, 8) and length(text) > 100000").count() == 2  # very long texts have no company
    pieces = common.stored(corpus_pipeline.pack_stage(spark, exact, tables), "test")
    long = pieces.where("doc_id = 7 and doc_tokens > 60000")
    assert long.agg({"length": "sum"}).first()[0] == long.first().doc_tokens
