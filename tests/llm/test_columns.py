"""Columns of the user's that clash with names of the operators, and workers that can't import the package."""

import os
import subprocess
import sys

import pytest

from cirrostrat.llm import decontaminate, exact_dedup, jaccard, quality

from .helpers import docs

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"
CLASH = ["score", "spans", "items", "n_words", "n_hit", "keep_id", "kept", "group_size", "key", "best", "h", "h2", "__h", "__first", "__salt", "first", "row", "c0", "c1", "label", "doc", "raw", "id"]


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "p q r s t u v"), (None, None), (4, ITEM), (5, "")]
    return docs(spark, rows).selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in CLASH)).cache()


@pytest.mark.parametrize(
    ("operator", "ids"),
    [
        (lambda d, b: exact_dedup.deduplicate(d, keep="largest"), {2, 3, 4, 5}),
        (lambda d, b: exact_dedup.deduplicate(d), {1, 3, 4, None}),
        (lambda d, b: jaccard.keep_one(d, jaccard.Similarity(3, 4, 5)), {1, 3, 4, 5, None}),
        (lambda d, b: decontaminate.decontaminate(d, b), {1, 2, 3, 5, None}),
        (lambda d, b: decontaminate.decontaminate(d, b, remove="spans"), {1, 2, 3, 4, 5, None}),
        (lambda d, b: quality.keep_good(d, quality.Additive(0.0)), {1, 2, 3, 4, 5, None}),
    ],
)
def test_values_of_clashing_columns(spark, clash, operator, ids):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = operator(clash, benchmark)
    assert out.columns == clash.columns
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted(ids, key=repr)
    for r in rows:
        for c in CLASH:
            assert r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}")


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{shared}").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
known = __spark_entry__.queries()
for name in [n for n in known if n.startswith("op") or n == "pipeline"]:
    assert known[name](spark, {sf!r}).count(), name
print("whole")
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    if rest := os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and os.path.abspath(x) != REPO):
        env["PYTHONPATH"] = rest
    (tmp_path / "shared").mkdir()
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, shared=tmp_path / "shared", sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert got.stdout.strip().endswith("whole"), got.stderr[-2000:]
