"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All stages but the last return the columns of ``documents``;
``run`` writes each stage's rows to the shared folder before the next reads
them.

1. quality: documents that the additive classifier scores below its cutoff go;
   it learns from the labels that op2 doesn't hold out.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: one document of each component of links (word 5-grams, Jaccard
   similarity of 0.8 or more) stays, the one with the smallest doc_id.
4. decontaminate: documents with at least one in twenty words in benchmark
   windows of 13 words go.
5. pack: pieces of token ids, gapless in sequences of 1024.

Defined cases: an empty table passes through all stages and gives no pieces. A
null text counts as empty: the classifier scores it like any text (it is rejected
where that is below the cutoff), null and empty texts are copies of each other,
and one that stays has the end id alone. A null identifier is the smallest in
stage 2 and the largest in stage 3; of rows that are equal in all of that one
stays. Equal scores are treated alike, as the cutoff is a number. Very long texts
are scored, compared, scanned and packed whole. Columns beside identifier and
text pass through unchanged up to the last stage, whatever their names; that one
returns pieces. SQL can't express the classifier or the tokenizer, so there is no
SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm import common, decontaminate, exact_dedup, jaccard, packing, quality

NEAR = jaccard.Similarity(n=5, num=4, den=5)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.model_of(spark, docs, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs, keep="largest")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
