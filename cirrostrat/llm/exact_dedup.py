"""Exact deduplication by a log-structured merge index of text digests.

Each task collects digests of its rows in a memtable, which folds repeated
digests together and is flushed as a sorted run (so a hot text leaves a task
once a flush, not once a row). Runs are Parquet files; each has a filter of its
digests, made when it is first asked. Compaction merges runs to two of level 1,
sorted and dealt by digest, with the extreme identifier and the number of rows
for each digest: the digests that one row has, and those that several have.

A lookup asks the runs' filters first; only digests that one may hold are joined
with that run. Where all rows of a table are in the index, each has its digest
there, so the filter of the run of several rows is the one that tells: rows that
it rules out are the only ones of their text. The rest are verified by their
bytes against the row that stays; a digest shared by different texts is
resolved by grouping on the texts themselves. ``unseen`` looks up the rows of
another table, and verifies its hits by their bytes too.

Defined cases: null texts count as empty; null identifiers order below all
others; of repeated rows with the extreme identifier one stays; an empty table
gives no rows; very long texts are hashed and compared whole. ``exact_groups``
reports: its columns replace ones of the same name. ``deduplicate`` gives back
all columns of its rows as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, filters

#: Entries of a memtable: 24 bytes each, and as much again while it is sorted.
MEMTABLE = 1 << 20
#: Bits of the SHA-256 that make the digest key; fewer only in tests of collisions.
KEY_BITS = 64
LOWEST = -(2**63)


def _text(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def digest(text, bits: int = KEY_BITS):
    """The first bits of the SHA-256 of a text as a signed long."""
    key = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, -10).cast("long")
    return key if bits == 64 else F.shiftright(key, 64 - bits)


def _flushed(batches: Iterator[pa.RecordBatch], keep: str, capacity: int) -> Iterator[pa.RecordBatch]:
    table: list[np.ndarray] = []

    def flush() -> list[np.ndarray]:
        key, best, rows = np.concatenate(table, axis=1)
        order = np.lexsort((best, key))
        key, best, rows = key[order], best[order], rows[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[first[1:], len(key)] - 1
        return [np.stack((key[first], best[last if keep == "largest" else first], np.add.reduceat(rows, first)))]

    def run(at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in at], ["key", "best", "n"])

    held = 0
    for b in batches:
        if b.num_rows:
            key = b.column("key").to_numpy(zero_copy_only=False)
            table.append(np.stack((key, b.column("id").to_numpy(zero_copy_only=False), np.ones(len(key), np.int64))))
            held += len(key)
        if held >= capacity:
            table = flush()  # folds repeated digests; only what doesn't fold away fills a run
            held = table[0].shape[1]
            if 2 * held >= capacity:
                yield run(table[0])
                table, held = [], 0
    if table:
        yield run(flush()[0])


ENTRIES = "key long, best long, n long"


class Run:
    """A sorted run in a folder, and the filter of its digests."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path
        self._filter: filters.KeyFilter | None = None

    def entries(self) -> DataFrame:
        """key, best identifier, rows. A run that got no rows has no files."""
        return self.spark.read.schema(ENTRIES).parquet(self.path)

    def filter(self, most_bits: int = filters.MOST_BITS) -> filters.KeyFilter:
        if self._filter is None or self._filter.bits > most_bits:
            self._filter = filters.filter_of(self.entries(), "key", most_bits=most_bits)
        return self._filter


class DigestIndex:
    """A log-structured merge index of a folder: level 0 has runs as flushed, level 1 what compaction made of them."""

    def __init__(self, spark, path: str, *, keep: str = "smallest", bits: int = KEY_BITS, memtable: int = MEMTABLE) -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError("keep: smallest or largest")
        self.spark, self.path, self.keep, self.bits, self.memtable = spark, path, keep, bits, memtable
        self.written = 0
        self.runs: list[Run] = []
        self.level1: dict[str, Run] = {}

    def _folder(self, level: int) -> str:
        self.written += 1
        return f"{self.path}/level{level}-{self.written}"

    def _best(self):
        return F.max("best") if self.keep == "largest" else F.min("best")

    def insert(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> None:
        """Flushes the digests of docs as level-0 runs."""
        keep, memtable = self.keep, self.memtable
        pairs = docs.select(digest(_text(text), self.bits).alias("key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("id"))
        run = Run(self.spark, self._folder(0))
        pairs.mapInArrow(lambda it: _flushed(it, keep, memtable), ENTRIES).write.option("compression", "zstd").parquet(run.path)
        self.runs.append(run)

    def compact(self) -> None:
        """Merges all runs to a new level 1, in one pass."""
        old = [r.path for r in [*self.runs, *self.level1.values()]]
        merged = self.spark.read.schema(ENTRIES).parquet(*old).groupBy("key").agg(self._best().alias("best"), F.sum("n").alias("n"))
        top = self._folder(1)
        split = merged.withColumn("rows", F.when(F.col("n") > 1, "several").otherwise("one")).sortWithinPartitions("rows", "key")
        split.write.option("compression", "zstd").partitionBy("rows").parquet(top)
        self.level1 = {}
        for name in ("one", "several"):
            run = Run(self.spark, f"{top}/rows={name}")
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run.path)
            files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            files.mkdirs(at)  # there may be no such digest
            self.level1[name] = run
        for x in {x.partition("/rows=")[0] for x in old}:
            common.delete_folder(self.spark, x)
        self.runs = []

    def entries(self) -> DataFrame:
        """key, best identifier, rows; compacted."""
        return self.of_one().entries().unionByName(self.of_several().entries())

    def of_one(self) -> Run:
        """The compacted run of digests that one row has."""
        if self.runs or not self.level1:
            self.compact()
        return self.level1["one"]

    def of_several(self) -> Run:
        """The compacted run of digests that several rows have."""
        if self.runs or not self.level1:
            self.compact()
        return self.level1["several"]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key, best identifier and rows of the keys (a column of longs) that are in the index, compacted or not. Each
        run's filter is asked before its entries are joined."""
        found = None
        for run in [*self.runs, *self.level1.values()]:
            some = keys.select("key").where(filters.may_hold(self.spark, run.filter())("key"))
            part = run.entries().join(some, "key", "left_semi")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], ENTRIES)
        return found.groupBy("key").agg(self._best().alias("best"), F.sum("n").alias("n"))


def unseen(docs: DataFrame, index: DigestIndex, earlier: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text no row of earlier has, as they were. index: of earlier, compacted or not. Hits are
    verified by their bytes; texts of earlier rows are read only where the index says that a digest meets."""
    spark = docs.sparkSession
    rows, (_, body), back = common.renamed(docs, doc_id, text)
    rows = rows.withColumn("key", digest(_text(body), index.bits))
    hits = common.stored(index.lookup(rows).select("key"), "dedup-lookup")
    may_hold = filters.may_hold(spark, filters.filter_of(hits, "key"))
    texts = earlier.select(digest(_text(text), index.bits).alias("key"), _text(text).alias("body")).where(may_hold("key")).distinct()
    known = rows.where(may_hold("key")).join(texts, (rows["key"] == texts["key"]) & (_text(body) == texts["body"]), "left_anti")
    return rows.where(~may_hold("key")).select(back).unionByName(known.select(back))


def exact_groups(docs: DataFrame, *, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text", bits: int = KEY_BITS, memtable: int = MEMTABLE, filter_bits: int = filters.MOST_BITS) -> DataFrame:
    """All columns of docs with keep_id (identifier of the row that stays), group_size and kept."""
    spark = docs.sparkSession
    docs = docs.drop("keep_id", "group_size", "kept")
    index = DigestIndex(spark, common.new_folder(spark, "digests"), keep=keep, bits=bits, memtable=memtable)
    index.insert(docs, doc_id=doc_id, text=text)
    run = index.of_several()
    several = run.entries()
    may_hold = filters.may_hold(spark, run.filter(filter_bits))

    # Columns of docs travel in a struct, so that no name of theirs meets a name of ours.
    others = F.struct(F.lit(0), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text))
    ident = F.col(doc_id).cast("long")
    rows = docs.select(others.alias("doc"), F.col(text).alias("raw"), ident.alias("id"), digest(_text(text), bits).alias("key"))
    body = F.coalesce(F.col("raw"), F.lit(""))

    def out(df: DataFrame, best, n, kept) -> DataFrame:
        own = [(F.col("raw") if c == text else F.col(f"doc.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
        return df.select(*own, F.when(best != LOWEST, best).alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"))

    ordered = F.coalesce("id", F.lit(LOWEST))
    one = out(rows.where(~may_hold("key")), ordered, F.lit(1), F.lit(True))
    # Verification needs the texts; those of rows that may have company only.
    some = common.stored(rows.where(may_hold("key")).select("*", ordered.alias("ordered"), F.monotonically_increasing_id().alias("row")), "dedup-hits")
    stays = some.join(several.withColumnRenamed("best", "ordered"), ["key", "ordered"])
    first = stays.groupBy("key").agg(F.min("row").alias("row"))
    originals = stays.select("key", "row", "n", F.col("ordered").alias("best"), body.alias("original")).join(first, ["key", "row"]).withColumnRenamed("row", "first")
    crowded = filters.crowded_filter(several.where(F.col("n") > filters.HOT), "key", most_bits=filter_bits)
    hits = filters.spread_join(some, originals, ("key",), ("row",), crowded, "left")
    hits = hits.withColumn("same", body == F.coalesce("original", body)).drop("original")
    mixed = common.stored(hits.where(~F.col("same")).select("key").distinct(), "dedup-collisions")
    found = lambda df: out(df, F.coalesce("best", "ordered"), F.coalesce("n", F.lit(1)), F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    if mixed.isEmpty():
        return one.unionByName(found(hits))
    # Different texts under one digest: grouped by the texts.
    rest = some.join(mixed, "key", "left_semi").withColumn("body", body)
    extreme = F.max("ordered") if keep == "largest" else F.min("ordered")
    best = rest.groupBy("key", "body").agg(extreme.alias("best"), F.count(F.lit(1)).alias("n"))
    rest = rest.join(best, ["key", "body"])
    first = rest.where(F.col("ordered") == F.col("best")).groupBy("key", "body").agg(F.min("row").alias("first"))
    return one.unionByName(found(hits.join(mixed, "key", "left_anti"))).unionByName(found(rest.join(first, ["key", "body"])))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, as they were."""
    rows, (ident, body), back = common.renamed(docs, doc_id, text)
    return exact_groups(rows, doc_id=ident, text=body, **options).where("kept").select(back)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_groups(docs, keep="largest")
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.sha2(_text("text").cast("binary"), 256).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
