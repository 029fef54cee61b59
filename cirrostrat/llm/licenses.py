"""License scan by diagonal voting.

All rolling word k-gram hashes of every text are joined in Spark to the
positions of the same k-grams in license templates (a fixed small table, so the
join moves no text). A hit votes for its diagonal (word position less template
position: where the template would start). Votes are counted by document,
template and diagonal; diagonals at most ``slack`` apart are merged, which
bridges words put in or left out; a merged span is accepted if enough of the
template's k-grams voted for it and it is not stretched. The join compares the
words of each vote, not only their hashes.

Texts go to the join in chunks of ``CHUNK`` words, so that a row stays small
however long the text is; positions count from the text's first word.

A base phrase counts where all its k-grams vote for one diagonal: its words
stand there consecutively. Templates have labels of their own and any length.

Defined cases: a null text is empty; repeated rows are judged each by itself;
an empty table gives no rows; only the identifier and text columns are read, so
other columns of any name don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words


@dataclass(frozen=True)
class Template:
    """Words and the label of what they show. base: a phrase that counts where its words stand consecutively."""

    text: str
    label: str
    base: bool = False

    def words(self) -> list[str]:
        return re.findall(r"[0-9a-z]+", self.text.lower())


#: The base phrases and their labels.
PHRASES = (
    Template("gnu general public license", "gpl", base=True),
    Template("apache license", "apache", base=True),
    Template("cc by", "cc-by", base=True),
    Template("mit license", "mit", base=True),
)

TEMPLATES = (
    Template("licensed under the Apache License, Version 2.0", "apache-2.0"),
    Template("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    Template("licensed under the GNU General Public License, version 2", "gpl-2.0"),
    Template("licensed under the GNU Lesser General Public License", "lgpl"),
    Template("licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    Template("licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    Template("licensed under the Mozilla Public License, v. 2.0", "mpl-2.0"),
    Template("released under the MIT License", "mit-notice"),
    Template("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    Template("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    Template("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    Template(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, "
        "fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, "
        "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "mit-whole",
    ),
    Template(
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
        "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
        "isc-whole",
    ),
)

K = 2
SLACK = 2
SHARE = 0.8
#: An accepted span has at most so many times the template's words.
STRETCH = 1.5
#: Words of a text that go to the join in a row.
CHUNK = 1 << 14


def _hash(gram: bytes, k: int) -> int:
    return int(words.grams(words.cut([gram], words.ALNUM).hashes(words.Powers()), k)[0].astype(np.int64))


def positions(templates: Sequence[Template], k: int = K) -> list[tuple]:
    """(hash, words, template number, position, k-grams of the template, words, label, base) for every k-gram."""
    out = []
    for number, t in enumerate(templates):
        w = t.words()
        n = len(w) - k + 1
        if n < 1:
            raise ValueError(f"a template has {k} words at least: {t.text}")
        for at in range(n):
            gram = " ".join(w[at : at + k])
            out.append((_hash(gram.encode(), k), gram, number, at, n, len(w), t.label, t.base))
    return out


def _rolled(batches: Iterator[pa.RecordBatch], k: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The hashes of all k-grams, in chunks: the first one of a text begins with a null, so that every text has an entry."""
    powers = words.Powers()
    for batch in batches:
        for rows, column in words.slices(batch):
            cutted = words.cut(words.raw_bytes(column), words.ALNUM)
            g, count = words.grams(cutted.hashes(powers), k), cutted.counts()
            grams = np.maximum(count - k + 1, 0)
            parts = np.maximum(-(-grams // chunk), 1)
            doc = np.repeat(np.arange(len(count)), parts)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            n = np.minimum(grams[doc] - nth * chunk, chunk)
            lo = cutted.first[doc] + nth * chunk
            ranges = lambda size: np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            edges = lambda size: pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            size = n + (nth == 0)
            begin = np.cumsum(size) - size
            hashes, null = np.zeros(size.sum(), np.int64), np.zeros(size.sum(), bool)
            null[begin[nth == 0]] = True
            hashes[~null] = g[ranges(n)].view(np.int64)
            data = cutted.data[cutted.data != 32]
            at = np.concatenate(([0], np.cumsum(cutted.end - cutted.start))).astype(np.int32)
            every = pa.Array.from_buffers(pa.string(), len(cutted.start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
            own = np.where(n > 0, n + k - 1, 0)
            row = pa.array(doc)
            arrays = [rows.column("row").take(row), rows.column("doc_id").take(row), pa.array(count[doc]), pa.array(nth * chunk - (nth == 0)), pa.ListArray.from_arrays(edges(size), pa.array(hashes, mask=null)), pa.ListArray.from_arrays(edges(own), every.take(pa.array(ranges(own))))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_words", "base_pos", "hashes", "words"])


def spans(docs: DataFrame, templates: Sequence[Template] = PHRASES + TEMPLATES, *, k: int = K, slack: int = SLACK, share: float = SHARE, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). Documents: doc_id, n_words, and row, a number of the row. Spans, accepted:
    row, label, base, first_word, last_word (where the span's template starts, at least and at most), coverage."""
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"row long, doc_id {dict(own.dtypes)['doc_id']}, n_words long, base_pos long, hashes array<long>, words array<string>"
    rolled = own.mapInArrow(lambda it: _rolled(it, k, chunk), schema)
    every = rolled.select("row", "doc_id", "n_words", "base_pos", "words", F.posexplode("hashes").alias("nth", "hash"))
    positions_df = spark.createDataFrame(positions(templates, k), "hash long, gram string, template int, at int, grams int, size int, label string, base boolean")
    # A null hash meets nothing: the entry that keeps a text without votes. In the first chunk it moves the others by one.
    joined = every.join(F.broadcast(positions_df), "hash", "left").where(F.col("hash").isNull() | F.col("gram").isNotNull())
    place = F.col("nth") + F.when(F.col("base_pos") < 0, 0).otherwise(1)
    same = F.array_join(F.slice("words", place, F.lit(k)), " ") == F.col("gram")
    known = joined.where(F.col("hash").isNull() | same).select("row", F.when(F.col("hash").isNull(), F.col("doc_id")).alias("doc_id"), "n_words", F.col("hash").isNull().alias("mark"), (F.col("base_pos") + F.col("nth") - F.col("at")).cast("long").alias("diagonal"), "template", "at", "grams", "size", "label", "base")
    known = common.stored(known, "license-votes")
    votes = known.where("not mark")
    names = ("row", "template", "grams", "size", "label", "base")
    exact = votes.where("base").groupBy(*names, "diagonal").agg(F.count(F.lit(1)).alias("n")).where("n = grams")
    exact = exact.select("row", "label", "base", F.col("diagonal").alias("first_word"), F.col("diagonal").alias("last_word"), F.lit(1.0).alias("coverage"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True))
    runs = votes.where("not base").withColumns({"apart": apart.cast("int"), "n": F.count(F.lit(1)).over(Window.partitionBy("row", "template", "diagonal"))})
    runs = runs.withColumn("run", F.sum("apart").over(along))  # votes of one diagonal are peers: they get one number
    merged = runs.groupBy(*names, "run").agg(F.count_distinct("at").alias("together"), F.max("n").alias("alone"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"))
    stretched = F.col("last_word") - F.col("first_word") > (STRETCH - 1) * F.col("size")
    coverage = F.when(stretched, F.col("alone")).otherwise(F.col("together")) / F.col("grams")
    merged = merged.select("row", "label", "base", "first_word", "last_word", coverage.alias("coverage")).where(F.col("coverage") >= share)
    return known.where("mark").select("row", "doc_id", "n_words"), exact.unionByName(merged)


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows, found = spans(docs, **options)
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by = found.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("last_word"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    return rows.join(by, "row", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    rows = ", ".join(f"('{gram}', {number}, {at}, {n}, {size}, '{label}', {str(base).lower()})" for _, gram, number, at, n, size, label, base in positions(PHRASES + TEMPLATES))
    return rf"""
WITH t(gram, template, tpos, grams, size, label, base) AS (VALUES {rows}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM d)),
votes AS (SELECT doc_id, template, grams, size, label, base, pos - tpos AS diagonal, tpos FROM g JOIN t USING (gram)),
diag AS (SELECT doc_id, template, grams, size, label, base, diagonal, count(*) AS n FROM votes GROUP BY ALL),
lagged AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {SLACK}, true) AS apart FROM diag WHERE NOT base),
runs AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM lagged),
merged AS (SELECT doc_id, template, run, any_value(grams) AS grams, any_value(size) AS size, any_value(label) AS label, any_value(base) AS base, count(DISTINCT tpos) AS together, max(n) AS alone, min(diagonal) AS lo, max(diagonal) AS hi
  FROM runs JOIN (SELECT doc_id, template, diagonal, tpos FROM votes) USING (doc_id, template, diagonal) GROUP BY doc_id, template, run),
found AS (
  SELECT doc_id, label, base, diagonal AS lo, diagonal AS hi, CAST(1 AS DOUBLE) AS coverage FROM diag WHERE base AND n = grams
  UNION ALL
  SELECT * FROM (SELECT doc_id, label, base, lo, hi, CAST(CASE WHEN hi - lo > {STRETCH - 1}::DOUBLE * size THEN alone ELSE together END AS DOUBLE) / grams AS coverage FROM merged) WHERE coverage >= {SHARE}::DOUBLE),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(lo) FILTER (WHERE base) AS first_word, max(hi) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN by_doc USING (doc_id)
"""


ORACLE_SQL = _oracle()
