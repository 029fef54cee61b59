"""Benchmark decontamination: a broadcast hash set of normalised benchmark
n-grams, scanned over the token windows of every text.

A window is ``n`` consecutive words of an item; an item with fewer words, but
not none, is one window. Texts are cut, hashed and looked up with numpy in one
narrow pass (no shuffle); each hit is verified by its words. Words inside any
occurrence of a window are hit.

What is broadcast has a checked size: a benchmark of more than ``block_bytes``
of text is taken in several blocks of items, one pass of the documents each. A
block is sorted hash arrays, offsets into one text and numbers of items, about
six times its text.

Defined cases: null or wordless texts have no hit; null item texts have no
window; null item ids count as one item named ''; repeated rows are judged
each by itself; an empty benchmark hits nothing; very long texts are scanned
whole, one at a time. ``scan`` reports: its columns replace ones of the same
name. ``decontaminate`` gives back all columns of its rows as they were (but the
text it cuts spans from), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words

NGRAM = 13
#: Text of a block: its windows, one for a word, take about 60 MB, and 150 MB if all words had one letter.
BLOCK_BYTES = 8 << 20
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


@dataclass
class Windows:
    """Windows of one length: sorted hashes, where the words of each are in the text, and its items."""

    hashes: np.ndarray
    at: np.ndarray
    size: np.ndarray
    edge: np.ndarray  # of each window, where its items begin in items; and the end
    items: np.ndarray


class WindowSet:
    """Windows of a block of items. Takes about 28 bytes for each window and item that has it, besides the words."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        cutted = words.cut([t.encode() for _, t in items], words.ALNUM)
        names = sorted({name for name, _ in items})
        number = np.searchsorted(np.array(names, object), np.array([name for name, _ in items], object)) if items else np.zeros(0, np.int64)
        self.names = names
        self.text, at = cutted.joined()
        h, room, count = cutted.hashes(words.Powers()), cutted.room(), cutted.counts()
        item = np.repeat(number, count)
        self.by_length: dict[int, Windows] = {}
        for k in np.unique(np.minimum(count, n)).tolist():
            if k:
                first = np.flatnonzero(room >= n) if k == n else cutted.first[:-1][count == k]
                self.by_length[k] = self._windows(words.grams(h, k)[first], at[first], at[first + k] - 1 - at[first], item[first])

    def _windows(self, g: np.ndarray, at: np.ndarray, size: np.ndarray, item: np.ndarray) -> Windows:
        order = np.lexsort((item, g))
        g, at, size, item = g[order], at[order], size[order], item[order]
        new = np.r_[True, g[1:] != g[:-1]]
        # Windows with one hash and different words are entries of their own.
        run = np.flatnonzero(new)
        mixed = [(a, b) for a, b in zip(run.tolist(), [*run[1:].tolist(), len(g)], strict=True) if b - a > 1 and len({self._words(at[i], size[i]) for i in range(a, b)}) > 1]
        for a, b in mixed:
            own = sorted(range(a, b), key=lambda i: (self._words(at[i], size[i]), item[i]))
            at[a:b], size[a:b], item[a:b] = at[own], size[own], item[own]
            new[a + 1 : b] = [self._words(at[i], size[i]) != self._words(at[i - 1], size[i - 1]) for i in range(a + 1, b)]
        once = new | np.r_[True, item[1:] != item[:-1]]  # an item with a window twice counts once
        first = np.flatnonzero(new)
        edge = np.r_[np.cumsum(once)[first] - 1, once.sum()]
        return Windows(g[first], at[first], size[first].astype(np.int32), edge.astype(np.int32), item[once].astype(np.int32))

    def _words(self, at: int, size: int) -> bytes:
        return self.text[at : at + size]

    def scan(self, texts: words.Words, powers: words.Powers) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, words, numbers of items) of each verified occurrence."""
        h, room = texts.hashes(powers), texts.room()
        for k, known in self.by_length.items():
            g = words.grams(h, k)
            at = np.searchsorted(known.hashes, g)
            at[at == len(known.hashes)] = 0
            for w in np.flatnonzero((known.hashes[at] == g) & (room[: len(g)] >= k)).tolist():
                own, e = texts.text(w, k), int(at[w])
                while e < len(known.hashes) and known.hashes[e] == g[w]:
                    if self._words(int(known.at[e]), int(known.size[e])) == own:
                        yield w, k, set(known.items[known.edge[e] : known.edge[e + 1]].tolist())
                        break
                    e += 1


def _scan(batches: Iterator[pa.RecordBatch], windows: WindowSet, text: str) -> Iterator[pa.RecordBatch]:
    """Adds what this block hits to the columns spans and items."""
    powers = words.Powers()
    for batch in batches:
        for rows, column in words.slices(batch, text):
            cutted = words.cut(words.raw_bytes(column), words.ALNUM)
            mark = np.zeros(len(cutted.start) + 1, np.int64)
            named: dict[int, set[int]] = {}
            for w, k, items in windows.scan(cutted, powers):
                mark[w] += 1
                mark[w + k] -= 1
                named.setdefault(int(np.searchsorted(cutted.first, w, side="right")) - 1, set()).update(items)
            hit = np.concatenate(([0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]))
            before = rows.column("spans").to_pylist()
            old = rows.column("items").to_pylist()
            out_items, out_spans, n_hit = [], [], []
            for i, (lo, hi) in enumerate(pairwise(cutted.first.tolist())):
                if i in named or before[i]:
                    own = hit[lo : hi + 2].copy()
                    own[0] = own[-1] = 0
                    for a, b in before[i] or ():
                        own[a + 1 : b + 1] = 1
                    edge = np.flatnonzero(np.diff(own)).reshape(-1, 2)
                    out_spans.append(edge.tolist())
                    n_hit.append(int(own.sum()))
                else:
                    out_spans.append([])
                    n_hit.append(0)
                out_items.append(sorted({*(old[i] or ()), *(windows.names[x] for x in named.get(i, ()))}))
            made = {
                "n_words": pa.array(cutted.counts(), pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array(out_items, pa.list_(pa.string())),
                "spans": pa.array(out_spans, pa.list_(pa.list_(pa.int64()))),
            }
            yield pa.RecordBatch.from_arrays([made.get(c, rows.column(c)) for c in rows.schema.names], rows.schema.names)


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = NGRAM, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs with n_words, n_hit, items (names of the items with occurring
    windows, sorted) and spans ([first word, word after the last] of each run of hit words)."""
    items = _items(benchmark, item_id, item_text)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs.drop(*REPORT.names)
    out = out.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in REPORT))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        windows = common.Shared(docs.sparkSession, WindowSet([(r.name, r.text) for r in block.toLocalIterator()], n))
        if b:
            out = common.stored(out, "decontaminate")  # so that one task holds one block at a time
        schema = out.schema
        out = out.mapInArrow(lambda it, w=windows: _scan(it, w.value, text), schema)
    return out


def contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def _without(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for t, spans in zip(words.utf8(batch.column(text)).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                cutted = words.cut([t.encode()], words.ALNUM)
                raw, at, kept = t.encode(), 0, []
                for a, b in spans:
                    kept.append(raw[at : cutted.start[a]])
                    at = cutted.end[b - 1]
                t = b"".join([*kept, raw[at:]]).decode()
            made.append(t)
        i = batch.schema.get_field_index(text)
        yield batch.set_column(i, batch.schema.field(i).name, pa.array(made, batch.schema.field(i).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", share: int = SHARE, text: str = "text", **options) -> DataFrame:
    """docs without what the benchmark holds: remove 'documents' that are contaminated, or the hit 'spans'."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    rows, (body,), back = common.renamed(docs, text)
    found = scan(rows, benchmark, text=body, **options)
    if remove == "documents":
        return found.where(~contaminated(share)).select(back)
    return found.mapInArrow(lambda it: _without(it, body), found.schema).select(back)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, common.read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i
        FROM (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw USING (k, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
