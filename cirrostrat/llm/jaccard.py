"""N-gram Jaccard join with rare-first prefix filtering.

A text's set holds its distinct word n-grams (64-bit hashes; two n-grams of a
pair with one hash are beyond what can be expected of any number of pairs).
Texts with equal sets (128 bits of digest) are one class. n-grams are ordered
rarest first by a table of counts over all documents whose number of cells
grows with the text up to a bound (the order of n-grams that share a cell is by
hash, so any number of cells gives the same links). Two sets that are similar
enough share an n-gram of their prefixes, so classes are joined on prefix
n-grams, and pairs go through

- the length filter: the smaller set has the threshold's part of the larger;
- the positional filter: what can follow the shared n-gram in both is enough;
- the suffix filter: sets are cut into ``CELLS`` parts by hash, and the sum of
  the smaller parts bounds what both share. It cuts the whole sets, not what
  follows the shared n-gram, so that a class has one row of parts and not one
  for each n-gram of its prefix;

then each pair left is verified once, on the whole sets of the two texts.

For components a prefix n-gram that more than ``BIG`` classes share is not
joined with itself. Its classes are first verified against one of them, the one
with the fewest rarer n-grams; then only those outside the largest component
are joined to classes of other components. That leaves out no pair that could
connect anything, and a large group of copies costs a row for each member.

Defined cases: a text with fewer words than n has its whole sequence as one
n-gram; texts without words and nulls have empty sets and are linked with
nothing; null identifiers order above all others; repeated rows have equal
sets; very long texts are whole, one at a time; an empty table gives no rows.
Only identifier and text are read, and ``keep_one`` gives back all columns of
its rows as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components, filters, words

#: Cells of the table of counts: one for about CELL_BYTES of text, between 2**FEWEST_BITS and 2**MOST_BITS cells of 4 bytes.
CELL_BYTES, FEWEST_BITS, MOST_BITS = 512, 16, 23
#: The largest number a cell holds; counts stay there.
MOST_COUNTED = 2**32 - 1
BIG = 128
CELLS = 32
HIGHEST = 2**63 - 1


@dataclass(frozen=True)
class Similarity:
    """Words of an n-gram, and the threshold as a fraction: intersection * den >= union * num."""

    n: int = 5
    num: int = 4
    den: int = 5

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return np.where(size > 0, size - -(-size * self.num // self.den) + 1, 0)

    def overlap(self, a: Column, b: Column) -> Column:
        """The least intersection of sets of these sizes."""
        both = self.num + self.den
        return F.floor((self.num * (a + b) + (both - 1)) / F.lit(both))

    def lengths(self, a: Column, b: Column) -> Column:
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)


def shingles(column: pa.LargeStringArray, n: int, powers: words.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams (with repeats) and their documents."""
    cutted = words.cut(words.raw_bytes(column), words.BLANKS)
    h, count = cutted.hashes(powers), cutted.counts()
    doc = np.repeat(np.arange(len(count)), count)
    g = words.grams(h, n)
    own = cutted.room()[: len(g)] >= n
    parts, docs = [g[own]], [doc[: len(g)][own]]
    for k in range(1, n):  # whole texts of fewer words
        short = np.flatnonzero(count == k)
        if len(short):
            at = cutted.first[short]
            parts.append(np.array([words.grams(h[i : i + k], k)[0] for i in at.tolist()], np.uint64))
            docs.append(short)
    return np.concatenate(parts), np.concatenate(docs)


def _counted(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    powers, cells, some = words.Powers(), np.zeros(1 << bits, np.uint32), False
    for batch in batches:
        for _, column in words.slices(batch):
            g, _ = shingles(column, n, powers)
            at, times = np.unique(g & np.uint64((1 << bits) - 1), return_counts=True)
            at = at.astype(np.int64)
            cells[at] = np.minimum(cells[at].astype(np.int64) + times, MOST_COUNTED)
            some = True
    if some:
        yield filters.packed(cells)


def _added(total: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The sum, which stays at the largest number a cell can hold."""
    total += cells
    total[total < cells] = MOST_COUNTED
    return total


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            cells = filters.unpacked(x, np.uint32)
            total = cells.copy() if total is None else _added(total, cells)
    if total is not None:
        yield filters.packed(total)


def count_cells(docs: DataFrame) -> int:
    """Bits of the number of a cell, by the size of the texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(FEWEST_BITS, int(size // CELL_BYTES).bit_length()))


def counts(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """n-grams of all documents by the low bits of their hash. A task's table is a row; a few tasks add
    the rows up, and the driver adds theirs."""
    out = np.zeros(1 << bits, np.uint32)
    rows = docs.select("text").mapInArrow(lambda it: _counted(it, n, bits), "data binary")
    for r in rows.repartition(filters.MERGES).mapInArrow(_summed, "data binary").toLocalIterator():
        out = _added(out, filters.unpacked(bytes(r.data), np.uint32))
    return out


def _list(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, and where each list begins (and the end)."""
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _sets(batches: Iterator[pa.RecordBatch], how: Similarity, shared) -> Iterator[pa.RecordBatch]:
    powers = words.Powers()
    cells = shared.value
    low = np.uint64(len(cells) - 1)
    for batch in batches:
        for rows, column in words.slices(batch):
            g, doc = shingles(column, how.n, powers)
            many = cells[(g & low).astype(np.int64)]
            order = np.lexsort((g, many, doc))
            g, doc = g[order], doc[order]
            new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]) if len(g) else np.zeros(0, np.int64)
            g, doc = g[new], doc[new]
            n_docs = rows.num_rows
            size = np.bincount(doc, minlength=n_docs)
            edge = _edges(size)
            total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(g * np.uint64(m) + np.uint64(1))))) for m in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]
            d1, d2 = (pa.array((t[edge[1:]] - t[edge[:-1]]).view(np.int64)) for t in total)
            parts = np.bincount(doc * CELLS + (g >> np.uint64(64 - 5)).astype(np.int64), minlength=n_docs * CELLS).astype(np.int32)
            p = how.prefix(size)
            at = np.arange(len(g)) - edge[doc]
            head = g[at < p[doc]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "h", "h2")), pa.array(size), d1, d2, _list(head, _edges(p)), _list(parts, np.arange(n_docs + 1) * CELLS)],
                ["doc_id", "h", "h2", "n", "d1", "d2", "prefix", "parts"],
            )


def _entries(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Prefix n-grams that the filter doesn't rule out, with the row, the size of its set and the place in it."""
    for b in batches:
        values, edge = _flat(b.column("prefix"))
        at = np.flatnonzero(shared.value.may_hold(values)) if len(values) else np.zeros(0, np.int64)
        doc = np.searchsorted(edge, at, side="right") - 1
        arrays = [pa.array(values[at]), b.column("row").take(pa.array(doc)), b.column("n").take(pa.array(doc)).cast(pa.int32()), pa.array((at - edge[doc]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, ["token", "c", "n", "pos"])
    words.give_back()


def _arrays(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The whole set of each text, as sorted hashes."""
    powers = words.Powers()
    for batch in batches:
        for rows, column in words.slices(batch):
            g, doc = shingles(column, n, powers)
            order = np.lexsort((g, doc))
            g, doc = g[order], doc[order]
            new = np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])] if len(g) else np.zeros(0, bool)
            size = np.bincount(doc[new], minlength=rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("c"), _list(g[new].view(np.int64), _edges(size))], ["c", "hashes"])


#: Hashes of so many set members are compared at once; a larger pair goes alone.
COMPARED = 1 << 18


def _verified(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (x, at), (y, to) = (_flat(b.column(f"{side}_hashes")) for side in ("a", "b"))
        ends = at[1:] + to[1:]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + to[lo] + COMPARED, side="right")))
            n, m = np.diff(at[lo : hi + 1]), np.diff(to[lo : hi + 1])
            pair = np.concatenate((np.repeat(np.arange(hi - lo), n), np.repeat(np.arange(hi - lo), m)))
            both = np.concatenate((x[at[lo] : at[hi]], y[to[lo] : to[hi]]))
            order = np.lexsort((both, pair))
            both, pair = both[order], pair[order]
            same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])  # sets hold no member twice
            shared = np.bincount(pair[1:][same], minlength=hi - lo)
            union = n + m - shared
            good = np.flatnonzero(shared * how.den >= union * how.num)
            if len(good):
                rows = b.slice(lo, hi - lo).take(pa.array(good))
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(shared[good]), pa.array(union[good])], ["a", "b", "both", "either"])
            lo = hi
        words.give_back()


def row_hashes(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that tell rows apart by identifier and text."""
    ident, body = F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(ident, body), F.xxhash64(F.lit(1), body, ident)


class Join:
    """Sets, classes and links of some documents. A class goes by the number of its representative's row,
    which is given once, when the table of sets is written."""

    def __init__(self, docs: DataFrame, how: Similarity, *, doc_id: str = "doc_id", text: str = "text", count_bits: int | None = None, big: int = BIG) -> None:
        self.how, self.big = how, big
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        shared = common.Shared(self.spark, counts(self.docs, how.n, count_bits or count_cells(self.docs)))
        schema = "doc_id long, h long, h2 long, n long, d1 long, d2 long, prefix array<long>, parts array<int>"
        h, h2 = row_hashes()
        rows = self.docs.select("doc_id", h.alias("h"), h2.alias("h2"), "text").mapInArrow(lambda it: _sets(it, how, shared), schema)
        self.sets = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
        # A class goes by its document with the smallest identifier.
        ordered = F.coalesce("doc_id", F.lit(HIGHEST))
        classes = self.sets.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(ordered.alias("first"), "row")).alias("r"), F.count(F.lit(1)).alias("docs"))
        self.classes = common.stored(classes.select("d1", "d2", F.col("r.first").alias("first"), F.col("r.row").alias("c"), "docs"), "jaccard-classes")
        reps = self.classes.select(F.col("c").alias("row"))
        tokens = self.sets.where("n > 0").select("row", "prefix").join(reps, "row").select(F.explode("prefix").alias("token"))
        shared_tokens = common.stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "jaccard-tokens")
        # Only n-grams that several classes have (and a few more that the filter lets pass) leave their task.
        wanted = common.Shared(self.spark, filters.filter_of(shared_tokens, "token"))
        entries = self.sets.select("row", "n", "prefix").mapInArrow(lambda it: _entries(it, wanted), "token long, c long, n int, pos int")
        entries = entries.join(reps.select(F.col("row").alias("c")), "c", "left_semi").join(shared_tokens, "token")
        self.entries = common.stored(entries, "jaccard-prefixes")
        common.release(shared_tokens)

    def _may_match(self, b: str = "b_") -> Column:
        """Length and positional filter on columns n, pos and b_n, b_pos."""
        a, c = F.col("n").cast("long"), F.col(f"{b}n").cast("long")
        return self.how.lengths(a, c) & (F.least(a - F.col("pos"), c - F.col(f"{b}pos")) >= self.how.overlap(a, c))

    def _pairs(self, left: DataFrame, right: DataFrame, *extra: Column) -> DataFrame:
        names = [x for x in right.columns if x != "token"]
        joined = left.join(right.select("token", *(F.col(x).alias(f"b_{x}") for x in names)), "token")
        for x in (self._may_match(), *extra):
            joined = joined.where(x)
        return joined.select(F.least("c", "b_c").alias("a"), F.greatest("c", "b_c").alias("b")).where("a <> b").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of classes (a < b) that are similar enough, with their intersection and union."""
        how = self.how
        found = common.stored(pairs, "jaccard-pairs")
        # A class of a large group may be in very many pairs.
        some = common.stored(found.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").count(), "jaccard-degrees")
        crowded = filters.crowded_filter(some.where(F.col("count") > filters.HOT), "row")
        # Suffix filter, before any text is fetched.
        parts = self.sets.select("row", "n", "parts").join(some.select("row"), "row")
        pairs = found
        for side in ("a", "b"):
            pairs = filters.spread_join(pairs, parts.select(F.col("row").alias(side), F.col("n").alias(f"{side}_n"), F.col("parts").alias(f"{side}_parts")), (side,), ("a", "b"), crowded)
        most = F.aggregate(F.zip_with("a_parts", "b_parts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        candidates = common.stored(pairs.where(most >= how.overlap(F.col("a_n"), F.col("b_n"))).select("a", "b"), "jaccard-candidates")
        classes = candidates.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        wanted = common.stored(self.sets.select("row", "h", "h2").join(classes, "row"), "jaccard-wanted")
        may_hold = filters.may_hold(self.spark, filters.filter_of(wanted, "h"))
        h, h2 = row_hashes()
        texts = self.docs.select("text", h.alias("h"), h2.alias("h2")).where(may_hold("h")).join(wanted, ["h", "h2"])
        # Rows equal to the representative have its hashes, and its set.
        arrays = common.stored(texts.select(F.col("row").alias("c"), "text").dropDuplicates(["c"]).mapInArrow(lambda it: _arrays(it, how.n), "c long, hashes array<long>"), "jaccard-arrays")
        pairs = candidates
        for side in ("a", "b"):
            pairs = filters.spread_join(pairs, arrays.select(F.col("c").alias(side), F.col("hashes").alias(f"{side}_hashes")), (side,), ("a", "b"), crowded)
        links = common.stored(pairs.mapInArrow(lambda it: _verified(it, how), "a long, b long, both long, either long"), "jaccard-links")
        common.release(found, some, candidates, wanted, arrays)
        return links

    def links(self) -> DataFrame:
        """All links between classes: a, b, both, either. The number of rows is that of similar pairs of different sets."""
        return self.verified(self._pairs(self.entries, self.entries, F.col("c") < F.col("b_c")))

    def components(self) -> DataFrame:
        """c, root: every class that is linked to another, and one class for its component."""
        small = self.entries.where(F.col("size") <= self.big)
        large = self.entries.where(F.col("size") > self.big)
        pivots = large.groupBy("token").agg(F.min(F.struct("pos", "c", "n", "size")).alias("p")).select("token", "p.pos", "p.c", "p.n", "p.size")
        pairs = self._pairs(small, small, F.col("c") < F.col("b_c")).unionByName(self._pairs(large, pivots)).distinct()
        links = self.verified(pairs).select("a", "b")
        known = common.stored(components.connected(links), "jaccard-components")
        if large.limit(1).count():
            labelled = large.join(known.withColumnRenamed("v", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
            labelled = common.stored(labelled, "jaccard-large")
            sizes = labelled.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
            most = sizes.groupBy("token").agg(F.max(F.struct("k", "root")).alias("m")).select("token", F.col("m.root").alias("most"))
            outside = labelled.join(most, "token").where("root <> most").drop("most")
            other = (F.col("root") != F.col("b_root")) & ((F.col("b_root") == F.col("b_most")) | (F.col("c") < F.col("b_c")))
            rest = self._pairs(outside, labelled.join(most, "token"), other)
            more = self.verified(rest).select("a", "b")
            known = common.stored(components.connected(links.unionByName(more)), "jaccard-components")
        return known.select(F.col("v").alias("c"), "root")

    def groups(self) -> DataFrame:
        """One row a document: doc_id, h, h2, n_shingles, component_id, members (documents of its component) and first (whether it is the document that stays, or a row equal to it)."""
        found = self.components()
        named = self.classes.join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))
        best = named.groupBy("root").agg(F.min(F.struct("first", "c")).alias("f"), F.sum("docs").alias("members"))
        named = named.join(best, "root").select("d1", "d2", F.col("f.first").alias("component"), F.col("f.c").alias("stays"), "members")
        # A class may have very many documents: copies of one text.
        crowded = filters.crowded_filter(self.classes.where(F.col("docs") > filters.HOT), "d1")
        own = self.sets.select("doc_id", "row", "h", "h2", "n", "d1", "d2")
        out = filters.spread_join(own, named, ("d1", "d2"), ("row",), crowded, "left")
        alone = F.col("n") == 0
        component = F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("component") < HIGHEST, F.col("component")))
        return out.select("doc_id", "h", "h2", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(alone, 1).otherwise(F.col("members")).alias("members"), F.when(alone, True).otherwise(F.col("row") == F.col("stays")).alias("first"))


def keep_one(docs: DataFrame, how: Similarity | None = None, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest identifier. Repeated rows of one stay once.
    Only rows with company are joined; the others pass as they are read. Columns of any name pass unchanged."""
    own = Join(docs, how or Similarity(), doc_id=doc_id, text=text, **options)
    several = common.stored(own.groups().where("members > 1").groupBy("h", "h2").agg(F.max("first").alias("first")), "jaccard-groups")
    may_hold = filters.may_hold(docs.sparkSession, filters.filter_of(several, "h"))
    rows, own_names, back = common.renamed(docs, doc_id, text)
    h, h2 = row_hashes(*own_names)
    rows = rows.select("*", h.alias("h"), h2.alias("h2"))
    some = rows.where(may_hold("h")).join(several, ["h", "h2"], "left")
    stays = some.where("first").dropDuplicates(["h", "h2"]).unionByName(some.where("first is null"))
    return rows.where(~may_hold("h")).select(back).unionByName(stays.select(back))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return Join(docs, Similarity(3, 9, 10)).groups().select("doc_id", "n_shingles", "component_id")
