"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text (shares of character classes, word lengths, repetition) are
put into bins. Boosting goes round the features: a shallow tree on a feature's
bins is fitted to the gradients left and added to that feature's lookup table.
Pairs of features that still explain most of what is left get tables over both
their bins in the same way. A score is the logistic of the sum of table
entries, looked up for whole batches.

Training reads a bounded sample of labelled documents (``SAMPLE`` of each
label). Features are counted over whole texts.

Defined cases: null texts count as empty; an empty text has all features 0;
rows without identifier or label teach nothing; without documents of both
labels the score is the share of label 1 (0.5 without labels); repeated rows
are scored each, and teach as often as the table of documents has them; of
contradicting labels the largest holds; equal gains of a tree go to its later cut
between groups and its first within one; very long texts are measured whole; an
empty table gives no rows. ``score`` replaces a column named score, ``keep_good``
gives back all columns of its rows as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled, words

#: Documents of each label that training reads at most.
SAMPLE = 12000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 200, 60, 6
RATE, RIDGE = 0.1, 4.0
#: Texts with a lower score are rejected.
CUTOFF = 0.3

#: Byte classes whose share of a text's bytes is a feature.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "line": b"\n\r",
    "blank": b" \t",
    "stop": b".,;:?",
    "shout": b"!",
    "odd": b"#$%&*@^~+=<>",
    "bar": b"|\\/_{}[]",
    "wide": bytes(range(128, 256)),
}
FEATURES = (*CLASSES, "log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "same_as_before", "distinct_pairs", "distinct_triples", "distinct_lines", "line_words")


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h for each document."""
    key = words.mix(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    return np.bincount(doc[at], minlength=n)


def features(raw: np.ndarray, offsets: np.ndarray, powers: words.Powers) -> np.ndarray:
    """[texts, features]. raw, offsets: the texts' bytes as Arrow has them."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets)
    table = np.full(256, len(CLASSES), np.uint8)
    for i, members in enumerate(CLASSES.values()):
        table[list(members)] = i
    kind = table[raw]
    doc_of_byte = np.repeat(np.arange(n), size)
    count = np.bincount(doc_of_byte * (len(CLASSES) + 1) + kind, minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
    out[:, : len(CLASSES)] = count[:, : len(CLASSES)] / np.maximum(size, 1)[:, None]

    cutted = words.cut((raw, offsets), words.BLANKS)
    h, m = cutted.hashes(powers), cutted.counts()
    doc = np.repeat(np.arange(n), m)
    length = (cutted.end - cutted.start).astype(float)
    some = np.maximum(m, 1)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / some - mean**2, 0))
    same = np.zeros(n)
    if len(h) > 1:
        equal = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:], equal, n)
    room = cutted.room()
    pairs = []
    for k in (2, 3):
        g = words.grams(h, k)
        own = room[: len(g)] >= k
        pairs.append(np.where(m >= k, _distinct(doc[: len(g)][own], g[own], n) / np.maximum(m - k + 1, 1), m > 0))
    # Lines: their hash from the words in them, so one more pass over the bytes is saved.
    lines = np.zeros(n)
    line_words = np.zeros(n)
    if len(h):
        breaks = np.concatenate(([0], np.cumsum(np.concatenate((kind == list(CLASSES).index("line"), np.zeros(n, bool))))))
        place = np.minimum(cutted.start - doc, len(raw))  # where a word begins in raw: a blank was put after each text
        line = breaks[place]
        edge = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
        total = np.add.reduceat(words.mix(h + (np.arange(len(h)) - np.repeat(edge, np.diff(np.r_[edge, len(h)]))).astype(np.uint64)), edge)
        n_lines = np.bincount(doc[edge], minlength=n)
        lines = _distinct(doc[edge], total, n) / np.maximum(n_lines, 1)
        line_words = m / np.maximum(n_lines, 1)
    rest = [np.log1p(size), np.log1p(m), mean, spread, _distinct(doc, h, n) / some, same / some, *pairs, lines, np.log1p(line_words)]
    out[:, len(CLASSES) :] = np.stack(rest, axis=1)
    return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, one for each bin, of a tree with up to three leaves on a histogram of gradients."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return 0.0, -1
        total, weight = g[lo:hi].sum(), h[lo:hi].sum()
        gain = a * a / (b + RIDGE) + (total - a) ** 2 / (weight - b + RIDGE) - total * total / (weight + RIDGE)
        at = int(gain.argmax())
        return float(gain[at]), lo + at + 1

    cuts = [0, len(g)]
    for _ in range(2):
        gain, at = max(best(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False))
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over two features' bins of a tree that cuts both features once: four leaves."""
    best, out = -1.0, np.zeros(g.shape)
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    at = lambda s, i, j: s[i - 1, j - 1]
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            gs = [at(a, i, j), at(a, i, m) - at(a, i, j), at(a, n, j) - at(a, i, j)]
            hs = [at(b, i, j), at(b, i, m) - at(b, i, j), at(b, n, j) - at(b, i, j)]
            gs.append(at(a, n, m) - sum(gs))
            hs.append(at(b, n, m) - sum(hs))
            gain = sum(x * x / (w + RIDGE) for x, w in zip(gs, hs, strict=True))
            if gain > best:
                best, leaves, cut = gain, [x / (w + RIDGE) for x, w in zip(gs, hs, strict=True)], (i, j)
    if best > 0:
        i, j = cut
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = leaves
    return out


def _gain2(g: np.ndarray, h: np.ndarray) -> float:
    """How much a free value in each cell of two features would explain."""
    return float((g * g / (h + RIDGE)).sum())


@dataclass
class Additive:
    """Lookup tables of features and of pairs of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (a, b), t in self.pairs.items():
                out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS, bins: int = BINS) -> Additive:
    """Cyclic boosting of the tables of all features, then of the best pairs."""
    p = min(max((weight * y).sum() / weight.sum(), 1e-6), 1 - 1e-6)
    model = Additive(float(np.log(p / (1 - p))))
    if p in (1e-6, 1 - 1e-6):
        return model
    model.edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(x), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-margin))
        return weight * (y - q), weight * q * (1 - q)

    for _ in range(rounds):
        for j, at in enumerate(fine):
            g, h = gradients()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(at, g, n), np.bincount(at, h, n))
            model.tables[j] += step
            margin += step[at]
    g, h = gradients()

    def histogram(a: int, b: int, values: np.ndarray) -> np.ndarray:
        n, m = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * m + coarse[b], values, n * m).reshape(n, m)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ab: -_gain2(histogram(*ab, g), histogram(*ab, h)))
    model.pairs = {ab: np.zeros((len(model.pair_edges[ab[0]]) + 1, len(model.pair_edges[ab[1]]) + 1)) for ab in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (a, b), t in model.pairs.items():
            g, h = gradients()
            step = RATE * _tree2(histogram(a, b, g), histogram(a, b, h))
            t += step
            margin += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Additive:
    """A model of the labels given (rows to be held out are not to be among them)."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    share = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    total = sum(share.values())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for b in batches:
            for rows, column in words.slices(b):
                f = features(*words.raw_bytes(column), powers)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(f.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "f"])

    ids = labelled.sample_ids(own, "label", {0: sample, 1: sample})
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    rows = labelled.texts_of(docs, ids, doc_id=doc_id, text=text).mapInArrow(measured, f"doc_id {kind}, label int, f array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy(np.float64)
    if not len(y):
        return Additive(0.0)
    x = np.array(rows["f"].tolist()).reshape(-1, len(FEATURES))
    each = {v: share.get(v, 0) / total * len(y) / max((y == v).sum(), 1) for v in (0, 1)}
    return fit(x, y, np.where(y == 1, each[1], each[0]))


def score(docs: DataFrame, model: Additive, *, text: str = "text") -> DataFrame:
    """docs with score."""
    docs = docs.drop("score")
    shared = common.Shared(docs.sparkSession, model)
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for b in batches:
            for rows, column in words.slices(b, text):
                out = shared.value.score(features(*words.raw_bytes(column), powers))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], [*names, "score"])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: Additive, *, cutoff: float = CUTOFF, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, as they were."""
    rows, (body,), back = common.renamed(docs, text)
    return score(rows, model, text=body).where(F.col("score") >= cutoff).select(back)


def model_of(spark, docs: DataFrame, sf_dir: str) -> Additive:
    """The model of the labels that are not held out."""
    labels = common.read_table(spark, sf_dir, "labels").where(~common.in_fold("doc_id", 5, 0))
    return train(docs, labels.select("doc_id", "quality"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, model_of(spark, docs, sf_dir))
    return out.select("doc_id", common.in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
