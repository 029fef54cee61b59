"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the words of ordinary texts, as
often as texts have them, and one on the words of toxic texts that are not about
as common in ordinary ones. A window of words is compressed with the ordinary
one alone and with the toxic one behind it; the bytes that the toxic dictionary
saves are the window's distance. The number of windows beyond a threshold, their
share and the largest distance give the score; the threshold and the weights are
calibrated on other labelled documents than those of the dictionaries.

Why not each dictionary alone, trained on texts as they are: what a window of
ordinary words costs then differs by chance between the two, by more than a
toxic word saves. Ranking falls from 0.93 to 0.64 or less on the smallest table
with enough labels (the README has all figures).

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z
lower-cased; windows follow each other over the whole text.

Training reads bounded samples: ``toxic`` and ``ordinary`` documents for the
dictionaries and ``calibration`` other documents, told apart by a hash of the
identifier. Only labels of rows passed as training labels are read.

Defined cases: null and empty texts have no window and the lowest score; rows
without identifier or label teach nothing; without toxic and ordinary documents
in both parts of the training labels all scores are 0; where labels are so few
that no word is more common in toxic texts, all words of toxic texts are taken,
and where zstandard can't train, the words themselves (both with a warning);
repeated rows are scored each; of contradicting labels the largest holds; equal
thresholds are settled for the smallest; very long texts are scored whole; an
empty table gives no rows; columns named score, windows and toxic_windows are
replaced, others of any name pass unchanged.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled, words

TOXIC, ORDINARY, CALIBRATION = 2000, 4000, 6000
WINDOW = 8
ORDINARY_BYTES = 32 << 10
#: A word of a toxic text is left out of training unless it is in so many times as many toxic texts as ordinary
#: ones, in this share of toxic texts and in 3 of them at least.
ODDS, SUPPORT = 8.0, 0.02
#: Of ten labelled documents, so many can go to the dictionaries; the others to calibration.
DICTIONARY_TENTHS = 7
#: Distances of a window from 1 to so many bytes are told apart.
STEPS = 8
#: predicted is 1 from this score on.
CUTOFF = 0.3


def _words(cutted: words.Words) -> tuple[bytes, np.ndarray]:
    """All words with one blank before, between and after, and where each begins (its blank)."""
    text, at = cutted.joined()
    return b" " + text, at


@dataclass
class Distance:
    """Compression with both dictionaries."""

    ordinary: bytes
    toxic: bytes
    window: int = WINDOW

    def compressors(self):
        parameters = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, hash_log=16, chain_log=16, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_DFAST)
        for content in (self.ordinary, self.ordinary + self.toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            yield zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary).compress

    def features(self, cutted: words.Words, plain, toxic) -> np.ndarray:
        """For each text: windows, windows saving 1 byte or more, ... STEPS bytes or more, largest saving."""
        text, at = _words(cutted)
        view = memoryview(text)
        n_docs = len(cutted.first) - 1
        counts = cutted.counts()
        n_windows = -(-counts // self.window)
        doc = np.repeat(np.arange(n_docs), n_windows)
        before = np.concatenate(([0], np.cumsum(n_windows)))
        lo = (np.arange(before[-1]) - before[doc]) * self.window + cutted.first[doc]
        hi = np.minimum(lo + self.window, cutted.first[doc + 1])
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in (view[a : b + 1] for a, b in zip(at[lo].tolist(), at[hi].tolist(), strict=True))], np.int64)
        out = np.zeros((n_docs, STEPS + 2))
        out[:, 0] = n_windows
        for k in range(1, STEPS + 1):
            out[:, k] = np.bincount(doc, saved >= k, n_docs)
        np.maximum.at(out[:, STEPS + 1], doc, saved)
        return out


#: What zstandard puts between a trained dictionary's tables and its content: its first three offsets.
_OFFSETS = struct.pack("<III", 1, 4, 8)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content that zstandard's training picks from the samples. Where it refuses (it wants some kilobytes of
    several samples) a warning says so, and the content is the samples themselves, each once: as few as that fit whole."""
    try:
        trained = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError as e:
        warnings.warn(f"a dictionary of {len(samples)} samples is not trained ({e}); it holds the samples", stacklevel=2)
        return b"".join(dict.fromkeys(samples))[-size:]
    return _content(trained)


def _content(trained: bytes) -> bytes:
    """What stands behind a trained dictionary's tables."""
    at = trained.find(_OFFSETS, 8)
    if at < 0:
        raise ValueError("a trained dictionary without the offsets that end its tables")
    return trained[at + len(_OFFSETS) :]


def _rounds(counts: dict[bytes, int], most: int) -> list[bytes]:
    """Words between blanks, in rounds of those that are left: training covers more words so than with a word's copies in a row."""
    names = sorted(counts, key=lambda w: (zlib.crc32(w), w))
    return [b" " + w + b" " for k in range(min(most, max(counts.values()))) for w in names if counts[w] > k]


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's words, joined by blanks."""
    for batch in batches:
        for rows, column in words.slices(batch):
            cutted = words.cut(words.raw_bytes(column), words.ALNUM)
            text, at = _words(cutted)
            edge = at[cutted.first].tolist()
            out = [text[a : b + 1] for a, b in pairwise(edge)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "words"])


def _one_for_copies(rows: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, list[bytes]]]:
    """Copies of a text speak once: those that share the four of their long words with the smallest checksums,
    or all words where there are fewer long ones."""
    met = set()
    for label, own in rows:
        some = sorted({zlib.crc32(w) for w in own if len(w) > 6})[:4]
        sign = (label, *(some if len(some) == 4 else own))
        if sign not in met:
            met.add(sign)
            yield label, own


def dictionaries(sample: DataFrame, window: int = WINDOW) -> Distance | None:
    """sample: doc_id, label (1: toxic) and text of a bounded number of documents."""
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "label", "text").mapInArrow(_normal, f"doc_id {kind}, label int, words binary").toLocalIterator()
    texts: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for label, own in _one_for_copies([(label, own) for _, label, own in sorted((r.doc_id, r.label, bytes(r.words).split()) for r in rows)]):
        texts[label].append(own)
    if not texts[0] or not texts[1]:
        return None
    seen = {label: Counter(w for own in group for w in set(own)) for label, group in texts.items()}
    n = {label: len(group) for label, group in texts.items()}
    least = min(max(3, SUPPORT * n[1]), n[1])
    marks = {w: k for w, k in seen[1].items() if k >= least and k / n[1] >= ODDS * (seen[0][w] + 0.5) / n[0]}
    if not marks and seen[1]:
        warnings.warn(f"no word is more common in {n[1]} toxic texts than in {n[0]} ordinary ones; all words are taken", stacklevel=2)
        marks = dict(seen[1])
    if not marks or not seen[0]:
        return None
    size = min(64 << 10, max(1024, 3 * sum(len(w) + 2 for w in marks)))
    return Distance(_dictionary(_rounds(seen[0], 20), ORDINARY_BYTES), _dictionary(_rounds(marks, 50), size), window)


@dataclass
class Model:
    distance: Distance
    threshold: int
    weights: np.ndarray

    def inputs(self, f: np.ndarray) -> np.ndarray:
        n = f[:, self.threshold]
        return np.c_[np.log1p(n), np.sqrt(n / np.maximum(f[:, 0], 1)), np.minimum(f[:, STEPS + 1], 12) / 12, np.log1p(f[:, 0])]

    def score(self, f: np.ndarray) -> np.ndarray:
        x = np.c_[self.inputs(f), np.ones(len(f))]
        return np.where(f[:, 0] > 0, 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), 0.0)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = TOXIC, ordinary: int = ORDINARY, calibration: int = CALIBRATION) -> Model | None:
    """A model of the labels given (rows to be held out are not to be among them)."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    for_dictionaries = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < DICTIONARY_TENTHS
    first = labelled.texts_of(docs, labelled.sample_ids(own.where(for_dictionaries), "label", {1: toxic, 0: ordinary}), doc_id=doc_id, text=text)
    distance = dictionaries(first)
    if distance is None:
        return None
    share = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    total = sum(share.values())
    ids = labelled.sample_ids(own.where(~for_dictionaries), "label", {1: calibration // 2, 0: calibration // 2}, salt=1)
    both = labelled.texts_of(docs, ids, doc_id=doc_id, text=text)
    shared = common.Shared(docs.sparkSession, distance)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, tox = shared.value.compressors()
        for b in batches:
            for rows, column in words.slices(b):
                f = shared.value.features(words.cut(words.raw_bytes(column), words.ALNUM), plain, tox)
                yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(f.tolist(), pa.list_(pa.float64()))], ["label", "f"])

    def collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out = rows.select("label", "text").mapInArrow(measured, "label int, f array<double>").toPandas()
        return out["label"].to_numpy(np.int64), np.array(out["f"].tolist()).reshape(-1, STEPS + 2)

    y, f = collected(both)
    if not (y == 1).any() or not (y == 0).any():
        return None
    threshold = max(range(1, STEPS + 1), key=lambda k: labelled.ranking(f[:, k] / np.maximum(f[:, 0], 1), y))
    model = Model(distance, threshold, np.zeros(5))
    weight = np.where(y == 1, share.get(1, 0) / total / max((y == 1).mean(), 1e-9), share.get(0, 0) / total / max((y == 0).mean(), 1e-9))
    model.weights = labelled.logistic(model.inputs(f), y, weight)
    return model


def score(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with score, windows and toxic_windows."""
    docs = docs.drop("score", "windows", "toxic_windows")
    shared = common.Shared(docs.sparkSession, model)
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        plain, tox = known.distance.compressors() if known else (None, None)
        for b in batches:
            for rows, column in words.slices(b, text):
                if known is None:
                    out = np.zeros((3, rows.num_rows))
                else:
                    f = known.distance.features(words.cut(words.raw_bytes(column), words.ALNUM), plain, tox)
                    out = known.score(f), f[:, 0], f[:, known.threshold]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out[0], pa.float64()), pa.array(out[1].astype(np.int64)), pa.array(out[2].astype(np.int64))], [*names, "score", "windows", "toxic_windows"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("windows", T.LongType()), T.StructField("toxic_windows", T.LongType())])
    return docs.mapInArrow(scored, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.in_fold("doc_id", 4, 2)
    model = train(docs, common.read_table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "windows", "toxic_windows")
