"""Language identification with interpolated Kneser-Ney character models.

Counts of character 4-grams are taken over all training documents, folded
within tasks and summed by Spark. From them the models of all languages are
made: one table of sorted hashes for each order with a log-probability (and for
contexts a back-off weight) for each language. A text goes to the language with
the lowest cross-entropy for a character; an entropy above what its language
had on texts that the tables don't know is a rejection. Those are a share of the
training texts, told by a hash of the text (so copies stay together), which is
left out of the counts and calibrates limits and scores. A language of few
documents keeps them all in its counts; its limit is that of all languages.

Letters are lower-cased, each run of other characters is one blank. The tables
hold every n-gram counted and grow with the input: they are files in the shared
folder, cut by context into parts that one task each makes, order by order, and
workers look them up through memory maps. Only a caller's own ``max_grams``
leaves rows out (those below the count that fits).

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without language teach nothing; without any training row all texts are
``und``; repeated rows count each; of languages with equal entropies the first
by name is predicted; very long texts are counted and scored whole, one at a
time; an empty table gives no rows; columns named lang_pred, score,
cross_entropy and rejected are replaced, others of any name pass unchanged.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words

ORDER = 4
#: Values (rows times languages) of a part of a table, about.
PART_VALUES = 1 << 22
DISCOUNT = 0.75
#: Training documents for calibration: about so many, and one in LEAST_SHARE at most.
CALIBRATION, LEAST_SHARE = 2000, 10
#: Languages of fewer documents keep them all in their counts; a limit of its own needs so many calibration texts.
FEW_DOCUMENTS, FEW_TEXTS = 200, 20
UNDETERMINED = "und"
_HELD = 1 << 21


def letter_table() -> np.ndarray:
    """For each code point of the basic plane its lower case, 0 if it is no letter."""
    out = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < 1 << 16 else c
    return out


def symbols(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, ORDER - 1 blanks before each and one after it at least, and where each text begins."""
    pad = " " * (ORDER - 1)
    code = np.frombuffer((pad + pad.join(t + " " for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + ORDER for t in texts], out=begin[1:])
    high = code >> 16 != 0
    if high.any():  # letters of other planes are folded to 16 bits
        some, where = np.unique(code[high], return_inverse=True)
        folded = np.array([1 + c % 65535 if chr(c).isalpha() else 0 for c in some.tolist()], np.uint16)
        out = letters[np.where(high, 0, code)]
        out[high] = folded[where]
    else:
        out = letters[code]
    return out, begin


def grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts, where each text's begin, and each text's letters."""
    code, begin = symbols(texts, letters)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    for i in range(ORDER - 1):
        keep[np.minimum(begin[:-1] + i, len(code) - 1)] = True  # the padding stays whole
    ends = np.searchsorted(np.flatnonzero(keep), begin) if len(texts) else begin
    code = code[keep].astype(np.uint64)
    packed = np.zeros(max(0, len(code) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        packed = (packed << np.uint64(16)) | code[i : len(code) - ORDER + 1 + i]
    # A text of n symbols after its padding has n grams; those that reach into the next text's padding go.
    n = np.diff(ends) - (ORDER - 1)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.maximum(n, 0), out=first[1:])
    at = np.arange(first[-1]) - np.repeat(first[:-1], np.maximum(n, 0)) + np.repeat(ends[:-1], np.maximum(n, 0))
    packed = packed[at]
    seen = np.concatenate(([0], np.cumsum((packed & np.uint64(0xFFFF)) != 0)))
    return packed, first, seen[first[1:]] - seen[first[:-1]]


def _count(batches: Iterator[pa.RecordBatch], letters: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["lang", "gram", "n"]
    held: dict[str, list] = {}

    def folded(parts: list) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        for rows, column in words.slices(batch):
            by: dict[str, list[str]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), column.to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                key, n = np.unique(grams(texts, letters)[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((key, n))
                if len(parts) > 16 or sum(len(k) for k, _ in parts) > _HELD:
                    held[lang] = parts = [folded(parts)]
                    if len(parts[0][0]) > _HELD:
                        key, n = held.pop(lang)[0]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], names)
    for lang, parts in held.items():
        key, n = folded(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], names)


class Table:
    """Values for each language by a packed gram, in order of its hash; missing ones are nan."""

    def __init__(self, gram: np.ndarray, lang: np.ndarray, value: np.ndarray, langs: int) -> None:
        hashed = words.mix(gram)
        self.keys, at = np.unique(hashed, return_inverse=True)
        self.values = np.full((len(self.keys), langs), np.nan, np.float32)
        self.values[at, lang] = value

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table, and whether the gram has one."""
        h = words.mix(gram)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == h

    def take(self, gram: np.ndarray) -> np.ndarray:
        """Values of the grams, [grams, languages]."""
        if not len(self.keys):
            return np.full((len(gram), self.values.shape[1]), np.nan, np.float32)
        at, here = self.find(gram)
        return np.where(here[:, None], self.values[at], np.float32(np.nan))


class Mapped(Table):
    """A table in a folder, through memory maps; files of other than local folders are copied to a local one first."""

    def __init__(self, path: str) -> None:
        self.keys, self.values = (self._open(f"{path}.{x}.npy") for x in ("keys", "values"))

    @staticmethod
    def _open(path: str) -> np.ndarray:
        from pyarrow import fs

        own, at = common.filesystem(path)
        if isinstance(own, fs.LocalFileSystem):
            return np.load(at, mmap_mode="r").view(np.ndarray)
        with tempfile.NamedTemporaryFile() as copy, own.open_input_stream(at) as f:
            while block := f.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.load(copy.name, mmap_mode="r").view(np.ndarray)  # the map outlives the name

    @staticmethod
    def write(table: Table, path: str) -> None:
        own, at = common.filesystem(path)
        own.create_dir(os.path.dirname(at))
        for x in ("keys", "values"):
            temporary = f"{at}.{uuid.uuid4().hex}"
            with own.open_output_stream(temporary) as f:
                np.save(f, getattr(table, x))
            own.move(temporary, f"{at}.{x}.npy")


class Parts:
    """A table cut by context. shift: bits of a gram below its context; some: numbers of the parts that have rows."""

    def __init__(self, path: str, parts: int, shift: int, some: list[int], langs: int) -> None:
        self.path, self.parts, self.shift, self.some, self.langs = path, parts, shift, frozenset(some), langs
        self.opened: dict[int, Mapped] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    def part(self, i: int) -> Mapped:
        if i not in self.opened:
            self.opened[i] = Mapped(f"{self.path}/{i}")
        return self.opened[i]

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(self.part(i).keys for i in sorted(self.some))])

    def take(self, gram: np.ndarray) -> np.ndarray:
        if self.parts == 1 and self.some:
            return self.part(0).take(gram)
        out = np.full((len(gram), self.langs), np.nan, np.float32)
        of = ((gram >> np.uint64(self.shift)) % np.uint64(self.parts)).astype(np.uint32)
        order = np.argsort(of, kind="stable")
        edge = np.flatnonzero(np.diff(of[order], prepend=-1))
        for lo, hi in zip(edge, np.append(edge[1:], len(order)), strict=True):
            i = int(of[order[lo]])
            if i in self.some:
                out[order[lo:hi]] = self.part(i).take(gram[order[lo:hi]])
        return out


_MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]


class Models:
    """Interpolated Kneser-Ney models of several languages. rows: (language number, packed 4-gram, count)."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, discount: float = DISCOUNT) -> None:
        self.langs, L = langs, len(langs)
        self.entropy_limit = np.full(L, np.inf)
        self.sharpness = 8.0
        levels = []  # highest order first: (lang, gram, count or number of kinds of what precedes it)
        at = np.lexsort((gram, lang))
        lang, gram, n = lang[at], gram[at], n[at]
        for k in range(ORDER, 0, -1):
            levels.append((k, lang, gram, n))
            low = gram & _MASK[k - 1]
            order = np.lexsort((low, lang))
            lang, low = lang[order], low[order]
            edge = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (lang[1:] != lang[:-1])])
            n = np.diff(np.r_[edge, len(low)])  # kinds of character before it
            lang, gram = lang[edge], low[edge]
        alphabet = len(np.unique(levels[-1][2]))
        self.floor = np.float32(1.0 / (alphabet + 1))  # one place for all characters never seen
        self.seen: dict[int, Table | Parts] = {}
        self.weight: dict[int, Table | Parts] = {}
        for k, lang, gram, n in reversed(levels):
            self.add(k, lang, gram, n, discount)

    def add(self, k: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, discount: float) -> None:
        """The tables of an order, which need those of the lower ones; all rows of a context must be there."""
        L = len(self.langs)
        context = gram >> np.uint64(16)
        order = np.lexsort((context, lang))
        edge = np.flatnonzero(np.r_[True, (context[order][1:] != context[order][:-1]) | (lang[order][1:] != lang[order][:-1])])
        total = np.add.reduceat(n[order], edge)
        kinds = np.diff(np.r_[edge, len(order)])
        own = np.empty(len(order), np.int64)
        own[order] = np.repeat(np.arange(len(edge)), kinds)
        back = discount * kinds / total
        self.weight[k] = Table(context[order][edge], lang[order][edge], back, L)
        lower = self.probability(gram, k - 1)[np.arange(len(gram)), lang]
        self.seen[k] = Table(gram, lang, (n - discount) / total[own] + back[own] * lower, L)
        if k == ORDER:  # rows of the highest order get their values for all languages, so most characters need one look
            top = self.seen[k]
            gram = np.unique(gram)
            full = self.probability(gram, k)
            where, _ = top.find(gram)
            top.values[where] = full

    def probability(self, gram: np.ndarray, k: int) -> np.ndarray:
        """p(last character | the k - 1 before it) for each language, [grams, languages]."""
        if k == 0:
            return np.full((len(gram), len(self.langs)), self.floor, np.float32)
        key = gram & _MASK[k]
        out = self.seen[k].take(key)
        todo = np.flatnonzero(np.isnan(out).any(axis=1))
        if len(todo):
            rest = key[todo]
            w = self.weight[k].take(rest >> np.uint64(16))
            other = np.where(np.isnan(w), np.float32(1), w) * self.probability(rest, k - 1)
            own = out[todo]
            out[todo] = np.where(np.isnan(own), other, own)
        return out

    def entropies(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats for a character, [texts, languages], and the letters of each text."""
        packed, first, n_letters = grams(texts, letters)
        out = np.zeros((len(texts), len(self.langs)))
        if len(packed):
            lost = -np.log(self.probability(packed, ORDER))
            total = np.concatenate((np.zeros((1, lost.shape[1])), np.cumsum(lost, axis=0, dtype=np.float64)))
            out = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
        return out, n_letters

    def predict(self, texts: list[str], letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (0 to 1), cross-entropy, and whether that is above the limit."""
        h, n_letters = self.entropies(texts, letters)
        z = -(h - h.min(axis=1, keepdims=True)) * self.sharpness
        p = np.exp(z)
        best = h.argmin(axis=1)
        rows = np.arange(len(texts))
        score = (p / p.sum(axis=1, keepdims=True))[rows, best]
        none = n_letters == 0
        return [UNDETERMINED if x else self.langs[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score), h[rows, best], none | (h[rows, best] > self.entropy_limit[best])


def stored_models(counts: DataFrame, langs: list[str], discount: float = DISCOUNT) -> Models:
    """Models of all rows of counts (lang, gram, n; at least one), with their tables in the shared folder."""
    spark = counts.sparkSession
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit(int(_MASK[k])))
        levels[k] = common.stored(levels[k + 1].groupBy("lang", low.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "language-grams")
    parts = 1 + counts.count() * len(langs) // PART_VALUES
    while any(parts % i == 0 for i in range(2, int(parts**0.5) + 1)):  # contexts spread best over a prime number
        parts += 1
    folder = common.new_folder(spark, "language-models")
    out = Models.__new__(Models)
    out.langs, out.seen, out.weight = langs, {}, {}
    out.entropy_limit, out.sharpness = np.full(len(langs), np.inf), 8.0
    out.floor = np.float32(1.0 / (levels[1].select("gram").distinct().count() + 1))
    for k in range(1, ORDER + 1):

        def made(key: tuple, rows: pa.Table) -> pa.Table:  # shipped before k goes on
            models = Models.__new__(Models)
            models.langs, models.floor, models.seen, models.weight = out.langs, out.floor, dict(out.seen), dict(out.weight)
            number = {x: i for i, x in enumerate(out.langs)}
            texts = rows.column("lang").combine_chunks().dictionary_encode()
            lang = np.array([number[x] for x in texts.dictionary.to_pylist()], np.int64)[texts.indices.to_numpy(zero_copy_only=False)]
            models.add(k, lang, rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy(), discount)
            Mapped.write(models.seen[k], f"{folder}/seen{k}/{key[0].as_py()}")
            Mapped.write(models.weight[k], f"{folder}/weight{k}/{key[0].as_py()}")
            words.give_back()
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64())})

        context = F.shiftrightunsigned("gram", 16)
        rows = levels[k].select("lang", "gram", "n", (context % F.lit(parts)).alias("part"))
        some = [r.part for r in rows.groupBy("part").applyInArrow(made, "part long").collect()]
        out.seen[k] = Parts(f"{folder}/seen{k}", parts, 16, some, len(langs))
        out.weight[k] = Parts(f"{folder}/weight{k}", parts, 0, some, len(langs))
    return out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_grams: int | None = None, calibration: int = CALIBRATION) -> Models | None:
    """Models of the languages in docs; None without any. max_grams: a caller's own bound on the (language, 4-gram) rows."""
    letters = letter_table()
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    documents = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    every = max(LEAST_SHARE, sum(documents.values()) // calibration)
    large = [x for x, n in documents.items() if n >= FEW_DOCUMENTS]
    aside = F.col("lang").isin(large) & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = rows.where(~aside).select("lang", "text").mapInArrow(lambda it: _count(it, letters), "lang string, gram long, n long")
    counts = common.stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    if max_grams is not None and counts.count() > max_grams:
        kinds, least = 0, None
        for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            kinds += r["count"]
            if kinds > max_grams:
                break
            least = r.n
        counts = counts.where(F.col("n") >= (least or r.n + 1))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    out = stored_models(counts, langs)
    shared = common.Shared(rows.sparkSession, (out, letters))

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, table = shared.value
        for b in batches:
            for part, column in words.slices(b):
                h, n = models.entropies(column.to_pylist(), table)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64())], ["lang", "h", "n"])

    if not large:  # nothing is unknown to the tables: calibration on what there is
        aside = F.pmod(F.xxhash64("text"), F.lit(every)) == 0
    some = rows.where(aside).select("lang", "text").mapInArrow(entropies, "lang string, h array<double>, n long").where("n > 0").toPandas()
    some = some[some["lang"].isin(langs)]
    if len(some):
        h = np.array(some["h"].tolist())
        true = some["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
        at = np.arange(len(h))

        def likelihood(sharpness: float) -> float:
            z = -h * sharpness
            return float((z[at, true] - np.logaddexp.reduce(z, axis=1)).mean())

        out.sharpness = max((2.0**i for i in range(-1, 8)), key=likelihood)
        limit = lambda own: np.quantile(own, 0.995) + own.std()
        for i in range(len(langs)):
            own = h[true == i, i]
            out.entropy_limit[i] = limit(own if len(own) >= FEW_TEXTS else h[at, true])
    return out


def identify(docs: DataFrame, models: Models | None, *, text: str = "text", reject: bool = False) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected. reject: rejected texts are ``und`` too."""
    shared = common.Shared(docs.sparkSession, (models, letter_table()))
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters = shared.value
        for b in batches:
            for rows, column in words.slices(b, text):
                texts = column.to_pylist()
                if known is None:
                    out = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
                else:
                    out = known.predict(texts, letters)
                lang = [UNDETERMINED if no else x for x, no in zip(out[0], out[3], strict=True)] if reject else out[0]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), *map(pa.array, out[1:])], [*names, "lang_pred", "score", "cross_entropy", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(scored, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    held_out = common.in_fold("doc_id", 4, 2)
    models = train(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "text"), models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


