"""Token ids as wavelet matrices, one compressed file for a shard.

Documents are dealt to shards by ranges of their identifier, encoded, and a
shard's ids are written as a wavelet matrix (or several, where a shard has more
text than a file is to hold): one bit-plane for each bit of the
ids' codes, most significant first, each plane ordered by the bits above it. The 256
most frequent ids have a matrix of 8 planes and the others one of their own; a
first plane tells which matrix a token is in. A plane is kept in compressed blocks with the number of ones before each block,
so access to a token, counting one in a range and finding its occurrences
decompress a block or two for each plane. Codes number the ids that the shard
has, which keeps planes few.

A file is written under a temporary name and renamed when it is whole; its
bytes are the same on every attempt. The manifest, renamed into place last,
lists the files; readers take only what it lists.

Layout: magic, length of the header (8 bytes, little-endian), header (JSON),
then the sections at the offsets the header gives, each compressed alone.

Defined cases: a null text is empty and has the end id only; a null identifier
orders below all others; rows with equal identifiers follow each other by text;
very long texts are encoded whole and have a file of their own; an empty table
gives a manifest without files. Only identifier and text are read, so other
columns of any name don't matter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, sharding, tokens, words

MAGIC = b"WVLTMTX1"
#: Bits of a block of a plane.
BLOCK = 1 << 16
#: Text of a large file; a task holds about 8 times as much.
SHARD_BYTES = 48 << 20
END = 0
#: Ids in the matrix of the most frequent ones.
FREQUENT = 256

MANIFEST = "file string, shard int, part int, docs long, tokens long, bytes long"


def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _planes(code: np.ndarray, kinds: int, pack) -> tuple[dict, list[bytes]]:
    """A wavelet matrix of codes below kinds: its part of the header and its compressed blocks."""
    n = len(code)
    zeros, blocks, ones, sections = [], [], [], []
    for level in reversed(range(max(1, int(kinds - 1).bit_length()) if n else 0)):
        bit = (code & code.dtype.type(1 << level)) != 0
        one = np.flatnonzero(bit)
        plane = np.packbits(bit, bitorder="little").tobytes()
        own = [pack(plane[i : i + BLOCK // 8]) for i in range(0, len(plane), BLOCK // 8)]
        blocks.append([len(x) for x in own])
        sections += own
        ones.append(np.searchsorted(one, np.arange(0, n, BLOCK)).tolist())
        zeros.append(n - len(one))
        if level:
            code = np.concatenate((code[np.flatnonzero(~bit)], code[one]))
    return {"n": n, "zeros": zeros, "blocks": blocks, "ones": ones}, sections


def encode(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file of a shard. starts: where each document's ids begin, and the end."""
    pack = _codec()[0].compress
    n = len(ids)
    often = np.bincount(ids) if n else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(often)
    alphabet = alphabet[np.lexsort((alphabet, -often[alphabet]))]
    code = np.zeros(len(often), np.uint16 if len(alphabet) < 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    code = code[ids]
    rare = code >= FREQUENT
    parts = [_planes(rare.astype(np.uint8), 2, pack), _planes(code[np.flatnonzero(~rare)].astype(np.uint8), FREQUENT, pack), _planes(code[np.flatnonzero(rare)] - code.dtype.type(FREQUENT), len(alphabet) - FREQUENT, pack)]
    lists = [pack(alphabet.astype("<u4").tobytes()), pack(doc_ids.astype("<i8").tobytes()), pack(np.diff(starts).astype("<u4").tobytes())]
    head = json.dumps({"tokens": n, "docs": len(doc_ids), "sizes": [len(x) for x in lists], "matrices": [h for h, _ in parts]}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(lists) + b"".join(x for _, own in parts for x in own)


class Matrix:
    """One wavelet matrix in a file: access, counting and occurrence lookup of codes."""

    def __init__(self, stream, head: dict, at: int) -> None:
        self.stream, self.n, self.zeros = stream, head["n"], head["zeros"]
        self.unpack = _codec()[1].decompress
        self.ones = [np.array(x, np.int64) for x in head["ones"]]
        self.at: list[np.ndarray] = []
        for own in head["blocks"]:
            self.at.append(at + np.concatenate(([0], np.cumsum(own, dtype=np.int64))))
            at = int(self.at[-1][-1])
        self.end = at
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, block: int) -> np.ndarray:
        """The bits of a block; a few of them are held."""
        if (level, block) not in self._held:
            if len(self._held) > 64:
                self._held.clear()
            lo, hi = self.at[level][block : block + 2]
            self.stream.seek(int(lo))
            self._held[level, block] = np.unpackbits(np.frombuffer(self.unpack(self.stream.read(int(hi - lo))), np.uint8), count=min(BLOCK, self.n - block * BLOCK), bitorder="little")
        return self._held[level, block]

    def rank(self, level: int, bit: int, i: int) -> int:
        """Such bits among the first i of a plane."""
        if i >= self.n:
            one, i = self.n - self.zeros[level], self.n
        else:
            one = int(self.ones[level][i // BLOCK]) + int(self._block(level, i // BLOCK)[: i % BLOCK].sum())
        return one if bit else i - one

    def select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) such bit of a plane is."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK - self.ones[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[k - before[block]])

    def _down(self, level: int, bit: int, i: int) -> int:
        return self.rank(level, bit, i) + (self.zeros[level] if bit else 0)

    def access(self, i: int) -> int:
        code = 0
        for level in range(len(self.zeros)):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            i = self._down(level, bit, i)
            code = code << 1 | bit
        return code

    def _bits(self, code: int) -> list[int]:
        return [code >> s & 1 for s in reversed(range(len(self.zeros)))]

    def range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the code's occurrences in [lo, hi) are below the last plane."""
        for level, bit in enumerate(self._bits(code)):
            lo, hi = self._down(level, bit, lo), self._down(level, bit, hi)
        return lo, hi

    def locate(self, code: int, k: int) -> int:
        """Where the k-th (from 0) occurrence is; -1 if there are fewer."""
        lo, hi = self.range(code, 0, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level, bit in reversed([*enumerate(self._bits(code))]):
            i = self.select(level, bit, i - (self.zeros[level] if bit else 0))
        return i

    def decode(self, kind: type) -> np.ndarray:
        """All codes."""
        code = np.zeros(self.n, kind)
        for level in reversed(range(len(self.zeros))):
            edges = self.at[level]
            self.stream.seek(int(edges[0]))
            data = self.stream.read(int(edges[-1] - edges[0]))
            edges = (edges - edges[0]).tolist()
            plane = b"".join([self.unpack(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little")
            last = level == len(self.zeros) - 1
            if last:  # below it all codes are 0
                code = bit.astype(kind, copy=False)
                continue
            bit = bit.view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = code[: self.zeros[level]]
            out[np.flatnonzero(bit)] = code[self.zeros[level] :] | kind(1 << (len(self.zeros) - 1 - level))
            code = out
        return code


class TokenFile:
    """A shard's file: token access, counting and occurrence lookup. stream: seekable.

    The most frequent ids have a matrix of fewer planes of their own; a plane tells which of the two
    matrices a token is in."""

    def __init__(self, stream) -> None:
        stream.seek(0)
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(stream.read(8), "little")
        head = json.loads(stream.read(size))
        at, unpack, parts = len(MAGIC) + 8 + size, _codec()[1].decompress, []
        for s in head["sizes"]:
            stream.seek(at)
            parts.append(unpack(stream.read(s)))
            at += s
        self.n = head["tokens"]
        self.alphabet = np.frombuffer(parts[0], "<u4").astype(np.uint32)
        self.code = {int(t): c for c, t in enumerate(self.alphabet.tolist())}
        self.doc_ids = np.frombuffer(parts[1], "<i8")
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(parts[2], "<u4"), dtype=np.int64)))
        matrices = []
        for h in head["matrices"]:
            matrices.append(Matrix(stream, h, at))
            at = matrices[-1].end
        self.which, self.parts = matrices[0], matrices[1:]

    def access(self, i: int) -> int:
        """The i-th token."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rare = self.which.access(i)
        return int(self.alphabet[self.parts[rare].access(self.which.rank(0, rare, i)) + FREQUENT * rare])

    def _part(self, token: int) -> tuple[int, int] | None:
        """Which matrix a token is in, and its code there."""
        code = self.code.get(token)
        return None if code is None else (int(code >= FREQUENT), code % FREQUENT if code < FREQUENT else code - FREQUENT)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token is in [lo, hi)."""
        part = self._part(token)
        if part is None:
            return 0
        rare, code = part
        a, b = self.parts[rare].range(code, self.which.rank(0, rare, lo), self.which.rank(0, rare, self.n if hi is None else hi))
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of the token is; -1 if there are fewer."""
        part = self._part(token)
        at = -1 if part is None else self.parts[part[0]].locate(part[1], k)
        return at if at < 0 else self.which.select(0, part[0], at)

    def decode(self) -> np.ndarray:
        """All tokens."""
        if not self.n:
            return np.zeros(0, np.uint32)
        rare = self.which.decode(np.uint8).view(bool)
        out = np.empty(self.n, np.uint32)
        out[np.flatnonzero(~rare)] = self.alphabet[:FREQUENT][self.parts[0].decode(np.uint8)]
        if self.parts[1].n:
            out[np.flatnonzero(rare)] = self.alphabet[FREQUENT:][self.parts[1].decode(np.uint16 if len(self.alphabet) < 1 << 16 else np.uint32)]
        return out


def _write(batches: Iterator[pa.RecordBatch], shared, folder: str, most: int) -> Iterator[pa.RecordBatch]:
    coder = shared.value.coder()
    fs, top = common.filesystem(folder)
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
    shard, part, size, held, docs = None, 0, 0, [], []

    def flush() -> pa.RecordBatch:
        ids = np.concatenate([x for x, _ in held])
        lengths = np.concatenate([n for _, n in held])
        data = encode(ids, np.concatenate(docs), np.concatenate(([0], np.cumsum(lengths))))
        name = f"tokens-{shard:06d}-{part:06d}.wvm"
        temporary = f"{top}/.{name}.{uuid.uuid4().hex}"
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(data)
        fs.move(temporary, f"{top}/{name}")
        return pa.RecordBatch.from_pylist([{"file": name, "shard": shard, "part": part, "docs": len(lengths), "tokens": len(ids), "bytes": len(data)}], schema)

    for batch in batches:
        number = batch.column("shard").to_numpy()
        edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
        for lo, hi in zip(edge, [*edge[1:], len(number)], strict=True):
            if shard is not None and shard != number[lo]:
                yield flush()
                part, size, held, docs = 0, 0, [], []
            shard = int(number[lo])
            for rows, column in words.slices(batch.slice(lo, hi - lo), most=min(words.SLICE_BYTES, most)):
                own = len(words.raw_bytes(column)[0])
                if held and size + own > most:  # the shard goes on in another file
                    yield flush()
                    part, size, held, docs = part + 1, 0, [], []
                size += own
                ids, at = coder.encode(column.to_pylist())
                n = np.diff(at)
                out = np.full(len(ids) + len(n), END, np.uint32)  # the end id after each document
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                held.append((out.astype(np.uint16) if len(out) and out.max() < 1 << 16 else out, n + 1))
                docs.append(rows.column("ordered").to_numpy())
    if shard is not None:
        yield flush()


def write_tokens(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = tokens.TOKENIZER, file_bytes: int = SHARD_BYTES) -> str:
    """Writes the ids of all documents, in order of their identifiers; returns the folder."""
    spark = docs.sparkSession
    own = docs.select(sharding.ordered_id(doc_id).alias("ordered"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = sharding.shard_bounds(own, "ordered", F.octet_length("text") + 1, largest=file_bytes)
    shared = common.Shared(spark, tokens.Shared(tokenizer))
    sharding.in_shards(own, bounds, "ordered", "text").mapInArrow(lambda it: _write(it, shared, folder, file_bytes), MANIFEST).write.parquet(f"{folder}/_manifest.writing")
    common.rename(spark, f"{folder}/_manifest.writing", f"{folder}/_manifest")
    return folder


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, top = common.filesystem(folder)
    for b in batches:
        for name, before in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
            with fs.open_input_file(f"{top}/{name}") as stream:
                file = TokenFile(stream)
                data = file.decode().astype("<u4").tobytes()
            at = file.starts
            lo = 0
            while lo < len(at) - 1:  # about 4 MB of ids at a time
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), side="right")) - 1)
                offsets = pa.py_buffer(((at[lo : hi + 1] - at[lo]) * 4).astype(np.int32).tobytes())
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(data[at[lo] * 4 : at[hi] * 4])])
                own = file.doc_ids[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == sharding.LOWEST), pa.array(at[lo:hi] + before), pa.array(np.diff(at[lo : hi + 1])), ids], ["doc_id", "start", "n_tokens", "ids"])
                lo = hi


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    # Ids before a shard: a row for each shard goes to the driver. Before a file: within its shard.
    shards = sorted((r.shard, r.tokens, r.files) for r in files.groupBy("shard").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("files")).collect())
    at = np.concatenate(([0], np.cumsum([n for _, n, _ in shards]))).astype(np.int64).tolist()
    bases = spark.createDataFrame([(shard, base) for (shard, _, _), base in zip(shards, at, strict=False)], "shard int, base long")
    earlier = F.coalesce(F.sum("tokens").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("earlier", earlier).join(F.broadcast(bases), "shard").select("file", (F.col("base") + F.col("earlier")).alias("before"))
    n = sum(k for *_, k in shards)
    return rows.repartition(min(max(1, n), 4096)).mapInArrow(lambda it: _read(it, folder), "doc_id long, start long, n_tokens long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = write_tokens(docs, common.new_folder(spark, "tokens"))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
