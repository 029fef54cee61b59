"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of their identifier and sorted in them,
so the archives depend on the rows alone. A shard's task rolls its files by
compressed size and makes all headers and digests anew. Each record is a gzip
member of its own. A file is written under a temporary name and renamed when it
is whole; its bytes are the same on every attempt, so a repeated task replaces
it by itself. The manifest, a Parquet folder with one row a file, is renamed
into place last; readers take only what it lists.

Of records with equal payloads of ``revisit_bytes`` or more the one with the
largest identifier is a response; the others are revisit records that refer to
it and hold no payload.

Defined cases: a null payload is empty; a null identifier orders below all
others and is left out of the record; rows that repeat identifier and payload
are a response and revisits of the same identifier (of rows that are equal in
both, which one is the response makes no difference); a very long payload is
one record, compressed as it is written; an empty table gives a manifest without
files; a null address is left out of the record. Only identifier, address and
payload are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, filters, sharding

FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_READ = 1 << 16
_SPACE = uuid.UUID("5b1c3d0e-3b0a-5f0e-9d0c-7a6f0f6f2c11")

MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(ident: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{ident}/{digest}/{copy}')}>"


def _clean(url: str | None) -> str | None:
    """An address as a header can hold it."""
    return None if url is None else "".join(url.split())


def record(ident: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers: tuple[int | None, str | None] | None, date: str) -> bytes:
    """One WARC record. refers: for a revisit, the identifier and address of the response."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is None:
        block += payload
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", _record_id(ident, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Row-ID", ident),
    ]
    if refers is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers[0], digest, 0)),
            ("WARC-Refers-To-Target-URI", _clean(refers[1])),
            ("Refers-To-Row-ID", refers[0]),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member; without a time stamp, so equal for equal data."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Roll:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, most: int) -> None:
        self.fs, self.folder = common.filesystem(folder)
        self.shard, self.most, self.part, self.out = shard, most, 0, None
        self.done: list[tuple] = []

    def add(self, data: bytes, ident: int | None) -> None:
        if self.out is not None and self.size + len(data) > self.most:
            self.close()
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.name = f"records-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.sha, self.first = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256(), ident
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.n += 1
        self.last = ident

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.shard, self.n, self.size, self.sha.hexdigest(), self.first, self.last))
            self.out, self.part = None, self.part + 1


def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    roll, role, seen, copy = None, None, None, 0
    for b in batches:
        for shard, ident, digest, kind, url, payload, refers_to, refers_url in zip(*(b.column(c).to_pylist() for c in ("shard", "ordered", "sha1", "kind", "url", "payload", "refers_to", "refers_url")), strict=True):
            if kind == 0:
                role = ((ident, digest), (refers_to, refers_url))
                continue
            if roll is None or roll.shard != shard:
                if roll is not None:
                    roll.close()
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in roll.done], schema)
                roll = _Roll(folder, shard, most)
            own = None if ident == sharding.LOWEST else ident
            at = (ident, digest)
            copy = copy + 1 if seen == at else 0
            refers = role[1] if role and role[0] == at and role[1] is not None else None
            if digest is None:  # below revisit_bytes
                digest = base32(hashlib.sha1(payload).digest())
            else:
                digest = base32(bytes.fromhex(digest))
                if refers is None and copy:
                    refers = (own, url)
            seen = at
            roll.add(member(record(own, url, payload, digest, copy, refers, date), level), own)
    if roll is not None:
        roll.close()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in roll.done], schema)


def write_warc(records: DataFrame, folder: str, *, ident: str = "id", url: str = "url", payload: str = "payload", revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 6, date: str = DATE) -> str:
    """Writes records (payload: binary) as WARC files; returns the folder."""
    spark = records.sparkSession
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = records.select(sharding.ordered_id(ident).alias("ordered"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("sha1", F.when(F.octet_length("payload") >= revisit_bytes, F.sha1("payload")))
    heads = common.stored(rows.select("ordered", "url", "sha1", F.octet_length("payload").cast("long").alias("size")), "warc-heads")
    groups = heads.where("sha1 is not null").groupBy("sha1").agg(F.max(F.struct("ordered", "url")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A common page has very many records: they are dealt to several tasks.
    key = F.xxhash64("sha1").alias("key")
    groups = groups.select("*", key)
    crowded = filters.crowded_filter(groups.where(F.col("n") > filters.HOT), "key")
    roles = filters.spread_join(heads.where("sha1 is not null").select("*", key), groups.drop("n"), ("key", "sha1"), ("ordered",), crowded).where("ordered < best.ordered").groupBy("ordered", "sha1").agg(F.first("best").alias("best"))
    bounds = sharding.shard_bounds(heads, "ordered", F.col("size") + 500)
    pages = rows.select("ordered", "sha1", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    known = F.col("best.ordered") != sharding.LOWEST
    roles = roles.select("ordered", "sha1", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(b"").alias("payload"), F.when(known, F.col("best.ordered")).alias("refers_to"), F.col("best.url").alias("refers_url"))
    dealt = sharding.in_shards(pages.unionByName(roles), bounds, "ordered", "sha1", "kind", "url")
    dealt.mapInArrow(lambda it: _write(it, folder, file_bytes, level, date), MANIFEST).write.parquet(f"{folder}/_manifest.writing")
    common.rename(spark, f"{folder}/_manifest.writing", f"{folder}/_manifest")
    return folder


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data, rest = zlib.decompressobj(31), b""
    parts: list[bytes] = []
    while chunk := rest or stream.read(_READ):
        parts.append(data.decompress(chunk))
        rest = b""
        if data.eof:
            yield b"".join(parts)
            rest, parts, data = data.unused_data, [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("the last record is not whole")


def parse(data: bytes) -> dict:
    """A record's fields; digests and lengths are checked against what the record holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(field["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or field["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"damaged record {field.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    response = field["WARC-Type"] == "response"
    if response and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged payload of {field['WARC-Record-ID']}")
    number = lambda k: int(field[k]) if k in field else None
    return {"id": number("Row-ID"), "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("Refers-To-Row-ID"), "payload": payload if response else None}


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string())])
    fs, top = common.filesystem(folder)
    for b in batches:
        for name in b.column("file").to_pylist():
            rows: list[dict] = []
            size = 0
            with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                for data in members(stream):
                    rows.append(parse(data) | {"file": name} | ({} if payloads else {"payload": None}))
                    size += len(data) if payloads else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of all files that the manifest lists."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")
    n = max(1, files.count())
    return files.repartition(min(n, 4096)).mapInArrow(lambda it: _read(it, folder, payloads), RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("html"))
    folder = write_warc(pages, common.new_folder(spark, "warc"), ident="page_id", payload="html")
    return read_warc(spark, folder, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
bits AS (SELECT page_id, h, s, list_transform(range(0, 40), lambda i: ('0x' || s[i + 1])::INT) AS x FROM p),
d AS (SELECT page_id, h, s, list_transform(range(0, 8), lambda c: list_sum(list_transform(range(0, 5), lambda j: x[c * 5 + j + 1]::BIGINT << (4 * (4 - j))))) AS words FROM bits),
b AS (SELECT page_id, h, s, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((words[i // 4 + 1]::BIGINT >> (5 * (3 - i % 4))) & 31) + 1]), '') AS digest FROM d)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM b WINDOW g AS (PARTITION BY h)
"""
