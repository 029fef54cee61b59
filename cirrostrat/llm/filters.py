"""Membership filters of a fixed size over 64-bit keys, built across tasks and broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: The largest filter: 2**26 bits are 8 MB. A full filter passes everything, which costs work, never rows.
MOST_BITS = 26
#: Tasks that put tables of tasks together, before the driver does so with theirs.
MERGES = 8


def packed(table: np.ndarray) -> pa.RecordBatch:
    """A table as a row; compressed, as a task with few rows has mostly zeros."""
    return pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(table.tobytes())], pa.binary())], ["data"])


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class KeyFilter:
    """A Bloom filter with two bits for a key."""

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.bits = bits
        self.data = np.zeros(max(1, 1 << bits >> 3), np.uint8) if data is None else data

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = words.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
        m = np.uint64((1 << self.bits) - 1)
        return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys)
        return ((self.data[a >> 3] >> (a & 7)) & (self.data[b >> 3] >> (b & 7)) & 1).astype(bool)


def filter_of(keys: DataFrame, key: str, *, most_bits: int = MOST_BITS) -> KeyFilter:
    """The filter of a column of long keys, sized by their number up to the bound."""
    bits = min(most_bits, max(10, (16 * keys.count()).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = KeyFilter(bits), False
        for b in batches:
            if b.num_rows:
                own.add(b.column(0).to_numpy(zero_copy_only=False))
                some = True
        if some:
            yield packed(own.data)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                total = unpacked(x, np.uint8) if total is None else total | unpacked(x, np.uint8)
        if total is not None:
            yield packed(total)

    out = KeyFilter(bits)
    rows = keys.select(F.col(key).cast("long")).where(F.col(key).isNotNull()).mapInArrow(part, "data binary")
    for r in rows.repartition(MERGES).mapInArrow(merged, "data binary").toLocalIterator():
        out.data |= unpacked(bytes(r.data), np.uint8)
    return out


def may_hold(spark, found: KeyFilter):
    """A column function: whether the filter may hold a long key; false for null."""
    shared = common.Shared(spark, found)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        out = np.zeros(len(keys), bool)
        here = keys.notna().to_numpy()
        out[here] = shared.value.may_hold(keys[here].to_numpy(np.int64))
        return pd.Series(out)

    return test


#: A key of more rows is dealt to SALTS tasks.
HOT, SALTS = 512, 32


def crowded_filter(crowded: DataFrame, key: str, *, most_bits: int = MOST_BITS) -> KeyFilter | None:
    """The filter of keys that very many rows have; None without any."""
    return filter_of(crowded, key, most_bits=most_bits) if crowded.limit(1).count() else None


def spread_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], crowded: KeyFilter | None, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for its keys. crowded: the first keys (longs) that very many rows of
    left have; these rows are dealt to several tasks by a hash of the columns ``by`` (so a task that is run again
    deals them the same), with a copy of the key's row of right for each."""
    if crowded is None:
        return left.join(right, [*keys], how)
    is_hot = may_hold(left.sparkSession, crowded)
    salt = "__salt"
    left = left.withColumn(salt, F.when(is_hot(keys[0]), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int"))
    right = right.withColumn(salt, F.explode(F.when(is_hot(keys[0]), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, salt], how).drop(salt)
