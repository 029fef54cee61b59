"""Packing of token sequences by cutting-stock column generation.

A document's ids fill as many whole sequences as they can; what remains (fewer
ids than a sequence has) is an item of a cutting-stock problem. The histogram
of remainder lengths, which has fewer entries than a sequence has ids, goes to
a linear program over patterns: multisets of lengths that fit a sequence. It
starts from first-fit-decreasing patterns; new ones are priced by a knapsack
dynamic program on the program's duals, until no pattern is worth more than its
sequence, sequences and bound are ``gap`` apart, or the bound proves that whole
sequences can't be fewer. Pattern counts are rounded down, and what rounding leaves gets patterns
of its own, first-fit-decreasing with whole counts.

Documents are ranked within their remainder length, and ranks are dealt to the
patterns' places by arithmetic on a table that is as small as the program.
A pattern's free ids are filled: some of the patterns with the most of them
give up their remainders, which are cut into what is free elsewhere. What is
left of those at the end is cut into whole sequences and powers of two, so that
nothing is padded.

Ids are written once to the shared folder and not shuffled: a rank is its
offset among the files' counts, which each task reads for its own file.

Defined cases: a null text is empty and has the end id only; repeated rows are
documents of their own; very long texts are encoded whole and fill sequences
alone; an empty table gives no pieces. Only identifier and text are read, so
other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens, words

LENGTH = 1024
END = 0
#: The linear program is solved when its bound is so near, as a share of its sequences.
GAP = 1e-6
#: Demand is shifted by up to so many pieces of a length (so many millionths where there are millions).
SHIFT = 1e-6
#: Pricing rounds for each remainder length, at most.
ROUNDS = 4


def knapsack(value: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths 1.. that fits, and how many of each. value: of length 1 + i."""
    best = np.zeros(length + 1)
    pick = np.zeros(length + 1, np.int64)
    n = len(value)
    for c in range(1, length + 1):
        m = min(c, n)
        got = value[:m] + best[c - m : c][::-1]
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = got[i], i + 1
        else:
            best[c] = best[c - 1]
    out = np.zeros(n, np.int64)
    c = length
    while c > 0:
        if pick[c]:
            out[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[length]), out


def _fill(left: np.ndarray, length: int, whole: bool) -> np.ndarray:
    """A pattern of lengths of which some are left: the largest first, closed by one or two lengths that fill
    the sequence exactly where there are such. left[r]: pieces of length r; whole: they are whole numbers."""
    pattern = np.zeros(len(left), np.int64)
    free = length
    while free > 0:
        room = left - pattern if whole else left
        have = room >= 1 if whole else room > 0
        have[0] = False
        top = min(free, len(left) - 1)
        some = np.flatnonzero(have[: top + 1])
        if not len(some):
            break
        if pattern.any():
            if free < len(left) and have[free]:
                pattern[free] += 1
                break
            a = some[some < free]
            b = free - a
            fits = (b < len(left)) & have[np.minimum(b, len(left) - 1)]
            if whole:
                fits &= (a != b) | (room[a] >= 2)
            if fits.any():
                a, b = a[fits], b[fits]
                k = int(np.minimum(room[a], room[b]).argmax())
                pattern[a[k]] += 1
                pattern[b[k]] += 1
                break
        pattern[some[-1]] += 1
        free -= int(some[-1])
    return pattern


def filled(demand: np.ndarray, length: int, whole: bool) -> list[tuple[np.ndarray, float, int]]:
    """Patterns that use the demand up, one after the other, how often each is used, and a length that it uses
    up (0: none). A pattern has no length that one before it used up. demand[r]: pieces of length r."""
    left = demand.astype(np.int64 if whole else np.float64)
    left[0] = 0
    out = []
    while left.any():
        pattern = _fill(left, length, whole)
        here = np.flatnonzero(pattern)
        if whole:
            times = int((left[here] // pattern[here]).min())
            left[here] -= times * pattern[here]
            out.append((pattern, times, 0))
            continue
        each = left[here] / pattern[here]
        times = float(each.min())
        left[here] -= times * pattern[here]
        gone = here[left[here] <= 1e-9 + 1e-13 * demand[here]]
        left[gone] = 0
        out.append((pattern, times, int(gone[0])))
        for r in gone[1:]:  # used up by the same pattern: a column of its own that is not used
            alone = np.zeros(len(left), np.int64)
            alone[r] = length // r
            out.append((alone, 0.0, int(r)))
    return out


@dataclass
class Program:
    """The solved linear program: patterns, how often each is used, a bound from below on the sequences, pricing
    rounds, and whether the bound proves that it can't do with fewer (to ``gap``, or in whole sequences)."""

    patterns: list[tuple[np.ndarray, float]]
    bound: float
    rounds: int
    proved: bool = True

    def sequences(self) -> float:
        return sum(times for _, times in self.patterns)


def _inverse(columns: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The inverse of a matrix that is lower triangular with its rows in that order, by substitution in its few
    entries. All arithmetic of the program is numpy's own: the linear algebra library's threads don't always come
    back in a process that also runs an engine."""
    out = np.zeros_like(columns)
    by_rank = np.zeros_like(columns)  # columns of the inverse in that order
    for n, row in enumerate(order.tolist()):
        entries = columns[row]
        some = np.flatnonzero(entries[:n])
        by_rank[n] = -(entries[some, None] * by_rank[some]).sum(axis=0)
        by_rank[n, n] += 1
        by_rank[n] /= entries[n]
    out[:, order] = by_rank
    return out


def program(demand: np.ndarray, length: int = LENGTH, *, gap: float = GAP, rounds: int = ROUNDS) -> Program:
    """The linear program over patterns, by column generation. demand[r]: pieces of length r < length.

    The simplex method starts from first-fit-decreasing patterns, of which each uses up a length (so their matrix
    is triangular), and prices by the knapsack program. It ends when no pattern is worth more than a sequence or
    sequences and bound are ``gap`` apart, or after a pricing round whose bound and sequences are the same in whole
    sequences; at the latest after ``rounds`` pricing rounds for each length there is (then ``proved`` is false)."""
    kinds = np.flatnonzero(demand)
    kinds = kinds[kinds > 0]
    m = len(kinds)
    if not m:
        return Program([], 0.0, 0)
    # Demand is shifted a little, each length's differently, so that no two lengths are used up at once: the simplex
    # method would go in circles there.
    real = demand[kinds].astype(float)
    shifted = demand * 1.0
    shifted[kinds] += SHIFT * max(1.0, demand[kinds].max() / 1e6) * np.modf(kinds * 0.6180339887)[0]
    start = filled(shifted, length, whole=False)
    columns = np.array([p[kinds] for p, _, _ in start], np.float64).T
    used = np.array([t for _, t, _ in start])
    inverse = _inverse(columns, np.searchsorted(kinds, [gone for _, _, gone in start]))
    bound = float((real * kinds).sum()) / length  # lengths as prices
    done, proved = 0, False
    while True:
        total = float(used.sum())
        proved = proved or total - bound <= gap * total or (done > 0 and np.ceil(total - 1e-6) <= np.ceil(bound - 1e-6))
        if proved or done == rounds * m:
            break
        done += 1
        dual = np.maximum(inverse.sum(axis=0), 0)
        value = np.zeros(length - 1)
        value[kinds - 1] = dual
        most, pattern = knapsack(value, length)
        bound = max(bound, float((real * dual).sum()) / most)
        if most <= 1 + 1e-9:
            proved = True
            continue
        entering = pattern[kinds - 1].astype(float)
        some = np.flatnonzero(entering)
        along = (inverse[:, some] * entering[some]).sum(axis=1)
        up = along > 1e-9
        if not up.any():
            break
        ratio = np.where(up, used / np.where(up, along, 1), np.inf)
        out = int(ratio.argmin())
        step = float(ratio[out])
        used = np.maximum(used - step * along, 0)
        used[out] = step
        row = inverse[out] / along[out]
        inverse -= along[:, None] * row
        inverse[out] = row
        columns[:, out] = entering
    found = []
    for j in np.flatnonzero(used > 0):
        full = np.zeros(len(demand), np.int64)
        full[kinds] = columns[:, j].astype(np.int64)
        found.append((full, float(used[j])))
    return Program(found, bound, done, proved)


@dataclass
class Plan:
    """Where the pieces of each rank of each remainder length go."""

    length: int
    first_rank: list[np.ndarray]  # by remainder length: ranks from which a row of the next four holds
    copies: list[np.ndarray]
    sequence: list[np.ndarray]
    offset: list[np.ndarray]
    placed: np.ndarray  # ranks that patterns place
    stream: np.ndarray  # where the rest of each length begins in the stream of what is cut
    total: int  # ids in that stream
    hole_edge: np.ndarray  # where in the stream each used pattern's free ids begin, and the end of them all
    hole_size: np.ndarray  # free ids of each sequence of the pattern
    hole_sequence: np.ndarray  # its first sequence
    base: int  # the first sequence of the stream's own
    whole: int  # the first sequence of those that a document fills alone
    by_program: int  # ids that rounded patterns of the linear program place
    by_rest: int  # ids that patterns of what rounding left place
    bound: float  # sequences of remainders, from below
    used: float  # by the linear program
    rounds: int  # of pricing
    proved: bool  # that the program can't do with fewer

    def tail(self) -> np.ndarray:
        """Ends of the last sequences of the stream's own part: powers of two."""
        own = self.total - int(self.hole_edge[-1])
        left = own % self.length
        at, out = own - left, [own - left]
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                at += 1 << bit
                out.append(at)
        return np.array(out)

    def stream_sequence(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset there, and ids until that place ends, for positions of the stream."""
        sequence, offset, room = (np.zeros(len(position), np.int64) for _ in range(3))
        filled_holes = int(self.hole_edge[-1])
        own = np.flatnonzero(position < filled_holes)
        if len(own):
            j = np.searchsorted(self.hole_edge, position[own], side="right") - 1
            k, at = np.divmod(position[own] - self.hole_edge[j], self.hole_size[j])
            sequence[own], offset[own], room[own] = self.hole_sequence[j] + k, self.length - self.hole_size[j] + at, self.hole_size[j] - at
        own = np.flatnonzero(position >= filled_holes)
        if len(own):
            at = position[own] - filled_holes
            edges = self.tail()
            k = at // self.length
            lo, hi = k * self.length, (k + 1) * self.length
            late = at >= edges[0]
            if late.any():
                i = np.searchsorted(edges, at[late], side="right")
                k[late] = edges[0] // self.length + i - 1
                lo[late], hi[late] = edges[i - 1], edges[i]
            sequence[own], offset[own], room[own] = self.base + k, at - lo, hi - at
        return sequence, offset, room


def plan(demand: np.ndarray, length: int = LENGTH, *, gap: float = GAP) -> Plan:
    """demand[r]: documents with a remainder of r ids, r from 0."""
    solved = program(demand, length, gap=gap)
    sizes = np.arange(length)
    left = demand.astype(np.int64)
    left[0] = 0
    chosen: list[tuple[np.ndarray, int, bool]] = []
    for pattern, times in solved.patterns:
        here = np.flatnonzero(pattern)
        n = min(int(times + 1e-3), int((left[here] // pattern[here]).min()))
        if n:
            chosen.append((pattern, n, True))
            left -= n * pattern
    chosen += [(pattern, int(n), False) for pattern, n, _ in filled(left, length, whole=True)]
    # A pattern's free ids are filled from the stream of what no pattern places; patterns with the most free ids
    # give their lengths to the stream until it has ids for all that stay free.
    chosen.sort(key=lambda c: length - int(c[0] @ sizes))
    left[:] = 0
    free = sum(n * (length - int(p @ sizes)) for p, n, _ in chosen)
    total = 0
    while free > total:
        pattern, n, of_program = chosen.pop()
        size = int(pattern @ sizes)
        k = min(n, -(-(free - total) // length))  # each that goes takes its free ids away and adds its own to the stream
        if k < n:
            chosen.append((pattern, n - k, of_program))
        left += k * pattern
        free -= k * (length - size)
        total += k * size
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(length)]
    taken = np.zeros(length, np.int64)
    holes, sequence, placed = [], 0, [0, 0]
    for pattern, n, of_program in chosen:
        at = 0
        for r in np.flatnonzero(pattern)[::-1].tolist():
            c = int(pattern[r])
            rows[r].append((int(taken[r]), c, sequence, at))
            taken[r] += c * n
            at += c * r
        if at < length:
            holes.append((n * (length - at), length - at, sequence))
        placed[not of_program] += n * at
        sequence += n
    lengths = sizes * left
    stream = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    edges = np.concatenate(([0], np.cumsum([h[0] for h in holes]))).astype(np.int64)
    own = total - int(edges[-1])
    cut = own // length + bin(own % length).count("1")
    column = lambda i: [np.array([x[i] for x in r], np.int64) for r in rows]
    size, first = (np.array([h[i] for h in holes], np.int64) for i in (1, 2))
    return Plan(length, column(0), column(1), column(2), column(3), taken, stream, total, edges, size, first, sequence, sequence + cut, placed[0], placed[1], solved.bound, solved.sequences(), solved.rounds, solved.proved)


def _encoded(batches: Iterator[pa.RecordBatch], shared, length: int, width: str) -> Iterator[pa.RecordBatch]:
    """Adds ids, their number, and the numbers by which the rank of the document is found."""
    coder = shared.value.coder()
    part = TaskContext.get().partitionId()
    met = np.zeros(length, np.int64)
    whole = 0
    for batch in batches:
        for rows, column in words.slices(batch):
            ids, at = coder.encode(column.to_pylist())
            n = np.diff(at) + 1
            out = np.full(len(ids) + len(n), END, width)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            rest = n % length
            order = np.argsort(rest, kind="stable")
            kind = rest[order]
            begin = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(begin, np.diff(np.r_[begin, len(n)])) + met[kind]
            met += np.bincount(rest, minlength=length)
            full = n // length
            before = whole + np.cumsum(full) - full
            whole += int(full.sum())
            size = np.dtype(width).itemsize
            offsets = np.concatenate(([0], np.cumsum(n))) * size
            binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(n), pa.array(rank), pa.array(before), binary], ["doc_id", "part", "n", "rank", "whole", "ids"])


def _offsets(folder: str, part: int, length: int) -> np.ndarray:
    """Documents of each remainder length in the parts before this one, and at the end the whole sequences there."""
    import pyarrow.parquet as pq

    fs, top = common.filesystem(f"{folder}/bucket={part // 64}")
    out = np.zeros(length + 1, np.int64)
    for row in pq.read_table(top, filesystem=fs, filters=[("part", "=", part)], partitioning=None).to_pylist():
        out[row["rest"]] = row["before"]
    return out


def _pieces(batches: Iterator[pa.RecordBatch], shared, folder: str, width: str) -> Iterator[pa.RecordBatch]:
    p = shared.value
    L = p.length
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        lo = 0
        n_all = batch.column("n").to_numpy()
        ends = np.cumsum(n_all)
        while lo < len(n_all):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), side="right")))
            rows = batch.slice(lo, hi - lo)
            lo = hi
            n, rank, whole, part = (rows.column(c).to_numpy() for c in ("n", "rank", "whole", "part"))
            for k in np.unique(part).tolist():
                if k not in held:
                    held[k] = _offsets(folder, k, L)
            rest, full = n % L, n // L
            rank = rank + np.array([held[k][r] for k, r in zip(part.tolist(), rest.tolist(), strict=True)], np.int64)
            whole = whole + np.array([held[k][L] for k in part.tolist()], np.int64)
            # Remainders: placed by a pattern, or cut from the stream.
            out = []  # (document, start, length, sequence, offset) columns
            d = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(d)) - np.repeat(np.cumsum(full) - full, full)
            out.append((d, nth * L, np.full(len(d), L), p.whole + whole[d] + nth, np.zeros(len(d), np.int64)))
            has = rest > 0
            fixed = has & (rank < p.placed[rest])
            for r in np.unique(rest[fixed]).tolist():
                own = np.flatnonzero(fixed & (rest == r))
                at = np.searchsorted(p.first_rank[r], rank[own], side="right") - 1
                i, c = rank[own] - p.first_rank[r][at], p.copies[r][at]
                out.append((own, full[own] * L, np.full(len(own), r), p.sequence[r][at] + i // c, p.offset[r][at] + i % c * r))
            own = np.flatnonzero(has & ~fixed)
            at, to, done = p.stream[rest[own]] + (rank[own] - p.placed[rest[own]]) * rest[own], rest[own], np.zeros(len(own), np.int64)
            while len(own):
                sequence, offset, room = p.stream_sequence(at)
                take = np.minimum(room, to)
                out.append((own, full[own] * L + done, take, sequence, offset))
                more = take < to
                own, at, to, done = own[more], (at + take)[more], (to - take)[more], (done + take)[more]
            d, start, size, sequence, offset = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((start, d))
            d, start, size, sequence, offset = d[order], start[order], size[order], sequence[order], offset[order]
            column = rows.column("ids")
            _, at, data = column.buffers()
            at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(width).astype("<u4")
            edges = pa.py_buffer((np.concatenate(([0], np.cumsum(size))) * 4).astype(np.int32).tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, edges, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(d)), *map(pa.array, (start, size, n[d], sequence, offset)), binary], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, *, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", tokenizer: str = tokens.TOKENIZER, gap: float = GAP) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    known = tokens.Shared(tokenizer)
    shared = common.Shared(spark, known)
    width = "<u2" if known.most_id() < 1 << 16 else "<u4"
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    encoded = common.stored(own.mapInArrow(lambda it: _encoded(it, shared, length, width), f"doc_id {kind}, part int, n long, rank long, whole long, ids binary"), "packing-ids")
    counts = encoded.groupBy("part", F.pmod("n", F.lit(length)).cast("int").alias("rest")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.floor(F.col("n") / length)).cast("long").alias("whole"))
    counts = common.stored(counts, "packing-counts")
    demand = np.zeros(length, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("docs").alias("docs")).collect():  # a row for each remainder length
        demand[r.rest] = r.docs
    # The numbers that each part has to add to its ranks; whole sequences count as a remainder of the full length.
    counted = counts.select("part", "rest", "docs").unionByName(counts.groupBy("part").agg(F.lit(length).alias("rest"), F.sum("whole").alias("docs")))
    before = F.sum("docs").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    folder = common.new_folder(spark, "packing-offsets")
    offsets = counted.select("part", "rest", F.coalesce(before, F.lit(0)).alias("before"), F.floor(F.col("part") / 64).alias("bucket"))
    offsets.repartition("bucket").sortWithinPartitions("bucket", "part").write.partitionBy("bucket").parquet(folder)
    placed = common.Shared(spark, plan(demand, length, gap=gap))
    return encoded.mapInArrow(lambda it: _pieces(it, placed, folder, width), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, its number of ids, and the ids. A group has a sequence's ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts")).select("sequence_id", "n_ids", joined.alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(pack(common.read_table(spark, sf_dir, "documents").select("doc_id", "text")))
