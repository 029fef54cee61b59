import base64
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cirrostrat.llm import common, packing, sharding, tokens, warc, wavelet

from .helpers import ODD, docs


@pytest.fixture(scope="module")
def shared():
    return tokens.Shared()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.TOKENIZER)  # unmodified


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abst'srevmdl LL  \n\t  .,!?09é中😀\x1c\x85<|>"))), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    known, t = test_pieces_give_the_ids_of_whole_texts.state
    ids, at = known.encode(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts_are_those_of_the_library(spark, shared):
    t = Tokenizer.from_file(tokens.TOKENIZER)  # unmodified
    special = next(iter(t.get_added_tokens_decoder().values())).content
    texts = ["plain text", f"end. {special} next", "", special, f"{special}{special} a  ", special[:-1], "plain text", f"x{special}\n\n y's"]
    coder = tokens.Coder(shared.source, shared.kinds)
    for _ in range(2):
        ids, at = coder.encode(texts)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids
    assert t.token_to_id(special) in ids
    rows = [*enumerate(texts)]
    folder = wavelet.write_tokens(docs(spark, rows), common.new_folder(spark, "t"))
    got = {r.doc_id: bytes(r.ids) for r in wavelet.read_tokens(spark, folder).collect()}
    pieces = packing.pack(docs(spark, rows), length=16).collect()
    for i, text in rows:
        assert got[i] == expected(t, text).tobytes()
        assert b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)) == got[i]


@pytest.fixture(autouse=True, scope="module")
def _state(shared, tokenizer):
    test_pieces_give_the_ids_of_whole_texts.state = tokens.Coder(shared.source, shared.kinds), tokenizer


def expected(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("n", [0, 1, 7, 70000])
def test_token_file(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    f = wavelet.TokenFile(io.BytesIO(wavelet.encode(ids, np.arange(2), np.array([0, n // 2, n]))))
    assert (f.decode() == ids).all()
    for i in rng.integers(0, n, 20) if n else []:
        assert f.access(int(i)) == ids[i]
    for t in set(rng.choice(ids, 8).tolist()) if n else []:
        at = np.flatnonzero(ids == t)
        assert f.count(t) == len(at)
        assert f.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [f.locate(t, k) for k in (0, len(at) - 1, len(at))] == [at[0], at[-1], -1]
    assert f.count(999999) == 0 and f.locate(999999, 0) == -1
    with pytest.raises(IndexError):
        f.access(n)


def test_token_files(spark, tokenizer, monkeypatch):
    rng = random.Random(1)
    rows = ODD + [(rng.randrange(1000), " ".join(rng.choice(["the", "öl", "x1", "end."]) for _ in range(rng.randrange(30)))) for _ in range(80)]
    folder = wavelet.write_tokens(docs(spark, rows).selectExpr("*", "1 as shard", "2 as ordered"), common.new_folder(spark, "t"))
    got = wavelet.read_tokens(spark, folder).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = expected(tokenizer, t)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, at, len(ids), ids.tobytes())
        at += len(ids)
    monkeypatch.setattr(sharding, "MOST_SHARDS", 2)
    rolled = wavelet.write_tokens(docs(spark, rows), common.new_folder(spark, "t"), file_bytes=500)
    assert spark.read.parquet(f"{rolled}/_manifest").where("part > 0").count() > 0
    assert [tuple(r) for r in wavelet.read_tokens(spark, rolled).orderBy("start").collect()] == [tuple(r) for r in got]
    empty = wavelet.write_tokens(docs(spark, []), common.new_folder(spark, "t"))
    assert wavelet.read_tokens(spark, empty).count() == 0


def check_pieces(pieces, rows, tokenizer, length):
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(expected(tokenizer, t).tobytes())
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    for (d, n), parts in own.items():
        same = sorted(x for x in want[d] if len(x) == 4 * n)
        if len(same) == 1:
            parts.sort(key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in parts) == same[0]
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for v in want.values() for x in v)
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


@pytest.mark.parametrize("length", [16, 64, 1024])
def test_packing(spark, tokenizer, length):
    rng = random.Random(length)
    rows = ODD + [(100 + i, " ".join(rng.choice(["the", "öl", "x1", "end."]) for _ in range(rng.randrange(3 * length // 4)))) for i in range(150)]
    pieces = packing.pack(docs(spark, rows).selectExpr("*", "1 as part", "2 as n"), length=length)
    assert check_pieces(pieces.collect(), rows, tokenizer, length) == 0
    whole = {r.sequence_id: (r.n_ids, len(r.ids) // 4) for r in packing.sequences(pieces).collect()}
    assert all(a == b <= length for a, b in whole.values())
    assert packing.pack(docs(spark, []), length=length).count() == 0


def test_knapsack_and_program():
    rng = np.random.default_rng(0)
    value = rng.random(9)
    best, pattern = packing.knapsack(value, 10)
    table = [0.0]
    for c in range(1, 11):
        table.append(max([table[c - 1], *(value[i] + table[c - 1 - i] for i in range(9) if i < c)]))
    assert best == pytest.approx(table[10]) == pytest.approx(pattern @ value)
    demand = np.array([0, 0, 0, 4, 0, 5, 0, 3, 0, 0])  # lengths 3, 5, 7 in sequences of 10
    solved = packing.program(demand, 10, gap=0)
    covered = sum(p * x for p, x in solved.patterns)
    assert (covered >= demand - 1e-4).all()
    assert solved.sequences() == pytest.approx(3 + 2.5 + 1 / 3, abs=1e-4)
    assert solved.bound == pytest.approx(solved.sequences(), abs=1e-4)


def test_inverse_by_substitution():
    demand = np.random.default_rng(3).poisson(9, 60)
    start = packing.filled(demand * 1.0, 60, whole=False)
    kinds = np.flatnonzero(demand)
    kinds = kinds[kinds > 0]
    columns = np.array([p[kinds] for p, _, _ in start], float).T
    inverse = packing._inverse(columns, np.searchsorted(kinds, [gone for _, _, gone in start]))
    assert np.abs(inverse @ columns - np.eye(len(kinds))).max() < 1e-9


def test_program_of_all_lengths_beside_an_engine(spark):
    """All 1023 remainder lengths, in the process of a session that is at work; patterns are priced."""
    assert spark.range(100000).selectExpr("sum(id)").first()[0]
    demand = np.random.default_rng(7).poisson(9.0, 1024) + 1
    solved = packing.program(demand)
    assert solved.proved and solved.rounds > 0
    assert np.ceil(solved.sequences() - 1e-6) <= np.ceil(solved.bound) + 1
    covered = sum(p * x for p, x in solved.patterns)
    assert (covered[1:] >= demand[1:] - 1e-4).all()


def test_program_says_when_it_is_stopped():
    demand = np.zeros(1024, np.int64)
    demand[[301, 343, 411, 477, 600]] = [40, 50, 60, 70, 30]
    assert not packing.program(demand, rounds=0).proved
    solved = packing.program(demand, gap=0)
    assert solved.proved and solved.rounds > 0


def histogram(kind, seed):
    rng = np.random.default_rng(seed)
    if kind == "even":
        out = rng.poisson(10, 1024)
    elif kind == "short":
        out = np.where(np.arange(1024) < 200, rng.poisson(40, 1024), 0)
    elif kind == "long":
        out = np.where(np.arange(1024) > 400, rng.poisson(40, 1024), 0)
    elif kind == "few":
        out = np.bincount(rng.choice([3, 340, 343, 600, 1023], 4000), minlength=1024)
    else:
        out = rng.zipf(1.2, 1024) % 5000
    return out.astype(np.int64)


@pytest.mark.parametrize("kind", ["even", "short", "long", "few", "uneven"])
@pytest.mark.parametrize("scale", [1, 1000])
def test_program_reaches_its_bound_and_patterns_place_most(kind, scale):
    demand = histogram(kind, 5) * scale
    made = packing.plan(demand, gap=5e-3)
    sizes = np.arange(1024)
    ids = int(demand @ sizes)
    assert made.used - made.bound <= 0.01 * made.used
    assert made.bound <= made.used + 1e-6 and made.bound * 1024 >= ids * (1 - 1e-9)
    assert made.by_program + made.by_rest + made.total == ids
    waste = made.used * 1024 - ids  # what no packing could fill with whole remainders is filled with cut ones
    assert made.total <= 1.1 * waste + 0.02 * ids
    assert made.by_program >= (0.6 if scale == 1 else 0.95) * (ids - made.total)
    assert made.hole_edge[-1] <= made.total
    # Every rank has a place, and no two have the same.
    places = np.zeros(made.whole * 1024, np.int8) if scale == 1 else None
    for r in np.flatnonzero(demand[1:]) + 1:
        placed = int(made.placed[r])
        assert 0 <= placed <= demand[r]
        if scale == 1 and placed:
            rank = np.arange(placed)
            at = np.searchsorted(made.first_rank[r], rank, side="right") - 1
            i, c = rank - made.first_rank[r][at], made.copies[r][at]
            begin = (made.sequence[r][at] + i // c) * 1024 + made.offset[r][at] + i % c * r
            for k in range(int(r)):
                places[begin + k] += 1
    if scale == 1:
        position = np.arange(made.total)
        sequence, offset, room = made.stream_sequence(position)
        assert (room > 0).all()
        np.add.at(places, sequence * 1024 + offset, 1)
        assert places.max() == 1 and places.sum() == ids
        fill = places.reshape(-1, 1024).sum(axis=1)
        assert all(f == 1024 or f & (f - 1) == 0 for f in fill.tolist())
        assert (np.maximum.accumulate(places.reshape(-1, 1024)[:, ::-1], axis=1)[:, ::-1] == places.reshape(-1, 1024)).all()



def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (5, "http://c", "<p>x</p>"), (5, "http://c", "<p>x</p>"), (3, "http://d", None), (4, "http://e", ""), (None, "http://f", "ünï\r\n\r\n"), (6, "http://g", "y" * 300000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as kind", "'z' as sha1")
    folder = warc.write_warc(table, common.new_folder(spark, "w"), ident="page_id", payload="html", file_bytes=600)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    best = {}
    for d, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if d is None else d)
    responses = defaultdict(int)
    for r in got:
        h = next(x[2] or "" for x in rows if x[0] == r.id)
        assert r.payload_bytes == len(h.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if r.record_type == "response":
            responses[h] += 1
            assert bytes(r.payload) == h.encode() and r.refers_to is None
            assert best[h] in (-1, r.id)
        else:
            assert r.refers_to == best[h]
    assert dict(responses) == dict.fromkeys({x[2] or "" for x in rows}, 1)
    files = {f.file: f.sha256 for f in spark.read.parquet(f"{folder}/_manifest").collect()}
    again = warc.write_warc(table.repartition(3), common.new_folder(spark, "w"), ident="page_id", payload="html", file_bytes=600)
    assert {f.file: f.sha256 for f in spark.read.parquet(f"{again}/_manifest").collect()} == files and len(files) > 1
    small = warc.read_warc(spark, warc.write_warc(table, common.new_folder(spark, "w"), ident="page_id", payload="html", revisit_bytes=100)).collect()
    assert all(r.record_type == "response" for r in small)
    assert warc.read_warc(spark, warc.write_warc(table.limit(0), common.new_folder(spark, "w"), ident="page_id", payload="html")).count() == 0


def test_damaged_records_are_found():
    data = warc.record(1, "u", b"payload", warc.base32(hashlib.sha1(b"payload").digest()), 0, None, warc.DATE)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError):
        [*warc.members(io.BytesIO(warc.member(data, 6)[:-10]))]
    assert zlib.decompress(warc.member(data, 6), 31) == data
