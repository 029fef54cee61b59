import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cirrostrat.llm import components, exact_dedup, filters, jaccard, words

from .helpers import ODD, blanks, docs


@pytest.mark.parametrize("bits", [64, 3])
@pytest.mark.parametrize(("keep", "hot"), [("largest", 512), ("smallest", 3)])
def test_exact_groups_by_brute_force(spark, monkeypatch, bits, keep, hot):
    monkeypatch.setattr(filters, "HOT", hot)
    rng = random.Random(3)
    rows = ODD + [(rng.randrange(100), rng.choice(["a", "b", "c", "d e", "", None]) if rng.random() < 0.6 else str(rng.random())) for _ in range(120)]
    out = exact_dedup.exact_groups(docs(spark, rows), keep=keep, bits=bits, memtable=16).collect()
    texts = defaultdict(list)
    for d, t in rows:
        texts[t or ""].append(d)
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    kept = Counter()
    for r in out:
        own = texts[r.text or ""]
        order = [x if x is not None else -(2**63) for x in own]
        best = max(order) if keep == "largest" else min(order)
        assert r.group_size == len(own)
        assert r.keep_id == (None if best == -(2**63) else best)
        kept[r.text or ""] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert kept == Counter(dict.fromkeys(texts, 1))


def test_exact_on_nothing_and_clashing_names(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a"), (2, "a")]).selectExpr("*", "7 as kept", "'x' as keep_id", "0 as key", "0 as best")
    out = exact_dedup.deduplicate(clash, keep="largest").collect()
    assert [(r.doc_id, r.key, r.best) for r in out] == [(2, 0, 0)]


def test_runs_and_compaction(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", keep="smallest", memtable=4)
    index.insert(docs(spark, [(i, str(i % 10)) for i in range(50)]))
    index.compact()
    index.insert(docs(spark, [(-1, "3"), (99, "new")]))
    got = {r.key: (r.best, r.n) for r in index.entries().collect()}
    digest = lambda t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big", signed=True)
    assert got == {digest(str(i)): (i, 5) for i in range(10) if i != 3} | {digest("3"): (-1, 6), digest("new"): (99, 1)}


@pytest.mark.parametrize("bits", [64, 3])
def test_lookups_ask_the_runs(spark, tmp_path, bits, monkeypatch):
    """Rows of a later table against an index of compacted and of fresh runs; collisions of digests are told apart."""
    rng = random.Random(6)
    earlier = [(i, f"text {rng.randrange(60)}") for i in range(100)] + [(200, None), (201, "only one")]
    later = [*((1000 + i, f"text {rng.randrange(120)}") for i in range(80)), (None, "only one"), (2000, ""), (2001, "never"), (2001, "never"), *ODD]
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", bits=bits, memtable=8)
    index.insert(docs(spark, earlier[:50]))
    index.compact()
    index.insert(docs(spark, earlier[50:]))
    assert len(index.runs) == 1 and set(index.level1) == {"one", "several"}
    asked = []
    ask = filters.may_hold
    monkeypatch.setattr(filters, "may_hold", lambda spark, found: asked.append(found) or ask(spark, found))
    keys = docs(spark, later).select(exact_dedup.digest(exact_dedup._text("text"), bits).alias("key"))
    index.lookup(keys).count()
    assert asked == [r.filter() for r in [*index.runs, *index.level1.values()]]
    for _ in range(2):
        seen = {t or "" for _, t in earlier}
        out = exact_dedup.unseen(docs(spark, later).selectExpr("*", "1 as key", "'x' as body"), index, docs(spark, earlier))
        assert out.columns[-2:] == ["key", "body"]
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r for r in later if (r[1] or "") not in seen)
        index.compact()
    empty = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/empty")
    assert exact_dedup.unseen(docs(spark, later), empty, docs(spark, [])).count() == len(later)


def test_components(spark):
    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(0, 60) if a % 20] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(5, 5)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = blanks(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def near_copies(rng, n_base, copies, edits):
    words = [f"w{i}" for i in range(300)]
    rows, ident = [], 100
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((ident, " ".join(own)))
            ident += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "den", "big"), [(3, 9, 10, 128), (3, 9, 10, 2), (5, 4, 5, 3), (1, 1, 2, 2)])
def test_components_of_links_by_brute_force(spark, monkeypatch, n, num, den, big):
    monkeypatch.setattr(filters, "HOT", 2 * big)
    rng = random.Random(n + big)
    rows = ODD + near_copies(rng, 12, 9, 3) + near_copies(rng, 1, 40, 4)
    join = jaccard.Join(docs(spark, rows), jaccard.Similarity(n, num, den), big=big, count_bits=10)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in join.groups().collect())
    assert got == brute(rows, n, num, den)


def test_all_links(spark):
    rng = random.Random(9)
    rows = near_copies(rng, 6, 6, 2)
    links = jaccard.Join(docs(spark, rows), jaccard.Similarity(3, 4, 5)).links()
    sets = {}
    for d, t in rows:
        w = blanks(t)
        sets.setdefault(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))), d)
    distinct = list(sets)
    want = sorted((len(a & b), len(a | b)) for i, a in enumerate(distinct) for b in distinct[:i] if len(a & b) * 5 >= 4 * len(a | b))
    assert sorted((r.both, r.either) for r in links.collect()) == want


def test_keep_one(spark):
    rows = ODD + near_copies(random.Random(4), 8, 6, 1)
    clash = docs(spark, rows).selectExpr("*", "1 as h", "2 as n", "3 as component_id")
    out = jaccard.keep_one(clash, jaccard.Similarity(3, 4, 5))
    assert out.columns == clash.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = brute(rows, 3, 4, 5)
    components_ = {c for (d, n, c), _ in want.items() if n}
    empty = sum(k for (d, n, c), k in want.items() if not n)
    assert sum(got.values()) == len(components_) + empty
    assert jaccard.keep_one(docs(spark, [])).count() == 0


def test_counts_over_several_slices(spark):
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(300_000)) for _ in range(3)]  # each most of a slice
    got = jaccard.counts(docs(spark, list(enumerate(texts))).coalesce(1), 2, 12)
    want = np.zeros(1 << 12, np.int64)
    for t in texts:
        g, _ = jaccard.shingles(words.utf8(pa.array([t])), 2, words.Powers())
        want += np.bincount((g & np.uint64(4095)).astype(np.int64), minlength=1 << 12)
    assert (got == want).all() and want.sum() == 3 * 299_999
    full = np.full(2, np.iinfo(np.uint32).max - 1, np.uint32)
    assert jaccard._added(full, np.array([1, 7], np.uint32)).tolist() == [2**32 - 1, 2**32 - 1]


def test_counts_stay_at_the_largest_number(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from cirrostrat.llm import filters, jaccard

    monkeypatch.setattr(jaccard, "MOST_COUNTED", 5)
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three four five six seven eight nine ten"] * 3)], ["text"])
    (out,) = jaccard._counted(iter([batch, batch]), 1, 2)
    cells = filters.unpacked(out.column(0)[0].as_py(), np.uint32)
    assert cells.max() == 5 and len(cells) == 4
