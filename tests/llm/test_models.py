import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.llm import common, labelled, language_id, quality, toxicity, words

from .helpers import ALPHABET, ODD, alnum, blanks, docs


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["", "a", " ", "A b\tC", "é😀b C!d", *("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(200))]
    for table, cut in ((words.ALNUM, alnum), (words.BLANKS, blanks)):
        got = words.cut([t.encode() for t in texts], table)
        h = got.hashes(words.Powers())
        lists, seen = [], {}
        for a, b in zip(got.first.tolist(), got.first.tolist()[1:], strict=False):
            lists.append([got.data[got.start[i] : got.end[i]].tobytes().decode() for i in range(a, b)])
        assert lists == [cut(t) for t in texts]
        for word, x in zip([w for own in lists for w in own], h.tolist(), strict=True):
            assert seen.setdefault(word, x) == x
        assert len(set(seen.values())) == len(seen)


def naive_kneser_ney(counts, discount, alphabet):
    """Probability of a gram's last symbol after the others, straight from the formula."""

    def kinds_before(gram):
        return len({g[0] for g in counts[len(gram) + 1] if g[1:] == gram})

    def p(gram):
        if not gram:
            return 1 / (alphabet + 1)
        k = len(gram)
        value = (lambda g: counts[k].get(g, 0)) if k == language_id.ORDER else kinds_before
        known = counts[k] if k == language_id.ORDER else {g[1:] for g in counts[k + 1]}
        after = [g for g in known if g[:-1] == gram[:-1]]
        total = sum(value(g) for g in after)
        if not total:
            return p(gram[1:])
        own = max(value(gram) - discount, 0) if gram in known else 0
        return own / total + discount * len(after) / total * p(gram[1:])

    return p


def test_kneser_ney_by_formula():
    texts = ["abab abc", "bca cab", "aab"]
    table = language_id.letter_table()
    packed, _, _ = language_id.grams(texts, table)
    key, n = np.unique(packed, return_counts=True)
    model = language_id.Models(["x"], np.zeros(len(key), np.int64), key, n)
    unpack = lambda g: tuple(int(g) >> (16 * s) & 0xFFFF for s in (3, 2, 1, 0))
    counts = {language_id.ORDER: {unpack(g): int(c) for g, c in zip(key, n, strict=True)}}
    for k in range(language_id.ORDER - 1, 0, -1):
        counts[k] = {g[1:]: 1 for g in counts[k + 1]}
    alphabet = len(counts[1])
    p = naive_kneser_ney(counts, language_id.DISCOUNT, alphabet)
    seen = [*key.tolist(), *(language_id.grams(["cbz aa zzz"], table)[0].tolist())]
    got = model.probability(np.array(seen, np.uint64), language_id.ORDER)[:, 0]
    assert got == pytest.approx([p(unpack(g)) for g in seen], rel=1e-5)


def test_language_identification(spark):
    rng = random.Random(2)
    own = {"xx": ["ka", "to", "mi"], "yy": ["sch", "en", "ung"], "zz": ["я", "ж", "зу"]}
    rows = [(100 + i, prose(rng, own[lang], 40), lang) for i, lang in enumerate([*own] * 60)]
    table = docs(spark, rows)
    models = language_id.train(table.where(F.col("doc_id") % 4 != 2))
    out = {(r.doc_id, r.text): r for r in language_id.identify(docs(spark, rows + ODD).selectExpr("*", "1 as score"), models).collect()}
    assert all(out[i, t].lang_pred == lang for i, t, lang in rows)
    for i, t in ODD:
        r = out[i, t]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= r.score <= 1
    assert out[1, None].rejected and out[1, None].score == 0
    none = language_id.train(table.where("lang = 'nothing'"))
    assert {r.lang_pred for r in language_id.identify(table, none).collect()} == {"und"}
    assert language_id.identify(docs(spark, []), models).count() == 0
    small = language_id.train(table, max_grams=20)
    assert len(small.seen[language_id.ORDER].keys) <= 20


def naive_symbols(text, letters):
    """Lower-cased letters with each run of others as one blank, three blanks before and one behind."""
    out = []
    for c in text:
        low = c.lower()[0] if c.isalpha() and len(c.lower()) else c
        s = low if c.isalpha() else " "
        if s != " " or (out and out[-1] != " "):
            out.append(s)
    if out and out[-1] != " ":
        out.append(" ")
    return [" "] * 3 + out


def test_texts_against_a_slow_version(spark):
    """Predicted language and cross-entropy of whole texts, from counts of letters in plain Python."""
    rng = random.Random(21)
    own = {"xx": ["ka", "tö", "mi", "a"], "yy": ["ka", "en", "mu"], "zz": ["ж", "зу", "ka"]}
    rows = [(i, prose(rng, own[lang], 12) + rng.choice(["", "!", " 1 ", "\n"]), lang) for i, lang in enumerate([*own] * 12)]
    models = language_id.train(docs(spark, rows))
    counts, alphabet = {}, set()
    for lang in own:
        grams = Counter()
        for _, text, spoken in rows:
            if spoken == lang:
                s = naive_symbols(text, None)
                grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
        counts[lang] = {4: grams} | {k: {g[4 - k :]: 1 for g in grams} for k in (1, 2, 3)}
        alphabet |= set(counts[lang][1])
    texts = [t for _, t, _ in rows[:6]] + ["Ka ka; ka", "ж", "  12 !", "", "tö KA mi x", "unknown wörds"]
    got = language_id.identify(docs(spark, list(enumerate(texts))), models).collect()
    assert len(got) == len(texts)
    for r in got:
        s = naive_symbols(texts[r.doc_id], None)
        if len(s) == 3:
            assert r.lang_pred == "und" and r.score == 0
            continue
        h = {}
        for lang in sorted(own):
            p = naive_kneser_ney(counts[lang], language_id.DISCOUNT, len(alphabet))
            h[lang] = float(np.mean([-np.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)]))
        assert r.lang_pred == min(h, key=h.get)
        assert r.cross_entropy == pytest.approx(min(h.values()), rel=1e-5)
        share = {k: np.exp(-(v - min(h.values())) * models.sharpness) for k, v in h.items()}
        assert r.score == pytest.approx(1 / sum(share.values()), rel=1e-4)


def test_limits_come_from_texts_the_tables_do_not_know(spark):
    """A large language leaves a share of its texts out of the counts, copies together; a small one keeps all, and has a limit too."""
    rng = random.Random(22)
    syllables = ["ka", "to", "mi", "len", "shu", "ro", "pe", "da"]
    rows = [(i, prose(rng, syllables, 30), "big") for i in range(600)] + [(1000 + i, prose(rng, ["я", "ж", "зу"], 30), "small") for i in range(30)]
    rows += [(2000 + i, rows[7][1], "big") for i in range(40)]
    models = language_id.train(docs(spark, rows))
    counted = common.stored(docs(spark, rows).where("lang = 'big'"), "t")
    aside = counted.where(F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    assert 20 <= aside.select("text").distinct().count() < 120
    assert np.isfinite(models.entropy_limit).all() and models.langs == ["big", "small"]
    fresh = [(i, prose(rng, syllables, 30)) for i in range(200)]
    out = language_id.identify(docs(spark, fresh + [(900, "qxzv wvqx zzqj xqvw jjqz " * 5)]), models).collect()
    assert sum(r.rejected for r in out if r.doc_id < 200) <= 6 and all(r.rejected for r in out if r.doc_id == 900)


def test_tables_in_parts_are_those_of_all_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, prose(rng, s, 60), lang) for i, (lang, s) in enumerate([("xx", ["ka", "to", "mi"]), ("yy", ["sch", "en", "to"])] * 20)] + [(99, "ый", "rare")]
    letters = language_id.letter_table()
    langs, by = ["rare", "xx", "yy"], {}
    for _, t, lang in rows:
        for g in language_id.grams([t], letters)[0].tolist():
            by[langs.index(lang), g] = by.get((langs.index(lang), g), 0) + 1
    lang, gram = (np.array(x) for x in zip(*by, strict=True))
    whole = language_id.Models(langs, lang, gram.astype(np.uint64), np.array([*by.values()]))
    monkeypatch.setattr(language_id, "PART_VALUES", 40)
    parted = language_id.train(docs(spark, rows))
    assert parted.seen[language_id.ORDER].parts > 5 and parted.langs == langs
    some = np.concatenate((gram.astype(np.uint64), language_id.grams(["kasch zz ый q"], letters)[0]))
    for k in range(1, language_id.ORDER + 1):
        assert (parted.probability(some, k) == whole.probability(some, k)).all()


def test_rare_languages_stay_among_millions_of_grams(spark):
    rng = np.random.default_rng(5)
    big = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 2_100_000)))  # nearly as many 4-grams, each twice below
    rows = [(1, big, "zh"), (2, big, "zh"), (3, "lorem ipsum dolor", "la")]
    models = language_id.train(docs(spark, rows))
    assert models.langs == ["la", "zh"] and len(models.seen[language_id.ORDER].keys) > 2_000_000
    texts = ["ipsum dolor", big[1000:1100]]
    assert models.predict(texts, language_id.letter_table())[0] == ["la", "zh"]


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["grumblefoo", "snarkwibble", "blorptastic"]
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, ["ka", "to", "mi", "len", "shu"], 60).split()
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((100 + i, " ".join(t)))
        labels.append((100 + i, int(toxic)))
    labels += [(None, 1), (101, None), (100, 0)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs(spark, rows), table.where("doc_id is null or doc_id % 4 <> 2 or doc_id % 16 = 2"), toxic=60, ordinary=120, calibration=120)
    out = {(r.doc_id, r.text): r.score for r in toxicity.score(docs(spark, rows + ODD).selectExpr("*", "1 as windows"), model).collect()}
    scores = np.array([out[r] for r in rows])
    assert labelled.ranking(scores, np.arange(400) % 4 == 0) > 0.95
    assert out[1, None] == out[2, ""] == 0
    assert all(0 <= s <= 1 for s in out.values())
    assert toxicity.train(docs(spark, rows), table.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs(spark, rows), None).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_dictionaries_of_few_samples_say_so():
    with pytest.warns(UserWarning, match="is not trained"):
        assert toxicity._dictionary([b" one ", b" two ", b" one "], 1024) == b" one  two "
    rng = random.Random(4)
    samples = [prose(rng, ["ka", "to", "mi", "len"], 20).encode() for _ in range(300)]
    content = toxicity._dictionary(samples, 2048)
    assert 100 < len(content) <= 2048 and content[-8:] in b"".join(samples)
    with pytest.raises(ValueError, match="offsets"):
        toxicity._content(b"\x37\xa4\x30\xec" + bytes(100))


def test_few_labels_take_all_words(spark):
    rows = [(0, "alpha beta gamma"), (1, "alpha beta gamma delta"), (2, "beta alpha"), (3, "")]
    sample = docs(spark, rows).selectExpr("doc_id", "cast(doc_id = 1 as int) as label", "text")
    with pytest.warns(UserWarning, match="all words are taken"):
        found = toxicity.dictionaries(sample)
    assert b" delta " in found.toxic and b" alpha " in found.ordinary


def test_windows_cover_all_words():
    d = toxicity.Distance(b" plain text and much more of it ", b" terribly nasty remarks ", window=3)
    texts = [b"", b"one", b"one two three", b"a b c d nasty", b"terribly nasty remarks " * 10]
    f = d.features(words.cut(texts, words.ALNUM), *d.compressors())
    assert f[:, 0].tolist() == [0, 1, 1, 2, 10]
    assert f[4, -1] > 0


def slow_features(text):
    raw = text.encode()
    w = blanks(text)
    lines = [x for x in (blanks(s) for s in text.replace("\r", "\n").split("\n")) if x]
    grams = lambda k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    n = [len(x.encode()) for x in w]
    out = [sum(b in c for b in raw) / max(len(raw), 1) for c in quality.CLASSES.values()]
    share = lambda x: len(set(x)) / len(x) if x else float(len(w) > 0)
    rest = [np.log1p(len(raw)), np.log1p(len(w)), np.mean(n or [0]), np.std(n or [0]), len(set(w)) / max(len(w), 1), sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(len(w), 1), share(grams(2)), share(grams(3)), len({tuple(x) for x in lines}) / max(len(lines), 1), np.log1p(len(w) / len(lines) if lines else 0)]
    return out + rest


def test_features_by_hand():
    rng = random.Random(5)
    texts = ["", " ", "a", "a a", "A!! b\nA!! b\n\nc", "é é\r\né", "".join(rng.choice(ALPHABET) for _ in range(300)), " ".join(rng.choice("abc") for _ in range(200)), "x\n" * 50]
    raw = [t.encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), words.Powers())
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx(slow_features(t), abs=1e-6), t


def test_additive_model_finds_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000], np.ones(2000), n_pairs=2)
    assert (0, 1) in model.pairs
    assert labelled.ranking(model.score(x[2000:]), y[2000:]) > 0.95
    plain = quality.fit(x[:2000], y[:2000], np.ones(2000), n_pairs=0)
    assert labelled.ranking(plain.score(x[2000:]), y[2000:]) < 0.7


def slow_fit(x, y, weight, rounds, pair_rounds, n_pairs, bins):
    """Boosting as described, a sample and a cut at a time."""
    ridge, rate, n, d = quality.RIDGE, quality.RATE, len(x), len(x[0])
    p = sum(w * v for w, v in zip(weight, y, strict=True)) / sum(weight)
    margin = [np.log(p / (1 - p))] * n
    edges = {k: [sorted(set(np.quantile([r[j] for r in x], [i / k for i in range(1, k)]))) for j in range(d)] for k in (bins, quality.PAIR_BINS)}
    at = lambda k, j, v: sum(v >= e for e in edges[k][j])

    def leaf(members):
        q = {i: 1 / (1 + np.exp(-margin[i])) for i in members}
        g, h = sum(weight[i] * (y[i] - q[i]) for i in members), sum(weight[i] * q[i] * (1 - q[i]) for i in members)
        return g, h

    def worth(members):
        g, h = leaf(members)
        return g * g / (h + ridge)

    for _ in range(rounds):
        for j in range(d):
            place = [at(bins, j, r[j]) for r in x]
            groups = [(0, len(edges[bins][j]) + 1)]
            inside = lambda lo, hi, place=place: [i for i in range(n) if lo <= place[i] < hi]
            for _ in range(2):
                options = [(worth(inside(lo, c)) + worth(inside(c, hi)) - worth(inside(lo, hi)), c, lo, hi) for lo, hi in groups for c in range(lo + 1, hi)]
                if not options:
                    break
                gain, c, lo, hi = max(options, key=lambda o: (round(o[0], 12), -o[1]))
                if gain <= 1e-9:
                    break
                groups = sorted([*(g for g in groups if g != (lo, hi)), (lo, c), (c, hi)])
            steps = [(inside(*g), leaf(inside(*g))) for g in groups]
            for members, (g, h) in steps:
                for i in members:
                    margin[i] += rate * g / (h + ridge)
    cells = {}
    for a, b in [(a, b) for a in range(d) for b in range(a + 1, d)]:
        by = {}
        for i, r in enumerate(x):
            by.setdefault((at(quality.PAIR_BINS, a, r[a]), at(quality.PAIR_BINS, b, r[b])), []).append(i)
        cells[a, b] = sum(worth(m) for m in by.values())
    for _ in range(pair_rounds):
        for a, b in sorted(cells, key=lambda ab: -cells[ab])[:n_pairs]:
            place = [(at(quality.PAIR_BINS, a, r[a]), at(quality.PAIR_BINS, b, r[b])) for r in x]
            options = []
            for c in range(1, len(edges[quality.PAIR_BINS][a]) + 1):
                for e in range(1, len(edges[quality.PAIR_BINS][b]) + 1):
                    quarters = [[i for i in range(n) if (place[i][0] >= c, place[i][1] >= e) == q] for q in ((False, False), (False, True), (True, False), (True, True))]
                    options.append((round(sum(worth(m) for m in quarters), 12), -c, -e, quarters))
            steps = [(m, leaf(m)) for m in max(options, key=lambda o: o[:3])[3]]
            for members, (g, h) in steps:
                for i in members:
                    margin[i] += rate * g / (h + ridge)
    return 1 / (1 + np.exp(-np.array(margin)))


def test_boosting_against_a_slow_version():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((50, 3)), 2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    weight = np.where(y == 1, 1.5, 0.5)
    model = quality.fit(x, y, weight, rounds=3, pair_rounds=2, n_pairs=2, bins=6)
    assert model.score(x) == pytest.approx(slow_fit(x.tolist(), y.tolist(), weight.tolist(), 3, 2, 2, 6), abs=1e-9)


def test_quality(spark):
    rng = random.Random(7)
    rows = [(100 + i, prose(rng, ["ka", "to", "mi"], 60) if i % 3 else "BUY!! NOW!! " * 30) for i in range(300)]
    labels = spark.createDataFrame([(i, int((i - 100) % 3 > 0)) for i, _ in rows] + [(None, 1), (101, None), (5000, 1)], "doc_id long, quality int")
    model = quality.train(docs(spark, rows), labels.where("doc_id is null or doc_id % 5 <> 0"))
    table = docs(spark, rows + ODD).selectExpr("*", "'x' as label", "2 as score")
    out = {(r.doc_id, r.text): r.score for r in quality.score(table, model).collect()}
    assert all((out[i, t] >= quality.CUTOFF) == ((i - 100) % 3 > 0) for i, t in rows)
    assert out[1, None] == out[2, ""]
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns
    assert sum(r.doc_id is not None and r.doc_id >= 100 for r in kept.collect()) == 200
    assert quality.train(docs(spark, rows), labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.score(docs(spark, []), model).count() == 0


def test_folds(spark):
    rows = [(i,) for i in range(50)] + [(None,)]
    got = spark.createDataFrame(rows, "doc_id long").select("doc_id", common.in_fold("doc_id", 4, 2).alias("x")).collect()
    assert all(r.x == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_toxicity_scores_by_brute_force(spark):
    rng = random.Random(8)
    bad = ["grumblefoo", "snarkwibble", "blorptastic"]
    rows, labels = [], []
    for i in range(300):
        t = prose(rng, ["ka", "to", "mi", "len", "shu"], rng.randrange(1, 80)).split()
        if i % 4 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t) + 1), rng.choice(bad).upper())
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"grumblefoo" in model.distance.toxic and len(model.distance.ordinary) > 100
    assert b"grumblefoo" not in model.distance.ordinary
    plain, toxic = model.distance.compressors()
    want = {}
    for d, t in ODD + rows:
        w = [x.encode() for x in alnum(t)]
        saved = []
        for i in range(0, len(w), 8):
            window = b" " + b" ".join(w[i : i + 8]) + b" "
            saved.append(len(plain(window)) - len(toxic(window)))
        n = sum(x >= model.threshold for x in saved)
        if saved:
            x = [math.log1p(n), math.sqrt(n / len(saved)), min(max(0, *saved, 0), 12) / 12, math.log1p(len(saved)), 1]
            score = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))
        else:
            score = 0.0
        want.setdefault((d, t), (len(saved), n, pytest.approx(score)))
    got = toxicity.score(docs(spark, ODD + rows), model).collect()
    assert len(got) == len(ODD) + len(rows)
    for r in got:
        assert (r.windows, r.toxic_windows, r.score) == want[r.doc_id, r.text]


def test_copies_and_short_texts_of_toxicity():
    long = [b"wonderful", b"marvellous", b"excellent", b"brilliant", b"a"]
    rows = [(1, long), (1, [*long, b"b"]), (0, long), (1, [b"you", b"scum"]), (1, [b"you", b"fool"]), (1, [b"you", b"fool"])]
    assert [len(list(toxicity._one_for_copies(rows[:k]))) for k in range(1, 7)] == [1, 1, 2, 3, 4, 4]
