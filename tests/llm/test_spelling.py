"""Spelling variants against brute force, with crowded keys and odd rows."""

import collections
import itertools
import re
import zlib

import pytest

from cirrostrat.llm import spelling

from .helpers import LOWER, ODD, docs


def counted(rows):
    out = collections.Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def table(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words(spark):
    rows = [*ODD, *((i, "Straße STRASSE straßé×÷ Ünïcödé longest longer short " * 3 + "a") for i in range(400)), (500, "-".join(["broken"] * 9))]
    df = docs(spark, rows).selectExpr("*", "1 as word", "2 as n", "3 as key")
    assert {r.word: r.n for r in spelling.words_of(df).collect()} == counted(rows)
    assert spelling.words_of(docs(spark, [])).count() == 0
    assert spelling.variants(spelling.words_of(docs(spark, []))).count() == 0


@pytest.mark.parametrize("crowd", [2, 8, 128])
def test_variants(spark, crowd):
    """Words over few letters, so that halves are shared by very many; each crowd cuts keys to another depth."""
    letters = "abé"
    words = {"".join(x): 5 + 7 ** (i % 5) for i, x in enumerate(itertools.product(letters, repeat=6))}
    words |= {"".join(x) + "ab": 5 + i * i % 900 for i, x in enumerate(itertools.product(letters, repeat=5))}
    words |= {"x" * 40: 5, "x" * 41: 25, "x" * 39: 5, "x" * 20 + "y" + "x" * 20: 700, "commonword": 100, "comonword": 20, "comnword": 4, "comonwird": 19}
    words["comnword"] = 5
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert table(spelling.variants(df, crowd=crowd)) == brute(words)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("v", "w05"), ("u", "v")]
    assert {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {w: "w20" for w, _ in chain}
