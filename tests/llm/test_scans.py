import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.llm import decontaminate, licenses, words

from .helpers import ODD, alnum, docs


def windows(words, n):
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_by_brute_force(spark, block):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [("a", " ".join(rng.choice(vocabulary) for _ in range(20))), ("b", "Short one"), ("c", None), ("d", ""), (None, "nameless item"), ("e", " ".join(rng.choice(vocabulary) for _ in range(8)))]
    rows = list(ODD)
    for i in range(40):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _, item in rng.sample(items, 2):
            at = rng.randrange(len(t) + 1)
            own = alnum(item)
            lo = rng.randrange(len(own) + 1)
            t[at:at] = own[lo : lo + 15] if rng.random() < 0.7 else own
        rows.append((100 + i, "; ".join(t)))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    table = docs(spark, rows).selectExpr("*", "1 as n_words", "2 as items")
    out = decontaminate.scan(table, benchmark, n=5, block_bytes=block).collect()
    assert len(out) == len(rows)
    for r in out:
        w, hit, named = alnum(r.text), set(), set()
        for name, item in items:
            for g in windows(alnum(item), 5):
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        named.add(name or "")
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(named))
        assert {i for a, b in r.spans for i in range(a, b)} == hit


def test_removal(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five")], "item_id int, text string")
    rows = [(1, "keep this. One, two three FOUR five! and this"), (2, "clean text " * 100), (3, None), (4, "one two three four five " + "other words " * 100)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), benchmark, n=3).collect()) == [2, 3, 4]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs(spark, rows), benchmark, n=3, remove="spans").collect()}
    assert spans[1] == "keep this. ! and this"
    assert spans[2] == rows[1][1]
    empty = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.decontaminate(docs(spark, rows), empty).count() == 4
    assert decontaminate.decontaminate(docs(spark, []), benchmark).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs(spark, rows), benchmark, remove="other")


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["gnu", "general", "public", "license", "Apache", "license", "CC-BY", "cc", "by", "MIT", "mit license", "x", "yé"]
    rows = ODD + [(100 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(60)]
    phrases = {"gpl": ["gnu", "general", "public", "license"], "apache": ["apache", "license"], "cc-by": ["cc", "by"], "mit": ["mit", "license"]}
    out = licenses.scan(docs(spark, rows).withColumn("labels", F.lit(1))).collect()
    assert len(out) == len(rows)
    left = list(rows)
    for r in out:
        own = next(t for t in left if t[0] == r.doc_id and len(alnum(t[1])) == r.n_words)
        left.remove(own)
        w = alnum(own[1])
        found = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        assert r.n_base == len(found)
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_templates_bridge_small_changes(spark):
    text = "Redistribution and use in source and compiled binary forms, with or without modification, are permitted provided that following conditions are met"
    r = licenses.scan(docs(spark, [(1, "before it " + text), (2, "redistribution of source forms"), (3, "Licensed under the Apache License, Version 2.0.")])).orderBy("doc_id").collect()
    assert r[0].labels == "bsd" and r[0].base_labels == ""
    assert r[1].labels == "" and r[1].score == 0
    assert r[2].labels == "apache,apache-2.0" and r[2].first_word == 3
    assert licenses.scan(docs(spark, [])).count() == 0


def test_long_templates_and_chunks(spark):
    whole = next(t for t in licenses.TEMPLATES if t.label == "mit-whole")
    w = whole.words()
    assert len(w) > 150
    rng = random.Random(3)
    prose = lambda n: [rng.choice(["of", "the", "software", "lorem", "ipsum", "and"]) for _ in range(n)]
    body = w[30:]  # without its opening
    changed = [x for i, x in enumerate(w) if i not in (40, 90)]
    rows = [(101, " ".join(prose(50) + w + prose(9))), (102, " ".join(prose(7) + changed)), (103, " ".join(body)), (104, " ".join(prose(400)))]
    outs = []
    for chunk in (7, 64, 1 << 14):
        outs.append({r.doc_id: tuple(r) for r in licenses.scan(docs(spark, ODD[:7] + rows), chunk=chunk).collect()})
    assert outs[0] == outs[1] == outs[2]
    labels = {d: r[6].split(",") for d, r in outs[0].items()}
    assert {"mit-whole", "mit-text"} <= set(labels[101]) and "mit-whole" in labels[102] and "mit-whole" in labels[103]
    assert labels[104] == [""]


def test_windows_with_one_hash(monkeypatch):
    """Every window has the same hash; words tell them apart."""
    monkeypatch.setattr(words, "grams", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))
    items = [("a", "x y z w"), ("b", "y z w v"), ("a", "q r"), ("c", "x y z")]
    found = decontaminate.WindowSet(items, 3)
    text = words.cut([b"x y z w v q r x"], words.ALNUM)
    got = {(w, k, tuple(sorted(found.names[i] for i in named))) for w, k, named in found.scan(text, words.Powers())}
    assert got == {(0, 3, ("a", "c")), (1, 3, ("a", "b")), (2, 3, ("b",)), (5, 2, ("a",))}
