"""License scans against edit distances of all word ranges."""

import random
import re

import pytest

from plumbline.llm import licenses as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(text, base, fuzzy):
    words = words_of(text)
    places = [(i, n.label) for n in base for i in range(len(words)) if words[i : i + len(n.words.split())] == n.words.split()]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for n in fuzzy:
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + len(n.words.split()) + n.errors) + 1):
                span = " ".join(words[i:j])
                if abs(len(span) - len(n.words)) <= n.errors and (d := distance(span, n.words)) <= n.errors:
                    labels.add(n.label)
                    score = max(score, 1 - d / len(n.words))
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def spoilt(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        k = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            del s[k]
        elif kind == 1:
            s.insert(k, rng.choice("abcx é"))
        else:
            s[k] = rng.choice("abcx é")
    return "".join(s)


def texts(seed=2):
    rng = random.Random(seed)
    filler = ["the", "license", "public", "mit", "general", "Straße", "日本", "x1", "of", "copy"]
    out = [None, "", " ", "MIT License", "MIT-License, mit LICENSE", "gnu general public license", "é" * 300, "word " * 4000 + "mit license", "licensed under the", "Mit license mit license"]
    for n in L.FUZZY:
        for extra in (0, 1, n.errors, n.errors + 1, n.errors + 3):
            out.append(" ".join(rng.choices(filler, k=rng.randint(0, 6))) + " " + spoilt(rng, n.words, extra) + " " + " ".join(rng.choices(filler, k=rng.randint(0, 6))))
    return out


def test_scan(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    rows += [rows[3], (None, "mit license"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0, 3) for i, t in rows], "doc_id long, text string, id string, n_words int, score double, labels int").repartition(3)
    got = L.scan_licenses(df).drop("notices").collect()
    want = [(i, *brute(t, L.BASE, L.FUZZY)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_matches_have_spans(spark):
    text = "Intro. Released under the MIT Licence! And redistribution, and use in source or binary forms, with or without modification, are permitted."
    (row,) = L.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(m["label"], m["begin"], m["until"], m["edits"]) for m in row["notices"]] == [("mit", 1, 6, 1), ("bsd", 7, 21, 3)]
    assert row["base_labels"] == "" and row["labels"] == "bsd,mit" and row["n_base"] == 0


def test_both_sides_of_the_best_match():
    s = L.Search((L.Notice("mozilla public license", "mpl", 2),))
    data = L.canonical("mozila public license mozilla public license mozilla publik licence")
    assert [e for *_, e in s.find(data)] == [1, 0, 2]


def test_pieces_cover_and_seeds_suffice():
    for n in (1, 2, 5):
        parts = L.pieces("mozilla public license", n)
        assert "".join(p for _, p in parts) == "mozilla public license" and len(parts) == n
    with pytest.raises(ValueError):
        L.Search((L.Notice("abcd", "x", 2),))


def test_nothing(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
