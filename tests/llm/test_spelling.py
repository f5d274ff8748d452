"""Spelling variants against all pairs."""

import collections
import os
import random
import re
import zlib

import pytest

from rankloom.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def neighbours(counts):
    found = {}
    by_length = collections.defaultdict(list)
    for word in counts:
        by_length[len(word)].append(word)
    for a in counts:
        some = [b for k in (-1, 0, 1) for b in by_length[len(a) + k] if near(a, b)]
        if some:
            best = min(some, key=lambda b: (-counts[b], b))
            found[a] = (len(some), best, counts[best])
    return found


def brute_force(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    found = neighbours(counts)
    form = {w: b for w, (_, b, n) in found.items() if n >= 10 * counts[w]}
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        yield word, form.get(word), root, n, found.get(word, (0,))[0], counts[form[word]] if word in form else None


@pytest.mark.parametrize("most, cells", [(1024, 1 << 16), (128, 1 << 16), (1024, 200)])
def test_dense_words(spark, most, cells):
    rng = random.Random(3)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randint(7, 10))) for _ in range(900)}
    words |= {"x" * 40 + "abc", "x" * 41 + "abc", "x" * 40 + "abd", "internationally", "internationaly", "nternationally"}
    words |= {"same" * 2_000, "same" * 2_000 + "s", "b" + "same" * 2_000}
    counts = {w: rng.choice([2, 2, 3, 40, 500]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_words(df, most, cells).collect()}
    assert got == neighbours(counts)


def test_made_up_texts(spark):
    rng = random.Random(5)
    base = ["international", "Überraschung", "naïveté", "ÀÉÎÕÜÿ×÷", "straßenbahn", "aaaaaaa", "aaaaaaaa", "aaaaaab", "short"]
    rows = []
    for key in range(400):
        some = []
        for _ in range(rng.randint(0, 12)):
            word = rng.choice(base)
            if rng.random() < 0.2:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "x", word[at] * 2]) + word[at + 1 :]
            some.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((key, rng.choice([" ", ", ", "1"]).join(some)))
    rows += [(1, None), (2, ""), (None, "international " * 30), (None, "international " * 30), (9, "internationál " * 9)]
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "doc_id long, text string, word string, n int, key string")
    got = [tuple(r) for r in spelling.variants(docs, most=64).collect()]
    expected = list(brute_force(rows))
    assert sorted(got) == sorted(expected, key=lambda r: r[0])
    assert any(r[1] for r in expected)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_paths_of_several_steps(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", None), ("x", "c"), ("y", None)]
    df = spark.createDataFrame([(w, f, 1, 1, 1) for w, f in rows], "word string, form string, n int, n_near int, form_n int")
    got = {r.word: r.root for r in spelling._rooted(df).collect()}
    assert got == {"a": "e", "b": "e", "c": "e", "d": "e", "e": "e", "x": "e", "y": "y"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got) == sorted(brute_force(rows), key=lambda r: r[0])
