import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

from rankloom.functions.text import tokenize
from rankloom.operators import lexical, nearest, postings, substring
from rankloom.plans.lexical import bm25_search, substring_search

DOCS = [
    (0, "the cat sat on the mat"),
    (1, "the dog sat"),
    (2, "a cat and a dog and a bird"),
    (3, "nothing here"),
    (4, "the the the"),
    (5, ""),
    (6, None),
    (7, "bird song at dawn"),
]
QUERIES = [(0, "cat the the"), (1, "dog"), (2, "zebra"), (3, ""), (4, "bird song")]


def frames(spark, docs=DOCS, queries=QUERIES):
    return spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(
        docs, "doc_id long, text string"
    )


def direct_bm25(docs, queries, k, fill, k1=1.5, b=0.75, eps=0.25):
    split = {d: (t or "").split() for d, t in docs}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(t for words in split.values() for t in set(words))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    out = []
    for q, text in queries:
        scores = {}
        for d, words in split.items():
            tf = Counter(words)
            if not fill and not set(text.split()) & set(words):
                continue
            scores[d] = sum(
                idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(words) / mean)) for t in text.split()
            )
        order = sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:k]
        out += [(q, d, round(scores[d], 6), i) for i, d in enumerate(order, 1)]
    return sorted(out)


def close(got, want):
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_tokens_are_those_of_python(spark):
    odd = "a b c\x1cd\x85e　f \t g​h\v"
    _, corpus = frames(spark, [(1, odd), (2, "  "), (3, None)])
    got = {r[0]: r[1] for r in corpus.select("doc_id", tokenize(corpus["text"])).collect()}
    assert got == {1: odd.split(), 2: [], 3: []}


@pytest.mark.parametrize("fill", [False, True])
@pytest.mark.parametrize("k", [1, 3, 100])
def test_bm25_equals_direct(spark, fill, k):
    queries, corpus = frames(spark)
    close(rows_of(bm25_search(queries, corpus, k, fill)), direct_bm25(DOCS, QUERIES, k, fill))


def test_bm25_with_negative_mean_idf(spark):
    """Most terms in most documents: matches rank below documents without one."""
    docs = [(i, "a b c") for i in range(6)] + [(6, "x"), (7, "a b")]
    asked = [(0, "a"), (1, "x"), (2, "a x")]
    queries, corpus = frames(spark, docs, asked)
    for k in (1, 2, 5, 20):
        close(rows_of(bm25_search(queries, corpus, k, True)), direct_bm25(docs, asked, k, True))


def test_bm25_empty_corpus(spark):
    queries, corpus = frames(spark)
    assert bm25_search(queries, corpus.limit(0), 5, False).count() == 0
    assert bm25_search(queries, corpus.limit(0), 5, True).count() == 0


@pytest.mark.parametrize("docs_in_block", [2, 512])
def test_bm25_from_a_stored_index(spark, tmp_path, monkeypatch, docs_in_block):
    monkeypatch.setattr(postings, "BLOCK_DOCS", docs_in_block)
    queries, corpus = frames(spark)
    path = str(tmp_path / "index")
    lexical.write_index(corpus.repartition(2), path)
    for fill in (False, True):
        for k in (1, 5):
            got = bm25_search(queries, None, k, fill, index=path)
            close(rows_of(got), direct_bm25(DOCS, QUERIES, k, fill))


@pytest.mark.parametrize("fill", [False, True])
def test_bm25_in_query_blocks_with_seeds(spark, monkeypatch, fill):
    monkeypatch.setattr(nearest, "SEED_SPLITS", 0)
    queries, corpus = frames(spark)
    for k in (1, 3):
        close(rows_of(bm25_search(queries, corpus.repartition(5), k, fill, block_bytes=700)), direct_bm25(DOCS, QUERIES, k, fill))


@pytest.mark.parametrize("seeds", [0, 256])
def test_bm25_ties_and_blocks(spark, monkeypatch, seeds):
    """Many copies, blocks of three documents, lists of random words, several tasks."""
    monkeypatch.setattr(nearest, "SEED_SPLITS", seeds)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 9)))) for i in range(150)]
    docs += [(i, "a b") for i in range(150, 300)]
    asked = [(i, " ".join(rng.choice("abcdefgxy") for _ in range(rng.randint(0, 4)))) for i in range(12)]
    queries, corpus = frames(spark, docs, asked)
    for k in (4, 40, 400):
        close(rows_of(bm25_search(queries, corpus.repartition(7), k, True)), direct_bm25(docs, asked, k, True))
        close(rows_of(bm25_search(queries, corpus.repartition(7), k, False)), direct_bm25(docs, asked, k, False))


def test_bounds_skip_blocks():
    """A block whose bounds cannot reach the k-th best score is ruled out, others are not."""
    weights = (np.array([0, 1]), np.array([0, 1]), np.array([2.0, -1.0]))
    scorer = postings.Scorer(weights, 2, 1, 4.0, 1.5, 0.75, 6, True)
    first = postings.Block([1, 2], [1, 2], [4, 4], np.array([0]), np.array([0]), np.array([9]))
    scorer.add(first)
    assert scorer.bar[0] > 0 and scorer.bar[1] == 0
    assert scorer.asking(np.array([0]), np.array([1.0]), np.array([4.0])).tolist() == [False, True]
    assert scorer.asking(np.array([0, 1]), np.array([20.0, 1.0]), np.array([1.0, 4.0])).tolist() == [True, True]


def test_corpus_order_breaks_ties(spark):
    queries, corpus = frames(spark, [(0, "x"), (1, "x"), (2, "y"), (3, "y"), (4, "y")], [(0, "x"), (1, "none")])
    backwards = corpus.withColumn("pos", -corpus["doc_id"])
    got = bm25_search(queries, backwards, 3, True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(0, 1), (0, 0), (0, 4), (1, 4), (1, 3), (1, 2)]


CHUNKS = [(1, "t1", "the Cat sat"), (2, "t2", "cat cat"), (3, None, None), (4, "t4", ""), (5, "t5", "abc.*x")]
TEXTS = [(1, "cat"), (2, "at"), (3, ""), (4, None), (5, ".*"), (6, "at"), (7, "zzz")]


@pytest.mark.parametrize("bound", [50_000, 2])
@pytest.mark.parametrize("automaton", [True, False])
def test_substring_join(spark, monkeypatch, bound, automaton):
    chunks = spark.createDataFrame(CHUNKS, "id long, title string, body string")
    queries = spark.createDataFrame(TEXTS, "query_id long, text string")
    want = [(q, c) for q, t in TEXTS for c, _, b in CHUNKS if t is not None and b is not None and t in b]
    if not automaton:
        table, rows = queries.filter("text is not null").toArrow(), chunks.filter("body is not null").toArrow()
        who, where = substring._matches(table.column("text").to_pylist(), None, rows.column("body"))
        found = zip(table.column("query_id").take(who).to_pylist(), rows.column("id").take(where).to_pylist())
        assert sorted(found) == sorted(want)
        return
    got = substring.substring_join(queries, chunks, bound).select("query_id", "id")
    assert rows_of(got) == sorted(want)
    counts = substring.match_counts(queries, got)
    assert {r[0]: r[1] for r in counts.collect()} == {q: sum(1 for w in want if w[0] == q) for q, _ in TEXTS}


def test_substring_filter_and_lines(spark):
    chunks = spark.createDataFrame(CHUNKS, "id long, title string, body string")
    assert rows_of(substring.substring_filter(chunks, "cat")) == [("t2", "cat cat")]
    lines, counts = substring_search(spark.createDataFrame([(1, "at")], "query_id long, text string"), chunks)
    assert [r.line for r in lines.orderBy("rank").collect()] == ["1. t1\nthe Cat sat", "2. t2\ncat cat"]
    assert counts.first().n_results == 2
