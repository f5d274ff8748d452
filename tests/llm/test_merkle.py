"""The manifest against a tree built in plain Python, and single proofs against changes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, pos string, grp string, root int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    key, text, lang, source, n = row
    return h(*map(field, (key, source, lang, None if n is None else n + more, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        yield (level[at ^ 1], at & 1) if at ^ 1 < len(level) else None
        at >>= 1


def brute_force(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    sorted_rows = {x: sorted(langs[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in order}
    trees = {x: tree([leaf_of(r) for r in sorted_rows[x]]) for x in order}
    top = tree([trees[x][-1][0] for x in order])
    root = top[-1][0]
    for i, x in enumerate(order):
        for at, row in enumerate(sorted_rows[x]):
            steps = [*path(trees[x], at), *path(top, i)]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf_of(row, int(changed))
            for step in steps:
                folded = h(folded) if step is None else h(step[0], folded) if step[1] else h(folded, step[0])
            proof = h(*[s[0] for s in steps if s])
            yield row[0], leaf_of(row), trees[x][-1][0], root, proof, folded, folded == root


def rows(n):
    rng = random.Random(n)
    langs = ["en", "en", "en", "de", None, "", "zz", "é"]
    some = [(i if rng.random() < 0.97 else None, "t" * rng.randint(0, 9), rng.choice(langs), None, rng.choice([None, 4])) for i in range(n)]
    return [*some, *some[:3], (5, None, None, None, None), (6, "long " * 30_000, "en", "ß", 150_000)]


@pytest.mark.parametrize("n, levels", [(0, 12), (60, 12), (60, 2), (130, 1)])
def test_against_brute_force(spark, n, levels):
    data = rows(n)
    docs = spark.createDataFrame([(*r, 1, "x", "g", 2) for r in data], SCHEMA).repartition(3)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    got = [tuple(r) for r in merkle.manifest(docs, levels, tampered).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute_force(data), key=str)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(docs.limit(0)).count() == 0
    only = merkle.manifest(docs).first()
    assert only.leaf == only.subroot == only.root == only.folded_root == leaf_of((1, "a", "en", "s", 1))
    assert only.proof_sha256 == h("") and only.verified


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 13])
def test_appender_and_fold(n):
    leaves = [h(str(i)) for i in range(n)]
    grown = merkle.Appender()
    for leaf in leaves:
        grown.append(leaf)
    root = grown.finish()
    assert root == tree(leaves)[-1][0]
    for i, leaf in enumerate(leaves):
        assert merkle.fold(leaf, grown.witness[i], i, n) == (root, len(grown.witness[i]))
        assert merkle.fold(h("other"), grown.witness[i], i, n)[0] != root
