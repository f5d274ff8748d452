"""The operators against brute force, exact values or held-out accuracy, on small inputs."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import components, decontaminate, langid, lm, minhash, mixing, passages, pii, quality, sharding, simhash

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
DOCS = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def made_up(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    want = Sets()
    for a, b in edges:
        if a != b:
            want.join(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, want.find(x)) for x in want.up)


@pytest.mark.parametrize(("max_bits", "block"), [(4, 2048), (4, 8), (1, 2048), (0, 2048), (6, 16)])
def test_simhash_links(spark, max_bits, block):
    rng = random.Random(max_bits)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(x)
            for b in rng.sample(range(64), rng.randint(0, max_bits + 1)):
                x ^= 1 << b
    values = sorted(values)
    want = Sets()
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= max_bits:
                want.join(a, b)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = Sets()
    for r in simhash.links(spark.createDataFrame(signed, "fp long"), max_bits, block).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (want.find(a), want.find(a)) == (want.find(b), want.find(a))
        got.join(a, b)
    assert all(got.find(a) == want.find(a) for a in values)


def test_simhash_fingerprint():
    for text in ["", "A b", "a b c d", "The cat the cat the cat the cat sat", " ".join(made_up(random.Random(1), 300)), "É x É"]:
        words = split(text)
        runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def luhn(digits):
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def base_spans(text):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base(spark):
    rng = random.Random(9)
    texts = [
        "a@b.c_d@e.f x@y x@y.z.w- éé q@r.s",
        "a@b@c.d a.b@c..d",
        "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.001 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111 1111 1111 1111 2",
        "+1 (988) 555-2485 orthen +1 2 +123456789012345678 +49.30.1234567(",
        "é😀+1 (988) 555-2485 é a@b.co 1.2.3.4",
        " a@b.co  4.4.4.4",
        "9" * 3000 + " " + "a" * 3000 + "@" + "." * 50,
        "1 " * 2000,
    ]
    texts += ["".join(rng.choice("ab1.@+ -(5é") for _ in range(60)) for _ in range(150)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert got[i].spans.startswith(want[:6]) or got[i].n_found
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == (want.count(":") // 2)


def test_pii_discovers(spark):
    rows = [f"you can call me at +1 (555) 123-4{i}67 any day" for i in range(10, 40)]
    rows += ["please call me at 555-0199-x22, thanks", "the year of 12345 and call it 77777 now", "nobody ever met 98765 here"]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), DOCS)).collect()}
    assert [got[i].n_found for i in range(33)] == [0] * 30 + [1, 0, 0]
    kind, start, end = got[30].spans.split(":")
    assert kind == "phone" and rows[30][int(start) : int(end)] == "555-0199-x22"


def test_pii_occurrences(spark):
    """Word pairs are counted before they meet the contexts: the join makes a row for each context, not for each occurrence."""
    texts = ["call me at 5", "you can call me at +1 (555) 123-4567 or call me at 7", "at", "", "call me"] * 7
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    words = {name: F.xxhash64(F.array(*map(F.lit, name.split()))) for name in ("call me", "me at", "call", "at", "not there")}
    named = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), h.alias("pattern")) for n, h in words.items()))).alias("c")).select("c.*")
    found = pii._occurrences(rows, named.select("pattern"))
    got = {r.name: r.total for r in found.join(named, "pattern").collect()}
    assert got == {"call me": 21, "me at": 21, "call": 14}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") < plan.index("Generate explode")


def test_pii_unknown_identifiers(spark):
    """Numbers that fail the card check are found after words that cards follow, at the right place, and no others."""
    rng = random.Random(31)

    def number(good):
        while True:
            digits = "".join(rng.choice("0123456789") for _ in range(16))
            if luhn(digits) == good:
                return digits

    rows, want = [], {}
    for i in range(600):
        words = made_up(rng, rng.randint(2, 30))
        kind = i % 3
        value = number(kind == 0) if kind < 2 else f"{rng.randint(1000, 99999)}-{rng.randint(10, 99)}"
        lead = " ".join(words) + "\n(é😀 " + rng.choice(["card", "charge", "paid"] if kind < 2 else ["card", "page", "paid"])
        text = f"{lead}:  {value}, " if i % 2 else f"{lead} {value} " + " ".join(made_up(rng, 5))
        if kind == 1:
            want[i] = f"card:{text.index(value)}:{text.index(value) + 16}"
        rows.append((i, text))
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    found = {i: r.spans for i, r in got.items() if r.n_found}
    assert all(want.get(i) == spans for i, spans in found.items())
    assert len(found) >= 0.9 * len(want)


def test_passages(spark):
    rng = random.Random(4)
    shared, edited = made_up(rng, 70), None
    edited = list(shared)
    edited[35] = "changed"
    rows = [made_up(rng, 300) for _ in range(12)]
    rows[1][100:100] = shared
    rows[4][10:10] = shared
    rows[7][200:200] = edited
    rows[8] = list(rows[9])
    rows[10][5:5] = shared[:49]  # too short
    rows.append(["same"] * 400)
    rows.append(["same"] * 300)
    texts = [" ".join(r) for r in rows]
    got = passages.repeated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in got}
    joined = Sets()
    for a, b in map(tuple, pairs):
        joined.join(a, b)
    assert joined.find(1) == joined.find(4) == joined.find(7) and joined.find(8) == joined.find(9) and joined.find(12) == joined.find(13)
    assert {x for p in pairs for x in p} == {1, 4, 7, 8, 9, 12, 13}
    for r in got:
        a, b = rows[r.doc_id][r.start : r.end], rows[r.other_id][r.other_start : r.other_end]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert min(len(a), len(b)) >= 50 and abs(r.similarity - len(x & y) / len(x | y)) < 1e-9 and r.similarity >= 0.8
        if {r.doc_id, r.other_id} == {1, 4}:
            assert r.end - r.start >= 70


def test_passages_have_all_their_links(spark):
    """Any two of the texts that share a passage have a row, not just each with the first and the one before it."""
    rng = random.Random(14)
    shared = made_up(rng, 70)
    rows = [made_up(rng, 150) for _ in range(14)]
    for i in range(2, 14):
        rows[i][5 * i : 5 * i] = shared
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], DOCS)
    got = passages.repeated(docs).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == {frozenset((i, j)) for i in range(2, 14) for j in range(2, i)}
    assert {r.class_id for r in got} == {2}


def test_passages_of_a_large_group(spark):
    """Pairs that share a passage are found among many texts that share a stretch of it that is too short."""
    rng = random.Random(15)
    core = made_up(rng, 48)
    rows, pairs = [made_up(rng, 160) for _ in range(60)], {frozenset((i, i + 30)) for i in range(0, 30, 2)}
    for i in range(30):
        longer = core + made_up(rng, 4)
        for j in (i, i + 30):
            rows[j][80:80] = longer if i % 2 == 0 else core
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], DOCS)
    got = passages.repeated(docs).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == pairs
    assert all(r.class_id == min(r.doc_id, r.other_id) and r.similarity >= 0.8 for r in got)


def test_changed_passages_of_a_large_group(spark):
    """Pairs that are alike with a change inside every 50 words are found among many texts with the same smallest shingles."""
    rng = random.Random(21)
    core, rows, n = made_up(rng, 60), [made_up(rng, 90) for _ in range(160)], 80
    for i in range(n):
        own = list(core)
        for at in (20 + i % 6, 34 + i % 7):
            own[at] = f"own{i}"
        rows[i][40:40] = own
        rows[i + n][40:40] = [*own[:30], f"other{i}", *own[31:]]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], DOCS)
    got = passages.repeated(docs).collect()
    alike, split_rows = Sets(), [{tuple(r[40:100][i : i + 5]) for i in range(56)} for r in rows]
    for i in range(2 * n):
        for j in range(i):
            if jaccard(split_rows[i], split_rows[j]) >= 0.8:
                alike.join(i, j)
    assert all(alike.find(i) == alike.find(i + n) for i in range(n)) and len({alike.find(i) for i in range(n)}) == n
    assert {x: r.class_id for r in got for x in (r.doc_id, r.other_id)} == {i: alike.find(i) for i in range(2 * n)}


def test_alike_windows_are_connected():
    """The classes of a group are those of ``align`` asked for all pairs, with shingles that come twice and without."""
    rng = np.random.default_rng(22)
    for number in range(40):
        base, lists = rng.integers(0, 2**31, rng.integers(50, 92)).astype(np.int32), []
        for k in range(14):
            x = base.copy()
            x[rng.integers(0, len(x), rng.integers(0, 14))] = rng.integers(0, 2**31)
            edge = rng.integers(0, 2**31, rng.integers(0, 20)).astype(np.int32)
            x = np.concatenate([edge, x[rng.integers(0, 8) :]])
            lists.append(np.concatenate([x, x[:30]]) if number % 4 == 0 and k % 3 == 0 else x)
        flat, size = np.concatenate(lists), np.array([len(x) for x in lists])
        known = passages.connecting(flat, size, 46)
        want, got = Sets(), Sets()
        for i in range(14):
            for j in range(i):
                if (j, i) in known or (i, j) in known or passages.align(lists[i], lists[j], 46, 0.8):
                    want.join(i, j)
        for i, j in known + passages.alike(flat, size, 46, 0.8, known):
            got.join(i, j)
        assert [want.find(i) for i in range(14)] == [got.find(i) for i in range(14)]


def test_connecting():
    """Windows with a common run are connected, directly or over others, and no others are."""
    rng = np.random.default_rng(16)
    pieces = rng.integers(-(2**31), 2**31, (6, 12)).astype(np.int32)
    lists = []
    for _ in range(80):
        middle = pieces[rng.integers(0, 6)][rng.integers(0, 6) :][: rng.integers(3, 13)]
        lists.append(np.concatenate([rng.integers(0, 99, rng.integers(8, 14)), middle, rng.integers(0, 99, rng.integers(0, 5))]).astype(np.int32))
    runs = [{x[i : i + 8].tobytes() for i in range(len(x) - 7)} for x in lists]
    want, got = Sets(), Sets()
    for i in range(80):
        for j in range(i):
            if runs[i] & runs[j]:
                want.join(i, j)
    found = passages.connecting(np.concatenate(lists), np.array([len(x) for x in lists]), 8)
    assert found and all(runs[i] & runs[j] and j < i for i, j in found)
    for i, j in found:
        got.join(i, j)
    assert [want.find(i) for i in range(80)] == [got.find(i) for i in range(80)]


def test_align_sorts_each_side_once(monkeypatch):
    """The passages are those of plain set operations; numpy's set functions, which sort for every question, are not called."""
    rng = np.random.default_rng(17)
    pairs, want = [], []
    for _ in range(300):
        x = rng.integers(-(2**31), 2**31, rng.integers(30, 140)).astype(np.int32)
        y = np.concatenate([x[:0], *(rng.integers(0, 9, rng.integers(0, 12)).astype(np.int32) for _ in range(2)), x[rng.integers(0, 20) :]])
        y[rng.integers(0, len(y), rng.integers(0, 8))] = 5
        pairs.append((x, y))

    def stretch(hit, density):
        gains = np.cumsum([0.0, *np.where(hit, 1 - density, -density)])
        last = int(np.argmax(gains[1:] - np.minimum.accumulate(gains[:-1])))
        return int(np.argmin(gains[: last + 1])), last

    def plain(x, y, start, stop, number):
        tries = (0.7, 2 * 0.8 / 1.8, 0.99)
        hit = np.array([v in set(y.tolist()) for v in x[start:stop].tolist()], dtype=bool)
        if hit.sum() < 20 * tries[number]:
            return []
        a, b = stretch(hit, tries[number])
        a, b = start + a, start + b + 1
        out = plain(x, y, start, a, number) + plain(x, y, b, stop, number)
        if b - a < 20:
            return out
        part = set(x[a:b].tolist())
        c, d = stretch(np.array([v in part for v in y.tolist()], dtype=bool), tries[number])
        likeness = jaccard(part, set(y[c : d + 1].tolist()))
        if d + 1 - c >= 20 and likeness >= 0.8:
            return [*out, (a, b, c, d + 1, likeness)]
        return out + (plain(x, y, a, b, number + 1) if number < 2 else [])

    want = [sorted(plain(x, y, 0, len(x), 0)) for x, y in pairs]
    for name in ("isin", "unique", "intersect1d"):
        monkeypatch.setattr(np, name, None)
    assert [sorted(passages.align(x, y, 20, 0.8)) for x, y in pairs] == want
    assert sum(map(bool, want)) > 100 and not all(want)


def test_windows_merge_as_a_full_sort_does():
    """Overlapping windows of one text and hash are one, whatever the order of the rows."""
    rng = np.random.default_rng(18)
    h, node, a = (rng.integers(0, k, 2000) for k in (900, 3, 60))
    b = a + rng.integers(5, 15, 2000)
    want = []
    for row in sorted(zip(h.tolist(), node.tolist(), a.tolist(), b.tolist(), strict=True)):
        if want and want[-1][:2] == row[:2] and row[2] <= last:
            want[-1] = (*want[-1][:3], max(want[-1][3], row[3]))
        else:
            want.append(row)
        last = row[3]
    assert list(zip(*(c.tolist() for c in passages._merged(h, node, a, b)), strict=True)) == want


def test_passages_plan(spark):
    """The windows are sorted by their hash alone, and copies go before the lists are made: no exchange of lists."""
    plans, docs = [], spark.createDataFrame([(i, " ".join(made_up(random.Random(i % 3), 90))) for i in range(6)], DOCS)
    kept = passages.stored

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(passages, "stored", seen)
        got = passages.repeated(docs).collect()
    plans = dict(plans)
    assert len(got) == 3 and all(r.doc_id == r.other_id + 3 for r in got)
    sorts = re.findall(r"Sort \[(.*?)\], false", plans["passage-met"])
    assert len(sorts) == 1 and sorts[0].count("ASC") == 1
    assert plans["passage-lists"].index("MapInArrow") < plans["passage-lists"].index("Aggregate")


def test_passages_keep_little_on_disk(spark):
    """Lists hold what the candidates ask for, not whole texts, and no step leaves its shuffle files behind."""
    rng = random.Random(19)
    few, many = made_up(rng, 70), made_up(rng, 60)
    rows = [made_up(rng, 2000) for _ in range(40)]
    for i, words in enumerate(rows):
        words[900 + i : 900 + i] = many
    for i in (3, 8):
        rows[i][1300 + i : 1300 + i] = few
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], DOCS)
    made, kept = {}, passages.stored

    def seen(df, name):
        return made.setdefault(name, kept(df, name))

    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(name)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(passages, "stored", seen)
        out = passages.repeated(docs)
        assert spark.conf.get(name) == setting
        for _ in range(50):  # the files go in the background
            if not shuffles() - before:
                break
            time.sleep(0.2)
        assert not shuffles() - before
    sizes = {r.n for r in made["passage-lists"].selectExpr("size(list) n").collect()}
    assert len(sizes) > 1 and max(sizes) < 800
    got = out.collect()
    assert {x for r in got for x in (r.doc_id, r.other_id)} == set(range(40)) and {r.class_id for r in got} == {0}
    for r in got:
        assert rows[r.doc_id][r.start : r.end] == rows[r.other_id][r.other_start : r.other_end]
    (r,) = (r for r in got if {r.doc_id, r.other_id} == {3, 8} and r.start > 1200)
    assert {(r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)} == {(i, 1300 + i, 1370 + i) for i in (3, 8)}


def test_compact_windows():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 200).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [90, 15, 95])
    seed = np.uint64(12345)
    from rankloom.llm.common import mix

    key = mix(values ^ seed) >> np.uint64(26)
    want = set()
    for i in range(len(values) - 19):
        if doc[i] == doc[i + 19]:
            want.add(i + int(np.argmin(key[i : i + 20])))
    place, a, b = passages.compact_windows(values, doc, 20, seed)
    assert set(place.tolist()) == want
    for p, x, y in zip(place, a, b, strict=True):
        assert x <= p <= y and key[x : y + 1].min() == key[p]
        assert x in (0, p - 19) or doc[x - 1] != doc[x] or key[x - 1] <= key[p]
        assert y in (199, p + 19) or doc[y + 1] != doc[y] or key[y + 1] < key[p]


def sets_of(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash(spark):
    rng = random.Random(6)
    texts = [" ".join(made_up(rng, rng.randint(1, 200))) for _ in range(40)] + ["É" * 7, "x"]
    ids = list(range(100, 100 + len(texts)))
    order = list(zip(ids, texts, strict=True))
    rng.shuffle(order)
    got = {r.doc_id: r for r in minhash.compare_edited(spark.createDataFrame(order, DOCS).repartition(3)).collect()}
    for i, text in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[100 + i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(sets_of(text), sets_of(edited))) < 0.3
        assert abs(r.near_next - jaccard(sets_of(text), sets_of(following))) < 0.2


def test_near_duplicates(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = made_up(rng, 150)
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            again = list(words)
            for at in rng.sample(range(150), rng.choice([0, 1, 2, 30])):
                again[at] = "other"
            texts.append(" ".join(again))
    want = Sets()
    sets = [sets_of(t) for t in texts]
    for i in range(len(texts)):
        want.find(i)
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                want.join(i, j)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: want.find(i) for i in range(len(texts))}


def test_near_duplicates_have_all_their_links(spark):
    """Versions of one text, many of them linked to each other, over several blocks; repeated rows change nothing."""
    rng = random.Random(18)
    words, texts = made_up(rng, 150), []
    for _ in range(60):
        again = list(words)
        for at in rng.sample(range(150), rng.randint(0, 4)):
            again[at] = f"w{rng.randint(0, 10**6)}"
        texts.append(" ".join(again))
    sets = [frozenset(sets_of(t)) for t in texts]
    different = set(sets)
    want = {i: sum(jaccard(a, b) >= 0.8 for b in different - {a}) for i, a in enumerate(sets)}
    assert 10 < sum(want.values()) / len(want) < 58  # most have many, some none
    rows = [*enumerate(texts), *enumerate(texts[:5]), (None, texts[7])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.links for r in got if r.doc_id is not None} == want and len(got) == len(rows)
    before, minhash.BLOCK = minhash.BLOCK, 16
    try:
        got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        minhash.BLOCK = before
    assert {r.doc_id: r.links for r in got if r.doc_id is not None} == want and len(got) == len(rows)


def test_near_duplicates_of_a_table(spark):
    """All pairs of a driver table, and the classes they make, against the registered query."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sets = [frozenset(sets_of(r.text or "")) for r in docs]
    seen, pairs = {}, set()
    for i, have in enumerate(sets):
        near = set()
        for shingle in have:
            near.update(seen.get(shingle, ()))
        pairs.update((docs[j].doc_id, docs[i].doc_id) for j in near if jaccard(have, sets[j]) >= 0.8)
        for shingle in have:
            seen.setdefault(shingle, []).append(i)
    got = {r.doc_id: r for r in minhash.fingerprinted(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(got) == len(docs) and pairs
    together = sum(got[a].class_id == got[b].class_id for a, b in pairs)
    assert together >= 0.99 * len(pairs)
    linked = {d for pair in pairs for d in pair}
    alone = [r.doc_id for r, have in zip(docs, sets, strict=True) if have and r.doc_id not in linked]
    assert all((got[d].class_id, got[d].links) == (d, 0) for d in alone)


def test_decontaminate(spark):
    items = [
        (1, "Alice has 12 apples and gives 5 of them to her brother before Bob takes 12 km to walk home with the rest"),
        (2, "the quick brown fox jumps over the lazy dog while the slow green turtle looks on from the river bank"),
    ]
    docs = [
        (1, "Intro text here. Carol has 30 apples and gives 7 of them to her brother before Dave takes 30 miles to walk home with the rest. End."),
        (2, "Carol has 30 apples and gives 7 of them to her brother before Carol takes 99 km to walk home with the rest"),
        (3, "xx " + items[1][1].upper().lower() + " yy"),
        (4, "Alice has 12 apples and a dog that is slow and green but likes the river"),
        (5, " ".join(made_up(random.Random(1), 200))),
        (6, items[0][1]),
    ]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(*frames).collect()}
    assert set(got) == {(1, 1), (3, 2), (6, 1)}
    assert [got[k].verbatim for k in sorted(got)] == [False, True, True]
    assert got[1, 1].slots == 6 and got[1, 1].covered == 1.0
    assert {r.doc_id for r in decontaminate.clean(*frames).collect()} == {2, 4, 5}
    wide = decontaminate.contaminated(frames[0].union(frames[0]), frames[1]).collect()
    assert {(r.doc_id, r.item_id) for r in wide} == set(got)


def test_sharding():
    names = [f"n{i}" for i in range(11)]
    table = sharding.fill(names, 1009)
    counts = np.bincount(table)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    # brute force: walk every preference list turn by turn
    prefs = []
    for n in names:
        offset, step = sharding._number(n, "offset") % 1009, sharding._number(n, "step") % 1008 + 1
        prefs.append([(offset + j * step) % 1009 for j in range(1009)])
        assert sorted(prefs[-1]) == list(range(1009))
    turn = sorted(range(11), key=lambda i: (sharding._number(names[i], "turn"), names[i]))
    want, at = [-1] * 1009, 0
    while -1 in want:
        shard = turn[at % 11]
        want[next(p for p in prefs[shard] if want[p] < 0)] = shard
        at += 1
    assert table.tolist() == want
    less = sharding.fill(names[:10], 1009)
    moved = ((table != less) & (table != 10)).mean()
    assert moved < 0.2
    with pytest.raises(ValueError, match="prime"):
        sharding.fill(names, 1000)


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 3, 10, 50]), rng.choice(["b", "a", "é", None, "z", "a", "a", "tiny"]) if i % 97 else "one") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        assert (r.size, r.source_size) == (len(rows[r.doc_id][1].split()), size[r.source]) and abs(r.target - target[r.source]) < 1e-6 * total
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 26 for s in names)
    again = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.count("*").alias("n")).collect()
    times = collections.Counter()
    for r in got:
        times[r.source] += r.taken // r.size if r.size else 0
    assert all(0 <= r.n - times[r.source] <= 3 * sum(not t.split() for _, t, s in rows if s == r.source) for r in again)


@needs_tables
def test_langid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_bundle():
    letters = langid.letter_vectors(64)
    texts = ["ab c", "é", "", "Hello, World", "a1b"]
    doc, gram, count, lettered = langid.profile([t.encode() for t in texts])
    got = langid.bundles(doc, gram, count, len(texts), letters)
    assert lettered.tolist() == [True, True, False, True, True]
    for text, vector in zip(texts, got, strict=True):
        runs = [" ", *(c if c.isalpha() else " " for c in text.lower()), " "]
        symbols = [int(langid.symbols()[ord(c)]) for i, c in enumerate(runs) if c != " " or i == 0 or runs[i - 1] != " "]
        want = np.zeros(64)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            if a or b or c:
                want += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
        assert np.array_equal(vector, want)


def test_langid_long_text(monkeypatch):
    """A text in pieces has the n-grams and the vector that it has at once, in bounded memory."""
    rng = np.random.default_rng(9)
    wide = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 60_000)))
    text = (wide + " 12  ab, c" * 500 + "  x").encode()
    _, gram, count, _ = langid.profile([text])
    letters = langid.letter_vectors(64)
    want = langid.bundles(np.zeros(len(gram), int), gram, count, 1, letters)
    for piece in (7, 1000, 59_999):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert [x.tolist() for x in langid.long_profile(text)] == [gram.tolist(), count.tolist()]
    monkeypatch.setattr(langid, "SLICE", 1000)
    rows = [b"ab", text, b"", text, b"c d"]
    found = [(b - a, *rest) for a, b, *rest in langid.slices(rows)]
    vectors = np.concatenate([langid.bundles(doc, gram, count, n, letters) for n, doc, gram, count, _ in found])
    assert np.array_equal(vectors[[1, 3]], want[[0, 0]]) and not vectors[2].any()
    assert np.concatenate([f[-1] for f in found]).tolist() == [True, True, False, True, True]


def test_site_strength(spark):
    """Against the same moments in numpy: hosts far apart and paths alike inside them are shrunk hard to their host."""
    rng = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{p}", float(rng.random() < 0.1 + 0.08 * h)) for h in range(10) for p in range(6) for _ in range(40)]
    rows += [(None, f"p{p}", 0.5) for p in range(3)]
    scored = spark.createDataFrame(rows, "host string, path string, quality double")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"))
    got = quality._strength(paths, "quality", F.col("host"))
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    for host, path, value in rows:
        by[host][path].append(value)
    free = within = width = spread = 0
    for sites in by.values():
        size = np.array([len(v) for v in sites.values()])
        mean = sum(map(sum, sites.values())) / size.sum()
        free += len(size) - 1
        within += (len(size) - 1) * mean * (1 - mean)
        width += size.sum() - (size**2).sum() / size.sum()
        spread += sum(n * (np.mean(v) - mean) ** 2 for n, v in zip(size, sites.values(), strict=True))
    between = (spread - within) / width
    want = min(max(within / free / between - 1, 1.0), 1e6) if between > 0 else 1e6
    assert math.isclose(got, want, rel_tol=1e-6)
    hosts = scored.groupBy("host").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"))
    assert got > 10 * quality._strength(hosts, "quality", F.lit(0))


@needs_tables
def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, learn).join(labels.where("doc_id % 2 = 1").withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id").collect()
    assert np.mean([(r.quality >= 0.5) == (r.q == 1) for r in got]) > 0.95
    assert np.mean([r.keep for r in got if r.q == 1 and r.t == 0]) > 0.97


def test_site_rates(spark):
    rows = [("big", "p", 0.9)] * 500 + [("big", "q", 0.1)] * 500 + [("small", "p", 0.0)] * 2 + [("other", "p", 0.5)] * 300
    scored = spark.createDataFrame(rows, "host string, path string, quality double")
    table, base = quality.sites(scored, ("quality",))
    rate = {(r.host, r.path): r.quality_path for r in table.collect()}
    assert abs(base["quality"] - np.mean([r[2] for r in rows])) < 1e-9
    assert rate["big", "p"] > 0.8 and rate["big", "q"] < 0.2 and 0 < rate["small", "p"] < base["quality"]


@needs_tables
def test_lm(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    count = collections.Counter()
    for i, text in rows.items():
        if i not in held:
            count.update([*split(text), None])
    total, scale = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    got = lm.score(docs).collect()
    for r in got:
        words = [*split(rows[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(words), total)
        assert r.n_known == sum(count[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / scale) for w in words), rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_lm_normalised():
    rng = np.random.default_rng(1)
    w = lm.start_weights(np.full(lm.CLASSES, 1 / lm.CLASSES))
    w = {k: v + rng.normal(0, 1, v.shape) for k, v in w.items()}
    before = rng.integers(0, lm.CLASSES, (1, lm.CONTEXT)).repeat(lm.CLASSES, axis=0)
    p = np.exp(lm.log_probabilities(w, np.arange(lm.CLASSES), before))
    assert abs(p.sum() - 1) < 1e-4


def test_lm_learns():
    rng = np.random.default_rng(3)
    target = rng.integers(0, 4, 60_000)
    windows = np.stack([target, target, *[rng.integers(0, 4, 60_000)] * 3], axis=1)
    frequency = np.full(lm.CLASSES, 1e-6)
    frequency[:4] = 0.25
    w = lm.train_pass(lm.start_weights(frequency), windows, frequency, rng)
    assert np.exp(lm.log_probabilities(w, target[:100], windows[:100, 1:])).mean() > 0.8


def test_lm_windows_of_a_text():
    """Every token of a text is a window with the classes before it; pieces cut a long text without a gap."""
    words = [b"w%d" % (i * i % 97) for i in range(lm.PIECE + 100)]
    classes = lm.Classes(np.zeros(0, np.int64))
    rows = [b" ".join(words), b"", b"a b"]
    batch = pa.RecordBatch.from_arrays([pa.array([r.decode() for r in rows])], ["text"])
    got = pa.Table.from_batches(lm._windows([batch], classes)).to_pylist()
    assert [r["piece"] for r in got] == [0, 1, 0, 0]
    value, doc, group = lm.tokens(rows)
    own = classes(value, group)
    want = np.concatenate([own[:, None], lm.contexts(own, doc)], axis=1).astype(np.uint8)
    assert b"".join(r["windows"] for r in got) == want.tobytes()


@needs_tables
def test_lm_any_layout(spark):
    """The weights hang on the texts, not on how they lie in files and tasks; shards of several rounds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    frequency = np.full(lm.CLASSES, 1 / lm.CLASSES)
    total = docs.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + 1)).first()[0]
    one = lm.learn(docs, [], frequency, total, total // 6)
    two = lm.learn(docs.repartition(5), [], frequency, total, total // 6)
    assert all(np.allclose(one[k], two[k], rtol=1e-9, atol=1e-12) for k in one)
    assert not np.allclose(one["R"], lm.start_weights(frequency)["R"])
