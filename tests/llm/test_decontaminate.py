"""Decontamination against a direct search for runs, and the hashes and patterns it is made of."""

import random
import re

from pyspark.sql import functions as F

from rankloom.llm import decontaminate

TEXT = "doc_id long, text string"
HOLDER = re.compile(f"[{decontaminate.NAME}{decontaminate.NUMBER}{decontaminate.UNIT}]")


def made_up(rng, n, kind):
    words = {
        "plain": ["alpha", "beta", "gamma", "delta", "river", "stone", "walks", "over", "the", "a", "to", "with"],
        "names": ["LONDON", "Paris", "12", "35", "=", "47", "+", ",", "Anna", "km", "§", "1.5%"],
    }[kind]
    return " ".join(rng.choice(words) for _ in range(n))


def templates(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.w for r in df.select("i", decontaminate.words(F.col("text")).alias("w")).collect()}


def brute_force(spark, docs, items, window=8):
    """Items of which half is covered on one diagonal of a document, whose texts hold no slot twice with other values."""
    texts = [t for _, t in docs] + [t for _, t in items]
    of = templates(spark, texts)
    found = set()
    for k, (item, item_text) in enumerate(items):
        words = of[len(docs) + k]
        width = min(window, len(words))
        runs = [words[i : i + width] for i in range(len(words) - width + 1)] if words else []
        told = [sum(not HOLDER.search(w) for w in run) >= min(3, width) for run in runs]
        raw = not any(told)
        if raw:
            words = item_text.split()
            width = min(window, len(words))
            told = [True] * (len(words) - width + 1) if words else []
        for d, (doc, doc_text) in enumerate(docs):
            theirs = doc_text.split() if raw else of[d]
            for shift in range(-len(words), len(theirs)):
                covered = set()
                for i in range(len(told)):
                    at = i + shift
                    if told[i] and 0 <= at and theirs[at : at + width] == words[i : i + width]:
                        covered |= set(range(i, i + width))
                if words and len(covered) >= 0.5 * len(words):
                    found.add((doc, item, raw))
    return found


def test_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, made_up(rng, rng.randint(1, 30), rng.choice(["plain", "plain", "names"]))) for i in range(200)]
    items += [(200, "12 + 35 = 47 , ANNA 9"), (201, "LONDON PARIS BERLIN ROME MADRID WIEN OSLO BERN PRAG"), (202, "="), (203, "")]
    docs = []
    for i in range(120):
        text = made_up(rng, rng.randint(0, 60), "plain")
        if i % 2:
            text += " " + rng.choice(items)[1] + " " + made_up(rng, 5, "plain")
        if i % 5 == 0:
            words = rng.choice(items)[1].split()
            text += " " + " ".join(words[len(words) // 3 :])
        docs.append((i, text))
    docs += [(900, "so " + items[200][1] + " is"), (901, "see " + items[201][1])]
    frames = spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(*frames, consistent=0.0).collect()}
    expected = brute_force(spark, docs, items)
    assert got == {(d, i) for d, i, _ in expected}
    assert {(900, 200), (901, 201)} <= got and any(raw for *_, raw in expected)


def test_placeholders(spark):
    of = templates(spark, ["Anna ran 12 km, 5-day trips, 7km/h; weeks of \u20ac3.50!", "§ = +", None])
    name, number, unit = decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT
    assert of[0] == [name, "ran", number, unit, number + unit, "trips", number + unit, unit, "of", number]
    assert of[1] == of[2] == []


def test_run_hashes(spark):
    """Equal runs have equal hashes at every width, other runs other ones; the screen lets all known hashes pass."""
    texts = ["a b c d e f g h i", "x a b c d e f g h", "a b", ""]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "k int, words array<string>")
    rows = decontaminate._places(df, ["k"], list(range(1, 9))).collect()
    by_run = {}
    for r in rows:
        by_run.setdefault((r.w, r.h), set()).add(tuple(texts[r.k].split()[r.at : r.at + r.w]))
    assert len(rows) == sum(max(0, len(t.split()) - w + 1) for t in texts for w in range(1, 9))
    assert all(len(runs) == 1 for runs in by_run.values())
    assert len(by_run) == len({run for runs in by_run.values() for run in runs})
    known = spark.createDataFrame([(r.h,) for r in rows], "item_h long")
    passed = decontaminate._places(df, ["k"], list(range(1, 9)), decontaminate._screen(known, len(rows)))
    assert passed.count() == len(rows)
    none = decontaminate._places(df, ["k"], [2], decontaminate._screen(known.limit(0), 0))
    assert none.count() == 0
