"""Spelling variants: words one edit apart, and the far more frequent form each leads to.

Words are compared inside blocks.  A block fixes the longer word's length and a window of it that holds the
edit: all before and after the window is equal, so it is part of the block's key.  The two halves of a
word are the first windows; a block with too many words is cut again into the halves of its window, down to
one character, where a block has at most one word for each letter.  Each pair of words has one place
where the longer differs first, so exactly one block counts it.

A block's words, without their equal ends, are a sorted list.  The list is scanned with every word as the
query: a row of the edit matrix belongs to a prefix, and all neighbours in the list that share the prefix
(their LCP is as long) share the row.  Rows are banded, as only one edit counts, and once all
of a row's band exceeds one edit the whole range that shares the prefix is skipped.  The scan goes down one
character at a time, for all blocks of a batch at once.
"""

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.llm.common import pick
from rankloom.operators.sizing import stored

SHORTEST, FEWEST, RATIO = 7, 2, 10
#: A letter of a word.
RUN = "[A-Za-zÀ-ÿ]"
#: One run in this many loses a letter (chosen by crc32).
LOSES = 31
#: Words of a block; a larger one is cut again.  More than letters there are, or cutting would not end.
BLOCK = 1024
#: Letters of the middles in a block, for very long words.
CELLS = 64 * BLOCK
#: Words that wait in a Python task before they are counted out, and words of blocks scanned at once.
HELD, AT_ONCE = 100_000, 4 * BLOCK
_LOWER = {c: c + 32 for c in range(65, 91)}
_FAR = 2


def _count(shortest, loses, batches):
    """``word, n`` of the texts of a task, in parts; the same word may come again."""
    runs = re.compile(f"{RUN}{{{shortest},}}")
    counts = Counter()

    def out():
        words, n = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            text, start = text.as_py(), zlib.crc32(f"{key.as_py()}:".encode()) if key.is_valid else zlib.crc32(b":")
            if not text:
                continue
            for run, n in Counter(runs.findall(text.translate(_LOWER))).items():
                h = zlib.crc32(run.encode(), start)
                if loses and h % loses == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < shortest:
                        continue
                counts[run] += n
            if len(counts) >= HELD:
                yield out()
    if counts:
        yield out()


def words(docs, shortest=SHORTEST, fewest=FEWEST, loses=LOSES):
    """``word, n``: words of at least ``shortest`` letters with their number of occurrences, at least ``fewest``."""
    rows = pick(docs, doc_id="doc_id", text="text")
    found = rows.mapInArrow(partial(_count, shortest, loses), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def _keyed(rows):
    """The key of a row's block: the longer length, the window, and what stands before and after it."""
    end = F.col("longer") - F.col("hi")
    head = F.substring(F.col("word"), F.lit(1), F.col("lo"))
    tail = F.substring(F.col("word"), F.length("word") - end + 1, end)
    return rows.withColumn("key", F.xxhash64("longer", "lo", "hi", head, tail))


def _halves(rows):
    middle = F.shiftright(F.col("lo") + F.col("hi"), 1)
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.withColumn("w", F.explode(halves)).select("word", "n", "longer", "w.lo", "w.hi"))


def _blocks(words, most, cells):
    """``word, n, longer, lo, hi, key``: words by blocks of at most ``most`` words, and at least two."""
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    rows = stored(_halves(both.select("word", "n", "longer", F.lit(0).alias("lo"), F.col("longer").alias("hi"))), "spelling-blocks")
    ready = []
    while True:
        sizes = rows.groupBy("key").agg(
            F.count("*").alias("size"),
            (F.max("hi") - F.min("lo")).alias("width"),
            (F.max(F.length("word")) == F.max("longer")).alias("paired"),
        )
        sizes = stored(sizes.filter("size > 1 and paired").drop("paired"), "spelling-sizes")
        large = ((F.col("size") > most) | (F.col("size") * F.col("width") > cells)) & (F.col("width") > 1)
        ready.append(rows.join(sizes.filter(~large).select("key"), "key"))
        if sizes.filter(large).isEmpty():
            break
        rows = stored(_halves(rows.join(sizes.filter(large).select("key"), "key")), "spelling-blocks")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def _scan(block, size, codes, width):
    """``(query, entry)`` rows of the same block whose middles differ by exactly one edit.

    block: number of each row's block; size: length of its middle; codes: a matrix of its code points, 0 beyond the
    end.  Rows are sorted by block, then by codes.  A row of the edit matrix at depth d has the distances of the
    entry's first d codes to the query's first d-1, d, d+1.
    """
    n = len(block)
    # share[i]: how many codes row i shares with the row before it; -1 where a block begins
    same = np.zeros((n, width), dtype=bool)
    same[1:] = codes[1:] == codes[:-1]
    share = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(n, np.int64)
    share[np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))] = -1
    starts = np.flatnonzero(share < 0)
    ends = np.concatenate([starts[1:], [n]])
    of = np.repeat(np.arange(len(starts)), ends - starts)
    # every query starts with the whole block as its one range, and the row 0 of the matrix: (-, 0, 1)
    query, lo, hi = np.arange(n), starts[of], ends[of]
    band = np.tile(np.array([_FAR, 0, 1], dtype=np.int8), (n, 1))
    padded = np.zeros((n, width + 3), dtype=codes.dtype)  # column j + 1: code j
    padded[:, 1 : width + 1] = codes
    found = []
    for depth in range(width + 1):
        # entries that end here are first in their range, and equal ones do not occur
        ending = size[lo] == depth
        if ending.any():
            q, e, b = query[ending], lo[ending], band[ending]
            off = size[q] - depth
            near = np.abs(off) <= 1
            d = np.where(near, b[np.arange(len(b)), np.clip(off + 1, 0, 2)], _FAR)
            found.append((q[d == 1], e[d == 1]))
            lo = np.where(ending, lo + 1, lo)
        keep = lo < hi
        query, lo, hi, band = query[keep], lo[keep], hi[keep], band[keep]
        if depth == width or not len(query):
            break
        # ranges of the next depth: they begin at lo and wherever a row shares only depth codes or fewer
        cuts = np.flatnonzero(share <= depth)
        a, z = np.searchsorted(cuts, lo, side="right"), np.searchsorted(cuts, hi, side="left")
        parts = z - a + 1
        owner = np.repeat(np.arange(len(query)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.where(nth == 0, lo[owner], cuts[np.minimum(a[owner] + nth - 1, len(cuts) - 1)])
        last = nth == parts[owner] - 1
        end = np.where(last, hi[owner], cuts[np.minimum(a[owner] + nth, len(cuts) - 1)])
        query, before = query[owner], band[owner]
        # one more code of the entries: distances to the query's first depth, depth + 1, depth + 2 codes
        code = codes[begin, depth]
        three = padded[query[:, None], np.arange(depth, depth + 3)[None, :]]
        differs = (three != code[:, None]).astype(np.int8)
        beyond = size[query][:, None] < np.arange(depth, depth + 3)[None, :]
        band = np.full(before.shape, _FAR, dtype=np.int8)
        # before[:, j]: to the first depth - 1 + j codes; the new band's column j: to the first depth + j codes
        band[:, 0] = np.minimum(before[:, 0] + differs[:, 0], before[:, 1] + 1)
        band[:, 1] = np.minimum(np.minimum(before[:, 1] + differs[:, 1], before[:, 2] + 1), band[:, 0] + 1)
        band[:, 2] = np.minimum(before[:, 2] + differs[:, 2], band[:, 1] + 1)
        band[beyond] = _FAR
        np.minimum(band, _FAR, out=band)
        alive = (band < _FAR).any(axis=1)
        query, lo, hi, band = query[alive], begin[alive], end[alive], band[alive]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _compared(schema, at_once, cells, batches):
    """``word, n_near, near``: for each word of a block the near words that the block finds, and the first of them."""
    held, key, size = [], None, 0

    def out():
        rows = []
        for word, n, longer, lo, hi, _ in held:
            end = longer - hi
            rows.append((longer, lo, word[:lo], word[len(word) - end :], word[lo : len(word) - end], word, n, end))
        rows.sort(key=lambda r: r[:5])
        names = [r[:4] for r in rows]
        block = np.cumsum([i > 0 and names[i] != names[i - 1] for i in range(len(rows))])
        middles = [r[4] for r in rows]
        length = np.array([len(m) for m in middles])
        width = int(length.max())
        text = "".join(m.ljust(width, "\0") for m in middles).encode("utf-32-le")
        codes = np.frombuffer(text, dtype=np.uint32).reshape(len(rows), width).astype(np.int32)
        q, e = _scan(block, length, codes, width)
        full = np.array([len(r[5]) for r in rows])
        keep = np.maximum(full[q], full[e]) == np.array([r[0] for r in rows])[q]
        q, e = q[keep], e[keep]
        # where the longer middle is the shorter and one code more, the words first differ beyond the window if that
        # code also comes next: another block counts them
        long, short = np.where(full[q] > full[e], q, e), np.where(full[q] > full[e], e, q)
        after = np.array([ord(r[3][0]) if r[7] else -1 for r in rows])
        w = length[long]
        alike = codes[long] == codes[short]
        shared = np.where(alike.all(axis=1), width, alike.argmin(axis=1)) if width else np.zeros(len(q), np.int64)
        runs_on = (full[q] != full[e]) & (shared == w - 1) & (codes[long, np.maximum(w - 1, 0)] == after[long])
        q, e = q[~runs_on], e[~runs_on]
        place = np.empty(len(rows), np.int64)
        place[sorted(range(len(rows)), key=lambda i: rows[i][5])] = np.arange(len(rows))
        n = np.array([r[6] for r in rows], dtype=np.int64)
        order = np.lexsort((place[e], -n[e], q))
        q, e = q[order], e[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(q)]]))
        return pa.RecordBatch.from_pylist(
            [
                {"word": rows[a][5], "n_near": c, "near": {"less": -int(n[b]), "form": rows[b][5]}}
                for a, b, c in zip(q[first].tolist(), e[first].tolist(), count.tolist(), strict=True)
            ],
            schema=schema,
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[5] != key and held and (len(held) >= at_once or size >= cells):
                yield out()
                held, size = [], 0
            key = row[5]
            held.append(row)
            size += row[4] - row[3]
    if held:
        yield out()


def near_words(words, most=BLOCK, cells=CELLS):
    """``word, n_near, form, form_n``: how many words are one edit from each, and the most frequent of them.

    words: ``word, n``, each word once and of two code points or more.  A word without such a neighbour is left
    out.  Ties go to the first word in code-point order.  Exact: no block is cut short, large ones are cut finer.
    """
    blocks = _blocks(words, most, cells)
    schema = T.StructType(
        [
            words.schema["word"],
            T.StructField("n_near", T.LongType()),
            T.StructField("near", T.StructType([T.StructField("less", T.LongType()), T.StructField("form", T.StringType())])),
        ]
    )
    columns = ["word", "n", "longer", "lo", "hi", "key"]
    blocks = blocks.select(*columns).repartition("key").sortWithinPartitions("longer", "key")
    found = blocks.mapInArrow(partial(_compared, to_arrow_schema(schema), AT_ONCE, cells), schema)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    return best.select("word", "n_near", F.col("near.form").alias("form"), (-F.col("near.less")).alias("form_n"))


def variants(docs, ratio=RATIO, shortest=SHORTEST, fewest=FEWEST, loses=LOSES, most=BLOCK):
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    form: the most frequent word one edit away if it is ``ratio`` times as frequent, else null; root: where the
    forms lead to in the end.  Null and empty texts have no words; a null doc_id counts as empty; repeated
    rows count each time; an empty table gives no rows.
    """
    every = stored(words(docs, shortest, fewest, loses), "spelling-words")
    near = near_words(every, most).withColumnRenamed("word", "__word")
    rows = every.join(near, F.col("word") == F.col("__word"), "left").drop("__word")
    strong = F.col("form_n") >= ratio * F.col("n")
    rows = stored(
        rows.select(
            "word",
            F.when(strong, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return _rooted(rows)


def _rooted(rows):
    """Add ``root``.  Each step leads to a far more frequent word, so steps are few and end."""
    links = rows.filter("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to"))
    # roots of those forms that have a form themselves: few, and the only ones whose path is followed
    paths = links.select("to").distinct().join(links.toDF("from", "next"), F.col("to") == F.col("from"))
    paths = stored(paths.select(F.col("to").alias("passed"), F.col("next").alias("root")), "spelling-paths")
    while True:
        further = paths.join(links, F.col("root") == F.col("from"))
        if further.isEmpty():
            break
        paths = paths.join(links, F.col("root") == F.col("from"), "left")
        paths = stored(paths.select("passed", F.coalesce("to", "root").alias("root")), "spelling-paths")
    rows = rows.join(paths, F.col("form") == F.col("passed"), "left")
    return rows.select("word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n")
