"""BM25 in the map task: documents are cut into blocks, and a task scores its blocks and cuts its own top k.

A block is a range of documents in reading order.  Its postings are sorted by term, and each term has a bound: the
largest frequency and the smallest length among its documents, which bound its part of any score.  A query skips
a block whose bounds add up to less than the query's k-th best score so far.  A document is never split, so its
score is complete where it is read, and only k rows for each query and task are left to exchange.

Documents without a match have score 0 and take part in the order like all others where lists are filled
up, so gaps need no second pass: a task gives its first ones in corpus order.
"""

import heapq
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.operators.sizing import spread

#: Documents of a block, and tokens after which a block is closed early.
BLOCK_DOCS, BLOCK_TOKENS = 512, 1_000_000
#: Distinct terms that a task counts before it hands them on.
HELD_TERMS = 200_000
_COUNTED = "term string, df bigint, length bigint"


# ---- statistics ---------------------------------------------------------


def term_counts(corpus):
    """``term, df, length``: documents by term; the empty term has the number of documents and their total length.

    Tasks count first and hand on partial counts, so what is shuffled is distinct terms, not tokens.
    """
    found = spread(corpus.select("text")).mapInArrow(_count_terms, _COUNTED)
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))


def _count_terms(batches):
    counts, n, length = Counter(), 0, 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = (text or "").split()
            n, length = n + 1, length + len(words)
            counts.update(set(words))
            if len(counts) >= HELD_TERMS:
                yield _counted(counts)
                counts.clear()
    if counts:
        yield _counted(counts)
    if n:
        yield pa.RecordBatch.from_pydict({"term": [""], "df": [n], "length": [length]})


def _counted(counts):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(counts), pa.string()),
            pa.array(list(counts.values()), pa.int64()),
            pa.array(np.zeros(len(counts), np.int64)),
        ],
        names=["term", "df", "length"],
    )


# ---- blocks -------------------------------------------------------------


class Block:
    """Some documents with their lengths, and postings sorted by the number of the term."""

    def __init__(self, docs, keys, lengths, term, at, tf):
        self.docs, self.keys = docs, keys
        self.length = np.asarray(lengths, dtype=np.float64)
        self.term, self.at, self.tf = term, at, tf


def _text_blocks(wanted, batches):
    """Blocks of a task's ``doc, key, text`` rows; only terms in ``wanted`` (term -> number) are kept.

    ``wanted`` None: all terms, numbered by block in ascending order; then gives ``(block, terms)``.
    """
    docs, keys, lengths, found, at, tf, total = [], [], [], [], [], [], 0

    def closed():
        if wanted is None:
            names = sorted(set(found))
            number = {t: i for i, t in enumerate(names)}
        else:
            names, number = None, wanted
        term = np.fromiter((number[t] for t in found), dtype=np.int64, count=len(found))
        order = np.argsort(term, kind="stable")
        arrays = (np.array(x, dtype=np.int64)[order] for x in (at, tf))
        return Block(docs, keys, lengths, term[order], *arrays), names

    for batch in batches:
        for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = (text or "").split()
            counts = Counter(words)
            some = counts if wanted is None else counts.keys() & wanted.keys()
            found.extend(some)
            tf.extend([counts[t] for t in some])
            at.extend([len(docs)] * len(some))
            docs.append(doc)
            keys.append(key)
            lengths.append(len(words))
            total += len(words)
            if len(docs) >= BLOCK_DOCS or total >= BLOCK_TOKENS:
                yield closed()
                docs, keys, lengths, found, at, tf, total = [], [], [], [], [], [], 0
    if docs:
        yield closed()


# ---- stored blocks ------------------------------------------------------


def write_blocks(corpus, path, order="doc_id", mode="errorifexists"):
    """Store the blocks of a corpus: a row for each block and term, after one with the block's documents.

    A task writes one file of one row group, and a row group is never divided between tasks, so a search finds each
    block whole.  Terms ascend in a block, so that pages without a wanted term are skipped.
    """
    rows = corpus.select(F.col("doc_id"), F.col(order).alias("key"), F.col("text"))
    doc, key = rows.schema["doc_id"].dataType, rows.schema["key"].dataType
    ints = T.ArrayType(T.IntegerType())
    fields = [("block", T.LongType()), ("term", T.StringType()), ("max_tf", T.IntegerType()), ("min_length", T.IntegerType())]
    fields += [("at", ints), ("tf", ints), ("docs", T.ArrayType(doc)), ("keys", T.ArrayType(key)), ("lengths", ints)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    built = spread(rows).mapInArrow(partial(_block_rows, to_arrow_schema(schema)), schema)
    built.write.mode(mode).option("parquet.block.size", 1 << 40).option("maxRecordsPerFile", 0).parquet(path)


def _block_rows(schema, batches):
    first = TaskContext.get().partitionId() << 32
    for i, (block, names) in enumerate(_text_blocks(None, batches)):
        starts = np.searchsorted(block.term, np.arange(len(names) + 1)).astype(np.int32)
        lengths = block.length.astype(np.int32)
        head = [[first + i], [""], [0], [0], [None], [None], [block.docs], [block.keys], [lengths.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(head, schema.types, strict=True)], schema=schema)
        if not names:
            continue
        n = len(names)
        at, tf = (pa.ListArray.from_arrays(pa.array(starts), pa.array(x.astype(np.int32))) for x in (block.at, block.tf))
        largest = np.maximum.reduceat(block.tf, starts[:-1]).astype(np.int32)
        smallest = np.minimum.reduceat(lengths[block.at], starts[:-1])
        columns = [np.full(n, first + i), names, largest, smallest]
        columns = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=False)]
        columns += [at.cast(schema.types[4]), tf.cast(schema.types[5]), *[pa.nulls(n, t) for t in schema.types[6:]]]
        yield from _slices(pa.RecordBatch.from_arrays(columns, schema=schema))


def _slices(batch, rows=20_000):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _stored_blocks(wanted, batches):
    """``(block, terms, max_tf, min_length)`` from rows of ``write_blocks``, the wanted terms among them."""
    names = pa.array(list(wanted), pa.string())
    head, parts = None, []

    def closed():
        number, count, large, small, at, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(np.repeat(number, count), kind="stable")
        block = Block(*head, np.repeat(number, count)[order], at[order], tf[order])
        return block, number, large.astype(np.float64), small.astype(np.float64)

    for batch in batches:
        terms = batch.column(1)
        number = pc.index_in(terms, names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.flatnonzero(pc.equal(terms, "").to_numpy(zero_copy_only=False))
        for lo, hi in zip([0, *heads.tolist()], [*heads.tolist(), batch.num_rows], strict=True):
            if lo == hi:
                continue
            rows = batch.slice(lo, hi - lo)
            if terms[lo].as_py() == "":
                if head is not None:
                    yield closed()
                key = rows.column(0)[0].as_py()
                head, parts = [rows.column(c)[0].as_py() for c in (6, 7, 8)], []
            elif head is None or not pc.all(pc.equal(rows.column(0), key)).as_py():
                raise ValueError("a block of the index is divided; write it again without changing its files")
            here = number[lo:hi]
            rows = rows.filter(pa.array(here >= 0))
            at, tf = rows.column(4), rows.column(5)
            columns = [pc.list_value_length(at), rows.column(2), rows.column(3), at.flatten(), tf.flatten()]
            parts.append((here[here >= 0], *[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]))
    if head is not None:
        yield closed()


# ---- search -------------------------------------------------------------


class Scorer:
    """A query block's weights, and the k best documents so far for each of its queries."""

    def __init__(self, weights, n_queries, k, mean_length, k1, b, digits, fill, floor=None):
        """weights: arrays ``term number, query number, weight``; floor: for each query None or a proven (score, key)."""
        self.n, self.k, self.fill, self.digits = n_queries, k, fill, digits
        self.mean, self.k1, self.b = mean_length, k1, b
        term, query, weight = weights
        order = np.lexsort((query, term))
        self.query, self.weight = query[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange((term.max() if len(term) else -1) + 2))
        self.best = [[] for _ in range(n_queries)]  # (-score, key is there, key, doc), best first
        self.bar = np.full(n_queries, -np.inf)
        for q, mark in enumerate(floor or ()):
            if mark is not None:
                self.bar[q] = mark

    def part(self, tf, length):
        """What one term of weight 1 adds to a score."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def _expanded(self, term):
        """For each of some term numbers its queries: ``(row of term, place in query and weight)``."""
        n = self.start[term + 1] - self.start[term]
        row = np.repeat(np.arange(len(term)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[term], n)

    def asking(self, term, max_tf, min_length):
        """Queries that the bounds of a block do not rule out."""
        row, at = self._expanded(term)
        parts = np.maximum(self.weight[at], 0.0) * self.part(max_tf, min_length)[row]
        bound = np.bincount(self.query[at], weights=parts, minlength=self.n)
        touched = np.bincount(self.query[at], minlength=self.n) > 0
        return (bound + 1e-6 >= self.bar) & (touched | self.fill)

    def add(self, block, asking=None):
        n = len(block.docs)
        row, at = self._expanded(block.term)
        query = self.query[at]
        if asking is not None:
            keep = asking[query]
            row, at, query = row[keep], at[keep], query[keep]
        values = self.weight[at] * self.part(block.tf, block.length[block.at])[row]
        cell = query * n + block.at[row]
        score = np.bincount(cell, weights=values, minlength=self.n * n).astype(np.float64).reshape(self.n, n)
        if self.digits is not None:
            score = np.round(score, self.digits)
        score += 0.0
        good = score >= self.bar[:, None]
        if not self.fill:
            good &= (np.bincount(cell, minlength=self.n * n) > 0).reshape(self.n, n)
        elif asking is not None:
            good &= asking[:, None]
        if not good.any():
            return
        place = np.empty(n, np.int64)
        names = [(key is not None, key if key is not None else 0) for key in block.keys]
        order = sorted(range(n), key=names.__getitem__)
        place[order] = np.arange(n)
        for q in np.flatnonzero(good.any(axis=1)).tolist():
            some = np.flatnonzero(good[q])
            some = some[np.lexsort((place[some], -score[q][some]))[: self.k]]
            new = [(-score[q, d], *names[d], block.docs[d]) for d in some.tolist()]
            last = self.best[q][-1][:3] if len(self.best[q]) == self.k else None
            if last is None or new[0][:3] < last:
                merged = heapq.merge(self.best[q], new, key=lambda r: r[:3])
                self.best[q] = [r for r, _ in zip(merged, range(self.k), strict=False)]
                if len(self.best[q]) == self.k:
                    self.bar[q] = max(self.bar[q], -self.best[q][-1][0])

    def rows(self):
        for q, best in enumerate(self.best):
            for less, there, key, doc in best:
                yield q, doc, key if there else None, -less + 0.0


def search_task(schema, wanted, ids, indexed, scorer, seeds, batches):
    """The k best documents of a task for each query, ``query_id, doc_id, key, score``.

    seeds: only tasks whose number is a square work.
    """
    if seeds and int(TaskContext.get().partitionId() ** 0.5) ** 2 != TaskContext.get().partitionId():
        return
    best = scorer()
    if indexed:
        for block, term, max_tf, min_length in _stored_blocks(wanted, batches):
            asking = best.asking(term, max_tf, min_length)
            if asking.any():
                best.add(block, asking)
    else:
        for block, _ in _text_blocks(wanted, batches):
            best.add(block)
    out = list(best.rows())
    for lo in range(0, len(out), 50_000):
        q, docs, keys, scores = zip(*out[lo : lo + 50_000], strict=True)
        columns = [ids.take(pa.array(q, pa.int64())), pa.array(docs, schema[1].type), pa.array(keys, schema[2].type), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
