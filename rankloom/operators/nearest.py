"""Nearest-vector join: for each query vector, the k best rows by dot product.

Exact search scores each corpus row against each query; what matters at scale
is that the scores never become rows.  Each task multiplies an Arrow batch with
the query matrix, keeps the k best so far per query, and gives out only rows
that reach that mark.

A query set too large for a task is searched in blocks, one pass of map tasks each;
the corpus is never shuffled.

One pass would send ``tasks * queries * k`` rows to the final top-k.  On a
corpus of many splits a first pass therefore searches about the square root of
the tasks; the k-th best score it finds is a lower bound of the true one, and the
full pass starts from that mark.  Both passes then send about
``sqrt(tasks) * queries * k`` values, and the result stays exact.
"""

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import arrow, sizing
from rankloom.operators.ranking import top_k

QUERY_STEP = 256
#: Scan tasks of a corpus from which the seed pass pays.
SEED_SPLITS = 256


def nearest(
    queries,
    corpus,
    k,
    query_keys=("query_id",),
    corpus_keys=("chunk_id",),
    vector="embedding",
    kind="dot",
    digits=6,
    block_bytes=sizing.BLOCK_BYTES,
):
    """``query_keys, corpus_keys, similarity, rank`` of the k best rows per query.

    Null vectors on either side take no part.  Order: similarity descending,
    then corpus keys ascending; the similarity is rounded to ``digits`` first
    (None: not rounded) so that equal vectors tie wherever they are scored.
    """
    return _search(queries, corpus, k, query_keys, corpus_keys, vector, kind, digits, block_bytes, False)


def nearest_in_lists(
    queries,
    corpus,
    k,
    query_keys=("query_id",),
    corpus_keys=("chunk_id",),
    vector="embedding",
    kind="dot",
    digits=6,
    block_bytes=sizing.BLOCK_BYTES,
):
    """Approximate form: a row is scored only for queries that probe its list.

    ``corpus`` has ``list_id``; ``queries`` has ``lists``, an array of list ids.
    """
    return _search(queries, corpus, k, query_keys, corpus_keys, vector, kind, digits, block_bytes, True)


def _search(queries, corpus, k, query_keys, corpus_keys, vector, kind, digits, block_bytes, listed):
    if k < 1:
        raise ValueError("k must be at least 1")
    query_keys, corpus_keys = list(query_keys), list(corpus_keys)
    wanted = queries.select(*query_keys, vector, *(["lists"] if listed else [])).filter(F.col(vector).isNotNull())
    rows = corpus.select(*corpus_keys, vector, *(["list_id"] if listed else [])).filter(F.col(vector).isNotNull())
    schema = T.StructType(
        [wanted.schema[c] for c in query_keys]
        + [rows.schema[c] for c in corpus_keys]
        + [T.StructField("similarity", T.DoubleType())]
    )
    task = _BlockTopK(query_keys, corpus_keys, vector, k, kind, digits, listed)

    order = [F.desc("similarity"), *[F.asc(c) for c in corpus_keys]]
    found = []
    for table, alone in sizing.query_blocks(wanted, query_keys, _row_bytes(wanted, vector, k), block_bytes):
        asked = rows
        if listed and table.num_rows:
            probed = sorted({x for row in table.column("lists").to_pylist() for x in row})
            asked = rows.filter(F.col("list_id").isin(probed))
        floor = _seed(table, asked, task, k) if _splits(asked) >= SEED_SPLITS else None
        hits = asked.mapInArrow(lambda batches, table=table, floor=floor: task.over_batches(table, batches, floor), schema)
        best = top_k(hits, query_keys, order, k)
        found.append(best if alone else sizing.stored(best, "nearest"))
    return reduce(lambda a, b: a.union(b), found)


def _row_bytes(wanted, vector, k):
    """What a query costs a task: its vector and its k best scores so far."""
    first = wanted.select(F.size(vector)).first()
    return 8 * ((first[0] if first else 0) + 2 * k)


def _splits(rows):
    """About how many scan tasks the rows take, from the planner's size of them."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = rows.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "134217728b")
    return size // max(1, _bytes(split))


def _bytes(text):
    number = re.match(r"\s*(\d+)\s*([kmgt]?)", str(text).lower())
    return int(number[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[number[2]]


def _seed(table, rows, task, k):
    """Per query a lower bound of its k-th best score, from some of the tasks."""
    found = rows.mapInArrow(lambda batches: task.seed(table, batches), "q int, best array<double>")
    best = top_k(found.select("q", F.explode("best").alias("s")), ["q"], [F.desc("s")], k)
    bounds = best.groupBy("q").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    floor = np.full(table.num_rows, -np.inf)
    for row in bounds.collect():  # at most one row per query of a bounded set
        floor[row.q] = row.s
    return floor


class _BlockTopK:
    """The work of one task: block product, running k-th best, local cut."""

    def __init__(self, query_keys, corpus_keys, vector, k, kind, digits, listed):
        if kind not in ("dot", "dot01"):
            raise ValueError(f"unknown similarity: {kind}")
        self.query_keys, self.corpus_keys = query_keys, corpus_keys
        self.vector, self.k, self.kind, self.digits, self.listed = vector, k, kind, digits, listed

    def over_batches(self, table, batches, floor=None):
        if table.num_rows == 0:
            return
        q, mark, probing = self._start(table, floor)
        for batch in batches:
            found = self._cut(table, q, mark, arrow.as_table(batch), probing)
            if found is not None:
                yield from found.to_batches(max_chunksize=50_000)

    def seed(self, table, batches):
        """The k best scores per query, in tasks whose number is a square."""
        if table.num_rows == 0 or math.isqrt(TaskContext.get().partitionId()) ** 2 != TaskContext.get().partitionId():
            return
        q, mark, probing = self._start(table, None)
        for batch in batches:
            self._cut(table, q, mark, arrow.as_table(batch), probing)
        for i, best in enumerate(mark):
            best = best[best > -np.inf].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([best], pa.list_(pa.float64()))], names=["q", "best"]
            )

    def _start(self, table, floor):
        q = arrow.matrix(table.column(self.vector), len(table.column(self.vector)[0].as_py()))
        mark = np.full((len(q), self.k), -np.inf)
        if floor is not None:
            mark[:] = floor[:, None]
        return q, mark, self._probing(table) if self.listed else None

    def _probing(self, table):
        """list id -> numbers of the queries that probe it."""
        probing = {}
        for i, lists in enumerate(table.column("lists").to_pylist()):
            for one in lists:
                probing.setdefault(one, []).append(i)
        return {one: np.array(who) for one, who in probing.items()}

    def _cut(self, table, q, mark, corpus, probing):
        if corpus.num_rows == 0:
            return None
        corpus = corpus.take(arrow.key_order(corpus, self.corpus_keys))
        vectors = arrow.matrix(corpus.column(self.vector), q.shape[1])
        usable = np.flatnonzero(np.isfinite(vectors.sum(axis=1)))
        if probing is None:
            parts = [(np.arange(len(q)), usable)]
        else:
            lists = corpus.column("list_id").to_numpy()[usable]
            parts = [(probing[one], usable[lists == one]) for one in np.unique(lists) if one in probing]
        who, where, score = [], [], []
        for asking, at in parts:
            for lo in range(0, len(asking), QUERY_STEP):
                some = asking[lo : lo + QUERY_STEP]
                qi, ri, s = self._block(q[some], vectors[at], mark, some)
                who.append(some[qi])
                where.append(at[ri])
                score.append(s)
        if not who:
            return None
        return self._rows(table, corpus, np.concatenate(who), np.concatenate(where), np.concatenate(score))

    def _block(self, q, vectors, mark, some):
        s = q @ vectors.T
        if self.kind == "dot01":
            s = (1.0 + s) / 2
        if self.digits is not None:
            s = np.round(s, self.digits)
        s += 0.0
        best = s
        if s.shape[1] > self.k:
            best = np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k :]
        both = np.concatenate([mark[some], best], axis=1)
        mark[some] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        bar = mark[some].min(axis=1)
        qi, ri = np.nonzero(s >= bar[:, None])
        got = s[qi, ri]
        # Rows are in key order, so of those level with the bar the first ones
        # win; more than the free places cannot be among the k best.
        level = got == bar[qi]
        free = self.k - np.bincount(qi[~level], minlength=len(q))
        nth = np.cumsum(level)
        start = np.searchsorted(qi, np.arange(len(q)))
        before = np.where(start > 0, nth[np.maximum(start - 1, 0)], 0) if len(nth) else start
        keep = ~level | (nth - before[qi] <= free[qi])
        return qi[keep], ri[keep], got[keep]

    def _rows(self, table, corpus, who, where, score):
        who, where = pa.array(who, pa.int64()), pa.array(where, pa.int64())
        columns = [table.column(c).take(who) for c in self.query_keys]
        columns += [corpus.column(c).take(where) for c in self.corpus_keys]
        columns.append(pa.array(score, pa.float64()))
        return pa.table(columns, names=[*self.query_keys, *self.corpus_keys, "similarity"])
