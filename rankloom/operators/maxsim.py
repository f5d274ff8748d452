"""Late-interaction scores: best match per query token, summed per passage."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.vectors import settle
from rankloom.operators import arrow, sizing
from rankloom.operators.ranking import top_k
from rankloom.sources.tables import bucket_of


def best_matches(hits, extra_keys=()):
    """Best similarity per (chunk, query position), floored at -1."""
    best = F.greatest(F.max("similarity"), F.lit(-1.0))
    return hits.groupBy(*extra_keys, "query_id", "q_pos", "chunk_id").agg(best.alias("best"))


def stage1_scores(matches, extra_keys=(), digits=6):
    """Sum of the best matches over the positions that hit the chunk."""
    return matches.groupBy(*extra_keys, "query_id", "chunk_id").agg(settle(F.sum("best"), digits).alias("stage1"))


def candidates(scores, n_candidates, extra_keys=()):
    """The first n chunks per query by stage-1 score; ties by chunk id."""
    return top_k(scores, [*extra_keys, "query_id"], [F.desc("stage1"), F.asc("chunk_id")], n_candidates)


def maxsim_scores(
    wanted,
    query_tokens,
    tokens,
    wanted_bound=None,
    digits=6,
    floor_zero=False,
    buckets=None,
    block_bytes=sizing.BLOCK_BYTES,
):
    """Exact score of each wanted ``(query_id, chunk_id)`` pair.

    Per query position the best dot product over all token vectors of the
    chunk, summed over positions.  ``wanted_bound`` is the proven number of
    wanted pairs; under the broadcast bound the token table is not shuffled.
    ``floor_zero`` counts negative best matches as 0.  ``buckets``: the number
    the token table was written with, so that other buckets are not read.  A query
    set over ``block_bytes`` is scored in blocks of queries.

    The vectors of one chunk are never brought into one task: each batch gives
    its own best values, and the maximum over batches is a Spark aggregate.
    """
    pairs = wanted.select("query_id", "chunk_id").distinct()
    shared = ["chunk_id"]
    if buckets is not None:
        pairs = pairs.withColumn("chunk_bucket", bucket_of(F.col("chunk_id"), buckets))
        shared = ["chunk_bucket", "chunk_id"]
    pairs = sizing.broadcast_if(pairs, wanted_bound)
    rows = tokens.filter(F.col("embedding").isNotNull()).join(pairs, shared)
    asked = query_tokens.select("query_id", "q_pos", "embedding").filter(F.col("embedding").isNotNull())
    schema = T.StructType(
        [rows.schema["query_id"], rows.schema["chunk_id"], asked.schema["q_pos"], T.StructField("best", T.DoubleType())]
    )
    first = asked.select(F.size("embedding")).first()
    found = []
    for table, alone in sizing.query_blocks(asked, ["query_id"], 8 * (first[0] if first else 1), block_bytes):
        mine = rows.select("query_id", "chunk_id", "embedding")
        if not alone:
            own = asked.sparkSession.createDataFrame(table.select(["query_id"])).distinct()
            mine = mine.join(F.broadcast(own), "query_id", "left_semi")
        best = mine.mapInArrow(lambda batches, table=table: _best_per_batch(table, batches, schema.names), schema)
        best = best.groupBy("query_id", "chunk_id", "q_pos").agg(F.max("best").alias("best"))
        found.append(best if alone else sizing.stored(best, "maxsim"))
    best = reduce(lambda a, b: a.union(b), found)
    if floor_zero:
        best = best.withColumn("best", F.greatest("best", F.lit(0.0)))
    return best.groupBy("query_id", "chunk_id").agg(settle(F.sum("best"), digits).alias("score"))


def _best_per_batch(table, batches, names):
    """Per (query, chunk) present in a batch: the best value per position."""
    if table.num_rows == 0:
        return
    width = len(table.column("embedding")[0].as_py())
    everything = arrow.matrix(table.column("embedding"), width)
    coded = table.column("query_id").combine_chunks().dictionary_encode()
    of_query = coded.indices.to_numpy()
    query_rows = [np.flatnonzero(of_query == i) for i in range(len(coded.dictionary))]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        vectors = arrow.matrix(batch.column(2), width)
        code = pc.index_in(batch.column(0), value_set=coded.dictionary)
        chunk = batch.column(1).dictionary_encode()
        code = np.nan_to_num(code.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
        order = np.lexsort((chunk.indices.to_numpy(), code))
        edges = np.flatnonzero(np.diff(code[order], prepend=-2))
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            if code[order[lo]] < 0:
                continue
            asked = query_rows[code[order[lo]]]
            some = order[lo:hi]
            groups = chunk.indices.to_numpy()[some]
            starts = np.flatnonzero(np.diff(groups, prepend=-1))
            best = np.maximum.reduceat(vectors[some] @ everything[asked].T, starts, axis=0)
            chunk_rows = np.repeat(some[starts], len(asked))
            asked_rows = np.tile(asked, len(starts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(chunk_rows)),
                    batch.column(1).take(pa.array(chunk_rows)),
                    table.column("q_pos").take(pa.array(asked_rows)).combine_chunks(),
                    pa.array(best.reshape(-1)),
                ],
                names=names,
            )
