"""Approximate nearest-vector join: cluster lists as data layout.

Rows are assigned to their nearest of ``n_lists`` centroids and stored by
``list_id``; a query probes its ``nprobe`` nearest lists only.  Reads of other
lists are pruned at the scan.  With ``nprobe = n_lists`` the result is exact.

``train_two_level`` is for many lists: a row is held against the coarse centroids and then the fine ones below
the nearest, about twice the root of their number instead of all.  Both kinds of model serve the same calls.
"""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import arrow
from rankloom.operators.nearest import nearest_in_lists

TRAIN_ROWS = 256


def train_lists(corpus, n_lists, vector="embedding", iterations=10, seed=17, train_fraction=None):
    """Centroids by k-means on a sample, ``TRAIN_ROWS`` rows for each list by default.

    Only training samples; every row is assigned and stored.
    """
    if n_lists < 2:
        raise ValueError("n_lists must be at least 2")
    rows = corpus.filter(F.col(vector).isNotNull())
    if train_fraction is None:
        train_fraction = min(1.0, TRAIN_ROWS * n_lists / max(1, rows.count()))
    if train_fraction < 1.0:
        rows = rows.sample(fraction=train_fraction, seed=seed)
    rows = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=n_lists, maxIter=iterations, seed=seed).fit(rows)


class TwoLevel:
    """Coarse centroids and, below each, fine ones; the lists are the fine ones, numbered through."""

    def __init__(self, coarse, fine):
        self.coarse, self.fine = coarse, fine
        self.first = np.concatenate([[0], np.cumsum([len(f) for f in fine])])

    def clusterCenters(self):
        return list(np.concatenate(self.fine))

    def nearest_lists(self, vectors):
        """The list of each vector; a vector meets the fine centroids below its nearest coarse one only."""
        top = _nearest(vectors, self.coarse)
        out = np.empty(len(vectors), dtype=np.int32)
        for c in np.unique(top):
            own = top == c
            out[own] = self.first[c] + _nearest(vectors[own], self.fine[c])
        return out


def _nearest(vectors, centers):
    """Number of the centroid with the least squared distance; the first one on a tie."""
    return np.argmin((centers * centers).sum(axis=1) - 2 * (vectors @ centers.T), axis=1)


def _lloyd(vectors, n, iterations, seed):
    """At most n centroids of a bounded sample."""
    different = np.unique(vectors, axis=0)
    centers = different[np.random.default_rng(seed).permutation(len(different))[:n]]
    for _ in range(iterations):
        own = _nearest(vectors, centers)
        count = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, vectors)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def train_two_level(corpus, n_coarse, n_fine, vector="embedding", iterations=10, seed=17, train_fraction=None):
    """``n_coarse`` centroids, and up to ``n_fine`` below each, from a sample of the corpus.

    The fine ones of each coarse list are trained in a task of their own, from the list's share of the sample.
    """
    model = train_lists(corpus, n_coarse, vector, iterations, seed, train_fraction)
    if train_fraction is None:
        train_fraction = min(1.0, TRAIN_ROWS * n_coarse * n_fine / max(1, corpus.filter(F.col(vector).isNotNull()).count()))
    rows = corpus.sample(fraction=train_fraction, seed=seed) if train_fraction < 1.0 else corpus
    rows = assign_lists(rows, model, vector).select("list_id", F.col(vector).cast("array<double>").alias("v"))

    def fit(key, part):
        centers = _lloyd(np.stack(part["v"].to_numpy()), n_fine, iterations, seed)
        return pd.DataFrame({"list_id": [key[0]] * len(centers), "v": list(centers)})

    found = rows.groupBy("list_id").applyInPandas(fit, "list_id int, v array<double>")
    coarse = np.array(model.clusterCenters())
    fine = [[] for _ in coarse]
    for row in found.collect():  # at most n_coarse * n_fine centroids
        fine[row.list_id].append(row.v)
    return TwoLevel(coarse, [np.array(f) if f else coarse[i : i + 1] for i, f in enumerate(fine)])


def assign_lists(corpus, model, vector="embedding"):
    """Add ``list_id``; rows without a vector are left out.  model: of ``train_lists`` or ``train_two_level``."""
    if isinstance(model, TwoLevel):
        return _assign_two_level(corpus, model, vector)
    rows = corpus.filter(F.col(vector).isNotNull()).withColumn(
        "_features", array_to_vector(F.col(vector).cast("array<double>"))
    )
    model = model.copy().setFeaturesCol("_features").setPredictionCol("list_id")
    return model.transform(rows).drop("_features")


def _assign_two_level(corpus, model, vector):
    names = corpus.columns
    schema = T.StructType([*corpus.schema.fields, T.StructField("list_id", T.IntegerType())])

    def near(batches):
        for batch in batches:
            lists = model.nearest_lists(arrow.matrix(batch.column(names.index(vector)), model.coarse.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32())], names=[*names, "list_id"])

    return corpus.filter(F.col(vector).isNotNull()).mapInArrow(near, schema)


def write_lists(assigned, path, files_per_list=None):
    """Store by list.  A hot list is spread over tasks by its bytes, or over ``files_per_list`` tasks."""
    if files_per_list is None:
        assigned.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(os.fspath(path))
        return
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in assigned.columns if c != "list_id"]), F.lit(files_per_list))
    (assigned.repartition("list_id", salt).write.partitionBy("list_id").parquet(os.fspath(path)))


def probe_lists(queries, model, nprobe, vector="embedding"):
    """Add ``lists``: the nprobe lists whose centroids have the largest product with the query vector,
    as rows are ranked by products too."""
    centers = np.array(model.clusterCenters())
    names = queries.columns
    schema = T.StructType([*queries.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])

    def near(batches):
        for batch in batches:
            q = arrow.matrix(batch.column(names.index(vector)), centers.shape[1])
            lists = np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
            column = pa.array(list(lists), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, "lists"])

    return queries.filter(F.col(vector).isNotNull()).mapInArrow(near, schema)


def ivf_search(queries, assigned, model, k, nprobe, **options):
    """The k best rows per query among its probed lists."""
    vector = options.get("vector", "embedding")
    probes = probe_lists(queries, model, nprobe, vector)
    return nearest_in_lists(probes, assigned, k, **options)


def recall(found, exact, query_keys=("query_id",), corpus_keys=("chunk_id",)):
    """Per query ``n, hits, recall``: the share of the exact result that was found; queries of the exact result only."""
    keys = [*query_keys, *corpus_keys]
    got = found.select(*keys, F.lit(1).alias("hit")).dropDuplicates(keys)
    both = exact.select(*keys).join(got, keys, "left").groupBy(*query_keys)
    counted = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return counted.withColumn("recall", F.col("hits") / F.col("n"))


def probes_for(least, queries, exact, assigned, model, vector="embedding", query_keys=("query_id",), corpus_keys=("chunk_id",)):
    """The smallest ``nprobe`` with which the queries find at least that share of their exact results.

    Read off one join: how far down its query's order of lists each exact row's list comes.
    """
    n_lists = len(model.clusterCenters())
    lists = probe_lists(queries, model, n_lists, vector).select(*query_keys, "lists")
    rows = exact.select(*query_keys, *corpus_keys).join(lists, list(query_keys))
    rows = rows.join(assigned.select(*corpus_keys, "list_id"), list(corpus_keys))
    places = rows.groupBy(F.array_position("lists", F.col("list_id")).alias("p")).agg(F.count("*").alias("n"))
    counts = {r.p: r.n for r in places.collect()}  # at most one row for each list
    need, found = least * sum(counts.values()), 0
    for p in range(1, n_lists + 1):
        found += counts.get(p, 0)
        if found >= need:
            return p
    return n_lists
