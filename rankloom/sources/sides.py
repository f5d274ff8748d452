"""Chunks and their dense vectors as two tables cut alike, joined where they lie.

Both tables are bucketed and sorted by id, so a join reads bucket against bucket: neither side is exchanged.
Vectors change often and are small; the bodies of the chunks stay in their files whatever is set or added.
"""

import uuid

from pyspark.sql import functions as F

from rankloom.session import scratch_dir

BUCKETS = 256


def table_name(prefix="rankloom"):
    return f"{prefix}_{uuid.uuid4().hex}"


def write_bucketed(rows, table, key="id", buckets=BUCKETS, path=None, mode="errorifexists"):
    """Store rows as a table bucketed and sorted by a key.

    Rows are first brought together by bucket, so each bucket is one file or a few and needs no sort when it is read.
    """
    path = path or scratch_dir(rows.sparkSession, table)
    (
        rows.repartition(buckets, F.col(key))
        .write.mode(mode)
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )
    return rows.sparkSession.table(table)


def with_vectors(chunks, vectors, insert_missing=True):
    """``id, title, body, dense_embedding``: the stored chunks with the vectors set by id.

    chunks, vectors: tables of ``write_bucketed`` with equal buckets; an id has one vector at most.  A chunk without a
    new vector keeps its own.  An id without a chunk makes a row without title and body unless ``insert_missing`` is False.
    """
    new = vectors.select(F.col("id").alias("_id"), F.col("dense_embedding").alias("_new")).hint("merge")
    how = "full" if insert_missing else "left"
    joined = chunks.join(new, F.col("id") == F.col("_id"), how)
    return joined.select(
        F.coalesce("id", "_id").alias("id"), "title", "body", F.coalesce("_new", "dense_embedding").alias("dense_embedding")
    )
