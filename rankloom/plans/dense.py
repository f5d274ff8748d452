"""Dense search: one vector per passage."""

from pyspark.sql import functions as F

from rankloom.operators.encode import HashEncoder, encode_dense
from rankloom.operators.nearest import nearest
from rankloom.operators.sizing import stored
from rankloom.operators.upsert import update_dense
from rankloom.sources import sides


def dense_search(query_vectors, chunks, k=100, kind="dot", digits=6):
    """``query_id, id, similarity, rank``; chunks without a vector take no part."""
    rows = chunks.select("id", F.col("dense_embedding").alias("embedding"))
    return nearest(query_vectors, rows, k, ("query_id",), ("id",), kind=kind, digits=digits)


def dense_text_search(queries, chunks, k=100, encoder=HashEncoder, **options):
    """Query texts are encoded first."""
    vectors = encode_dense(queries, encoder, key="query_id", name="embedding")
    return dense_search(vectors, chunks, k, **options)


def add_dense_vectors(chunks, corpus, encoder=HashEncoder, insert_missing=True):
    """Encode the corpus texts and set them as dense vectors by id.

    The vectors are stored first: the update reads its input more than once,
    and every text is to be encoded once.
    """
    texts = corpus.select(F.col("doc_id").alias("id"), "text")
    return update_dense(chunks, stored(encode_dense(texts, encoder), "vectors"), insert_missing)


def add_side_vectors(chunks, corpus, encoder=HashEncoder, insert_missing=True, buckets=sides.BUCKETS):
    """The same for chunks that are a table of ``sources.sides``: only the vectors move, once, when they are stored."""
    texts = corpus.select(F.col("doc_id").alias("id"), "text")
    vectors = sides.write_bucketed(encode_dense(texts, encoder), sides.table_name("vectors"), buckets=buckets)
    return sides.with_vectors(chunks, vectors, insert_missing)


def dense_run(found, system="dense", config="default"):
    rows = found.select("query_id", F.col("id").alias("doc_id"), F.col("similarity").alias("score"), "rank")
    return rows.select(F.lit(system).alias("system"), F.lit(config).alias("config"), *rows.columns)
