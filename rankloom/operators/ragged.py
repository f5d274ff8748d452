"""Ragged arrays: rows per chunk, packed lists, and one flat list with counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F


SEGMENT = 8192


def pack(tokens, segment_rows=SEGMENT):
    """The vectors of each chunk in order, and how many there are.

    A chunk is one row (``segment`` 0) unless it is longer than
    ``segment_rows``; then it goes on in further segments, so that no list
    grows without a bound.
    """
    ordered = F.array_sort(F.collect_list(F.struct("embedding_id", "embedding")))
    segment = F.floor(F.col("embedding_id") / segment_rows).cast("int").alias("segment")
    packed = tokens.groupBy("chunk_id", segment).agg(ordered.alias("_rows"))
    vectors = F.transform("_rows", lambda r: r["embedding"])
    return packed.select("chunk_id", "segment", vectors.alias("embeddings"), F.size("_rows").alias("length"))


def unpack(packed, segment_rows=SEGMENT):
    """Back to one row per (chunk, position); positions count from 0 without gaps."""
    rows = packed.select("chunk_id", "segment", F.posexplode("embeddings").alias("_at", "embedding"))
    at = F.col("segment") * segment_rows + F.col("_at")
    return rows.select("chunk_id", at.alias("embedding_id"), "embedding")


def offsets(counts, keys=("doc_id",), order="part", length="length"):
    """Start of each part in the flat list: the sum of the lengths before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def slice_flat(flat, offset, length):
    """The part of a flat list that starts at offset (from 0)."""
    return F.slice(flat, offset + 1, length)
