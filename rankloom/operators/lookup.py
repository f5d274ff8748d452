"""Lookups by key, and text for result ids."""

from pyspark.sql import functions as F

from rankloom.sources.tables import bucket_of


def chunk_by_id(chunks, chunk_id):
    """One chunk; the filter reaches the scan."""
    return chunks.filter(F.col("id") == F.lit(chunk_id)).select("id", "title", "body")


def tokens_of_chunk(tokens, chunk_id, buckets=None):
    """All token vectors of one chunk.

    ``buckets``: the bucket number the table was written with, if any; then
    only one bucket folder is read.
    """
    rows = tokens.filter(F.col("chunk_id") == F.lit(chunk_id))
    if buckets is not None:
        rows = rows.filter(F.col("chunk_bucket") == bucket_of(F.lit(chunk_id), buckets))
    return rows.select("chunk_id", "embedding")


def result_records(results, chunks, strict=True):
    """``_id, title, body, score`` for ranked results; keeps query_id and rank.

    ``strict`` fails on a result whose chunk is missing; otherwise such results
    are dropped.
    """
    text = chunks.select(F.col("id"), "title", "body")
    joined = results.join(text, results["chunk_id"] == text["id"], "left" if strict else "inner")
    found = F.col("id")
    if strict:
        missing = F.concat(F.lit("no chunk with id "), results["chunk_id"].cast("string"))
        found = F.when(found.isNull(), F.raise_error(missing).cast(text.schema["id"].dataType)).otherwise(found)
    return joined.select("query_id", "rank", found.alias("_id"), "title", "body", "score")
