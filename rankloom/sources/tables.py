"""Chunk, token and run tables on Parquet."""

from pyspark.sql import functions as F

from rankloom.operators.ranking import top_k


def read_chunk_text(spark, path):
    """Full scan of (title, body); no other column is read."""
    return spark.read.parquet(path).select("title", "body")


def bucket_of(chunk_id, buckets):
    """The bucket folder of a chunk in a table from ``write_tokens``."""
    return F.pmod(F.xxhash64(chunk_id.cast("string")), F.lit(buckets)).cast("int")


def write_tokens(tokens, path, buckets=256, mode="errorifexists"):
    """Token vectors stored by a hash bucket of the chunk, sorted inside files.

    A lookup or a join that carries ``chunk_bucket`` reads only the buckets it
    needs.  Tasks are sized by their bytes (a rebalance, split by adaptive execution), so a
    bucket that is large, or holds one very long chunk, takes several tasks and
    files; rows are sorted inside each file.
    """
    (
        tokens.withColumn("chunk_bucket", bucket_of(F.col("chunk_id"), buckets))
        .hint("rebalance", "chunk_bucket")
        .sortWithinPartitions("chunk_bucket", "chunk_id", "embedding_id")
        .write.mode(mode)
        .partitionBy("chunk_bucket")
        .parquet(path)
    )


def write_run(run, path, mode="errorifexists"):
    """Search results, one folder per system and config."""
    run.write.mode(mode).partitionBy("system", "config").parquet(path)


def read_run(spark, path):
    return spark.read.parquet(path)


def latest(df, keys, version="seq"):
    """The newest row per key; map tasks keep one row per key before the shuffle."""
    return top_k(df, keys, [F.desc(version)], 1, "_newest").drop("_newest")
