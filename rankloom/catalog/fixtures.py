"""The engine's input tables, derived from the driver tables.  All rows are used."""

from pyspark.sql import functions as F

from rankloom.functions.vectors import mean_vector

WIDTH = 64
SLOTS = 4
CHUNK_ROWS = 8


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.col("source").alias("title"), "text")


def chunks(spark, sf):
    """Documents as chunks without dense vectors."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("title"),
        F.col("text").alias("body"),
        F.lit(None).cast("array<float>").alias("dense_embedding"),
    )


def queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokens(spark, sf):
    """Vectors as token vectors of chunks of eight."""
    vectors = table(spark, sf, "embeddings")
    return vectors.select(
        F.floor(F.col("vec_id") / CHUNK_ROWS).alias("chunk_id"),
        (F.col("vec_id") % CHUNK_ROWS).cast("int").alias("embedding_id"),
        "embedding",
    )


def class_tokens(spark, sf):
    """Vectors as token vectors of one long chunk per label; forces wider fetches."""
    vectors = table(spark, sf, "embeddings")
    return vectors.select(
        F.col("label").cast("bigint").alias("chunk_id"), F.col("vec_id").cast("int").alias("embedding_id"), "embedding"
    )


def query_tokens(spark, sf):
    """One query per label with four token vectors, each the mean of a share of its vectors."""
    vectors = table(spark, sf, "embeddings")
    slot = (F.col("vec_id") % SLOTS).cast("int").alias("q_pos")
    means = vectors.groupBy(F.col("label").cast("bigint").alias("query_id"), slot).agg(
        mean_vector("embedding", WIDTH).alias("embedding")
    )
    return means.withColumn("embedding", F.col("embedding").cast("array<float>"))


def query_vectors(spark, sf):
    """One query vector per label: the mean of its vectors."""
    vectors = table(spark, sf, "embeddings")
    means = vectors.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        mean_vector("embedding", WIDTH).alias("embedding")
    )
    return means.withColumn("embedding", F.col("embedding").cast("array<float>"))


def vector_chunks(spark, sf):
    """Vectors as chunks with a dense vector and a line of text."""
    vectors = table(spark, sf, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("id"),
        F.format_string("label %d", "label").alias("title"),
        F.format_string("vector %d", "vec_id").alias("body"),
        F.col("embedding").alias("dense_embedding"),
    )


def token_chunks(spark, sf):
    """Text of the chunks of eight."""
    ids = tokens(spark, sf).select("chunk_id").distinct()
    return ids.select(
        F.col("chunk_id").alias("id"),
        F.format_string("chunk %d", "chunk_id").alias("title"),
        F.format_string("vectors from %d", F.col("chunk_id") * CHUNK_ROWS).alias("body"),
    )


def graded_qrels(spark, sf):
    """Grade of a chunk for a label: how many of its vectors have the label."""
    vectors = table(spark, sf, "embeddings")
    return vectors.groupBy(
        F.col("label").cast("bigint").alias("query_id"), F.floor(F.col("vec_id") / CHUNK_ROWS).alias("doc_id")
    ).agg(F.count(F.lit(1)).cast("int").alias("rel"))


def paragraphs(spark, sf):
    """``doc_id, title, texts``: the lines of each document."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        "lang",
        "source",
        F.format_string("doc-%d", "doc_id").alias("title"),
        F.split("text", "\n").alias("texts"),
    )


def document_json(rows):
    """``value``: chunked JSON of paragraphs, with keys that must not count.

    After the parts come a part behind a gap, a key with a leading zero, and a
    named member.
    """

    def entry(key, text):
        return F.struct(key.alias("key"), F.struct(text.alias("content")).alias("value"))

    parts = F.transform("texts", lambda t, i: entry(i.cast("string"), t))
    hidden = F.array(
        entry((F.size("texts") + 1).cast("string"), F.lit("after a gap")),
        entry(F.lit("01"), F.lit("leading zero")),
        entry(F.lit("note"), F.lit("named")),
    )
    members = F.to_json(F.map_from_entries(F.concat(parts, hidden)))
    title = F.to_json(F.struct("title"))
    value = F.concat(F.regexp_replace(title, r"\}$", ","), F.regexp_replace(members, r"^\{", ""))
    return rows.withColumn("value", value)


def vector_text(vector):
    """A vector as text of whole millionths."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("bigint")), ",")
