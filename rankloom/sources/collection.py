"""Judged collections: corpus, queries, judgments."""

from pyspark.sql import functions as F

from rankloom.operators.numbering import in_file_order


def _line_order():
    """Place of a line in its file, as a sortable column."""
    return F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def load_collection(spark, folder, split="test"):
    """``(corpus, queries, qrels)`` from the usual folder of a judged dataset.

    corpus.jsonl and queries.jsonl have ``_id``; qrels/<split>.tsv has the
    columns query-id, corpus-id, score.  Queries come in the order in which the
    judgments first name them (``pos``); a query without judgments is left out.
    The corpus is numbered in the order of its lines (``pos`` from 0), which breaks ties in searches.
    """
    corpus = in_file_order(spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl"))
    corpus = corpus.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        "pos",
    )
    judged = spark.read.csv(
        f"{folder}/qrels/{split}.tsv",
        sep="\t",
        header=True,
        enforceSchema=True,
        schema="query_id string, doc_id string, rel int",
    )
    order = judged.select("query_id", _line_order().alias("line")).groupBy("query_id").agg(F.min("line").alias("pos"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    queries = queries.select(F.col("_id").alias("query_id"), "text").join(order, "query_id")
    return corpus, queries, judged


def restrict_queries(queries, qrels, n=None):
    """The first n queries by ``pos`` (all without n), and the judgments of these only."""
    first = queries if n is None else queries.orderBy("pos").limit(n)
    return first, qrels.join(first.select("query_id"), "query_id", "left_semi")


def dataset_sizes(corpus, queries, qrels):
    """One row: sizes of the corpus, the query set, and the judged query set."""
    return corpus.agg(F.count(F.lit(1)).alias("n_corpus")).select(
        "n_corpus",
        queries.agg(F.count(F.lit(1))).scalar().alias("n_queries"),
        qrels.agg(F.count_distinct("query_id")).scalar().alias("n_judged"),
    )
