"""BM25 and substring search over a whole query set."""

from pyspark.sql import functions as F

from rankloom.functions.text import result_line
from rankloom.operators.lexical import bm25_best
from rankloom.operators.numbering import numbered
from rankloom.operators.sizing import stored
from rankloom.operators.substring import match_counts, substring_matches


def bm25_search(queries, corpus, k=100, fill_zero=True, index=None, **options):
    """``query_id, doc_id, score, rank``.

    ``fill_zero``: documents without a match complete a list that is shorter
    than k.  ``index``: folder of a stored index of the same corpus.
    """
    return bm25_best(queries, corpus, k, fill_zero, index, **options)


def bm25_run(found, system="bm25", config="default"):
    return found.select(
        F.lit(system).alias("system"), F.lit(config).alias("config"), "query_id", "doc_id", "score", "rank"
    )


def substring_search(queries, chunks):
    """``(matches, counts)``: numbered result lines per query, and how many."""
    matches = stored(substring_matches(queries, chunks), "matches")
    # a text that matches most bodies is numbered by many tasks; bodies are joined to the numbered lines
    listed = numbered(matches, ["query_id"], ["id"]).withColumn("rank", (F.col("pos") + 1).cast("int"))
    listed = listed.join(chunks.select("id", "title", "body"), "id")
    lines = listed.select("query_id", "rank", result_line(F.col("rank"), F.col("title"), F.col("body")).alias("line"))
    return lines, match_counts(queries, matches)
