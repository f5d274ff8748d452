"""BM25 over whitespace tokens (the Okapi form with a floor for negative idf).

    idf   = ln(N - df + 0.5) - ln(df + 0.5);  where negative: epsilon * mean idf
    score = sum over query tokens, with repetition, of
            idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))
"""

from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions.text import tokenize
from rankloom.operators import nearest, postings as blocks, sizing
from rankloom.operators.ranking import top_k
from rankloom.schema import BM25_B, BM25_EPSILON, BM25_K1


#: Terms that are written into a filter of the scan; more are looked up in a broadcast table.
MAX_PUSHED = 500


def term_rows(texts, *keys):
    """One row per token.  The outer form of explode, with the empty row taken
    out by the caller's join or here: the plain form makes Spark test the size
    of the array first, and so cut every text into tokens twice."""
    tokens = texts.select(*keys, tokenize(F.col("text")).alias("tokens"))
    return tokens.select(*keys, F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term"))


def postings(corpus):
    """``doc_id, term, tf``: term frequencies.  Map tasks add up first."""
    rows = term_rows(corpus, "doc_id").filter(F.col("term").isNotNull())
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(corpus):
    return corpus.select("doc_id", F.size(tokenize(F.col("text"))).alias("length"))


def vocabulary(corpus):
    """``(terms, totals)`` from one pass and one shuffle, stored in the scratch folder.

    ``terms``: term, df.  ``totals``: one row n_docs, mean_length; none for an empty corpus.
    """
    counted = sizing.stored(blocks.term_counts(corpus), "terms")
    terms = counted.filter(F.col("term") != "").select("term", "df")
    totals = counted.filter(F.col("term") == "").select(
        F.col("df").alias("n_docs"), (F.col("length") / F.col("df")).alias("mean_length")
    )
    return terms, totals


def idf(terms, totals, epsilon=BM25_EPSILON):
    """Add ``idf``.  The mean is over all terms, negative ones included."""
    n = totals.select("n_docs").scalar()
    raw = terms.withColumn("_raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("_raw")).scalar()
    return raw.withColumn("idf", F.when(F.col("_raw") < 0, epsilon * mean).otherwise(F.col("_raw"))).drop("_raw")


def query_terms(queries):
    """``query_id, term, qtf``."""
    rows = term_rows(queries, "query_id").filter(F.col("term").isNotNull())
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def write_index(corpus, path, epsilon=BM25_EPSILON, order=None, mode="errorifexists"):
    """Store statistics and postings once for many searches.

    Postings are cut by document (``operators.postings``), so a search reads them in place and no term is a hot key.
    """
    terms, totals = vocabulary(corpus)
    totals.write.mode(mode).parquet(f"{path}/totals")
    totals = corpus.sparkSession.read.parquet(f"{path}/totals")
    idf(terms, totals, epsilon).write.mode(mode).parquet(f"{path}/terms")
    blocks.write_blocks(corpus, f"{path}/blocks", order or corpus_order(corpus), mode)


def stored_statistics(spark, path):
    """``(terms with idf, totals)`` of a stored index."""
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/totals")


def corpus_order(corpus):
    """The column that has the corpus order: ``pos`` where there is one, else the id."""
    return "pos" if "pos" in corpus.columns else "doc_id"


def bm25_best(
    queries,
    corpus=None,
    k=100,
    fill_zero=True,
    index=None,
    k1=BM25_K1,
    b=BM25_B,
    epsilon=BM25_EPSILON,
    digits=6,
    block_bytes=sizing.BLOCK_BYTES,
):
    """``query_id, doc_id, score, rank``: the k best documents; ties in corpus order.

    fill_zero: every document takes part, one without a match with score 0, before negative scores; else only
    documents that share a term.  index: folder of a stored index, which takes the corpus's place.

    Each task scores its own documents and gives its k best.  On a corpus of many tasks a first pass over
    about the square root of them gives each query a proven mark, below which nothing is given out.  A query
    set too large for a task is searched in blocks.
    """
    if index is None:
        counted, totals = vocabulary(corpus)
        terms = idf(counted, totals, epsilon)
        rows = sizing.spread(corpus.select("doc_id", F.col(corpus_order(corpus)).alias("key"), "text"))
        types = [rows.schema["doc_id"].dataType, rows.schema["key"].dataType]
    else:
        terms, totals = stored_statistics(queries.sparkSession, index)
        rows = queries.sparkSession.read.parquet(f"{index}/blocks")
        types = [rows.schema["docs"].dataType.elementType, rows.schema["keys"].dataType.elementType]
    asked = queries.select("query_id", "text")
    schema = T.StructType(
        [
            asked.schema["query_id"],
            T.StructField("doc_id", types[0]),
            T.StructField("key", types[1]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    total = totals.first()
    size = asked.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    order = [F.desc("score"), F.asc("key")]
    found = []
    for table, alone in sizing.query_blocks(asked, ["query_id", "text"], 100 + 20 * int(size) + 100 * k, block_bytes):
        wanted, weights = _weights(table, terms)
        make = partial(blocks.Scorer, weights, table.num_rows, k, total.mean_length if total else 1.0, k1, b, digits, fill_zero)
        read = rows if index is None else _with_terms(rows, wanted)
        task = partial(blocks.search_task, to_arrow_schema(schema), wanted, table.column("query_id").combine_chunks(), index is not None)
        if nearest._splits(read) >= nearest.SEED_SPLITS:
            make = partial(make, floor=_floor(read, task, make, table, schema, order, k))
        best = top_k(read.mapInArrow(partial(task, make, False), schema), ["query_id"], order, k).drop("key")
        found.append(best if alone else sizing.stored(best, "bm25"))
    return reduce(lambda x, y: x.union(y), found)


def _with_terms(rows, wanted):
    """The rows of stored blocks that a search needs, in their order; few terms also prune pages of the files."""
    if len(wanted) <= MAX_PUSHED:
        return rows.filter(F.col("term").isin(["", *wanted]))
    asked = rows.sparkSession.createDataFrame(pa.table({"term": pa.array(["", *wanted], pa.string())}))
    return rows.join(F.broadcast(asked), "term", "left_semi").select(*rows.columns)


def _weights(table, terms):
    """``(wanted, (term, query, weight))`` of a block of queries: terms by number, and arrays of numbers and weights.

    Only the terms of the block are looked up; their number is bounded by the block's size.
    """
    counts = [Counter((text or "").split()) for text in table.column("text").to_pylist()]
    wanted = sorted({t for some in counts for t in some})
    spark = terms.sparkSession
    asked = spark.createDataFrame(pa.table({"term": pa.array(wanted, pa.string())}))
    known = terms.join(F.broadcast(asked), "term").select("term", "idf").toArrow()
    idf_of = dict(zip(known.column("term").to_pylist(), known.column("idf").to_pylist(), strict=True))
    wanted = {t: i for i, t in enumerate(t for t in wanted if t in idf_of)}
    rows = [(wanted[t], q, n * idf_of[t]) for q, some in enumerate(counts) for t, n in some.items() if t in wanted]
    term, query, weight = zip(*rows, strict=True) if rows else ((), (), ())
    return wanted, (np.array(term, np.int64), np.array(query, np.int64), np.array(weight, np.float64))


def _floor(rows, task, make, table, schema, order, k):
    """For each query of a block the k-th best score that some of the tasks prove, or None."""
    seeds = top_k(rows.mapInArrow(partial(task, make, True), schema), ["query_id"], order, k)
    marks = seeds.groupBy("query_id").agg(F.min("score").alias("mark"), F.count("*").alias("n")).filter(F.col("n") >= k)
    of = {r.query_id: r.mark for r in marks.collect()}  # at most one row for each query of the block
    return [of.get(q) for q in table.column("query_id").to_pylist()]
