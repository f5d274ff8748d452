"""Late-interaction search over a whole query set."""

from pyspark.sql import functions as F

from rankloom.operators import sizing
from rankloom.operators.encode import HashEncoder, encode_tokens
from rankloom.operators.limits import adaptive_hits, deepest_fetch
from rankloom.operators.lookup import result_records
from rankloom.operators.maxsim import best_matches, candidates, maxsim_scores, stage1_scores
from rankloom.operators.nearest import nearest
from rankloom.operators.ranking import ranked, top_k
from rankloom.schema import MAX_FETCH


def encode_queries(queries, encoder=HashEncoder):
    """``query_id, q_pos, embedding`` of each query text."""
    return encode_tokens(queries, encoder, key="query_id", position="q_pos")


def token_hits(query_tokens, tokens, depth, kind="dot", digits=6):
    """The best ``depth`` token vectors per query token, ranked."""
    keys = ("query_id", "q_pos"), ("chunk_id", "embedding_id")
    return nearest(query_tokens, tokens, depth, *keys, kind=kind, digits=digits)


def grid_candidates(query_tokens, tokens, grid, n_candidates, kind="dot", digits=6, cap=MAX_FETCH):
    """``n_ann, query_id, chunk_id, stage1, rank`` for each n_ann of the grid.

    All grid values read prefixes of one ranking, so the corpus is searched once.
    """
    depth = deepest_fetch(grid, cap)
    hits = token_hits(query_tokens, tokens, max(depth, 1), kind, digits)
    kept = adaptive_hits(hits, grid, cap=cap)
    scores = stage1_scores(best_matches(kept, ["n_ann"]), ["n_ann"], digits)
    return candidates(scores, n_candidates, ["n_ann"])


def late_interaction_search(
    query_tokens, tokens, n_ann, n_candidates, kind="dot", digits=6, floor_zero=False, cap=MAX_FETCH, buckets=None
):
    """``query_id, chunk_id, stage1, rank, score`` of all candidates.

    ``rank`` is the stage-1 order in which they were picked; ``score`` is exact.
    """
    asked, _ = sizing.pinned(query_tokens)
    picked = grid_candidates(asked, tokens, [n_ann], n_candidates, kind, digits, cap).drop("n_ann")
    # Stored between the stages: the corpus is searched once, and the count of
    # pairs that decides on the broadcast is exact.
    picked = sizing.stored(picked, "candidates")
    exact = maxsim_scores(picked, asked, tokens, picked.count(), digits, floor_zero, buckets)
    return picked.join(exact, ["query_id", "chunk_id"])


def retrieve(query_tokens, tokens, chunks, n_docs=5, n_ann=None, n_candidates=None, strict=True, **options):
    """The best n_docs per query as ``query_id, rank, _id, title, body, score``."""
    found = late_interaction_search(query_tokens, tokens, n_ann or n_docs, n_candidates or n_docs, **options)
    best = final_top(found, n_docs)
    return result_records(best, chunks, strict)


def final_top(found, n_docs):
    """Top n by exact score; ties by chunk id."""
    rows = found.select("query_id", "chunk_id", "score")
    return top_k(rows, ["query_id"], [F.desc("score"), F.asc("chunk_id")], n_docs)


def late_run(found, system="late", config="default"):
    """Search results in the form that evaluation takes."""
    rows = found.select("query_id", F.col("chunk_id").alias("doc_id"), "score")
    rows = ranked(rows, ["query_id"], [F.desc("score"), F.asc("doc_id")])
    return rows.select(F.lit(system).alias("system"), F.lit(config).alias("config"), *rows.columns)
