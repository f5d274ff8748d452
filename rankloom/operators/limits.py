"""Adaptive fetch limit per query token, from one ranked hit table.

The rule: fetch ``n_ann`` hits; if they come from fewer than
``max(2, n_ann / 4)`` chunks, fetch twice as many, and so on while the limit is
at most ``cap``; the last fetch made counts, passed or not.  Every fetch is a
prefix of the same ranking, so the rule needs one ranking and one pass.
"""

from pyspark.sql import functions as F

from rankloom.schema import MAX_FETCH


def limit_series(n_ann, cap=MAX_FETCH):
    """The limits tried, in order; empty when n_ann is over the cap."""
    series, limit = [], n_ann
    while 0 < limit <= cap:
        series.append(limit)
        limit *= 2
    return series


def deepest_fetch(grid, cap=MAX_FETCH):
    """How many hits per token the whole grid can need."""
    return max((max(limit_series(n, cap), default=0) for n in grid), default=0)


def effective_limits(hits, grid, token_keys=("query_id", "q_pos"), chunk="chunk_id", cap=MAX_FETCH):
    """Add ``limits``: an array of (n_ann, limit), one per grid value.

    ``hits`` is ranked per token by ``rank`` and at least ``deepest_fetch`` deep.
    """
    token = ", ".join(token_keys)
    tried = sorted({limit for n in grid for limit in limit_series(n, cap)})
    if not tried:
        return hits.withColumn("limits", F.expr("cast(array() as array<struct<n_ann:int,limit:int>>)"))
    first = f"row_number() over (partition by {token}, {chunk} order by rank) = 1 as _new"
    distinct = [
        f"sum(if(_new and rank <= {limit}, 1, 0)) over (partition by {token}) as _distinct_{limit}" for limit in tried
    ]
    limits = []
    for n in grid:
        series = limit_series(n, cap)
        if series:
            passing = "".join(f"when _distinct_{x} >= {max(2, n / 4)}D then {x} " for x in series)
            limits.append(f"struct({n} as n_ann, case {passing}else {series[-1]} end as limit)")
    marked = hits.selectExpr("*", first).selectExpr("*", *distinct)
    return marked.selectExpr(*hits.columns, f"array({', '.join(limits)}) as limits")


def adaptive_hits(hits, grid, token_keys=("query_id", "q_pos"), chunk="chunk_id", cap=MAX_FETCH):
    """The hits that each grid value keeps; adds ``n_ann`` and ``limit``."""
    limited = effective_limits(hits, grid, token_keys, chunk, cap)
    return limited.select(*hits.columns, F.inline("limits")).filter(F.col("rank") <= F.col("limit"))
