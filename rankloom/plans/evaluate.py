"""Evaluation, side-by-side comparison, parameter sweep, frontier."""

import time

from pyspark.sql import functions as F

from rankloom.operators import sizing
from rankloom.operators.frontier import pareto, throughput
from rankloom.operators.maxsim import maxsim_scores
from rankloom.operators.metrics import metric_table, query_metrics
from rankloom.plans.late import grid_candidates, late_interaction_search, late_run
from rankloom.schema import EVAL_CUTS, MRR_CUTS, SWEEP_VALUES

RUN_COLUMNS = ["system", "config", "query_id", "doc_id", "score", "rank"]


def evaluate(run, qrels, cuts=EVAL_CUTS, mrr_cuts=MRR_CUTS, ignore_identical_ids=True, digits=6):
    """``system, config, metric, k, value``."""
    per_query = query_metrics(run, qrels, cuts, mrr_cuts, ignore_identical_ids)
    return metric_table(per_query, qrels, cuts, mrr_cuts, digits)


def stack_runs(*runs):
    """Runs of several systems, one below the other."""
    out = runs[0].select(*RUN_COLUMNS)
    for run in runs[1:]:
        out = out.unionByName(run.select(*RUN_COLUMNS))
    return out


def side_by_side(left, right):
    """Two result lists of the same queries, row by row; the shorter one has nulls."""
    a = left.select("query_id", "rank", F.col("doc_id").alias("left_doc"), F.col("score").alias("left_score"))
    b = right.select("query_id", "rank", F.col("doc_id").alias("right_doc"), F.col("score").alias("right_score"))
    return a.join(b, ["query_id", "rank"], "full_outer")


def overlap(left, right, k=10):
    """Per query: how many documents both lists have among their first k."""
    a = left.filter(F.col("rank") <= k).select("query_id", "doc_id")
    b = right.filter(F.col("rank") <= k).select("query_id", "doc_id")
    shared = a.join(b, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = a.select("query_id").union(b.select("query_id")).distinct()
    joined = asked.join(shared, "query_id", "left")
    return joined.select("query_id", F.coalesce("n", F.lit(0)).alias("n_shared"))


def compare_systems(runs, qrels, **options):
    """Metrics of several runs on one query set: the queries they all answered."""
    stacked = stack_runs(*runs)
    common = runs[0].select("query_id").distinct()
    for run in runs[1:]:
        common = common.join(run.select("query_id").distinct(), "query_id")
    stacked = stacked.join(common, "query_id", "left_semi")
    return evaluate(stacked, qrels.join(common, "query_id", "left_semi"), **options)


def sweep_run(
    query_tokens, tokens, ann_grid=SWEEP_VALUES, candidate_grid=SWEEP_VALUES, kind="dot", digits=6, buckets=None
):
    """One run per (n_ann, n_candidates), from one search.

    Candidates of each n_ann are prefixes of one stage-1 order, so the exact
    scores are computed once, for the union, and a grid cell is a filter.
    """
    ann_grid, candidate_grid = list(ann_grid), list(candidate_grid)
    deepest = max(candidate_grid)
    asked, _ = sizing.pinned(query_tokens)
    picked = sizing.stored(grid_candidates(asked, tokens, ann_grid, deepest, kind, digits), "candidates")
    exact = maxsim_scores(picked, asked, tokens, picked.count(), digits, buckets=buckets)
    cells = F.array(*[F.lit(n) for n in candidate_grid])
    cells = picked.select("*", F.explode(cells).alias("n_candidates")).filter(F.col("rank") <= F.col("n_candidates"))
    scored = cells.drop("rank", "stage1").join(exact, ["query_id", "chunk_id"])
    config = F.format_string("%d, %d", "n_ann", "n_candidates")
    return scored.select(
        F.lit("late").alias("system"),
        config.alias("config"),
        "n_ann",
        "n_candidates",
        "query_id",
        F.col("chunk_id").alias("doc_id"),
        "score",
    )


def sweep(
    query_tokens,
    tokens,
    qrels,
    ann_grid=SWEEP_VALUES,
    candidate_grid=SWEEP_VALUES,
    cuts=(1, 5, 10, 100),
    ignore_identical_ids=True,
    **options,
):
    """Metrics of every grid cell."""
    run = sweep_run(query_tokens, tokens, ann_grid, candidate_grid, **options)
    return evaluate(run, qrels, cuts, (), ignore_identical_ids)


def timed_sweep(query_tokens, tokens, qrels, ann_grid=SWEEP_VALUES, candidate_grid=SWEEP_VALUES):
    """``label, time, ndcg10`` with each cell run and timed on its own.

    One pass over the grid cannot time its cells, so this is the form to use
    when throughput is wanted.  Results of a cell stay in Spark; the driver
    holds one number per cell.
    """
    rows = []
    for n_ann in ann_grid:
        for n_candidates in candidate_grid:
            label = f"{n_ann}, {n_candidates}"
            start = time.perf_counter()
            run = late_run(late_interaction_search(query_tokens, tokens, n_ann, n_candidates), config=label).persist()
            run.count()
            seconds = time.perf_counter() - start
            table = evaluate(run, qrels, (10,), ())
            accuracy = table.filter("metric = 'ndcg'").select("value").first()
            run.unpersist()
            rows.append((label, seconds, accuracy[0] if accuracy else None))
    return query_tokens.sparkSession.createDataFrame(rows, "label string, time double, ndcg10 double")


def accuracy_frontier(bench, n_queries):
    """Pareto-optimal rows of ``label, time, ndcg10``.

    The bench is stored, so that the runs behind it are not repeated for each
    step of the frontier.
    """
    return pareto(throughput(sizing.stored(bench, "bench"), n_queries))
