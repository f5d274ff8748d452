"""Ranking quality: NDCG, MAP, recall, precision and MRR at cut-offs.

A run has ``system, config, query_id, doc_id, score``; judgments have
``query_id, doc_id, rel``.  A document without a judgment is not relevant.
Order inside a query: score descending, then document id descending as text.
"""

from pyspark.sql import functions as F

from rankloom.functions.vectors import settle
from rankloom.operators.ranking import top_k
from rankloom.schema import EVAL_CUTS, MRR_CUTS

RUN_KEYS = ["system", "config"]
FAMILIES = ("ndcg", "map", "recall", "precision", "mrr")


def rank_run(run, depth, ignore_identical_ids=True):
    """The first rows of each ranking.  A document that is the query itself is
    left out before ranking, as the usual evaluator does; switch off to keep."""
    if ignore_identical_ids:
        run = run.filter(F.col("query_id").cast("string") != F.col("doc_id").cast("string"))
    order = [F.desc("score"), F.desc(F.col("doc_id").cast("string"))]
    return top_k(run, [*RUN_KEYS, "query_id"], order, depth)


def ideal(qrels, cuts):
    """Per judged query: number of relevant documents and the ideal gain at each cut."""
    order = [F.desc("rel"), F.asc(F.col("doc_id").cast("string"))]
    best = top_k(qrels.filter("rel > 0"), ["query_id"], order, max(cuts))
    gains = best.groupBy("query_id").agg(
        *[F.expr(f"sum(if(rank <= {k}, rel / log2(rank + 1D), 0D)) as ideal_{k}") for k in cuts]
    )
    relevant = qrels.groupBy("query_id").agg(F.expr("count_if(rel > 0) as n_rel"))
    return relevant.join(gains, "query_id", "left")


def query_metrics(run, qrels, cuts=EVAL_CUTS, mrr_cuts=MRR_CUTS, ignore_identical_ids=True):
    """One row per (system, config, query) that has both results and judgments."""
    cuts, mrr_cuts = list(cuts), list(mrr_cuts)
    ordered = rank_run(run, max(cuts + mrr_cuts), ignore_identical_ids)
    judged = ordered.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left")
    group = ", ".join([*RUN_KEYS, "query_id"])
    judged = judged.selectExpr(*RUN_KEYS, "query_id", "rank", "coalesce(rel, 0) as rel").selectExpr(
        "*",
        f"""sum(if(rel > 0, 1, 0)) over (partition by {group} order by rank
            rows between unbounded preceding and current row) as _hits""",
    )
    sums = ["min(if(rel > 0, rank, null)) as _first"]
    for k in cuts:
        within = f"rank <= {k} and rel > 0"
        sums.append(f"sum(if({within}, rel / log2(rank + 1D), 0D)) as _gain_{k}")
        sums.append(f"sum(if({within}, _hits / rank, 0D)) as _precise_{k}")
        sums.append(f"sum(if({within}, 1D, 0D)) as _found_{k}")
    per_query = judged.groupBy(*RUN_KEYS, "query_id").agg(*[F.expr(s) for s in sums])
    columns = []
    for k in cuts:
        columns.append(f"if(ideal_{k} > 0, _gain_{k} / ideal_{k}, 0D) as ndcg_{k}")
        columns.append(f"if(n_rel > 0, _precise_{k} / n_rel, 0D) as map_{k}")
        columns.append(f"if(n_rel > 0, _found_{k} / n_rel, 0D) as recall_{k}")
        columns.append(f"_found_{k} / {k} as precision_{k}")
    columns += [f"if(_first <= {k}, 1D / _first, 0D) as mrr_{k}" for k in mrr_cuts]
    return per_query.join(ideal(qrels, cuts), "query_id").selectExpr(*RUN_KEYS, "query_id", *columns)


def metric_table(per_query, qrels, cuts=EVAL_CUTS, mrr_cuts=MRR_CUTS, digits=6):
    """Long form ``system, config, metric, k, value``: means over queries.

    MRR is divided by the number of judged queries, the others by the number
    of queries that have both results and judgments.
    """
    n_judged = qrels.select(F.count_distinct("query_id")).scalar().cast("double")
    names = [(metric, k) for metric in FAMILIES[:-1] for k in cuts] + [("mrr", k) for k in mrr_cuts]
    means = [F.expr(f"{'sum' if m == 'mrr' else 'avg'}({m}_{k}) as {m}_{k}") for m, k in names]
    rows = ", ".join(f"'{metric}', {k}, {metric}_{k}" for metric, k in names)
    long = (
        per_query.groupBy(*RUN_KEYS)
        .agg(*means)
        .selectExpr(*RUN_KEYS, f"stack({len(names)}, {rows}) as (metric, k, _mean)")
    )
    value = F.when(F.col("metric") == "mrr", F.col("_mean") / n_judged).otherwise(F.col("_mean"))
    return long.select(*RUN_KEYS, "metric", "k", settle(value, digits).alias("value"))
