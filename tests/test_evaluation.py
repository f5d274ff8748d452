import math

import pytest
from conftest import rows_of

from rankloom.operators.frontier import pareto, throughput
from rankloom.operators.metrics import query_metrics
from rankloom.plans import evaluate
from rankloom.schema import LOG_HEADER
from rankloom.sources.benchlog import log_records, read_log

RUN = "system string, config string, query_id string, doc_id string, score double"
QRELS = "query_id string, doc_id string, rel int"


def direct(run, qrels, cuts, mrr_cuts):
    out = {}
    for q in sorted({r[0] for r in run} & {r[0] for r in qrels}):
        rel = {d: g for a, d, g in qrels if a == q}
        docs = sorted(((s, d) for a, d, s in run if a == q and a != d), reverse=True)
        gains = [rel.get(d, 0) for _, d in docs]
        best = sorted(rel.values(), reverse=True)
        n = sum(g > 0 for g in best)
        row = {}
        for k in cuts:
            ideal = sum(g / math.log2(i + 2) for i, g in enumerate(best[:k]))
            got = sum(g / math.log2(i + 2) for i, g in enumerate(gains[:k]))
            row[f"ndcg_{k}"] = got / ideal if ideal else 0
            hits = [i for i, g in enumerate(gains[:k], 1) if g > 0]
            row[f"map_{k}"] = sum((j + 1) / i for j, i in enumerate(hits)) / n if n else 0
            row[f"recall_{k}"] = len(hits) / n if n else 0
            row[f"precision_{k}"] = len(hits) / k
        first = next((i for i, g in enumerate(gains, 1) if g > 0), None)
        for k in mrr_cuts:
            row[f"mrr_{k}"] = 1 / first if first and first <= k else 0
        out[q] = row
    return out


def sample(rng):
    run = [(f"q{q}", f"d{d}", float(rng.integers(0, 6))) for q in range(5) for d in rng.permutation(30)[:15]]
    qrels = [(f"q{q}", f"d{d}", int(rng.integers(0, 4))) for q in range(1, 6) for d in rng.permutation(30)[:8]]
    qrels += [("q4", "unseen", 3), ("none", "d1", 0), ("none", "d2", 0)]
    run += [("none", "d1", 1.0), ("q1", "q1", 9.0)]
    return run, qrels


def test_metrics_equal_direct(spark, rng):
    run, qrels = sample(rng)
    cuts, mrr_cuts = (1, 3, 10), (1, 10)
    frame = spark.createDataFrame([("s", "c", *r) for r in run], RUN)
    judged = spark.createDataFrame(qrels, QRELS)
    want = direct(run, qrels, cuts, mrr_cuts)
    got = {r.query_id: r for r in query_metrics(frame, judged, cuts, mrr_cuts).collect()}
    assert got.keys() == want.keys()
    for q, row in want.items():
        for name, value in row.items():
            assert got[q][name] == pytest.approx(value, abs=1e-9), (q, name)
    table = {(r.metric, r.k): r.value for r in evaluate.evaluate(frame, judged, cuts, mrr_cuts).collect()}
    assert table["ndcg", 10] == pytest.approx(sum(r["ndcg_10"] for r in want.values()) / len(want), abs=1e-6)
    n_judged = len({r[0] for r in qrels})
    assert table["mrr", 10] == pytest.approx(sum(r["mrr_10"] for r in want.values()) / n_judged, abs=1e-6)
    assert len(table) == 4 * 3 + 2


def test_empty_run(spark, rng):
    _, qrels = sample(rng)
    assert evaluate.evaluate(spark.createDataFrame([], RUN), spark.createDataFrame(qrels, QRELS)).count() == 0


def test_side_by_side_and_overlap(spark):
    schema = "system string, config string, query_id string, doc_id string, score double, rank int"
    a = spark.createDataFrame([("a", "", "q", "x", 2.0, 1), ("a", "", "q", "y", 1.0, 2)], schema)
    b = spark.createDataFrame([("b", "", "q", "y", 5.0, 1), ("b", "", "p", "z", 5.0, 1)], schema)
    assert sorted(map(str, evaluate.side_by_side(a, b).collect())) == sorted(
        map(
            str,
            spark.createDataFrame(
                [("q", 1, "x", 2.0, "y", 5.0), ("q", 2, "y", 1.0, None, None), ("p", 1, None, None, "z", 5.0)],
                "query_id string, rank int, left_doc string, left_score double, right_doc string, right_score double",
            ).collect(),
        )
    )
    assert rows_of(evaluate.overlap(a, b)) == [("p", 0), ("q", 1)]
    assert evaluate.stack_runs(a, b).count() == 4


def dominated(p, points):
    return any(
        t is not None
        and a is not None
        and p[1] is not None
        and p[2] is not None
        and t >= p[1]
        and a >= p[2]
        and (t > p[1] or a > p[2])
        for _, t, a in points
    )


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_pareto_equals_direct(spark, rng, buckets):
    points = [(f"p{i}", float(rng.integers(1, 40)), float(rng.integers(1, 40))) for i in range(150)]
    points += [("same", points[0][1], points[0][2]), ("slow", None, 3.0), ("blind", 100.0, None)]
    points += [("line%d" % i, 60.0 - i, 40.0 + i) for i in range(10)]
    points += [("hot%d" % i, 61.0, 39.0) for i in range(80)]
    frame = spark.createDataFrame(points, "label string, throughput double, accuracy double")
    want = sorted(p[0] for p in points if not dominated(p, points))
    assert sorted(r.label for r in pareto(frame, buckets).collect()) == want


def test_throughput_of_zero_time(spark):
    bench = spark.createDataFrame(
        [("a", 0.0, 0.1), ("b", 2.0, 0.5), ("c", None, 0.5), ("d", 4.0, 0.4)], "label string, time double, ndcg10 double"
    )
    rates = {r.label: r.throughput for r in throughput(bench, 100).collect()}
    assert rates == {"a": float("inf"), "b": 50.0, "c": None, "d": 25.0}
    assert sorted(r.label for r in evaluate.accuracy_frontier(bench, 100).collect()) == ["a", "b", "c"]


def test_log_records(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "noise\n  Time: 9.5 seconds\n"
        f"{LOG_HEADER} 20, 40\n  Time: 1.25 seconds\n  NDCG@1: 0.1\n  NDCG@10: 0.62000\n"
        f"{LOG_HEADER} 20, 80\n  NDCG@10: 0.5\n  NDCG@10: 0.7\nother: 3\n"
        f"{LOG_HEADER} empty\n"
    )
    (tmp_path / "b.log").write_text("nothing to see\n")
    got = log_records(read_log(spark, str(tmp_path))).orderBy("path", "record")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # the same over many blocks
    try:
        split = read_log(spark, str(tmp_path))
        assert split.select("line_no.start").distinct().count() > 3
        cut = log_records(split).orderBy("path", "record").drop("path").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert cut == got.drop("path").collect()
    assert [(r.label, r.time, r.ndcg10) for r in got.collect()] == [
        (None, 9.5, None),
        ("20, 40", 1.25, 0.62),
        ("20, 80", None, 0.7),
        ("empty", None, None),
    ]
