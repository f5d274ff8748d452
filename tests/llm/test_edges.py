"""Every operator on null, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import decontaminate, langid, lm, minhash, mixing, passages, pii, quality, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["h", "n", "k", "key", "fp", "size", "score", "value", "row_key", "node", "count", "kind", "taken", "b", "a", "words", "place", "slot", "bin", "host", "path", "_mix", "_leak_key", "_rejected", "_out"]
LONG = " ".join("q".join(chr(97 + int(c)) for c in f"{i % 977}{i % 31}") for i in range(30_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, " \n\t ", "en", "s1", 4),
    (4, LONG, "en", "s1", len(LONG)),
    (5, "one two three four five six", "en", "s2", 27),
    (5, "one two three four five six", "en", "s2", 27),
    (6, "one two three four five six", "de", "s3", 27),
    (None, "eins zwei drei vier", "de", "s3", 19),
    (8, "eins", None, None, 4),
    (9, "7 8 9 @ +1 . 1.2", "de", "s3", 16),
]
LABELS = [(4, 1, 0), (5, 1, 0), (6, 0, 1), (9, 0, None), (99, 1, 1), (None, 1, 1)]
BENCHMARK = [(1, None), (2, ""), (3, "three four five"), (4, " ".join(LONG.split()[100:130])), (None, "x")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(name))
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), spark.createDataFrame(BENCHMARK, "item_id long, text string")


def operators(labels, benchmark):
    return {
        "pii": pii.personal_data,
        "passages": passages.repeated,
        "lm": lambda d: lm.score(d),
        "minhash": minhash.compare_edited,
        "near_duplicates": minhash.near_duplicates,
        "fingerprinted": minhash.fingerprinted,
        "decontaminate": lambda d: decontaminate.contaminated(d, benchmark),
        "sharding": lambda d: sharding.place(d, "doc_id"),
        "mixing": mixing.mix,
        "langid": langid.identify,
        "quality": lambda d: quality.classify(d, labels),
        "simhash": simhash.groups,
        "mixed": mixing.mixed,
        "kept": lambda d: quality.kept(d, labels),
        "one_of_each": simhash.one_of_each,
        "clean": lambda d: decontaminate.clean(d, benchmark),
    }


ROW_FOR_ROW = ["pii", "lm", "minhash", "near_duplicates", "fingerprinted", "sharding", "mixing", "langid", "quality", "simhash"]


@pytest.mark.parametrize("name", operators(None, None))
def test_edges(tables, name):
    docs, labels, benchmark = tables
    run = operators(labels, benchmark)[name]
    got = run(docs).toPandas()
    if name in ROW_FOR_ROW:
        assert len(got) == len(ROWS)
        assert sorted(got["doc_id"].dropna().astype(int)) == sorted(r[0] for r in ROWS if r[0] is not None)
    assert len(run(docs.where("doc_id = -1")).toPandas()) == 0


def test_defined_results(tables):
    docs, labels, benchmark = tables
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}[1] == "und"
    groups = {(r.doc_id, r.component_id) for r in simhash.groups(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} <= groups
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(5, 3), (6, 3), (4, 4)}
    left = simhash.one_of_each(docs).groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in left} == {(1, 1), (4, 1), (5, 1), (None, 1), (8, 1), (9, 1)}
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()}[4] == 30_000
    near = {r.doc_id: (r.class_id, r.links) for r in minhash.near_duplicates(docs).collect()}
    assert near[6] == (5, 0) and near[2] == near[1] == near[3]
    sames = [r for r in minhash.compare_edited(docs).collect() if r.doc_id in (1, 2, 3)]
    assert len({r.fingerprint for r in sames}) == 1
    tokens = {r.doc_id: r.n_tokens for r in lm.score(docs).collect()}
    assert tokens[1] == tokens[2] == tokens[3] == 1 and tokens[4] == 30_001


def test_no_training_data(tables):
    docs, labels, benchmark = tables
    none = labels.where("doc_id = -1")
    assert quality.classify(docs, none).count() == len(ROWS)
    assert decontaminate.contaminated(docs, benchmark.where("item_id = -1")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    held = docs.where("doc_id IN (3, 5)").withColumn("doc_id", F.lit(3))  # crc32("3") % 5 is 1
    got = lm.score(held).collect()
    assert {(r.held_out, r.train_tokens, r.n_known) for r in got} == {(True, 0, 0)}


def test_pipeline_on_edges(spark, tables, tmp_path):
    docs, labels, benchmark = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "slot", "shard"]
    out.collect()
    empty = f"{tmp_path}/empty"
    docs.where("doc_id = -1").write.parquet(f"{empty}/documents.parquet")
    labels.write.parquet(f"{empty}/labels.parquet")
    benchmark.write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
