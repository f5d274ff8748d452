import gzip
import json
import os
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rankloom import session
from rankloom.catalog import queries
from rankloom.operators import upsert
from rankloom.operators.encode import HashEncoder, encode_dense, encode_tokens
from rankloom.plans import dense, ingest
from rankloom.schema import PART_TOKENS
from rankloom.sources import collection, documents, sides, tables, views
from rankloom.streaming import ingest as streaming


class ShortEncoder(HashEncoder):
    """Reports one token too many."""

    def encode_passages(self, texts):
        flat, counts = super().encode_passages(texts)
        return flat, [counts[0] + 1, *counts[1:]]


def part(text, vector=(0.5, 0.25)):
    return {"content": text, "embedding": list(vector)}


GOOD = {"title": "t", "0": part("a b"), "1": part("c"), "3": part("hidden"), "01": part("no"), "other": 5}
MANY = {"title": "many", "10": part("k"), **{str(i): part(f"w{i}") for i in (3, 1, 2, 0, 9, 8, 7, 6, 5, 4)}}


def write_files(folder):
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps(GOOD))
    (folder / "many.json").write_text(json.dumps(MANY, indent=1))
    (folder / "bad.json").write_text('{"title": "x", "0"')
    (folder / "list.json").write_text("[1]")
    (folder / "untitled.json").write_text(json.dumps({"0": part("a")}))
    (folder / "bare.json").write_text(json.dumps({"title": "b", "0": {"embedding": [1]}}))
    (folder / "none.json").write_text(json.dumps({"title": "none"}))
    (folder / "twice.json").write_text('{"title": "twice", "0": {"content": "old"}, "0": {"content": "new"}}')
    with gzip.open(folder / "zipped.json.gz", "wt", encoding="utf-8") as out:
        json.dump({"title": "zé", "0": part("e\nf")}, out)


def test_parts_and_rejects(spark, tmp_path):
    write_files(tmp_path / "in")
    read = documents.read_documents(spark, str(tmp_path / "in"))
    parts = documents.document_parts(documents.good_documents(read))
    got = rows_of(parts.select("title", "part", "content"))
    want = [("t", 0, "a b"), ("t", 1, "c"), ("twice", 0, "new"), ("zé", 0, "e\nf")]
    want += [("many", i, "k" if i == 10 else f"w{i}") for i in range(11)]
    assert got == sorted(want)
    assert parts.filter("title = 't' and part = 0").first().embedding == [0.5, 0.25]
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in documents.rejects(read).collect()}
    assert bad == {
        "bad.json": "not a JSON object",
        "list.json": "not a JSON object",
        "untitled.json": "no title",
        "bare.json": "a part has no content",
    }


def test_written_documents_keep_everything(spark, tmp_path):
    write_files(tmp_path / "in")
    good = documents.good_documents(documents.read_documents(spark, str(tmp_path / "in")))
    out = str(tmp_path / "out")
    documents.write_encoded(good, out, HashEncoder)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    doc = next(d for d in lines if d["title"] == "t")
    assert doc["other"] == 5 and doc["3"] == part("hidden") and doc["01"] == part("no")
    assert np.shape(doc["0"][PART_TOKENS]) == (2, HashEncoder.width)
    again = documents.good_documents(documents.read_documents(spark, out, "lines"))
    summary = {r.title: (r.n_parts, r.n_embeddings) for r in documents.ingest_summary(documents.document_parts(again)).collect()}
    assert summary == {"t": (2, 3), "many": (11, 11), "twice": (1, 1), "zé": (1, 2)}
    chunks, tokens, bad = ingest.ingest_documents(documents.read_documents(spark, out, "lines"))
    assert (chunks.count(), tokens.count(), bad.count()) == (15, 17, 0)
    encoded = ingest.ingest_documents(documents.read_documents(spark, str(tmp_path / "in")), HashEncoder)[1]
    assert rows_of(encoded.select("chunk_id", "embedding_id")) == rows_of(tokens.select("chunk_id", "embedding_id"))


def test_written_vectors_are_read_back_as_they_were(spark, tmp_path):
    write_files(tmp_path / "in")
    good = documents.good_documents(documents.read_documents(spark, str(tmp_path / "in")))
    out = str(tmp_path / "out")
    documents.write_encoded(good, out, HashEncoder)
    (line,) = [r.value for r in spark.read.text(out).collect() if '"many"' in r.value]
    vectors = {k: v[PART_TOKENS] for k, v in json.loads(line).items() if k != "title"}
    want = {k: HashEncoder().encode_passages([v["content"]])[0] for k, v in MANY.items() if k != "title"}
    assert {k: np.float32(v).tolist() for k, v in vectors.items()} == {k: v.tolist() for k, v in want.items()}
    assert max(map(len, line.split(","))) < 60  # no digits beyond float32
    parts = documents.document_parts(documents.good_documents(documents.read_documents(spark, out, "lines")))
    read = {r.part: r.token_embeddings for r in parts.filter("title = 'many'").collect()}
    assert read == {int(k): v.tolist() for k, v in want.items()}
    odd = np.float32([[np.nan, 1], [1e-30, -0.0]])
    assert np.float32(json.loads(documents._json_rows(odd[1:]))).tolist() == odd[1:].tolist() and "NaN" in documents._json_rows(odd)
    assert json.loads(documents._json_rows(odd[:0])) == []


def test_bad_parts_are_looked_for_once(spark, tmp_path):
    write_files(tmp_path / "in")
    good = documents.good_documents(documents.read_documents(spark, str(tmp_path / "in")))
    plan = documents.document_parts(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") <= 4  # two for each kind of vector


def test_vectors_are_parsed_in_batches(spark):
    """Matrices are read as arrays and never as Spark variants; what a strict reader does not take is left to Spark's, with the same result."""
    name, quoted = f'"{PART_TOKENS}"', json.dumps(f'say "{PART_TOKENS}": [[1,2]]')

    def doc(part, more=""):
        return '{"title": "t", "0": {"content": "a"}, "1": {"content": "b", ' + part + "}" + more + "}"

    strict = [
        (doc(f"{name}: [[1e-10,-20e-1],[0.5,3]]"), None, [[1e-10, -2.0], [0.5, 3.0]]),
        (doc(f"{name}:[[1.5, 2], [0.5, 3]]"), None, [[1.5, 2.0], [0.5, 3.0]]),
        (doc(f'"note": {quoted}, {name}: [[1]]'), None, [[1.0]]),
        (doc(f"{name}: []"), None, []),
        (doc(f"{name}: null"), None, None),
        (doc(f"{name}: [[1],[2,3]]"), f"part 1 has a ragged {PART_TOKENS}", None),
        (doc(f"{name}: [1]"), f"part 1 has a malformed {PART_TOKENS}", None),
        (doc(f'{name}: [[7]]', f', "3": {{{name}: [[5]]}}'), None, [[7.0]]),
    ]
    left = [
        (doc(f"{name}: [[01]]"), "not a JSON object", None),
        (doc(f"{name}: [[1,null]]"), f"part 1 has a malformed {PART_TOKENS}", None),
        (doc(f'{name}: [["1"]]'), f"part 1 has a malformed {PART_TOKENS}", None),
        (doc(f"{name}: [[2]]").replace('"title"', "'title'"), None, [[2.0]]),
        (doc(f"{name}: [[2]]", ', "1": {"content": "last"}'), None, None),
        ("[1]", "not a JSON object", None),
        (None, "not a JSON object", None),
    ]
    rows = [(str(i), value) for i, (value, *_) in enumerate(strict + left)]
    lines = spark.createDataFrame(rows, "path string, value string").coalesce(1)
    read = {r.path: r for r in documents.parse_documents(lines).collect()}
    for i, (value, reason, tokens) in enumerate(strict + left):
        got = read[str(i)]
        assert got.reason == reason, value
        assert reason or got.parts[1].token_embeddings == (None if tokens is None else np.float32(tokens).tolist()), value
    batch = pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "value": pa.array([r[1] for r in rows], pa.string())})
    (out,) = documents._parsed((), [batch])
    assert [v.is_valid for v in out.column(2)] == [True] * len(strict) + [False] * len(left)
    kept = json.loads(out.column(2)[7].as_py())
    assert kept["3"][PART_TOKENS] == [[5]] and type(kept["1"][PART_TOKENS]) is str


def test_numbers_are_written_short_and_exactly():
    rng = np.random.default_rng(6)
    unit = (rng.integers(0, 256, (500, 16)) - 127.5).astype(np.float64)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    text = documents._json_rows(unit)
    assert np.float32(json.loads(text)).tobytes() == unit.tobytes() and "." not in text
    for odd in (unit * 1e-12, unit * 1e8, np.float32([[-0.0, 1]])):
        assert np.float32(json.loads(documents._json_rows(odd))).tobytes() == odd.astype(np.float32).tobytes()


def test_a_large_source_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 512).alias("text")
    )
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50KB")
    try:
        path = queries._written_by_source(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert documents.list_files(spark, path).count() > 2 and spark.read.text(path).count() == 4000


def test_files_are_loaded_once(spark, tmp_path):
    folder = tmp_path / "gz"
    folder.mkdir()
    for i in range(5):
        with gzip.open(folder / f"{i}.json.gz", "wt") as out:
            json.dump({"title": f"d{i}", "0": {**part("x"), PART_TOKENS: [[1.0, 0.0]]}}, out)
    (folder / "skip.json").write_text("{}")
    with gzip.open(folder / "broken.json.gz", "wt") as out:
        out.write("{")
    args = (spark, str(folder), str(tmp_path / "c"), str(tmp_path / "t"), str(tmp_path / "m"))
    assert ingest.load_new_files(*args, cap=4) == 4
    assert ingest.load_new_files(*args, cap=4) == 2
    assert ingest.load_new_files(*args, cap=4) == 0
    assert ingest.load_new_files(*args, cap=4, retry=True) == 1  # the broken file is tried again
    chunks = tables.latest(spark.read.parquet(str(tmp_path / "c")), ["id"])
    assert rows_of(chunks.select("id")) == [(f"d{i}#0",) for i in range(5)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_side_vectors_move_no_body(spark):
    chunks = [(str(i), f"t{i}", f"body {i}", [float(i)]) for i in range(30)]
    df = spark.createDataFrame(chunks, "id string, title string, body string, dense_embedding array<float>")
    stored = sides.write_bucketed(df, sides.table_name("chunks"), buckets=4)
    corpus = spark.createDataFrame([(str(i), f"word {i}") for i in range(20, 40)], "doc_id string, text string")
    for missing, n in ((True, 40), (False, 30)):
        got = dense.add_side_vectors(stored, corpus, insert_missing=missing, buckets=4)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        direct = dense.add_dense_vectors(df, corpus, insert_missing=missing)
        assert got.count() == n
        assert got.exceptAll(direct).count() == direct.exceptAll(got).count() == 0


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")

    def rows(*items):
        return spark.createDataFrame(items, "id string, body string")

    def seen():
        return dict(rows_of(views.current(spark, root, "t", "id string, body string")))

    def publish(version, *items):
        views.publish(spark, root, version, {"t": (rows(*items), ["id"])}, buckets=4)

    assert seen() == {}
    publish(0, *[(f"k{i}", "old") for i in range(40)])
    publish(1, ("k1", "new"), ("k99", "new"))
    want = {f"k{i}": "old" for i in range(40)} | {"k1": "new", "k99": "new"}
    assert seen() == want
    assert len(os.listdir(f"{root}/t/version=1")) < 4 + 2  # touched buckets only, and the marks of the writer

    def dies(*args, **kwargs):
        raise OSError("lost")

    late = rows(("k2", "again"))
    with monkeypatch.context() as patch:  # the data are written, the manifest row is not
        patch.setattr(type(spark), "createDataFrame", dies)
        with pytest.raises(OSError):
            views.publish(spark, root, 2, {"t": (late, ["id"])}, buckets=4)
    assert seen() == want
    publish(2, ("k2", "again"))
    assert seen() == want | {"k2": "again"}
    publish(2, ("k2", "again"))  # a version run once more after its manifest row
    assert seen() == want | {"k2": "again"}
    publish(3)
    assert seen() == want | {"k2": "again"}
    plan = views.current(spark, root, "t", "id string")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_scratch_folder_without_the_setting(spark, monkeypatch):
    """A local session without the setting keeps one temporary folder; nothing tries to change the setting."""
    monkeypatch.setattr(session, "_local_roots", {})
    read = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, name, *d: None if name == "spark.checkpoint.dir" else read(name, *d))
    first, second = session.scratch_dir(spark, "a"), session.scratch_dir(spark, "b")
    assert os.path.dirname(first) == os.path.dirname(second) and first != second


def test_publish_makes_costly_rows_once(spark, tmp_path):
    """Rows of a Python stage are not made again to find their buckets or the stored rows that they replace."""
    made = tmp_path / "made"
    made.mkdir()

    def rows(first, last, body):
        def run(parts):
            (made / uuid.uuid4().hex).touch()
            yield from parts

        base = spark.range(first, last, 1, 1).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(body).alias("body"))
        return base.mapInArrow(run, "id string, body string"), ["id"], base.select("id")

    root = str(tmp_path / "tables")
    views.publish(spark, root, 0, {"t": rows(0, 40, "old")}, buckets=4)
    views.publish(spark, root, 1, {"t": rows(30, 50, "new")}, buckets=4)
    assert len(list(made.iterdir())) == 2
    got = rows_of(views.current(spark, root, "t", "id string, body string"))
    assert got == sorted([(f"k{i}", "old" if i < 30 else "new") for i in range(50)])


def test_publish_keeps_little_on_disk(spark, tmp_path):
    """One exchange of rows for a table, whose files go with the step, and packed files."""
    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f and f.endswith(".data")}

    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("k"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
    before = shuffles()
    views.publish(spark, str(tmp_path), 0, {"t": (rows, ["id"])}, buckets=4)
    for _ in range(50):  # the files go in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not {f for f in shuffles() - before if os.path.getsize(f) > 50_000}
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"} and len(files) == 4
    assert views.current(spark, str(tmp_path), "t", "id string, body string").count() == 4000


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    write_files(folder)
    streaming.stream_documents(spark, str(folder), out, marks, HashEncoder).awaitTermination()
    first = rows_of(streaming.current_chunks(spark, out).select("id", "body"))
    assert len(first) == 15
    streaming.stream_documents(spark, str(folder), out, marks, HashEncoder).awaitTermination()
    assert rows_of(streaming.current_chunks(spark, out).select("id", "body")) == first
    (folder / "later.json").write_text(json.dumps({"title": "t", "0": part("changed")}))
    streaming.stream_documents(spark, str(folder), out, marks, HashEncoder).awaitTermination()
    body = {r.id: r.body for r in streaming.current_chunks(spark, out).collect()}
    assert body["t#0"] == "changed" and body["t#1"] == "c" and len(body) == 15
    assert spark.read.parquet(f"{out}/rejects").count() == 4


def test_collection_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text(
        '{"_id": "d1", "title": "T", "text": "x", "metadata": {}}\n{"_id": "d2", "text": "y"}\n'
    )
    (tmp_path / "queries.jsonl").write_text("".join(f'{{"_id": "q{i}", "text": "w{i}"}}\n' for i in range(4)))
    (tmp_path / "qrels" / "test.tsv").write_text(
        "query-id\tcorpus-id\tscore\nq2\td1\t1\nq0\td1\t2\nq2\td2\t1\nq3\td2\t0\n"
    )
    corpus, queries, qrels = collection.load_collection(spark, str(tmp_path), "test")
    assert rows_of(corpus) == [("d1", "T", "x", 0), ("d2", "", "y", 1)]
    first, judged = collection.restrict_queries(queries, qrels, 2)
    assert [r.query_id for r in first.orderBy("pos").collect()] == ["q2", "q0"]
    assert rows_of(judged) == [("q0", "d1", 2), ("q2", "d1", 1), ("q2", "d2", 1)]
    assert tuple(collection.dataset_sizes(corpus, queries, qrels).first()) == (2, 3, 3)


CHUNKS = "id string, title string, body string, dense_embedding array<float>"
TOKENS = "chunk_id string, embedding_id int, embedding array<float>"


def test_chunk_upsert(spark):
    old = spark.createDataFrame([("a", "A", "x", [1.0]), ("b", "B", "y", None)], CHUNKS)
    new = spark.createDataFrame([("a", "A2", "x2", None), ("c", "C", "z", [3.0])], CHUNKS)
    kept = upsert.upsert_chunks(old, new)
    assert sorted(map(tuple, kept.collect())) == [("a", "A2", "x2", [1.0]), ("b", "B", "y", None), ("c", "C", "z", [3.0])]
    assert {r.id: r.dense_embedding for r in upsert.upsert_chunks(old, new, False).collect()}["a"] is None
    once = sorted(map(str, kept.collect()))
    assert sorted(map(str, upsert.upsert_chunks(kept, new).collect())) == once


def test_token_upsert(spark):
    old = spark.createDataFrame([("a", i, [float(i)]) for i in range(3)] + [("b", 0, [9.0])], TOKENS)
    new = spark.createDataFrame([("a", 0, [7.0])], TOKENS)
    tail = rows_of(upsert.upsert_tokens(old, new).select("chunk_id", "embedding_id"))
    assert tail == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    whole = upsert.upsert_tokens(old, new, replace_chunk=True)
    assert rows_of(whole.select("chunk_id", "embedding_id")) == [("a", 0), ("b", 0)]
    assert whole.filter("chunk_id = 'a'").first().embedding == [7.0]


def test_dense_update(spark):
    old = spark.createDataFrame([("a", "A", "x", [1.0]), ("b", "B", "y", None)], CHUNKS)
    updates = spark.createDataFrame([("b", [2.0]), ("new", [5.0])], "id string, dense_embedding array<float>")
    got = {r.id: tuple(r)[1:] for r in upsert.update_dense(old, updates).collect()}
    assert got == {"a": ("A", "x", [1.0]), "b": ("B", "y", [2.0]), "new": (None, None, [5.0])}
    assert upsert.update_dense(old, updates, insert_missing=False).count() == 2


def test_encoders(spark):
    texts = [(i, " ".join(["w"] * (i % 5))) for i in range(100)] + [(100, None)]
    frame = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    rows = encode_tokens(frame, batch=7)
    want = sorted((i, p) for i, t in texts for p in range(len((t or "").split())))
    assert rows_of(rows.select("chunk_id", "embedding_id")) == want
    vector = rows.first().embedding
    assert np.linalg.norm(vector) == pytest.approx(1, abs=1e-6)
    vectors = {r[0]: r[1] for r in encode_dense(frame, key="chunk_id").collect()}
    assert len(vectors) == 101 and vectors[100] == [0.0] * HashEncoder.width
    assert vectors[1] == pytest.approx(vector, abs=1e-6)
    assert encode_tokens(frame.limit(0)).count() == 0


def test_dense_flow(spark):
    corpus = spark.createDataFrame([("a", "T", "red fox"), ("b", "T", "blue sky")], "doc_id string, title string, text string")
    chunks, tokens = ingest.ingest_corpus(corpus)
    assert tokens.count() == 4
    queries = spark.createDataFrame([("q", "blue sky")], "query_id string, text string")
    assert dense.dense_text_search(queries, chunks).count() == 0  # no vectors yet
    filled = dense.add_dense_vectors(chunks, corpus)
    best = dense.dense_text_search(queries, filled, 1).first()
    assert (best.id, best.similarity) == ("b", pytest.approx(1, abs=1e-6))
