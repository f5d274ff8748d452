"""One query per operator, over whole driver tables."""

from pyspark.sql import functions as F

from rankloom.catalog import fixtures as fx
from rankloom.functions.text import fixed_point, tokenize
from rankloom.functions.vectors import settle, similarity
from rankloom.operators import clusters, lexical, ragged, upsert
from rankloom.operators.encode import HashEncoder, encode_dense, encode_tokens
from rankloom.operators.frontier import throughput
from rankloom.operators.limits import effective_limits
from rankloom.operators.lookup import chunk_by_id, result_records, tokens_of_chunk
from rankloom.operators.maxsim import best_matches, maxsim_scores, stage1_scores
from rankloom.operators.metrics import query_metrics
from rankloom.operators.sizing import spread, stored
from rankloom.operators.substring import match_counts, substring_filter, substring_join, substring_matches
from rankloom.plans import dense, evaluate, ingest, late, lexical as lexical_plans
from rankloom.schema import DOC_TITLE, PART_DENSE, PART_TEXT, PART_TOKENS, SWEEP_VALUES
from rankloom.session import scratch_dir
from rankloom.sources import benchlog, collection, documents, sides, tables
from rankloom.streaming import ingest as streaming

N_ANN, N_CANDIDATES, K = 20, 40, 100
NEGATIVE_ASKED = ["most", "most few", "many most", "few en", "none", "many many fr"]


# ---- text ---------------------------------------------------------------


def chunk_scan(spark, sf):
    return fx.chunks(spark, sf).select("title", "body")


def substring_one(spark, sf):
    return substring_filter(fx.chunks(spark, sf), "tion the")


def substring_all(spark, sf):
    return substring_join(fx.queries(spark, sf), fx.chunks(spark, sf))


def substring_counts(spark, sf):
    asked = fx.queries(spark, sf)
    return match_counts(asked, substring_matches(asked, fx.chunks(spark, sf)))


def format_results(spark, sf):
    lines, _ = lexical_plans.substring_search(fx.queries(spark, sf), fx.chunks(spark, sf))
    return lines


def point_lookup(spark, sf):
    return chunk_by_id(fx.chunks(spark, sf), 7)


def tokenized(spark, sf):
    words = fx.corpus(spark, sf).select("doc_id", tokenize(F.col("text")).alias("t"))
    return words.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n_tokens"))


def postings(spark, sf):
    return lexical.postings(fx.corpus(spark, sf))


def doc_stats(spark, sf):
    corpus = fx.corpus(spark, sf)
    _, totals = lexical.vocabulary(corpus)
    return lexical.document_lengths(corpus).select(
        "doc_id",
        "length",
        totals.select("n_docs").scalar().alias("n_docs"),
        settle(totals.select("mean_length").scalar(), 6).alias("mean_length"),
    )


def idf_floor(spark, sf):
    terms, totals = lexical.vocabulary(fx.corpus(spark, sf))
    return lexical.idf(terms, totals).select("term", "df", settle(F.col("idf"), 6).alias("idf"))


def bm25_topk(spark, sf):
    return lexical_plans.bm25_search(fx.queries(spark, sf), fx.corpus(spark, sf), K, fill_zero=False)


def bm25_topk_zero_filled(spark, sf):
    return lexical_plans.bm25_search(fx.queries(spark, sf), fx.corpus(spark, sf), 1000, fill_zero=True)


def bm25_negative(spark, sf):
    """Lists far shorter than the corpus where terms of most documents have negative weight.

    The words are labels of documents; an unmatched document ranks above those that match such words only.
    """
    words = [
        F.when(F.col("doc_id") % 3 > 0, F.lit("most")),
        F.when(F.col("doc_id") % 10 > 0, F.lit("many")),
        F.when(F.col("doc_id") % 100 > 0, F.lit("nearly every one")),
        F.col("lang"),
        F.when(F.col("doc_id") % 50 == 0, F.lit("few few")),
    ]
    corpus = fx.table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", *words).alias("text"))
    asked = F.element_at(F.array(*[F.lit(t) for t in NEGATIVE_ASKED]), (F.col("item_id") % len(NEGATIVE_ASKED) + 1).cast("int"))
    queries = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("text"))
    return lexical_plans.bm25_search(queries, corpus, 37, fill_zero=True)


def bm25_file_order(spark, sf):
    """Zero-filled lists over a collection read from files, ties in the order of its lines."""
    corpus, asked, _ = _collection(spark, sf)
    return lexical_plans.bm25_search(asked.select("query_id", "text"), corpus, K)


def bm25_stored_index(spark, sf):
    path = scratch_dir(spark, "index")
    lexical.write_index(fx.corpus(spark, sf), path)
    return lexical_plans.bm25_search(fx.queries(spark, sf), None, K, fill_zero=False, index=path)


# ---- dense --------------------------------------------------------------


def dot_scores(spark, sf):
    """Each vector against the mean of its own label."""
    means = fx.query_vectors(spark, sf).select("query_id", F.col("embedding").alias("mean"))
    vectors = fx.table(spark, sf, "embeddings").withColumn("query_id", F.col("label").cast("bigint"))
    return vectors.join(means, "query_id").select(
        "vec_id",
        (settle(similarity("embedding", "mean"), 6) + 0.0).alias("similarity"),
        (settle(similarity("embedding", "mean", "dot01"), 6) + 0.0).alias("similarity01"),
    )


def dense_topk(spark, sf):
    return dense.dense_search(fx.query_vectors(spark, sf), fx.vector_chunks(spark, sf), K)


def dense_null_vectors(spark, sf):
    """Chunks of one label have no vector and so never appear."""
    vectors = fx.vector_chunks(spark, sf)
    present = F.when(F.col("title") != "label 3", F.col("dense_embedding"))
    return dense.dense_search(fx.query_vectors(spark, sf), vectors.withColumn("dense_embedding", present), K)


def dense_lookup(spark, sf):
    found = dense.dense_search(fx.query_vectors(spark, sf), fx.vector_chunks(spark, sf), 10)
    results = found.select("query_id", F.col("id").alias("chunk_id"), F.col("similarity").alias("score"), "rank")
    return result_records(results, fx.vector_chunks(spark, sf))


def ivf_topk(spark, sf):
    rows = fx.vector_chunks(spark, sf).select("id", F.col("dense_embedding").alias("embedding"))
    model = clusters.train_lists(rows, 8, iterations=3)
    path = scratch_dir(spark, "lists")
    clusters.write_lists(clusters.assign_lists(rows, model), path)
    stored = spark.read.parquet(path)
    return clusters.ivf_search(fx.query_vectors(spark, sf), stored, model, K, 8, corpus_keys=("id",))


def ivf_recall(spark, sf):
    """Two-level lists against the exact search: with as many probes as the even queries need for 0.95,
    all queries together find 0.9 of their exact rows, and not all lists are read."""
    rows = fx.vector_chunks(spark, sf).select("id", F.col("dense_embedding").alias("embedding"))
    model = clusters.train_two_level(rows, 4, 4, iterations=5)
    path = scratch_dir(spark, "lists")
    clusters.write_lists(clusters.assign_lists(rows, model), path)
    lists, asked = spark.read.parquet(path), fx.query_vectors(spark, sf)
    exact = stored(dense.dense_search(asked, fx.vector_chunks(spark, sf), 10), "exact")
    even = asked.where("query_id % 2 = 0")
    nprobe = clusters.probes_for(0.95, even, exact, lists, model, corpus_keys=("id",))
    found = clusters.ivf_search(asked, lists, model, 10, nprobe, corpus_keys=("id",))
    return clusters.recall(found, exact, corpus_keys=("id",)).agg(
        F.count("*").alias("n_queries"),
        F.sum("n").alias("n_exact"),
        (F.sum("hits") >= 0.9 * F.sum("n")).alias("recall_reached"),
        F.lit(nprobe < len(model.clusterCenters())).alias("lists_skipped"),
    )


def text_vectors(spark, sf):
    out = encode_dense(fx.corpus(spark, sf), key="doc_id", name="embedding")
    return out.select("doc_id", fx.vector_text("embedding").alias("vector"))


def dense_text_topk(spark, sf):
    chunks = dense.add_dense_vectors(fx.chunks(spark, sf), fx.corpus(spark, sf))
    return dense.dense_text_search(fx.queries(spark, sf), chunks, K)


# ---- late interaction ---------------------------------------------------


def token_hits(spark, sf):
    return late.token_hits(fx.query_tokens(spark, sf), fx.tokens(spark, sf), N_ANN)


def adaptive_limit(spark, sf):
    """Limits of the whole grid on chunks so long that narrow fetches fail."""
    hits = late.token_hits(fx.query_tokens(spark, sf), fx.class_tokens(spark, sf), 1000)
    limits = effective_limits(hits, [4, *SWEEP_VALUES])
    return limits.select("query_id", "q_pos", F.inline("limits")).distinct()


def best_per_token(spark, sf):
    hits = late.token_hits(fx.query_tokens(spark, sf), fx.tokens(spark, sf), N_ANN)
    return best_matches(hits)


def stage1(spark, sf):
    hits = late.token_hits(fx.query_tokens(spark, sf), fx.tokens(spark, sf), N_ANN)
    return stage1_scores(best_matches(hits))


def candidates(spark, sf):
    picked = late.grid_candidates(fx.query_tokens(spark, sf), fx.tokens(spark, sf), [N_ANN], 10)
    return picked.drop("n_ann")


def maxsim_all(spark, sf):
    """Exact scores of every chunk that any query token hits."""
    asked, tokens = fx.query_tokens(spark, sf), fx.tokens(spark, sf)
    wanted = late.token_hits(asked, tokens, N_ANN).select("query_id", "chunk_id").distinct()
    return maxsim_scores(wanted, asked, tokens)


def late_search(spark, sf):
    return late.late_interaction_search(fx.query_tokens(spark, sf), fx.tokens(spark, sf), N_ANN, N_CANDIDATES)


def late_search_wide(spark, sf):
    """The same where the fetch limit has to grow."""
    return late.late_interaction_search(fx.query_tokens(spark, sf), fx.class_tokens(spark, sf), N_ANN, N_CANDIDATES)


def late_retrieve(spark, sf):
    return late.retrieve(
        fx.query_tokens(spark, sf),
        fx.tokens(spark, sf),
        fx.token_chunks(spark, sf),
        n_docs=5,
        n_ann=N_ANN,
        n_candidates=N_CANDIDATES,
    )


def partition_lookup(spark, sf):
    path = scratch_dir(spark, "tokens")
    tables.write_tokens(fx.tokens(spark, sf), path, buckets=8)
    found = tokens_of_chunk(spark.read.parquet(path), 5, buckets=8)
    return found.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), fx.vector_text("embedding").alias("vector"))


def pack_vectors(spark, sf):
    packed = ragged.pack(fx.tokens(spark, sf))
    flat = F.flatten("embeddings")
    return packed.select("chunk_id", "segment", "length", fx.vector_text(flat).alias("vectors"))


def unpack_offsets(spark, sf):
    """Documents of 64 vectors with one part per label: a flat list each, cut back by offset and count."""
    rows = fx.table(spark, sf, "embeddings")
    doc = F.floor(F.col("vec_id") / 64).alias("doc_id")
    parts = rows.groupBy(doc, F.col("label").alias("part")).agg(
        F.count(F.lit(1)).cast("int").alias("length"),
        F.array_sort(F.collect_list("vec_id")).alias("ids"),
    )
    placed = ragged.offsets(parts)
    flat = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("_parts"))
    flat = flat.select("doc_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("flat"))
    cut = placed.join(flat, "doc_id")
    part = ragged.slice_flat(F.col("flat"), F.col("offset").cast("int"), F.col("length"))
    return cut.select("doc_id", "part", "offset", "length", F.array_join(part, ",").alias("ids"))


# ---- evaluation ---------------------------------------------------------


def contains_qrels(spark, sf):
    found = substring_matches(fx.queries(spark, sf), fx.chunks(spark, sf))
    judged = found.select("query_id", F.col("id").alias("doc_id"), F.lit(1).alias("rel"))
    return stored(judged, "qrels")  # judgments are a table to all that read them


def bm25_results(spark, sf):
    return lexical_plans.bm25_run(bm25_topk(spark, sf))


def late_results(spark, sf):
    return late.late_run(late_search(spark, sf))


def _per_query(spark, sf, metric, cuts):
    table = query_metrics(bm25_results(spark, sf), contains_qrels(spark, sf))
    return table.select("query_id", *[settle(F.col(f"{metric}_{k}"), 6).alias(f"{metric}_{k}") for k in cuts])


def ndcg(spark, sf):
    return _per_query(spark, sf, "ndcg", (1, 3, 5, 10, 100))


def mean_average_precision(spark, sf):
    return _per_query(spark, sf, "map", (1, 3, 5, 10, 100))


def recall(spark, sf):
    return _per_query(spark, sf, "recall", (1, 3, 5, 10, 100))


def precision(spark, sf):
    return _per_query(spark, sf, "precision", (1, 3, 5, 10, 100))


def mrr(spark, sf):
    return _per_query(spark, sf, "mrr", (1, 10, 100))


def metric_table(spark, sf):
    return evaluate.evaluate(bm25_results(spark, sf), contains_qrels(spark, sf))


def metric_table_filled(spark, sf):
    """The same over lists that documents without a match complete."""
    run = lexical_plans.bm25_run(lexical_plans.bm25_search(fx.queries(spark, sf), fx.corpus(spark, sf), K))
    return evaluate.evaluate(run, contains_qrels(spark, sf))


def metric_lines(spark, sf):
    """The table as printed lines with five decimals."""
    rows = evaluate.evaluate(bm25_results(spark, sf), contains_qrels(spark, sf), digits=None)
    name = F.concat(F.upper("metric"), F.lit("@"), F.col("k").cast("string"))
    return rows.select(F.concat(name, F.lit(": "), fixed_point(F.round("value", 5), 5)).alias("line"))


def graded_metrics(spark, sf):
    return evaluate.evaluate(late_results(spark, sf), fx.graded_qrels(spark, sf), (1, 5, 10, 100), (1, 10, 100), False)


def sweep_grid(spark, sf):
    run = evaluate.sweep_run(fx.query_tokens(spark, sf), fx.tokens(spark, sf))
    return run.select("config", "n_ann", "n_candidates", "query_id", "doc_id", "score")


def sweep_metrics(spark, sf):
    return evaluate.sweep(
        fx.query_tokens(spark, sf), fx.tokens(spark, sf), fx.graded_qrels(spark, sf), ignore_identical_ids=False
    )


def _text_runs(spark, sf):
    return bm25_results(spark, sf), dense.dense_run(dense_text_topk(spark, sf))


def system_union(spark, sf):
    return evaluate.stack_runs(*_text_runs(spark, sf))


def side_by_side(spark, sf):
    return evaluate.side_by_side(*_text_runs(spark, sf))


def overlap_at_k(spark, sf):
    return evaluate.overlap(*_text_runs(spark, sf), k=10)


def compare_systems(spark, sf):
    return evaluate.compare_systems(_text_runs(spark, sf), contains_qrels(spark, sf))


def run_roundtrip(spark, sf):
    path = scratch_dir(spark, "run")
    tables.write_run(dense.dense_run(dense_topk(spark, sf)), path)
    return tables.read_run(spark, path).select("system", "config", "query_id", "doc_id", "score", "rank")


# ---- frontier -----------------------------------------------------------


def _line_bench(spark, sf):
    rows = fx.table(spark, sf, "lineitem")
    label = F.format_string("%d, %d", "l_orderkey", "l_linenumber")
    value = F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 4)
    return rows.select(label.alias("label"), F.col("l_extendedprice").alias("time"), value.alias("ndcg10"))


def throughput_rows(spark, sf):
    rates = throughput(_line_bench(spark, sf), 100)
    return rates.select("label", settle(F.col("throughput"), 9).alias("throughput"), "accuracy")


def pareto_lines(spark, sf):
    best = evaluate.accuracy_frontier(_line_bench(spark, sf), 100)
    return best.select("label", "time", "accuracy")


def pareto_sweep(spark, sf):
    """The sweep's accuracy against a stand-in time that grows with the work of a cell."""
    cells = sweep_metrics(spark, sf).filter("metric = 'ndcg' and k = 10")
    sizes = F.split("config", ", ")
    work = (sizes[0].cast("double") + sizes[1].cast("double")) / 100
    bench = cells.select(F.col("config").alias("label"), work.alias("time"), F.col("value").alias("ndcg10"))
    return evaluate.accuracy_frontier(bench, 100).select("label", "time", "accuracy")


def log_records(spark, sf):
    """A log rendered from a table, read back."""
    parts = fx.table(spark, sf, "part")
    bench = parts.select(
        F.col("p_partkey").alias("config_no"),
        F.col("p_size").alias("n_ann"),
        F.col("p_partkey").alias("n_candidates"),
        F.col("p_retailprice").alias("time"),
        (F.col("p_size") / 50).alias("ndcg10"),
    )
    path = scratch_dir(spark, "log")
    lines = benchlog.log_lines(bench)
    lines.select("value").write.text(path)
    records = benchlog.log_records(benchlog.read_log(spark, path))
    return records.select("label", "time", "ndcg10")


# ---- collections and ingest ---------------------------------------------


def _collection(spark, sf):
    """The corpus, queries and judgments written in their usual files, read back."""
    path = scratch_dir(spark, "collection")
    text = fx.corpus(spark, sf).orderBy(F.desc("doc_id"))  # so that file order is not id order
    text = text.select(F.col("doc_id").cast("string").alias("_id"), "title", "text")
    text.write.json(f"{path}/corpus.jsonl")
    asked = fx.queries(spark, sf).select(F.col("query_id").cast("string").alias("_id"), "text")
    asked.write.json(f"{path}/queries.jsonl")
    judged = contains_qrels(spark, sf).select(
        F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score")
    )
    judged.write.csv(f"{path}/qrels/test.tsv", sep="\t", header=True)
    return collection.load_collection(spark, path, "test")


def load_collection(spark, sf):
    corpus, _, _ = _collection(spark, sf)
    return corpus


def load_qrels(spark, sf):
    _, asked, judged = _collection(spark, sf)
    return judged.join(asked.select("query_id", "text"), "query_id").select("query_id", "doc_id", "rel", "text")


def query_restriction(spark, sf):
    """The judgments of the first 25 queries by position."""
    asked = fx.queries(spark, sf).withColumn("pos", F.col("query_id"))
    _, judged = collection.restrict_queries(asked, contains_qrels(spark, sf), 25)
    return judged


def dataset_sizes(spark, sf):
    return collection.dataset_sizes(fx.corpus(spark, sf), fx.queries(spark, sf), contains_qrels(spark, sf))


def chunk_upsert(spark, sf):
    """Documents with vectors, of which the labelled ones are written again, and pages added."""
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("_v"))
    stored = fx.chunks(spark, sf).join(vectors, "id", "left").withColumn("dense_embedding", F.col("_v")).drop("_v")
    none = F.lit(None).cast("array<float>").alias("dense_embedding")
    labelled = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        F.format_string("quality %d", "quality").alias("title"),
        F.format_string("toxic %d", "toxic").alias("body"),
        none,
    )
    pages = fx.table(spark, sf, "pages").select(
        (F.col("page_id") + 1_000_000_000).alias("id"), F.col("url").alias("title"), F.col("html").alias("body"), none
    )
    merged = upsert.upsert_chunks(stored, labelled.unionByName(pages))
    return merged.select("id", "title", "body", fx.vector_text("dense_embedding").alias("vector"))


def latest_rows(spark, sf):
    """The newest event per user, by time and event id."""
    events = fx.table(spark, sf, "events").withColumn("seq", F.struct("ts", "event_id"))
    return tables.latest(events, ["user_id"]).select("user_id", "event_id", "event_type")


def _new_tokens(spark, sf):
    means = fx.query_tokens(spark, sf)
    return means.select(F.col("query_id").alias("chunk_id"), F.col("q_pos").alias("embedding_id"), "embedding")


def _token_text(rows):
    return rows.select("chunk_id", "embedding_id", fx.vector_text("embedding").alias("vector"))


def token_upsert(spark, sf):
    return _token_text(upsert.upsert_tokens(fx.tokens(spark, sf), _new_tokens(spark, sf)))


def token_upsert_replace(spark, sf):
    return _token_text(upsert.upsert_tokens(fx.tokens(spark, sf), _new_tokens(spark, sf), replace_chunk=True))


def dense_update(spark, sf):
    """Vectors set for ids of which some are new."""
    updates = fx.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 150).alias("id"), F.col("embedding").alias("dense_embedding")
    )
    changed = upsert.update_dense(fx.chunks(spark, sf), updates)
    return changed.select("id", "title", "body", fx.vector_text("dense_embedding").alias("vector"))


def dense_side_table(spark, sf):
    """The same update where chunks and vectors are bucketed tables."""
    updates = fx.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 150).alias("id"), F.col("embedding").alias("dense_embedding")
    )
    chunks = sides.write_bucketed(fx.chunks(spark, sf), sides.table_name("chunks"), buckets=8)
    vectors = sides.write_bucketed(updates, sides.table_name("vectors"), buckets=8)
    changed = sides.with_vectors(chunks, vectors)
    return changed.select("id", "title", "body", fx.vector_text("dense_embedding").alias("vector"))


def typed_rejects(spark, sf):
    """Documents of two parts whose second part has a vector that is missing, malformed or ragged, by kind."""
    good, tokens = "[0.5, 1, -2e-3]", "[[1, 2], [0.5, 1.5]]"
    vectors = [
        (good, tokens),
        (None, tokens),
        ('"0.5"', tokens),
        ("[0.5, null]", tokens),
        (good, None),
        (good, "[[1, 2], [3]]"),
        (good, '[[1, "2"]]'),
        ("null", tokens),
        (good, "[]"),
        ("[[1]]", tokens),
    ]

    def part(dense, many):
        members = [(PART_DENSE, dense), (PART_TOKENS, many)]
        return ", ".join([f'"{PART_TEXT}": "x"', *[f'"{name}": {v}' for name, v in members if v is not None]])

    second = F.element_at(F.array(*[F.lit(part(*v)) for v in vectors]), (F.col("doc_id") % len(vectors) + 1).cast("int"))
    head = F.format_string(f'{{"{DOC_TITLE}": "doc-%d", "0": {{{part(good, tokens)}}}, "1": {{', "doc_id")
    rows = fx.table(spark, sf, "documents").select(F.concat(head, second, F.lit("}}")).alias("value"))
    read = documents.read_documents(spark, _written_documents(spark, sf, rows), "lines", (PART_DENSE, PART_TOKENS))
    return read.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n_documents"))


def token_vectors(spark, sf):
    rows = encode_tokens(fx.corpus(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text"))
    return rows.select("chunk_id", "embedding_id", fx.vector_text("embedding").alias("vector"))


def query_token_vectors(spark, sf):
    rows = late.encode_queries(fx.queries(spark, sf))
    return rows.select("query_id", "q_pos", fx.vector_text("embedding").alias("vector"))


def ingest_corpus(spark, sf):
    """Chunks with the number of token vectors that go with each."""
    chunks, tokens = ingest.ingest_corpus(fx.corpus(spark, sf))
    counts = tokens.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    joined = chunks.join(counts, chunks["id"] == counts["chunk_id"], "left")
    return joined.select("id", "title", "body", F.coalesce("n", F.lit(0)).alias("n_tokens"))


def _written_documents(spark, sf, rows=None):
    path = scratch_dir(spark, "documents")
    rows = fx.document_json(fx.paragraphs(spark, sf)) if rows is None else rows
    spread(rows.select("value")).write.option("compression", "gzip").text(path)
    return path


def json_parts(spark, sf):
    read = documents.read_documents(spark, _written_documents(spark, sf), "lines")
    parts = documents.document_parts(documents.good_documents(read))
    return parts.select("title", "part", "content")


def json_roundtrip(spark, sf):
    """Encoded, written with token vectors, read again: every vector of every part."""
    read = documents.read_documents(spark, _written_documents(spark, sf), "lines")
    path = scratch_dir(spark, "encoded")
    documents.write_encoded(documents.good_documents(read), path, HashEncoder)
    again = documents.document_parts(documents.good_documents(documents.read_documents(spark, path, "lines")))
    return again.select(
        "title",
        "part",
        "content",
        F.size("token_embeddings").alias("n_tokens"),
        F.md5(fx.vector_text(F.flatten("token_embeddings")).cast("binary")).alias("vectors"),
    )


def ingest_summary(spark, sf):
    read = documents.read_documents(spark, _written_documents(spark, sf), "lines")
    path = scratch_dir(spark, "encoded")
    documents.write_encoded(documents.good_documents(read), path, HashEncoder)
    again = documents.good_documents(documents.read_documents(spark, path, "lines"))
    return documents.ingest_summary(documents.document_parts(again))


def _damaged(spark, sf):
    """French documents cut short, German ones without a title."""
    rows = fx.document_json(fx.paragraphs(spark, sf))
    value = F.col("value")
    broken = (
        F.when(F.col("lang") == "fr", F.regexp_replace(value, r"\}$", ""))
        .when(F.col("lang") == "de", F.regexp_replace(value, f'^."{DOC_TITLE}"', '{"heading"'))
        .otherwise(value)
    )
    return rows.withColumn("value", broken)


def rejected_documents(spark, sf):
    read = documents.read_documents(spark, _written_documents(spark, sf, _damaged(spark, sf)), "lines")
    return documents.rejects(read).groupBy("reason").agg(F.count(F.lit(1)).alias("n_documents"))


def accepted_documents(spark, sf):
    read = documents.read_documents(spark, _written_documents(spark, sf, _damaged(spark, sf)), "lines")
    return documents.good_documents(read).select("title", "n_parts")


def _written_by_source(spark, sf):
    """Documents in one folder per source; a large source takes several tasks and files."""
    path = scratch_dir(spark, "by-source")
    rows = fx.document_json(fx.paragraphs(spark, sf)).select("value", "source")
    rows.hint("rebalance", "source").write.partitionBy("source").option("compression", "gzip").text(path)
    return path


def manifest_skip(spark, sf):
    """Documents in one folder per source; finished folders are left out."""
    path, manifest = _written_by_source(spark, sf), scratch_dir(spark, "manifest")
    files = documents.list_files(spark, path, ".gz")
    documents.mark_done(files.filter(F.col("path").rlike("source=src1")), manifest)
    todo = documents.first_files(documents.not_done(files, spark.read.parquet(manifest)))
    read = documents.read_documents(spark, [row.path for row in todo.collect()], "lines")
    return documents.good_documents(read).select("title", "n_parts")


def load_new_files(spark, sf):
    """Documents in one folder per source, loaded three files at a time until none is left."""
    path, out = _written_by_source(spark, sf), scratch_dir(spark, "loaded")
    places = [path, f"{out}/chunks", f"{out}/tokens", f"{out}/manifest"]
    while ingest.load_new_files(spark, *places, cap=3, layout="lines"):
        pass
    return tables.latest(spark.read.parquet(f"{out}/chunks"), ["id"]).select("id", "title", "body")


def encode_resumed(spark, sf):
    """Documents of some languages encoded, then all of them: how many are encoded by each call, and the rows."""
    path, calls = scratch_dir(spark, "encoded"), []
    for rows in (fx.paragraphs(spark, sf).filter("lang <> 'en'"), fx.paragraphs(spark, sf), fx.paragraphs(spark, sf)):
        read = documents.read_documents(spark, _written_documents(spark, sf, fx.document_json(rows)), "lines")
        calls.append(documents.encode_new(documents.good_documents(read), path, HashEncoder))
    again = documents.document_parts(documents.good_documents(documents.read_documents(spark, path, "lines")))
    counts = again.groupBy("title").agg(F.count("*").alias("n_parts"), F.sum(F.size("token_embeddings")).alias("n_tokens"))
    return counts.select("*", *[F.lit(n).cast("bigint").alias(f"call_{i}") for i, n in enumerate(calls)])


def _streamed(spark, sf):
    """Damaged documents streamed in, then whole ones of which some titles come again with other lines."""
    out, marks = scratch_dir(spark, "loaded"), scratch_dir(spark, "marks")
    path = _written_documents(spark, sf, _damaged(spark, sf))
    streaming.stream_documents(spark, path, out, marks, HashEncoder, layout="lines").awaitTermination()
    again = fx.paragraphs(spark, sf).filter("doc_id % 3 = 0").withColumn("texts", F.transform("texts", lambda t: F.translate(t, "aeo", "AEO")))
    fx.document_json(again).select("value").write.mode("append").option("compression", "gzip").text(path)
    for _ in range(2):  # the second time nothing is new
        streaming.stream_documents(spark, path, out, marks, HashEncoder, layout="lines").awaitTermination()
    return out


def stream_ingest(spark, sf):
    return streaming.current_chunks(spark, _streamed(spark, sf)).select("id", "title", "body")


def stream_tokens(spark, sf):
    return streaming.current_tokens(spark, _streamed(spark, sf)).groupBy("chunk_id").agg(
        F.count("*").alias("n_tokens"), F.max("embedding_id").alias("last")
    )


def stream_rejects(spark, sf):
    rows = streaming.all_rejects(spark, _streamed(spark, sf))
    return rows.groupBy(F.col("batch_id").cast("int").alias("batch_id"), "reason").agg(F.count("*").alias("n_documents"))


QUERIES = {
    "chunk_scan": chunk_scan,
    "substring_filter": substring_one,
    "substring_join": substring_all,
    "substring_counts": substring_counts,
    "format_results": format_results,
    "point_lookup": point_lookup,
    "tokenize": tokenized,
    "postings": postings,
    "doc_stats": doc_stats,
    "idf_floor": idf_floor,
    "bm25_topk": bm25_topk,
    "bm25_topk_zero_filled": bm25_topk_zero_filled,
    "bm25_negative": bm25_negative,
    "bm25_file_order": bm25_file_order,
    "bm25_stored_index": bm25_stored_index,
    "dot_scores": dot_scores,
    "dense_topk": dense_topk,
    "dense_null_vectors": dense_null_vectors,
    "dense_lookup": dense_lookup,
    "ivf_topk": ivf_topk,
    "ivf_recall": ivf_recall,
    "encode_dense": text_vectors,
    "dense_text_topk": dense_text_topk,
    "token_hits": token_hits,
    "adaptive_limit": adaptive_limit,
    "best_matches": best_per_token,
    "stage1_scores": stage1,
    "candidates": candidates,
    "maxsim_rerank": maxsim_all,
    "late_search": late_search,
    "late_search_wide": late_search_wide,
    "late_retrieve": late_retrieve,
    "partition_lookup": partition_lookup,
    "pack_vectors": pack_vectors,
    "unpack_offsets": unpack_offsets,
    "ndcg": ndcg,
    "map": mean_average_precision,
    "recall": recall,
    "precision": precision,
    "mrr": mrr,
    "metric_table": metric_table,
    "metric_table_filled": metric_table_filled,
    "metric_lines": metric_lines,
    "graded_metrics": graded_metrics,
    "sweep_grid": sweep_grid,
    "sweep_metrics": sweep_metrics,
    "system_union": system_union,
    "side_by_side": side_by_side,
    "overlap_at_k": overlap_at_k,
    "compare_systems": compare_systems,
    "run_roundtrip": run_roundtrip,
    "throughput": throughput_rows,
    "pareto": pareto_lines,
    "pareto_sweep": pareto_sweep,
    "log_records": log_records,
    "load_collection": load_collection,
    "load_qrels": load_qrels,
    "query_restriction": query_restriction,
    "dataset_sizes": dataset_sizes,
    "chunk_upsert": chunk_upsert,
    "latest_rows": latest_rows,
    "token_upsert": token_upsert,
    "token_upsert_replace": token_upsert_replace,
    "dense_update": dense_update,
    "dense_side_table": dense_side_table,
    "typed_rejects": typed_rejects,
    "encode_tokens": token_vectors,
    "encode_queries": query_token_vectors,
    "ingest_corpus": ingest_corpus,
    "json_parts": json_parts,
    "json_roundtrip": json_roundtrip,
    "ingest_summary": ingest_summary,
    "rejects": rejected_documents,
    "accepted_documents": accepted_documents,
    "manifest_skip": manifest_skip,
    "load_new_files": load_new_files,
    "encode_resumed": encode_resumed,
    "stream_ingest": stream_ingest,
    "stream_tokens": stream_tokens,
    "stream_rejects": stream_rejects,
}
