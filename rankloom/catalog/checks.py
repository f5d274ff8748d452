"""Check SQL for the registered queries, in DuckDB's dialect.

Each statement states the meaning of an operator again, on its own terms: all
pairs scored, then ranked.
"""

# White space as an explicit class: the same characters, spelled for this dialect.
_SPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

K1, B, EPSILON = 1.5, 0.75, 0.25


def _words(text):
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda w: w <> '')"


def _vector_text(vector):
    return f"array_to_string(list_transform({vector}, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',')"


def _sql(*ctes, select):
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _dot(a, b):
    return f"(round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]), 6) + 0.0)"


# ---- inputs -------------------------------------------------------------

CORPUS = "corpus AS (SELECT doc_id, source AS title, text FROM documents)"
ASKED = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
TOKENS = """tokens AS (SELECT vec_id // 8 AS chunk_id, (vec_id % 8)::INTEGER AS embedding_id, embedding
    FROM embeddings)"""
CLASS_TOKENS = """tokens AS (SELECT label::BIGINT AS chunk_id, vec_id::INTEGER AS embedding_id, embedding
    FROM embeddings)"""


def _means(name, keys, groups):
    return f"""{name} AS (SELECT {keys}, list(v ORDER BY i) AS embedding FROM (
        SELECT {groups}, i, avg(x::DOUBLE)::FLOAT AS v FROM (
            SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY ALL) GROUP BY {keys})"""


QUERY_TOKENS = _means(
    "query_tokens", "query_id, q_pos", "label::BIGINT AS query_id, (vec_id % 4)::INTEGER AS q_pos"
)
QUERY_VECTORS = _means("query_vectors", "query_id", "label::BIGINT AS query_id")
GRADED = """graded AS (SELECT label::BIGINT AS query_id, vec_id // 8 AS doc_id, count(*)::INTEGER AS rel
    FROM embeddings GROUP BY ALL)"""
CONTAINS = """qrels AS (SELECT item_id AS query_id, doc_id, 1 AS rel FROM documents d JOIN benchmark b
    ON contains(d.text, b.text))"""

# ---- lexical ------------------------------------------------------------

WORDS = f"words AS (SELECT doc_id, unnest({_words('text')}) AS term FROM documents)"
LENGTHS = f"lengths AS (SELECT doc_id, len({_words('text')}) AS length FROM documents)"
POSTINGS = "postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL)"
STATS = "stats AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM lengths)"
RAW_IDF = """raw_idf AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats)"""
IDF = f"""idf AS (SELECT term, df,
    CASE WHEN raw < 0 THEN {EPSILON} * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf)"""
QUERY_WORDS = f"""query_words AS (SELECT query_id, term, count(*) AS qtf FROM (
    SELECT item_id AS query_id, unnest({_words('text')}) AS term FROM benchmark) GROUP BY ALL)"""
SCORED = f"""scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({K1} + 1)
        / (tf + {K1} * (1 - {B} + {B} * length / mean_length))), 6) AS score
    FROM query_words JOIN idf USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), stats
    GROUP BY ALL)"""
NEGATIVE = """few AS (SELECT doc_id, concat_ws(' ', CASE WHEN doc_id % 3 > 0 THEN 'most' END,
        CASE WHEN doc_id % 10 > 0 THEN 'many' END, CASE WHEN doc_id % 100 > 0 THEN 'nearly every one' END, lang, CASE WHEN doc_id % 50 = 0 THEN 'few few' END) AS text
    FROM documents),
words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM few),
lengths AS (SELECT doc_id, count(*) AS length FROM words GROUP BY doc_id),
query_words AS (SELECT query_id, term, count(*) AS qtf FROM (
    SELECT item_id AS query_id, unnest(string_split(
        ['most', 'most few', 'many most', 'few en', 'none', 'many many fr'][item_id % 6 + 1], ' ')) AS term
    FROM benchmark) GROUP BY ALL)"""
BM25_CTES = [WORDS, LENGTHS, POSTINGS, STATS, RAW_IDF, IDF, QUERY_WORDS, SCORED]


def _first(source, keys, order, k, rank="rank"):
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order})::INTEGER AS {rank}
        FROM {source}) WHERE {rank} <= {k}"""


EVERYTHING = """everything AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM benchmark b
    CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = b.item_id AND s.doc_id = d.doc_id)"""
BM25_TOP = "bm25 AS (" + _first("scored", "query_id", "score DESC, doc_id", 100) + ")"
BM25 = [*BM25_CTES, BM25_TOP]

# ---- vectors ------------------------------------------------------------

VECTOR_CHUNKS = """chunks AS (SELECT vec_id AS id, 'label ' || label AS title, 'vector ' || vec_id AS body,
    embedding AS dense_embedding FROM embeddings)"""


def _dense(k, where="true"):
    return [
        QUERY_VECTORS,
        VECTOR_CHUNKS,
        f"""dense_pairs AS (SELECT query_id, id, {_dot('embedding', 'dense_embedding')} AS similarity
            FROM query_vectors, chunks WHERE {where})""",
        "dense AS (" + _first("dense_pairs", "query_id", "similarity DESC, id", k) + ")",
    ]


DENSE_SELECT = "SELECT query_id, id, similarity, rank FROM dense"

# Hash vectors: byte i of the token's md5, centred, scaled to length 1.
_BYTES = "list_transform(range(16), lambda i: ('0x' || substr(md5({t}), (2 * i + 1)::INTEGER, 2))::INTEGER - 127.5)"


def _unit(vector):
    return f"list_transform({vector}, lambda x: x / sqrt(list_dot_product({vector}, {vector})))"


def _token_vectors(name, source, key, text):
    """Vectors per distinct token, and the tokens of each text with their place."""
    return [
        f"""{name}_at AS (SELECT {key}, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS place
            FROM (SELECT {key}, {_words(text)} AS w FROM {source}))""",
        f"""{name}_raw AS (SELECT term, {_BYTES.format(t='term')}::DOUBLE[] AS v
            FROM (SELECT DISTINCT term FROM {name}_at))""",
        f"{name}_unit AS (SELECT term, {_unit('v')} AS v FROM {name}_raw)",
    ]


def _text_vectors(name, source, key, text):
    return [
        *_token_vectors(name, source, key, text),
        f"""{name}_sums AS (SELECT {key}, list(s ORDER BY i) AS v FROM (
            SELECT {key}, i, sum(x) AS s FROM (
                SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {name}_at JOIN {name}_unit USING (term))
            GROUP BY ALL) GROUP BY {key})""",
        f"""{name}_vectors AS (SELECT {key}, CASE WHEN v IS NULL THEN list_transform(range(16), lambda i: 0.0)
            ELSE {_unit('v')} END::FLOAT[] AS embedding FROM {source} LEFT JOIN {name}_sums USING ({key}))""",
    ]


DENSE_TEXT = [
    *_text_vectors("d", "documents", "doc_id", "text"),
    *_text_vectors("q", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text"),
    f"""text_pairs AS (SELECT query_id, doc_id, {_dot('q.embedding', 'd.embedding')} AS similarity
        FROM q_vectors q, d_vectors d)""",
    "dense_text AS (" + _first("text_pairs", "query_id", "similarity DESC, doc_id", 100) + ")",
]

# ---- late interaction ---------------------------------------------------

PAIRS = f"""pairs AS (SELECT q.query_id, q.q_pos, t.chunk_id, t.embedding_id,
    {_dot('q.embedding', 't.embedding')} AS similarity FROM query_tokens q, tokens t)"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, q_pos
    ORDER BY similarity DESC, chunk_id, embedding_id)::INTEGER AS rank FROM pairs)"""


def _tried(grid, cap=1000):
    rows, series = [], []
    for n in grid:
        limit = n
        while limit <= cap:
            rows.append(f"({n}, {limit})")
            limit *= 2
    return "tried AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(n_ann, lim))"


LIMITS = """fetches AS (SELECT n_ann, lim, query_id, q_pos, count(DISTINCT chunk_id) AS n
    FROM tried JOIN ranked ON rank <= lim GROUP BY ALL),
limits AS (SELECT query_id, q_pos, n_ann,
    coalesce(min(lim) FILTER (WHERE n >= greatest(2, n_ann / 4.0)), max(lim))::INTEGER AS "limit"
    FROM fetches GROUP BY ALL)"""


def _late(tokens, grid, n_candidates):
    return [
        QUERY_TOKENS,
        tokens,
        PAIRS,
        RANKED,
        _tried(grid),
        LIMITS,
        """matches AS (SELECT n_ann, query_id, q_pos, chunk_id, greatest(max(similarity), -1.0) AS best
            FROM ranked JOIN limits USING (query_id, q_pos) WHERE rank <= "limit" GROUP BY ALL)""",
        """stage1 AS (SELECT n_ann, query_id, chunk_id, round(sum(best), 6) AS stage1 FROM matches GROUP BY ALL)""",
        "picked AS (" + _first("stage1", "n_ann, query_id", "stage1 DESC, chunk_id", n_candidates) + ")",
        f"""maxsim AS (SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM (
            SELECT q.query_id, q.q_pos, t.chunk_id,
                max(list_dot_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[])) AS best
            FROM query_tokens q, tokens t GROUP BY ALL) GROUP BY ALL)""",
        "late AS (SELECT query_id, chunk_id, stage1, rank, score, n_ann FROM picked JOIN maxsim USING (query_id, chunk_id))",
    ]


LATE = _late(TOKENS, [20], 40)
SWEEP_VALUES = (20, 40, 80, 160, 240, 320)
CELLS = "cells AS (SELECT * FROM (VALUES " + ", ".join(f"({n})" for n in SWEEP_VALUES) + ") AS v(n_candidates))"
SWEEP = [
    *_late(TOKENS, SWEEP_VALUES, max(SWEEP_VALUES)),
    CELLS,
    """sweep AS (SELECT n_ann || ', ' || n_candidates AS config, n_ann, n_candidates, query_id, chunk_id AS doc_id, score
        FROM late JOIN cells ON rank <= n_candidates)""",
]

# ---- evaluation ---------------------------------------------------------


def _judged(run, qrels, cuts, mrr_cuts, same_ids=False):
    """Per-query metrics of ``run(system, config, query_id, doc_id, score)``."""
    keep = "true" if same_ids else "query_id::VARCHAR <> doc_id::VARCHAR"
    per_cut = ",\n".join(
        f"""coalesce(dcg_{k} / ideal_{k}, 0.0) AS ndcg_{k}, coalesce(ap_{k} / nullif(n_rel, 0), 0.0) AS map_{k},
        coalesce(hits_{k} / nullif(n_rel, 0), 0.0) AS recall_{k}, hits_{k} / {k}.0 AS precision_{k}"""
        for k in cuts
    )
    sums = ",\n".join(
        f"""sum(CASE WHEN r <= {k} THEN rel / log2(r + 1) END) AS dcg_{k},
        sum(CASE WHEN r <= {k} AND rel > 0 THEN seen / r END) AS ap_{k},
        coalesce(sum(CASE WHEN r <= {k} AND rel > 0 THEN 1.0 END), 0.0) AS hits_{k}"""
        for k in cuts
    )
    ideals = ",\n".join(f"sum(CASE WHEN r <= {k} THEN rel / log2(r + 1) END) AS ideal_{k}" for k in cuts)
    reciprocal = ",\n".join(f"CASE WHEN first <= {k} THEN 1.0 / first ELSE 0.0 END AS mrr_{k}" for k in mrr_cuts)
    return [
        f"""placed AS (SELECT system, config, query_id, doc_id, coalesce(rel, 0) AS rel,
            row_number() OVER (PARTITION BY system, config, query_id ORDER BY score DESC, doc_id::VARCHAR DESC) AS r
            FROM (SELECT * FROM {run} WHERE {keep}) LEFT JOIN {qrels} USING (query_id, doc_id))""",
        """seen AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1.0 ELSE 0 END) OVER (
            PARTITION BY system, config, query_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS seen FROM placed)""",
        f"""gains AS (SELECT system, config, query_id, {sums}, min(CASE WHEN rel > 0 THEN r END) AS first
            FROM seen GROUP BY ALL)""",
        f"""ideals AS (SELECT query_id, count(*) FILTER (WHERE rel > 0) AS n_rel, {ideals} FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM {qrels})
            GROUP BY query_id)""",
        f"""per_query AS (SELECT system, config, query_id, {per_cut}{',' + reciprocal if mrr_cuts else ''}
            FROM gains JOIN ideals USING (query_id))""",
    ]


def _table(cuts, mrr_cuts, qrels):
    rows = []
    for metric in ("ndcg", "map", "recall", "precision"):
        for k in cuts:
            rows.append(
                f"SELECT system, config, '{metric}' AS metric, {k} AS k, round(avg({metric}_{k}), 6) AS value "
                "FROM per_query GROUP BY ALL"
            )
    for k in mrr_cuts:
        rows.append(
            f"SELECT system, config, 'mrr' AS metric, {k} AS k, "
            f"round(sum(mrr_{k}) / (SELECT count(DISTINCT query_id) FROM {qrels}), 6) AS value FROM per_query GROUP BY ALL"
        )
    return "\nUNION ALL ".join(rows)


CUTS, MRR_CUTS = (1, 3, 5, 10, 100), (1, 10, 100)
BM25_RUN = "bm25_run AS (SELECT 'bm25' AS system, 'default' AS config, query_id, doc_id, score, rank FROM bm25)"
DENSE_RUN = """dense_run AS (SELECT 'dense' AS system, 'default' AS config, query_id, doc_id, similarity AS score, rank
    FROM dense_text)"""
LATE_RUN = "late_run AS (SELECT 'late' AS system, 'default' AS config, query_id, chunk_id AS doc_id, score FROM late)"
JUDGED = [*BM25, BM25_RUN, CONTAINS, *_judged("bm25_run", "qrels", CUTS, MRR_CUTS)]
RUNS = [*BM25, BM25_RUN, *DENSE_TEXT, DENSE_RUN]
STACKED = "stacked AS (SELECT * FROM bm25_run UNION ALL SELECT * FROM dense_run)"


def _one_metric(metric, cuts):
    columns = ", ".join(f"round({metric}_{k}, 6) AS {metric}_{k}" for k in cuts)
    return _sql(*JUDGED, select=f"SELECT query_id, {columns} FROM per_query")


# ---- frontier -----------------------------------------------------------

LINES = """bench AS (SELECT l_orderkey || ', ' || l_linenumber AS label, l_extendedprice AS time,
    round(l_quantity * (1 - l_discount), 4) AS accuracy, 100 / l_extendedprice AS throughput FROM lineitem)"""


def _frontier(points):
    """Best accuracy per throughput, and the best at any higher one."""
    return [
        f"best AS (SELECT throughput, max(accuracy) AS here FROM {points} GROUP BY throughput)",
        """bar AS (SELECT *, max(here) OVER (ORDER BY throughput DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            AS bar FROM best)""",
        f"""frontier AS (SELECT p.* FROM {points} p JOIN bar b
            ON p.throughput = b.throughput AND p.accuracy = b.here WHERE bar IS NULL OR here > bar)""",
    ]


SWEEP_TABLE = [*SWEEP, GRADED, "sweep_run AS (SELECT 'late' AS system, * FROM sweep)"]
SWEEP_JUDGED = [*SWEEP_TABLE, *_judged("sweep_run", "graded", (1, 5, 10, 100), (), True)]

# ---- documents ----------------------------------------------------------

PARTS = """parts AS (SELECT doc_id, 'doc-' || doc_id AS title, lang, source, unnest(string_split(text, chr(10))) AS content,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part FROM documents)"""
PART_COUNTS = """SELECT 'doc-' || doc_id AS title, len(string_split(text, chr(10)))::INTEGER AS n_parts
    FROM documents WHERE """
STORED_TOKENS = f"SELECT chunk_id, embedding_id, {_vector_text('embedding')} AS vector FROM tokens"
NEW_TOKENS = f"SELECT query_id AS chunk_id, q_pos AS embedding_id, {_vector_text('embedding')} AS vector FROM query_tokens"
MATCHES = """matches AS (SELECT item_id AS query_id, doc_id AS id, source AS title, d.text AS body
    FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""

DENSE_UPDATE = f"""SELECT coalesce(doc_id, vec_id + 150) AS id, source AS title, text AS body,
        {_vector_text('embedding')} AS vector FROM documents FULL JOIN embeddings ON doc_id = vec_id + 150"""

CHECKS = {
    "chunk_scan": "SELECT source AS title, text AS body FROM documents",
    "substring_filter": "SELECT source AS title, text AS body FROM documents WHERE contains(text, 'tion the')",
    "substring_join": _sql(MATCHES, select="SELECT * FROM matches"),
    "substring_counts": _sql(
        MATCHES,
        select="SELECT item_id AS query_id, count(id) AS n_results FROM benchmark LEFT JOIN matches ON item_id = query_id GROUP BY 1",
    ),
    "format_results": _sql(
        MATCHES,
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id)::INTEGER AS rank FROM matches)",
        select="SELECT query_id, rank, rank || '. ' || title || chr(10) || body AS line FROM numbered",
    ),
    "point_lookup": "SELECT doc_id AS id, source AS title, text AS body FROM documents WHERE doc_id = 7",
    "tokenize": f"""SELECT doc_id, array_to_string({_words('text')}, ' ') AS tokens, len({_words('text')})::INTEGER AS n_tokens
        FROM documents""",
    "postings": _sql(WORDS, POSTINGS, select="SELECT doc_id, term, tf FROM postings"),
    "doc_stats": _sql(
        LENGTHS,
        STATS,
        select="SELECT doc_id, length::INTEGER AS length, n_docs, round(mean_length, 6) AS mean_length FROM lengths, stats",
    ),
    "idf_floor": _sql(
        WORDS,
        "counted AS MATERIALIZED (SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term)",
        "n AS MATERIALIZED (SELECT count(*) AS n_docs FROM documents)",
        "raws AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM counted, n)",
        "middle AS MATERIALIZED (SELECT avg(raw) AS mean FROM raws)",
        select=f"SELECT term, df, round(CASE WHEN raw < 0 THEN {EPSILON} * mean ELSE raw END, 6) AS idf FROM raws, middle",
    ),
    "bm25_topk": _sql(*BM25, select="SELECT query_id, doc_id, score, rank FROM bm25"),
    "bm25_topk_zero_filled": _sql(
        *BM25_CTES,
        EVERYTHING,
        select="SELECT query_id, doc_id, score, rank FROM ("
        + _first("everything", "query_id", "score DESC, doc_id", 1000)
        + ")",
    ),
    "bm25_negative": _sql(
        NEGATIVE,
        POSTINGS,
        STATS,
        RAW_IDF,
        IDF,
        SCORED,
        EVERYTHING,
        select="SELECT query_id, doc_id, score, rank FROM (" + _first("everything", "query_id", "score DESC, doc_id", 37) + ")",
    ),
    "bm25_file_order": _sql(
        *BM25_CTES,
        CONTAINS,
        EVERYTHING,
        "listed AS (" + _first("everything", "query_id", "score DESC, doc_id DESC", 100) + ")",
        select="""SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, score, rank FROM listed
            SEMI JOIN qrels USING (query_id)""",
    ),
    "bm25_stored_index": _sql(*BM25, select="SELECT query_id, doc_id, score, rank FROM bm25"),
    "dot_scores": _sql(
        QUERY_VECTORS,
        select=f"""SELECT vec_id, {_dot('e.embedding', 'q.embedding')} AS similarity,
            round((1 + list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6) AS similarity01
            FROM embeddings e JOIN query_vectors q ON query_id = label""",
    ),
    "dense_topk": _sql(*_dense(100), select=DENSE_SELECT),
    "dense_null_vectors": _sql(*_dense(100, "title <> 'label 3'"), select=DENSE_SELECT),
    "dense_lookup": _sql(
        *_dense(10),
        select="SELECT query_id, rank, id AS _id, title, body, similarity AS score FROM dense JOIN chunks USING (id)",
    ),
    "ivf_topk": _sql(*_dense(100), select=DENSE_SELECT),
    "ivf_recall": _sql(
        *_dense(10),
        select="""SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, true AS recall_reached,
            true AS lists_skipped FROM dense""",
    ),
    "encode_dense": _sql(
        *_text_vectors("d", "documents", "doc_id", "text"),
        select=f"SELECT doc_id, {_vector_text('embedding')} AS vector FROM d_vectors",
    ),
    "dense_text_topk": _sql(*DENSE_TEXT, select="SELECT query_id, doc_id AS id, similarity, rank FROM dense_text"),
    "token_hits": _sql(
        QUERY_TOKENS,
        TOKENS,
        PAIRS,
        RANKED,
        select="SELECT query_id, q_pos, chunk_id, embedding_id, similarity, rank FROM ranked WHERE rank <= 20",
    ),
    "adaptive_limit": _sql(
        QUERY_TOKENS,
        CLASS_TOKENS,
        PAIRS,
        RANKED,
        _tried((4, *SWEEP_VALUES)),
        LIMITS,
        select='SELECT query_id, q_pos, n_ann, "limit" FROM limits',
    ),
    "best_matches": _sql(
        QUERY_TOKENS,
        TOKENS,
        PAIRS,
        RANKED,
        select="""SELECT query_id, q_pos, chunk_id, greatest(max(similarity), -1.0) AS best FROM ranked
            WHERE rank <= 20 GROUP BY ALL""",
    ),
    "stage1_scores": _sql(
        QUERY_TOKENS,
        TOKENS,
        PAIRS,
        RANKED,
        select="""SELECT query_id, chunk_id, round(sum(best), 6) AS stage1 FROM (
            SELECT query_id, q_pos, chunk_id, greatest(max(similarity), -1.0) AS best FROM ranked
            WHERE rank <= 20 GROUP BY ALL) GROUP BY ALL""",
    ),
    "candidates": _sql(*_late(TOKENS, [20], 10)[:-2], select="SELECT query_id, chunk_id, stage1, rank FROM picked"),
    "maxsim_rerank": _sql(
        *LATE,
        select="""SELECT query_id, chunk_id, score FROM maxsim
            SEMI JOIN (SELECT query_id, chunk_id FROM ranked WHERE rank <= 20) USING (query_id, chunk_id)""",
    ),
    "late_search": _sql(*LATE, select="SELECT query_id, chunk_id, stage1, rank, score FROM late"),
    "late_search_wide": _sql(
        *_late(CLASS_TOKENS, [20], 40), select="SELECT query_id, chunk_id, stage1, rank, score FROM late"
    ),
    "late_retrieve": _sql(
        *LATE,
        "best AS (SELECT * EXCLUDE (rank) FROM late)",
        "top AS (" + _first("best", "query_id", "score DESC, chunk_id", 5) + ")",
        select="""SELECT query_id, rank, chunk_id AS _id, 'chunk ' || chunk_id AS title,
            'vectors from ' || chunk_id * 8 AS body, score FROM top""",
    ),
    "partition_lookup": _sql(
        TOKENS, select=f"SELECT chunk_id, {_vector_text('embedding')} AS vector FROM tokens WHERE chunk_id = 5"
    ),
    "pack_vectors": _sql(
        TOKENS,
        select=f"""SELECT chunk_id, 0 AS segment, count(*)::INTEGER AS length,
            string_agg({_vector_text('embedding')}, ',' ORDER BY embedding_id) AS vectors FROM tokens GROUP BY chunk_id""",
    ),
    "unpack_offsets": """SELECT doc_id, part,
            coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
                AS "offset",
            length::INTEGER AS length, ids
        FROM (SELECT vec_id // 64 AS doc_id, label AS part, count(*) AS length, string_agg(vec_id, ',' ORDER BY vec_id) AS ids
            FROM embeddings GROUP BY ALL)""",
    "ndcg": _one_metric("ndcg", CUTS),
    "map": _one_metric("map", CUTS),
    "recall": _one_metric("recall", CUTS),
    "precision": _one_metric("precision", CUTS),
    "mrr": _one_metric("mrr", MRR_CUTS),
    "metric_table": _sql(*JUDGED, select=_table(CUTS, MRR_CUTS, "qrels")),
    "metric_table_filled": _sql(
        *BM25_CTES,
        EVERYTHING,
        "bm25 AS (" + _first("everything", "query_id", "score DESC, doc_id", 100) + ")",
        BM25_RUN,
        CONTAINS,
        *_judged("bm25_run", "qrels", CUTS, MRR_CUTS),
        select=_table(CUTS, MRR_CUTS, "qrels"),
    ),
    "metric_lines": _sql(
        *JUDGED,
        "long AS (" + _table(CUTS, MRR_CUTS, "qrels").replace(", 6) AS value", ", 9) AS value") + ")",
        select="SELECT upper(metric) || '@' || k || ': ' || format('{:.5f}', round(value, 5)) AS line FROM long",
    ),
    "graded_metrics": _sql(
        *LATE,
        LATE_RUN,
        GRADED,
        *_judged("late_run", "graded", (1, 5, 10, 100), MRR_CUTS, True),
        select=_table((1, 5, 10, 100), MRR_CUTS, "graded"),
    ),
    "sweep_grid": _sql(*SWEEP, select="SELECT config, n_ann, n_candidates, query_id, doc_id, score FROM sweep"),
    "sweep_metrics": _sql(*SWEEP_JUDGED, select=_table((1, 5, 10, 100), (), "graded")),
    "system_union": _sql(*RUNS, STACKED, select="SELECT * FROM stacked"),
    "side_by_side": _sql(
        *RUNS,
        select="""SELECT query_id, rank, a.doc_id AS left_doc, a.score AS left_score, b.doc_id AS right_doc,
            b.score AS right_score FROM bm25_run a FULL JOIN dense_run b USING (query_id, rank)""",
    ),
    "overlap_at_k": _sql(
        *RUNS,
        select="""SELECT query_id, count(DISTINCT doc_id) FILTER (WHERE n = 2) AS n_shared FROM (
            SELECT query_id, doc_id, count(*) AS n FROM (
                SELECT query_id, doc_id FROM bm25_run WHERE rank <= 10
                UNION ALL SELECT query_id, doc_id FROM dense_run WHERE rank <= 10) GROUP BY ALL) GROUP BY query_id""",
    ),
    "compare_systems": _sql(
        *RUNS,
        STACKED,
        CONTAINS,
        """common AS (SELECT query_id FROM bm25_run INTERSECT SELECT query_id FROM dense_run)""",
        "common_run AS (SELECT * FROM stacked SEMI JOIN common USING (query_id))",
        "common_qrels AS (SELECT * FROM qrels SEMI JOIN common USING (query_id))",
        *_judged("common_run", "common_qrels", CUTS, MRR_CUTS),
        select=_table(CUTS, MRR_CUTS, "common_qrels"),
    ),
    "run_roundtrip": _sql(
        *_dense(100),
        select="""SELECT 'dense' AS system, 'default' AS config, query_id, id AS doc_id, similarity AS score, rank
            FROM dense""",
    ),
    "throughput": _sql(LINES, select="SELECT label, round(throughput, 9) AS throughput, accuracy FROM bench"),
    "pareto": _sql(LINES, *_frontier("bench"), select="SELECT label, time, accuracy FROM frontier"),
    "pareto_sweep": _sql(
        *SWEEP_JUDGED,
        "long AS (" + _table((10,), (), "graded") + ")",
        """points AS (SELECT config AS label, value AS accuracy,
            (string_split(config, ', ')[1]::DOUBLE + string_split(config, ', ')[2]::DOUBLE) / 100 AS time
            FROM long WHERE metric = 'ndcg' AND k = 10)""",
        "rated AS (SELECT *, 100 / time AS throughput FROM points)",
        *_frontier("rated"),
        select="SELECT label, time, accuracy FROM frontier",
    ),
    "log_records": """SELECT p_size || ', ' || p_partkey AS label, round(p_retailprice, 2) AS time,
        round(p_size / 50, 5) AS ndcg10 FROM part""",
    "load_collection": """SELECT doc_id::VARCHAR AS doc_id, source AS title, text,
        row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos FROM documents""",
    "load_qrels": """SELECT item_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, 1 AS rel, b.text AS text
        FROM documents d JOIN benchmark b ON contains(d.text, b.text)""",
    "query_restriction": _sql(
        CONTAINS,
        select="""SELECT query_id, doc_id, rel FROM qrels
            SEMI JOIN (SELECT item_id AS query_id FROM benchmark ORDER BY item_id LIMIT 25) USING (query_id)""",
    ),
    "dataset_sizes": _sql(
        CONTAINS,
        select="""SELECT (SELECT count(*) FROM documents) AS n_corpus, (SELECT count(*) FROM benchmark) AS n_queries,
            (SELECT count(DISTINCT query_id) FROM qrels) AS n_judged""",
    ),
    "chunk_upsert": f"""SELECT doc_id AS id,
            CASE WHEN l.doc_id IS NULL THEN source ELSE 'quality ' || quality END AS title,
            CASE WHEN l.doc_id IS NULL THEN text ELSE 'toxic ' || toxic END AS body,
            {_vector_text('embedding')} AS vector
        FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id
        UNION ALL SELECT page_id + 1000000000, url, html, NULL FROM pages""",
    "latest_rows": """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "token_upsert": _sql(
        TOKENS,
        QUERY_TOKENS,
        select=f"""{STORED_TOKENS} ANTI JOIN (SELECT query_id AS chunk_id, q_pos AS embedding_id FROM query_tokens)
            USING (chunk_id, embedding_id) UNION ALL {NEW_TOKENS}""",
    ),
    "token_upsert_replace": _sql(
        TOKENS,
        QUERY_TOKENS,
        select=f"""{STORED_TOKENS} ANTI JOIN (SELECT query_id AS chunk_id FROM query_tokens) USING (chunk_id)
            UNION ALL {NEW_TOKENS}""",
    ),
    "typed_rejects": """SELECT ['good', 'part 1 has no embedding', 'part 1 has a malformed embedding',
            'part 1 has a malformed embedding', 'part 1 has no colbert_embedding', 'part 1 has a ragged colbert_embedding',
            'part 1 has a malformed colbert_embedding', 'part 1 has no embedding', 'good',
            'part 1 has a malformed embedding'][doc_id % 10 + 1] AS reason, count(*) AS n_documents FROM documents GROUP BY 1""",
    "dense_update": DENSE_UPDATE,
    "dense_side_table": DENSE_UPDATE,
    "encode_tokens": _sql(
        *_token_vectors("d", "documents", "doc_id", "text"),
        select=f"""SELECT doc_id AS chunk_id, place::INTEGER AS embedding_id, {_vector_text('v::FLOAT[]')} AS vector
            FROM d_at JOIN d_unit USING (term)""",
    ),
    "encode_queries": _sql(
        *_token_vectors("q", "benchmark", "item_id", "text"),
        select=f"""SELECT item_id AS query_id, place::INTEGER AS q_pos, {_vector_text('v::FLOAT[]')} AS vector
            FROM q_at JOIN q_unit USING (term)""",
    ),
    "ingest_corpus": f"""SELECT doc_id AS id, source AS title, text AS body, len({_words('text')}) AS n_tokens
        FROM documents""",
    "json_parts": _sql(PARTS, select="SELECT title, part::INTEGER AS part, content FROM parts"),
    "json_roundtrip": _sql(
        PARTS,
        f"worded AS (SELECT *, {_words('content')} AS w FROM parts)",
        "spread AS (SELECT title, part, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM worded)",
        f"raw AS (SELECT term, {_BYTES.format(t='term')}::DOUBLE[] AS v FROM (SELECT DISTINCT term FROM spread))",
        f"unit AS (SELECT term, {_vector_text(_unit('v') + '::FLOAT[]')} AS v FROM raw)",
        "joined AS (SELECT title, part, string_agg(v, ',' ORDER BY place) AS v FROM spread JOIN unit USING (term) GROUP BY ALL)",
        select="""SELECT title, part::INTEGER AS part, content, len(w)::INTEGER AS n_tokens, md5(coalesce(v, '')) AS vectors
            FROM worded LEFT JOIN joined USING (title, part)""",
    ),
    "ingest_summary": _sql(
        PARTS,
        select=f"SELECT title, count(*) AS n_parts, sum(len({_words('content')}))::BIGINT AS n_embeddings FROM parts GROUP BY title",
    ),
    "rejects": """SELECT CASE lang WHEN 'fr' THEN 'not a JSON object' ELSE 'no title' END AS reason, count(*) AS n_documents
        FROM documents WHERE lang IN ('fr', 'de') GROUP BY 1""",
    "accepted_documents": PART_COUNTS + "lang NOT IN ('fr', 'de')",
    "manifest_skip": PART_COUNTS + "source NOT LIKE 'src1%'",
    "load_new_files": _sql(PARTS, select="SELECT title || '#' || part AS id, title, content AS body FROM parts"),
    "encode_resumed": _sql(
        PARTS,
        select=f"""SELECT title, count(*) AS n_parts, sum(len({_words('content')}))::BIGINT AS n_tokens,
            (SELECT count(*) FROM documents WHERE lang <> 'en') AS call_0,
            (SELECT count(*) FROM documents WHERE lang = 'en') AS call_1, 0::BIGINT AS call_2 FROM parts GROUP BY title""",
    ),
    "stream_ingest": _sql(
        PARTS,
        select="""SELECT title || '#' || part AS id, title, CASE WHEN doc_id % 3 = 0 THEN translate(content, 'aeo', 'AEO') ELSE content END AS body
            FROM parts WHERE doc_id % 3 = 0 OR lang NOT IN ('fr', 'de')""",
    ),
    "stream_tokens": _sql(
        PARTS,
        f"""counted AS (SELECT title || '#' || part AS chunk_id, len({_words('content')}) AS n FROM parts
            WHERE doc_id % 3 = 0 OR lang NOT IN ('fr', 'de'))""",
        select="SELECT chunk_id, n AS n_tokens, (n - 1)::INTEGER AS last FROM counted WHERE n > 0",
    ),
    "stream_rejects": """SELECT 0 AS batch_id, CASE lang WHEN 'fr' THEN 'not a JSON object' ELSE 'no title' END AS reason,
        count(*) AS n_documents FROM documents WHERE lang IN ('fr', 'de') GROUP BY 2""",
}
