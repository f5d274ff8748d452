"""Case-sensitive substring search, one query or a whole query set."""

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import arrow, sizing

try:
    import ahocorasick
except ImportError:  # one pattern at a time then
    ahocorasick = None


def substring_filter(chunks, text):
    """``title, body`` of chunks whose body contains the text; the scan filters."""
    return chunks.filter(F.col("body").contains(F.lit(text))).select("title", "body")


def substring_matches(queries, chunks, block_bytes=sizing.BLOCK_BYTES):
    """``query_id, id`` for every query text found in a body; bodies stay in the tasks.

    All texts of a block are searched in one pass over each body (one automaton per
    task), so the cost follows the length of the corpus, not corpus * queries.
    Null texts and null bodies match nothing; an empty text matches each body.
    """
    asked = queries.select("query_id", "text").filter(F.col("text").isNotNull())
    rows = chunks.select("id", "body").filter(F.col("body").isNotNull())
    schema = T.StructType([asked.schema["query_id"], rows.schema["id"]])
    length = asked.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    found = []
    # an automaton takes some 50 bytes for each byte of its texts
    for table, alone in sizing.query_blocks(asked, ["query_id", "text"], 64 + 50 * int(length), block_bytes):
        got = rows.mapInArrow(lambda batches, table=table: _search(table, batches, schema.names), schema)
        found.append(got if alone else sizing.stored(got, "substring"))
    return reduce(lambda a, b: a.union(b), found)


def substring_join(queries, chunks, block_bytes=sizing.BLOCK_BYTES):
    """``query_id, id, title, body`` for every query text found in a body; ``id`` is a key of chunks."""
    found = substring_matches(queries, chunks, block_bytes)
    return found.join(chunks.select("id", "title", "body"), "id").select("query_id", "id", "title", "body")


def match_counts(queries, matches):
    """Number of matches per query, 0 included."""
    counted = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        queries.select("query_id")
        .join(counted, "query_id", "left")
        .select("query_id", F.coalesce("n", F.lit(0)).alias("n_results"))
    )


def _finder(texts):
    """A function: body -> numbers of the texts it contains."""
    everywhere = [i for i, t in enumerate(texts) if t == ""]
    same = {}
    for i, t in enumerate(texts):
        if t:
            same.setdefault(t, []).append(i)
    automaton = ahocorasick.Automaton()
    for t, who in same.items():
        automaton.add_word(t, (t, who))
    if same:
        automaton.make_automaton()

    def find(body):
        found = {t: who for _, (t, who) in automaton.iter(body)} if same else {}
        return everywhere + [i for who in found.values() for i in who]

    return find


def _matches(texts, find, bodies):
    who, where = [], []
    if find is not None:
        for at, body in enumerate(bodies.to_pylist()):
            for i in find(body):
                who.append(i)
                where.append(at)
    else:
        for i, text in enumerate(texts):
            for at in pc.indices_nonzero(pc.match_substring(bodies, text)).to_pylist():
                who.append(i)
                where.append(at)
    return pa.array(who, pa.int64()), pa.array(where, pa.int64())


def _search(table, batches, names):
    texts = table.column("text").to_pylist()
    find = _finder(texts) if ahocorasick else None
    for batch in batches:
        found = _found(table, texts, find, arrow.as_table(batch), names)
        yield from found.to_batches(max_chunksize=10_000)


def _found(table, texts, find, rows, names):
    who, where = _matches(texts, find, rows.column("body"))
    return pa.table([table.column("query_id").take(who), rows.column("id").take(where)], names=names)
