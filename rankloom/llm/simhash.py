"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has a bit for each bit position of its shingles' hashes: 1
if set in over half of them.  Documents are linked when their fingerprints differ in
at most ``max_bits`` bits, and a component's documents are near-duplicates.

Finding the links.  Cut the 64 bits, seen as a ring, into ``m = max_bits + 1`` segments.
If two fingerprints differ in at most t bits, some segment starts a chain in which the
first l segments differ in at most l*t/m bits together, for every l up to m.  For
l = 1 that is 0 bits, for l = 2 it is 1 bit: so the starting segment is equal, and of
two halves of the next one at least one is.  Fingerprints meet on these keys (two for
each start); chains are then checked segment by segment in growing length, and
the last step, all m segments, is the full Hamming check.

Equal fingerprints are one node with a count from the start, so copies never meet.
A key with very many different fingerprints is cut into blocks that meet two by two,
each pair of blocks in one task of bounded size; a task gives one link for each member at
most (to the smallest of its linked ones), never the pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from rankloom.llm.common import fresh, lower_bytes, pick, texts
from rankloom.llm.components import components
from rankloom.operators.sizing import broadcast_if, stored

BITS = 64
SHINGLE = 4
MAX_BITS = 4
#: Fingerprints of one key that one block holds.
BLOCK = 2048


def fingerprint(text, width=SHINGLE):
    """The fingerprint of UTF-8 bytes as an unsigned int; 0 if there are no words."""
    words = lower_bytes(text).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    if n <= width:
        return xxhash.xxh64_intdigest(line, 42)
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    firsts, lasts = start[: n - width + 1].tolist(), end[width - 1 :].tolist()
    many = len(firsts)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, many, 65_536):
        part = [digest(line[s:e], 42) for s, e in zip(firsts[at : at + 65_536], lasts[at : at + 65_536], strict=True)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > many, bitorder="little").view("<u8")[0])


def fingerprints(docs, width=SHINGLE):
    """``(doc_id, fp)`` for each row of docs (doc_id, text); fp is the fingerprint's 64 bits as a long."""

    def run(parts):
        for batch in parts:
            fp = np.array([fingerprint(t, width) for t in texts(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def segments(max_bits):
    """``(first bit, bits)`` of each segment of the ring."""
    m = max_bits + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _field(col, first, bits):
    """Some bits of a long column, as a long."""
    if bits == BITS:
        return col
    return F.shiftrightunsigned(col, first).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(max_bits):
    fp, ring = F.col("fp"), segments(max_bits)
    if max_bits == 0:
        return F.array(F.struct(F.lit(0).alias("start"), fp.alias("key")))
    keys = []
    for i, (first, bits) in enumerate(ring):
        next_first, next_bits = ring[(i + 1) % len(ring)]
        for half, (a, n) in enumerate([(next_first, next_bits // 2), (next_first + next_bits // 2, next_bits - next_bits // 2)]):
            key = F.xxhash64(F.lit(2 * i + half), _field(fp, first, bits), _field(fp, a, n))
            keys.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return F.array(*keys)


def chained(x, start, ring, max_bits):
    """Whether the differing bits x keep to the budget of every chain from that segment on."""
    ok = np.ones(len(x), dtype=bool)
    m = len(ring)
    masks = np.array([((1 << bits) - 1) << first for first, bits in ring], dtype=np.uint64)
    total = np.zeros(len(x), dtype=np.int64)
    for length in range(1, m + 1):
        total += np.bitwise_count(x & masks[(start + length - 1) % m])
        ok &= total * m <= length * max_bits
    return ok


def _links(table, max_bits):
    """One row ``(a, b)`` for each member that has a smaller linked one, from rows sorted by key, cell, fp."""
    ring = segments(max_bits)
    fp = table.column("fp").to_numpy().view(np.uint64)
    start = table.column("start").to_numpy()
    group = [table.column(c).to_numpy() for c in ("key", "low", "high")]
    n = len(fp)
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([g[1:] != g[:-1] for g in group], axis=0)
    first = np.flatnonzero(new)
    stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    at, step = np.arange(n), 1
    found_a, found_b = [], []
    while True:
        at = at[at + step < stop[at]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        hit = np.flatnonzero(np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= max_bits)
        hit = hit[chained(x[hit], start[at[hit]], ring, max_bits)]
        found_a.append(at[hit])
        found_b.append(at[hit] + step)
        step += 1
    a = np.concatenate(found_a) if found_a else at
    b = np.concatenate(found_b) if found_b else at
    label = np.arange(n)
    while len(a):
        old = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if np.array_equal(old, label):
            break
    own = np.flatnonzero(label != np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[label[own]].view(np.int64))], ["a", "b"])


def whole_groups(parts, keys, least=50_000):
    """Arrow tables of sorted rows, cut only where the key columns change."""
    held = []
    rows = 0
    for batch in parts:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(rows, dtype=bool)
        for k in keys:
            col = table.column(k).to_numpy()
            same &= col == col[-1]
        cut = rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def links(nodes, max_bits=MAX_BITS, block=BLOCK):
    """``(a, b)``: links between different fingerprints that connect all that are within ``max_bits``.

    nodes: different values ``fp``.  Every linked pair is connected through the links
    given; not every pair is a row.
    """
    keys = nodes.select("fp", F.explode(_keys(max_bits)).alias("k")).select("fp", "k.start", "k.key")
    counts = stored(keys.groupBy("key").count().where("count > 1"), "simhash-keys")
    met = keys.join(counts, "key")
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, F.col("mine")).alias("low"), F.greatest(i, F.col("mine")).alias("high")),
    )
    met = met.withColumn("blocks", blocks).withColumn("mine", mine).select("fp", "start", "key", F.explode(cells).alias("c"))
    met = met.select("fp", "start", "key", "c.low", "c.high").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")

    def run(parts):
        for table in whole_groups(parts, ("key", "low", "high")):
            yield _links(table, max_bits)

    return met.mapInArrow(run, "a long, b long")


def groups(docs, width=SHINGLE, max_bits=MAX_BITS):
    """One row for each document: ``doc_id, fp, component_id`` (the smallest doc_id reachable, itself included).

    docs: doc_id, text.  A null or empty text has no words and fingerprint zero, and is
    linked like any other.  Rows that share a doc_id stay rows of their own, each with
    its text's fingerprint; a null doc_id is never the smallest unless a component has no other.
    An empty table gives an empty table.
    """
    fps = stored(fingerprints(docs, width), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    member = stored(components(links(nodes.select("fp"), max_bits)).toDF("fp", "root"), "simhash-members")
    label = member.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    label = member.join(label, "root").select("fp", "component")
    labels = stored(nodes.join(label, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "simhash-labels")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs, width=SHINGLE, max_bits=MAX_BITS):
    """The rows of docs (with all their columns) without those that are near-duplicates of a kept one.

    Of each component the row with the smallest doc_id stays (a null doc_id comes last); of rows
    that are the same in all columns, one.
    """
    key = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    found = stored(groups(docs.select(key.alias("doc_id"), "text"), width, max_bits).select(F.col("doc_id").alias("k"), "component_id"), "simhash-rows")
    ids = docs.select(key.alias("i"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key.alias("key")).alias("rank")).distinct()
    ranked = found.groupBy("k", "component_id").agg(F.count("*").alias("n")).join(ids, F.col("k") == F.col("i"))
    ranked = stored(ranked.select("k", "component_id", "n", "rank"), "simhash-ranked")
    first = stored(ranked.groupBy(F.col("component_id").alias("c")).agg(F.min("rank").alias("best")), "simhash-first")
    out = ranked.join(first.select("c", F.col("best.key").alias("stays")), F.col("component_id") == F.col("c"))
    gone = fresh(docs, "_out")
    out = stored(out.where((F.col("k") != F.col("stays")) | (F.col("n") > 1)).select(F.col("k").alias(gone), (F.col("k") == F.col("stays")).alias("again")), "simhash-out")
    total = out.count()
    rest = docs.join(broadcast_if(out.select(gone), total), key == F.col(gone), "left_anti")
    twice = out.where("again").select(gone)
    same = docs.join(broadcast_if(twice, total), key == F.col(gone), "left_semi").dropDuplicates()
    return rest.unionByName(same)


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
