"""Document fingerprints by MinHash.

A text is the set of its five-word shingles, each a 32-bit hash.  ``PERMUTATIONS`` random
multiply-add functions stand for permutations of the hashes; the fingerprint holds 16 bits
of the smallest value under each.  The share of places in which two
fingerprints agree estimates the Jaccard similarity of the shingle sets.

Near-duplicates are found in three steps, none of which makes a row for a pair.  Fingerprints are cut
into bands; all that share a band are compared place by place, and those that agree in about as many places
as near-duplicates do make clusters.  In a cluster all texts are held against each other by their true Jaccard similarity.
A large band or cluster is cut into blocks that meet two by two, each pair of blocks in one task of bounded
size, which gives the number of links of each member and one link that keeps it connected.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankloom.llm.common import batches, hashed_words, mix, pick, shingles, texts
from rankloom.llm.components import components
from rankloom.llm.simhash import whole_groups
from rankloom.operators.sizing import broadcast_if, stored

SHINGLE = 5
PERMUTATIONS = 64
BANDS = 16
LEAST = 0.8
#: Nodes, and shingles of nodes, that one block of a band or a cluster holds.
BLOCK = 1024
BLOCK_SHINGLES = 4_000_000
#: Nodes or labels that are sent to every task; more are joined by a shuffle.
MAX_SENT = 1_000_000
_LAST = np.iinfo(np.int64).min


def _family(permutations):
    rng = np.random.default_rng(4242)
    a = rng.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, permutations, dtype=np.uint64)


def shingle_sets(rows, width=SHINGLE):
    """``(hashes, doc)`` of the shingles of a few texts, in order, repeats included."""
    words, doc, *_ = hashed_words(rows)
    hashes, doc = shingles(words, doc, width)
    return hashes >> np.uint64(32), doc


def signatures(rows, permutations=PERMUTATIONS, width=SHINGLE):
    """A uint16 row for each text (UTF-8 bytes); a text without words has 65535 in all places."""
    return _signed(rows, permutations, width)[0]


def _signed(rows, permutations=PERMUTATIONS, width=SHINGLE):
    """``signatures`` with a key of each text's shingles (0 without any) and their number, repeats included."""
    out = np.full((len(rows), permutations), 0xFFFF, dtype=np.uint16)
    key, size = np.zeros(len(rows), dtype=np.uint64), np.zeros(len(rows), dtype=np.int32)
    a, b = _family(permutations)
    for first, last in batches(rows, 400_000):
        words, doc, *_ = hashed_words(rows[first:last])
        every, doc = shingles(words, doc, width)
        if not len(every):
            continue
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        own = first + doc[start]
        key[own] = np.add.reduceat(mix(every), start)
        size[own] = np.diff(np.append(start, len(doc)))
        hashes = every >> np.uint64(32)
        value = np.empty_like(hashes)
        for i in range(permutations):
            np.multiply(hashes, a[i], out=value)
            value += b[i]
            out[own, i] = np.minimum.reduceat(value, start) >> np.uint64(16) & np.uint64(0xFFFF)
    return out, key.view(np.int64), size


def likeness(a, b):
    """The share of equal places, row by row."""
    return (a == b).mean(axis=1)


def _bytes(sig):
    return pa.array([row.astype(">u2").tobytes() for row in sig], pa.binary())


def _hex(col):
    return F.lower(F.hex(col))


def fingerprints(docs, permutations=PERMUTATIONS):
    """``(doc_id, tie, sig, node, size)`` for each row of docs (doc_id, text).

    sig: two bytes for each permutation; tie: a hash of the text; node, size: a key and the number of its shingles.
    """

    def run(parts):
        for batch in parts:
            sig, node, size = _signed(texts(batch.column("text")), permutations)
            columns = [batch.column("doc_id"), batch.column("tie"), _bytes(sig), pa.array(node), pa.array(size)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "sig", "node", "size"])

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(run, "doc_id long, tie long, sig binary, node long, size int")


def _bucket_of(col, bounds, first=0):
    """The number of bounds that are at most col, by bisection."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(col < bounds[mid], _bucket_of(col, bounds[:mid], first)).otherwise(_bucket_of(col, bounds[mid + 1 :], first + mid + 1))


def in_order(rows, key, parts):
    """rows dealt by ranges of key, one range to a partition, sorted; each range ends with its next row.

    Columns ``tail`` (0, or 1 for the first row of the next range, after the last range that
    of the first) and ``tie`` are added.  Only ids are read to find the ranges; each row of text
    is shuffled once, and the first of each range twice.
    """
    ids = rows.select(F.coalesce(F.col(key), F.lit(int(_LAST))).alias("k"))
    fractions = [i / parts for i in range(1, parts)]
    bounds = ids.agg(F.percentile_approx("k", fractions, 100 * parts).alias("b")).first()["b"] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    bucket = _bucket_of(F.col("k"), bounds)
    heads = {r["b"]: r["k"] for r in ids.groupBy(bucket.alias("b")).agg(F.min("k").alias("k")).collect()}  # one row for each range
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    n = len(bounds) + 1
    head = F.array(*(F.lit(heads.get(b)).cast("long") for b in range(n)))
    back = F.array(*(F.lit(before.get(b, 0)) for b in range(n)))
    dealt = rows.withColumn("k", F.coalesce(F.col(key), F.lit(int(_LAST)))).withColumn("b", bucket)
    own = F.struct(F.col("b").alias("part"), F.lit(0).alias("tail"))
    copy = F.struct(F.element_at(back, F.col("b") + 1).alias("part"), F.lit(1).alias("tail"))
    is_head = F.col("k") == F.element_at(head, F.col("b") + 1)
    dealt = dealt.withColumn("to", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, "k", F.xxhash64("text").alias("tie"), "to.part", "to.tail")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("tail", "k", "tie").drop("k", "part")


def edit(text, following):
    """text with its last half (rounded down) replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs, permutations=PERMUTATIONS):
    """Each document's fingerprint against that of its edited text and of the next document.

    docs: doc_id, text.  The order is by doc_id, null first, rows of one doc_id by a hash of
    the text; the row after the last is the first.  A null or empty text has no shingles: its
    fingerprint is all ones, alike to that of any other such text.  A lone document is its own next.
    """

    return _named(_edited(docs, permutations)).select(*COMPARED)


COMPARED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_EDITED = (
    "doc_id long, tie long, sig binary, node long, size int, n_chars long, edited_digest binary, edited_sig binary, "
    "near_edited double, near_next double"
)


def _named(rows):
    """The rows of ``_edited`` with their digests as text."""
    named = {"edited_sha256": "edited_digest", "fingerprint": "sig", "edited_fingerprint": "edited_sig"}
    return rows.withColumns({name: _hex(col) for name, col in named.items()})


def _edited(docs, permutations):
    """``compare_edited`` with digests as bytes, and the columns of ``fingerprints``."""

    def run(parts):
        held, done = None, False
        for batch in parts:
            if done:
                continue  # more copies of the next row
            ids, ties, tails = (batch.column(c).to_pylist() for c in ("doc_id", "tie", "tail"))
            rows = [t or "" for t in batch.column("text").to_pylist()]
            if held:
                ids, ties, rows, tails = [held[0], *ids], [held[1], *ties], [held[2], *rows], [0, *tails]
            own = tails.index(1) if 1 in tails else len(tails)
            if own == len(tails):  # the next of the last one is in a later batch
                held, pairs = (ids[-1], ties[-1], rows[-1]), own - 1
            else:
                held, pairs = None, own
            if pairs:
                yield _compared(ids[:pairs], ties[:pairs], rows[: pairs + 1], permutations)
            done = held is None

    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_order(rows, "doc_id", parts).select("doc_id", "text", "tie", "tail").mapInArrow(run, _EDITED)


def _compared(ids, ties, rows, permutations):
    n = len(ids)
    edited = [edit(rows[i], rows[i + 1]).encode() for i in range(n)]
    sig, node, size = _signed([t.encode() for t in rows], permutations)
    changed = signatures(edited, permutations)
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "tie": pa.array(ties, pa.int64()),
        "sig": _bytes(sig[:n]),
        "node": pa.array(node[:n]),
        "size": pa.array(size[:n]),
        "n_chars": pa.array([len(t) for t in rows[:n]], pa.int64()),
        "edited_digest": pa.array([hashlib.sha256(t).digest() for t in edited], pa.binary()),
        "edited_sig": _bytes(changed),
        "near_edited": pa.array(likeness(sig[:n], changed)),
        "near_next": pa.array(likeness(sig[:n], sig[1:])),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def near_duplicates(docs, least=LEAST, permutations=PERMUTATIONS, bands=BANDS):
    """One row for each document: ``doc_id, class_id, links``.

    docs: doc_id, text.  Texts are near-duplicates from a Jaccard similarity of ``least`` of their
    shingle sets.  class_id: the smallest doc_id reachable; links: how many texts with other shingles the document's
    text is linked to.  Texts without words are one class.  An empty table gives an empty table.
    """
    rows = stored(fingerprints(docs, permutations), "minhash")
    return _labelled(rows, docs, least, permutations, bands).select("doc_id", "class_id", "links")


def fingerprinted(docs, least=LEAST, permutations=PERMUTATIONS, bands=BANDS):
    """``compare_edited`` with each document's near-duplicate class: ``class_id, links`` as in ``near_duplicates``."""
    rows = stored(_edited(docs, permutations), "minhash-compared")
    return _named(_labelled(rows, docs, least, permutations, bands)).select(*COMPARED, "class_id", "links")


def _labelled(rows, docs, least, permutations, bands):
    labels = classes(rows.select("doc_id", "tie", "sig", "node", "size"), docs, least, permutations, bands)
    found = rows.join(broadcast_if(labels, labels.count(), MAX_SENT), "node", "left")
    return found.withColumns({"class_id": F.coalesce("class_id", "doc_id"), "links": F.coalesce("links", F.lit(0).cast("long"))})


def _cells(rows, group):
    """rows (node, blocks and others) in each pair of blocks ``low, high`` that they are in, ``mine`` the own block."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(group, "node"), F.col("blocks")).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, F.col("mine")).alias("low"), F.greatest(i, F.col("mine")).alias("high")),
    )
    return rows.withColumn("cell", F.explode(cells)).select(*[c for c in rows.columns if c != "blocks"], "cell.low", "cell.high")


def _roots(n, a, b):
    """For each of n places the smallest that links a - b lead to."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if np.array_equal(old, label):
            break
    return label


def _alike(parts, places):
    """Links ``(node, other)`` that connect all of a cell that agree in so many places, from rows sorted by key, low, high."""
    for table in whole_groups(parts, ("key", "low", "high")):
        n = table.num_rows
        node = table.column("node").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(n, -1)
        new = np.ones(n, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in (table.column(k).to_numpy() for k in ("key", "low", "high"))], axis=0)
        first = np.flatnonzero(new)
        stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        at, step, pairs = np.arange(n), 1, []
        while True:
            at = at[at + step < stop[at]]
            if not len(at):
                break
            pairs.append(at[np.count_nonzero(sig[at] == sig[at + step], axis=1) >= places])
            pairs[-1] = np.stack([pairs[-1], pairs[-1] + step])
            step += 1
        label = _roots(n, *(np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)))
        own = np.flatnonzero(label != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["node", "other"])


def _sets(parts):
    """``text`` as the set of its shingles, 32 bits of each."""
    for batch in parts:
        found = texts(batch.column("text"))
        for a, b in batches(found):
            hashes, doc = shingle_sets(found[a:b])
            both = np.unique(doc.astype(np.uint64) << np.uint64(32) | hashes)
            first = np.searchsorted(both >> np.uint64(32), np.arange(b - a + 1).astype(np.uint64))
            flat = pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            others = [batch.column(c).slice(a, b - a) for c in ("component", "node", "blocks")]
            yield pa.RecordBatch.from_arrays([*others, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), flat)], ["component", "node", "blocks", "set"])


def common(flat, size):
    """How many members each two sets have in common; flat: the sets after one another, size: of each."""
    n = len(size)
    out = np.zeros((n, n), dtype=np.float32)
    value, count = np.unique(flat, return_counts=True)
    shared = value[count > 1]
    keep = np.isin(flat, shared)
    owner, at = np.repeat(np.arange(n), size)[keep], np.searchsorted(shared, flat[keep])
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    step = max(1, 8_000_000 // max(n, 1))
    for first in range(0, len(shared), step):
        a, b = np.searchsorted(at, [first, first + step])
        has = np.zeros((n, min(step, len(shared) - first)), dtype=np.float32)
        has[owner[a:b], at[a:b] - first] = 1
        out += has @ has.T
    return out


def _checked(parts, least):
    """``(node, other, n)`` of the members of each cell that have links there: how many, and one that connects it or itself."""
    for table in whole_groups(parts, ("component", "low", "high"), 1000):
        node, mine = table.column("node").to_numpy(), table.column("mine").to_numpy()
        keys = [table.column(k).to_numpy() for k in ("component", "low", "high")]
        sets = table.column("set").combine_chunks()
        new = np.ones(len(node), dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
        edges = np.append(np.flatnonzero(new), len(node))
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            some = first + np.unique(node[first:last], return_index=True)[1]  # a row that repeats id and text counts once
            lists = [sets[int(i)].values.to_numpy() for i in some]
            size = np.array([len(x) for x in lists])
            both = common(np.concatenate(lists), size)
            linked = both >= least * (size[:, None] + size[None, :] - both.astype(np.float64))
            if keys[1][first] != keys[2][first]:
                linked &= mine[some][:, None] != mine[some][None, :]
            np.fill_diagonal(linked, False)
            n = np.count_nonzero(linked, axis=1)
            a, b = np.nonzero(np.triu(linked))
            own, ids = np.flatnonzero(n), node[some]
            other = ids[_roots(len(some), a, b)[own]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(other), pa.array(n[own].astype(np.int64))], ["node", "other", "n"])


def classes(sigs, docs, least=LEAST, permutations=PERMUTATIONS, bands=BANDS):
    """``(node, class_id, links)`` for each node of sigs (as of ``fingerprints``) with copies or links.

    Texts with the same shingles are one node from the start, so copies never meet.  Two nodes that share a band are
    of one cluster unless they agree in fewer places than two texts of similarity ``least`` do by six
    standard deviations; a cluster's nodes are all checked against each other, on the whole texts of docs (doc_id, text).
    """
    nodes = sigs.groupBy("node").agg(
        F.min("sig").alias("sig"),
        F.max("size").alias("size"),
        F.min("doc_id").alias("first"),
        F.min(F.struct("tie", "doc_id")).alias("row"),
        F.count("*").alias("copies"),
    )
    nodes = stored(nodes, "minhash-nodes")
    rows = permutations // bands * 2
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * rows + 1, F.lit(rows)))))
    keyed = nodes.select("node", band.alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "minhash-bands")
    met = keyed.join(broadcast_if(shared, shared.count(), MAX_SENT), "key")
    met = _cells(met.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "key").select("key", "low", "high", "node")
    met = met.join(nodes.select("node", "sig"), "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    places = int(permutations * least - 6 * (permutations * least * (1 - least)) ** 0.5)
    near = stored(met.mapInArrow(lambda parts: _alike(parts, places), "node long, other long"), "minhash-alike")

    member = stored(components(near, "node", "other").join(nodes.select("node", "size", "row"), "node"), "minhash-clusters")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    member = stored(member.join(member.groupBy("component").agg(blocks.alias("blocks")), "component"), "minhash-wanted")
    wanted = member.select("node", "component", "blocks", F.col("row.tie").alias("tie"), F.col("row.doc_id").alias("id"))
    text = pick(docs, doc="doc_id", text="text").withColumn("t", F.xxhash64("text"))
    same = (F.col("t") == F.col("tie")) & F.col("doc").cast("long").eqNullSafe(F.col("id"))
    text = text.join(broadcast_if(wanted, member.count(), MAX_SENT), same).select("component", "node", "blocks", "text")
    sets = _cells(text.mapInArrow(_sets, "component long, node long, blocks int, set array<int>"), "component")
    sets = sets.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "node")
    linked = stored(sets.mapInArrow(lambda parts: _checked(parts, least), "node long, other long, n long"), "minhash-links")

    ends = linked.groupBy("node").agg(F.sum("n").alias("links"))
    found = components(linked, "node", "other").join(ends, "node").join(nodes.select("node", "first"), "node")
    found = stored(found, "minhash-classes")
    least_id = found.groupBy("component").agg(F.min("first").alias("class_id"))
    found = found.join(least_id, "component").select("node", "class_id", "links")
    labels = nodes.select("node", "first", "copies").join(found, "node", "left").where("copies > 1 OR links IS NOT NULL")
    return stored(labels.select("node", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), "minhash-labels")
