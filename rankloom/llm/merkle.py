"""Merkle manifest of a table: a digest of each row, a tree over each group, and a proof for each row.

The tree is appended to, leaf by leaf in order.  What is complete so far is a row of open subtrees,
each with its members' partial witnesses (the siblings met so far); when a later leaf
completes a sibling, both subtrees close into one and every member's witness grows by the other's
root.  Blocks of ``BLOCK`` consecutive leaves are aligned subtrees, so they are built apart, and
their roots are appended to the tree above in the same way, until one block holds a whole group.
No task holds more than a block and the work above it shrinks by ``BLOCK`` each time.
"""

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.operators.numbering import numbered
from rankloom.operators.sizing import stored

_LEVELS = 12
#: Leaves that one task closes at once.
BLOCK = 1 << _LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value):
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(columns):
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


class Appender:
    """A tree that grows by one leaf at a time; ``witness[i]`` lists the siblings leaf i has met."""

    def __init__(self):
        self.witness = []
        self._open = []  # (level, root, first leaf, one past its last), levels falling

    def append(self, leaf):
        at = len(self.witness)
        self.witness.append([])
        self._open.append((0, leaf, at, at + 1))
        while len(self._open) > 1 and self._open[-1][0] == self._open[-2][0]:
            self._close()

    def _close(self):
        level, right, middle, last = self._open.pop()
        _, left, first, _ = self._open.pop()
        for own in self.witness[first:middle]:
            own.append(right)
        for own in self.witness[middle:last]:
            own.append(left)
        self._open.append((level + 1, _h(left + right), first, last))

    def finish(self, levels=None):
        """The root; with ``levels`` the root at that height.  A last subtree without a sibling rises alone."""
        while len(self._open) > 1 or (levels is not None and self._open[0][0] < levels):
            level, root, first, last = self._open[-1]
            if len(self._open) > 1 and self._open[-2][0] == level:
                self._close()
            else:
                self._open[-1] = (level + 1, _h(root), first, last)
        return self._open[0][1]


def fold(digest, siblings, pos, size):
    """``(root, siblings used)`` from a node at a position among ``size`` and its siblings upwards."""
    used = 0
    while size > 1:
        if pos & 1:
            digest = _h(siblings[used] + digest)
            used += 1
        elif pos + 1 < size:
            digest = _h(digest + siblings[used])
            used += 1
        else:
            digest = _h(digest)
        pos, size = pos >> 1, (size + 1) >> 1
    return digest, used


def _built(levels, schema, batches):
    """Rows in order of (grp, block, pos) with their witness in the block; a block's first row has its root."""
    block, held = None, []

    def closed():
        tree = Appender()
        for row in held:
            tree.append(row["digest"])
        root = tree.finish(levels if held[0]["size"] > 1 << levels else None)
        for row, own in zip(held, tree.witness, strict=True):
            row["witness"] = bytes.fromhex("".join(own))
            row["block_root"] = None
        held[0]["block_root"] = root
        return pa.RecordBatch.from_pylist(held, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            here = (row["grp"], row["pos"] >> levels)
            if held and here != block:
                yield closed()
                held = []
            block = here
            held.append(row)
    if held:
        yield closed()


def witnesses(nodes, levels=_LEVELS, top=None):
    """Add ``witness`` (binary, 32 bytes for each sibling, lowest first) and ``root`` to nodes.

    nodes: ``grp`` string, ``pos`` and ``size`` longs (position in the group from 0, nodes in it),
    ``digest`` lowercase hex; other columns are kept.  A lone node is its own root.

    top: turns ``grp, root`` into ``grp`` and the columns to add instead of root.  These are handed down from
    block to block, so that no group, however large, meets in one task.
    """
    block = F.shiftright("pos", levels)
    schema = T.StructType([*nodes.schema.fields, T.StructField("witness", T.BinaryType()), T.StructField("block_root", T.StringType())])
    rows = nodes.repartition("grp", block).sortWithinPartitions("grp", "pos")
    rows = stored(rows.mapInArrow(partial(_built, levels, to_arrow_schema(schema)), schema), "merkle-blocks")
    roots = rows.filter("block_root is not null")
    rows = rows.drop("block_root")
    if roots.filter(F.col("size") > (1 << levels)).isEmpty():
        # each group is one block here
        roots = roots.select("grp", F.col("block_root").alias("root"))
        roots = (top(roots) if top else roots).withColumnRenamed("grp", "__grp")
        return rows.join(roots, F.col("grp").eqNullSafe(F.col("__grp"))).drop("__grp")
    width = F.shiftright(F.col("size") + ((1 << levels) - 1), levels)
    above = roots.select("grp", block.alias("pos"), width.alias("size"), F.col("block_root").alias("digest"))
    above = witnesses(above, levels, top).drop("size", "digest")
    above = above.withColumnsRenamed({"grp": "__grp", "pos": "__block", "witness": "__more"})
    joined = rows.join(above, F.col("grp").eqNullSafe(F.col("__grp")) & (block == F.col("__block")))
    return joined.withColumn("witness", F.concat("witness", "__more")).drop("__grp", "__block", "__more")


def _languages(levels, roots):
    """The tree over the groups' roots: ``grp, subroot, top_pos, top_size, more, root``."""
    tops = stored(roots.select(F.col("grp").alias("lang"), F.col("root").alias("digest")), "merkle-tops")
    tops = witnesses(numbered(tops, [], ["lang"], size="size").withColumn("grp", F.lit("")), levels)
    return tops.select(
        F.col("lang").alias("grp"),
        F.col("digest").alias("subroot"),
        F.col("pos").alias("top_pos"),
        F.col("size").alias("top_size"),
        F.col("witness").alias("more"),
        "root",
    )


def manifest(docs, levels=_LEVELS, tampered=None):
    """``doc_id, lang, leaf, witness, subroot, root, proof_sha256, folded_root, verified``, one row per row of docs.

    A leaf hashes the row's five fields; leaves are ordered by doc_id within their language (null is a
    language too), the languages' roots by language.  ``tampered``: a condition on docs; such a row
    is folded from a leaf whose n_chars is one more.  Null doc_ids come first; rows that are alike
    in everything are leaves of their own, in any order.  Texts are hashed whole, null fields as
    ``-``.  An empty table gives no rows, and a table with one row the root that is its leaf.
    """
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    longer = (columns["n_chars"].cast("decimal(20,0)") + 1).cast("string")
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & columns["n_chars"].isNotNull()
    leaf = _leaf(columns.values())
    leaves = docs.select(
        columns["doc_id"].alias("doc_id"),
        columns["lang"].alias("grp"),
        leaf.alias("digest"),
        F.when(changed, _leaf([longer if c == "n_chars" else columns[c] for c in FIELDS])).alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = numbered(stored(leaves, "merkle-leaves"), ["grp"], ["doc_id", "digest", "row"], size="size").drop("row")
    rows = witnesses(leaves, levels, partial(_languages, levels))
    rows = rows.withColumn("witness", F.concat("witness", "more")).drop("more").withColumnRenamed("grp", "lang")
    schema = T.StructType([*rows.schema.fields, T.StructField("folded_root", T.StringType())])
    rows = rows.mapInArrow(partial(_folded, to_arrow_schema(schema)), schema)
    return rows.select(
        "doc_id",
        "lang",
        F.col("digest").alias("leaf"),
        "witness",
        "subroot",
        "root",
        F.sha2(F.lower(F.hex("witness")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _folded(schema, batches):
    """Recompute the root from each row's leaf, or the one it starts from instead, and its siblings."""
    for batch in batches:
        out = []
        for row in batch.select(["digest", "start", "witness", "pos", "size", "top_pos", "top_size"]).to_pylist():
            siblings = row["witness"].hex()
            siblings = [siblings[i : i + 64] for i in range(0, len(siblings), 64)]
            digest, used = fold(row["start"] or row["digest"], siblings, row["pos"], row["size"])
            out.append(fold(digest, siblings[used:], row["top_pos"], row["top_size"])[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema=schema)
