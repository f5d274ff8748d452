"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it
starts at one hash of its name and steps by another.  Shards take turns, and each
claims the next free slot of its order, until the table is full.  Slots are so
dealt evenly (counts differ by one at most, with equal weights) and few of them
change hands when a shard comes or goes.  A row's slot is the hash of its key
modulo the table size, and its shard is one look-up in the table.

The table has a fixed, stated size, so it goes to every task; the data are not
shuffled at all.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = 64


def _number(name, salt):
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def _prime(n):
    return n >= 2 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(names, size=TABLE_SIZE):
    """The shard number of each slot, as an int array of a prime ``size``.

    names: distinct shard names, at most ``size``; the result depends on the set
    and on each name's place in the list.  Ties for a slot go to the earlier turn.
    """
    names = [str(n) for n in names]
    if not _prime(size):
        raise ValueError(f"the table size {size} is not prime")
    if not names or len(names) > size or len(set(names)) < len(names):
        raise ValueError("shard names must be distinct, one at least, and no more than the table has slots")
    offset = [_number(n, "offset") % size for n in names]
    step = [_number(n, "step") % (size - 1) + 1 if size > 2 else 1 for n in names]
    turn = sorted(range(len(names)), key=lambda i: (_number(names[i], "turn"), names[i]))
    table = np.full(size, -1, dtype=np.int32)
    free = size
    while free:
        for shard in turn:
            while table[offset[shard]] >= 0:
                offset[shard] = (offset[shard] + step[shard]) % size
            table[offset[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(key, size=TABLE_SIZE):
    """The slot of a key: a 60-bit digest of it as text, modulo the table size. Null is a key of its own."""
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df, key, names=SHARDS, size=TABLE_SIZE, slot="slot", shard="shard"):
    """The rows of df with their slot and shard number added.

    names: the shards' names, or how many there are.  All rows of a key get one shard;
    repeated rows stay repeated; a null key is placed like any other; an empty table
    gives an empty table.  Columns of df that are called like the new ones are replaced.
    """
    names = [f"shard-{i}" for i in range(names)] if isinstance(names, int) else list(names)
    table = F.from_json(F.lit("[" + ",".join(map(str, fill(names, size).tolist())) + "]"), "array<int>")
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    out = df.withColumn(slot, slot_of(key, size))
    return out.withColumn(shard, F.element_at(table, F.col(f"`{slot}`") + 1))
