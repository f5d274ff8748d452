"""Size checks that stand before every broadcast.

A query set is small next to the corpus, but that is an assumption about the
data, so it is checked: a side is sent to every task only if its size is proven
to be under a bound; each caller has another way beyond the bound.
"""

import contextlib

from pyspark.sql import functions as F

from rankloom.session import scratch_dir

#: Rows that ``pinned`` keeps as local rows instead of a stored table.
MAX_QUERY_ROWS = 4096
#: Of a query set that goes to every task at once.
BLOCK_BYTES = 32 << 20
MAX_BROADCAST_ROWS = 500_000


def collect_bounded(df, max_rows):
    """The rows as an Arrow table, or None when there are more than max_rows.

    Reads at most ``max_rows + 1`` rows into the driver either way.
    """
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def broadcast_if(df, row_bound, max_rows=MAX_BROADCAST_ROWS):
    """Broadcast hint if the proven row bound allows it, else leave it to AQE."""
    if row_bound is not None and row_bound <= max_rows:
        return F.broadcast(df)
    return df


def spread(df):
    """The rows over all cores, where a small input has too few tasks for them.

    A scan of many tasks stays as it is, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def query_blocks(df, keys, row_bytes, block_bytes=BLOCK_BYTES):
    """``(table, alone)``: a query set as Arrow tables of about block_bytes each, one after another.

    The plan is the same for any size: each block is one pass of map tasks over the
    corpus.  A set that fits is read once and is ``alone``; a larger one is stored and cut by a
    hash of the keys, and the driver holds one block at a time, so the caller must
    store a block's result before it asks for the next.
    """
    most = max(1, block_bytes // row_bytes)
    table = collect_bounded(df, most)
    if table is not None:
        yield table, True
        return
    df = stored(df, "queries")
    n = -(-df.count() // most)
    for i in range(n):
        yield df.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == i).toArrow(), False


def stored(df, name):
    """Write to the shared scratch folder and read back.

    For a small result that costs much to make and is needed more than once:
    Spark does not share the output of Python stages between branches of a
    plan, and a table outlives lost executors.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark):
    """Inside, a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.

    For a chain of ``stored`` steps: what a step needs of those before it lies in their tables, so only the
    tables add up on disk.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def pinned(df, max_rows=MAX_QUERY_ROWS):
    """``(df, n)``: a query side that is encoded or derived only once.

    Up to the bound it is held as local rows, so the planner knows its exact
    size; beyond, it is stored and n is None.
    """
    table = collect_bounded(df, max_rows)
    if table is None:
        return stored(df, "queries"), None
    return df.sparkSession.createDataFrame(table, schema=df.schema), table.num_rows
