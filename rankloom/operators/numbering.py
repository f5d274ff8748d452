"""Positions in a total order, without one task that sees all rows.

Rows are counted where they lie, the counts of the parts are summed up in order, and each row's
position is the sum before its part plus its place in it.  Only the counts, one row for each part
and group, ever meet in one place.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators.sizing import stored

_PART, _AT = "__part", "__at"


def numbered(df, groups, order, name="pos", size=None):
    """Add each row's position in its group, from 0, and the group's ``size`` if a name is given.

    groups: names of columns, null a group of its own; may be empty.  order: columns or sort
    expressions.  Rows are range-partitioned by both, so a group that holds most rows is cut by the
    order and takes many tasks; rows that tie in everything stay together, so add a column that
    tells them apart where many may tie.  ``df`` is read twice (the range bounds are sampled): store it
    first if it costs much.  An empty table gives none.
    """
    groups = list(groups)
    keys = [*groups, *order]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return _placed(stored(spread.withColumn(_AT, F.monotonically_increasing_id()), "numbered"), groups, name, size)


def _placed(rows, groups, name, size):
    """Positions from ids that ascend inside a part and name it in their upper bits."""
    rows = rows.withColumn(_PART, F.shiftright(_AT, 33))
    starts = rows.groupBy(_PART, *groups).agg(F.min(_AT).alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col(_PART).alias("__p"),
        *[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)],
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(whole).alias("__size"),
    )
    same = F.col(_PART) == F.col("__p")
    for i, g in enumerate(groups):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    added = [(F.col(_AT) + F.col("__shift")).alias(name)] + ([F.col("__size").alias(size)] if size else [])
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (_PART, _AT)]
    return rows.join(starts, same).select(*kept, *added)


def in_file_order(lines, name="pos"):
    """Number the rows of a file scan from 0 in the order of their files (by path) and lines.

    ``lines`` reads files directly, so that ``_metadata`` is known; other columns are kept.  Nothing
    is sorted or shuffled but one row for each block of a file.
    """
    where = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    rows = stored(lines.select("*", *where, F.monotonically_increasing_id().alias(_AT)), "lines")
    blocks = rows.groupBy("__file", "__block").agg(F.min(_AT).alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "__file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    kept = [F.col(f"`{c}`") for c in lines.columns]
    return rows.join(blocks, ["__file", "__block"]).select(*kept, (F.col(_AT) + F.col("__shift")).alias(name))
