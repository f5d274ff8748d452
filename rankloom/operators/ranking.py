"""Rank and top-k per group."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def ranked(df, keys, order, name="rank"):
    """Add a 1-based rank per group; ``order`` must be a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df, keys, order, k, name="rank"):
    """The first k rows of each group with their rank.

    Spark limits each group in the map tasks before the shuffle
    (WindowGroupLimit), so a hot group ships at most k rows per task.  It does so
    up to a threshold of the session, which is raised to k where it is lower.
    """
    conf, name_of = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(name_of, "1000")) < k:
        conf.set(name_of, str(k))
    return ranked(df, keys, order, name).filter(F.col(name) <= k)
