"""Mixing sources to target weights by hash-threshold histograms.

Each source has a share of the words of the mix.  A document's hash decides: a
source takes all documents whose hash is under its threshold, so no sort and no
random state is needed, and a smaller budget takes a part of what a larger one takes.
The threshold comes from a histogram: words by source and by the leading bits
of the hash.  A running sum finds the bin in which the budget ends; only that bin
is cut by the next bits, until the hash is used up.  A source whose target is over
its size is taken whole once or twice, and the rest by threshold.

DataFrame functions only.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.llm.common import WORD, fresh, pick
from rankloom.operators.sizing import broadcast_if, stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
HASH_BITS = 60
#: Bits of the hash for one level of the histogram: 4,096 bins for each source.
LEVEL_BITS = 12


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key):
    """60 bits of the md5 digest of the key as text; null is a key of its own."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes, weights=WEIGHTS, repeats=MOST_REPEATS):
    """``(source, source_size, target)`` from one row ``(source, source_size)`` for each source.

    Sources in order of their code points, null last, get the weights in turn; the targets
    add up to all words, and stop at ``repeats`` times the source's size, what is over
    being shared again by weight until none is above.  That fixed point is a water
    level: with sources in order of cap over weight, one is capped if the level that fills it
    doesn't use up the words.  The table has a row for each source, not for documents;
    its windows need all sources in order and keep running sums only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    named = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(repeats)).alias("cap"))
    level = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = named.withColumn("r", F.col("cap") / F.col("w")).select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.sum("w").over(after).alias("open"),
        F.sum("source_size").over(everything).cast("double").alias("total"),
    )
    full = F.col("capped") + F.col("r") * F.col("open") <= F.col("total")
    lam = F.max(F.when(~full, (F.col("total") - F.col("capped")) / F.col("open"))).over(everything)
    target = F.when(full, F.col("cap")).otherwise(F.least(F.col("cap"), lam * F.col("w")))
    return steps.select("source", "source_size", target.alias("target"))


def thresholds(rows, budgets, sources=None, level_bits=LEVEL_BITS):
    """``(source, cut)``: the documents of a source with a hash under ``cut`` have about its budget of words.

    rows: ``(source, size, h)`` for each document, read once for each level; budgets:
    ``(source, budget)``, budget under the source's size; sources: how many there are, if that
    is known, so that a short list can go to every task.  The document at the boundary
    is in if more than half of its words fit.  At every level a source has one row for each
    bin, whatever its number of documents; from the second level on, only the documents of
    the boundary bin are read.
    """
    open_ = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for used in range(level_bits, HASH_BITS + 1, level_bits):
        rest = HASH_BITS - used
        inside = rows.withColumn("bin", F.shiftright("h", rest)).withColumn("prefix", F.shiftright("bin", level_bits))
        near = broadcast_if(open_.withColumnRenamed("source", "s").withColumnRenamed("prefix", "p"), sources)
        inside = inside.join(near, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix")))
        bins = inside.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        running = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("until", F.sum("words").over(running))
        # the first bin that the budget doesn't cover
        short = bins.where(F.col("until") > F.col("left")).groupBy("source").agg(
            F.min_by(F.struct("bin", "words", (F.col("left") - F.col("until") + F.col("words")).alias("left")), "bin").alias("b")
        )
        short = short.select("source", F.col("b.bin").alias("prefix"), F.col("b.left").alias("left"), F.col("b.words").alias("words"))
        open_ = stored(short, "mix-level")
        if used < HASH_BITS:
            open_ = open_.drop("words")
    cut = F.when(F.col("left") * 2 >= F.col("words"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return open_.select("source", cut.alias("cut"))


def _sizes(docs):
    """``(source, size, h, doc_id)`` of each document, stored: the text is read once."""
    rows = pick(docs, doc_id="doc_id", text="text", source="source")
    return stored(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h")), "mix-sizes")


def _plan(rows, weights, repeats):
    """``(s, source_size, target, whole, cut)`` for each source, and the number of sources."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, repeats).select(
        "*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole")
    )
    plan = stored(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    sources = plan.count()
    cuts = thresholds(rows, plan.where("budget > 0").select("source", "budget"), sources)
    near = plan.join(cuts.withColumnRenamed("source", "cs"), F.col("cs").eqNullSafe(F.col("source")), "left")
    near = near.select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"))
    return stored(near, "mix-cuts"), sources


def mix(docs, weights=WEIGHTS, repeats=MOST_REPEATS):
    """One row for each document: ``doc_id, source, size, source_size, target, taken``.

    docs: doc_id, text, source.  size: the words of the text, 0 for null.  taken: the words
    the mix takes of this document, repeats counted; 0 if it is left out.  Documents without words
    take nothing.  A null source is a source; rows that repeat a doc_id within a
    source share its hash and so its fate; an empty table gives an empty table.
    """
    rows = _sizes(docs)
    near, sources = _plan(rows, weights, repeats)
    out = rows.join(broadcast_if(near, sources), F.col("s").eqNullSafe(F.col("source")))
    taken = F.col("size") * (F.col("whole") + (F.col("h") < F.col("cut")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs, weights=WEIGHTS, repeats=MOST_REPEATS):
    """The rows of docs (with all their columns) as often as the mix takes them, at most ``repeats`` times.

    Every document is decided on by its own hash and its source's threshold, so the texts
    are not shuffled.  Rules as for ``mix``.
    """
    near, sources = _plan(_sizes(docs), weights, repeats)
    mix_of = fresh(docs, "_mix")
    near = near.select(F.struct("s", "whole", "cut").alias(mix_of))
    out = docs.join(broadcast_if(near, sources), F.col(f"{mix_of}.s").eqNullSafe(F.col("source")))
    copies = F.col(f"{mix_of}.whole") + (hash60(F.col("doc_id")) < F.col(f"{mix_of}.cut")).cast("long")
    again = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<long>"))
    return out.withColumn(mix_of, F.explode(again)).select(*(f"`{c}`" for c in docs.columns))
