"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked again
with other values keeps its template.  Every run of ``WINDOW`` template words of every
document is hashed and joined with the runs of the benchmark.  Runs that match on one
diagonal (same distance between the places in document and item) are one occurrence;
its slots are then read again: a value of the item must stand for one value of the document
throughout, and the reverse.

All rules look at one whitespace-separated token at a time.  A capitalised word is a
name, whatever its place; a token without letters or digits is no word.  An item of which
no run has words enough that are no placeholders is looked for as it stands: by runs of its raw tokens.

DataFrame functions only.  A bit for each of the benchmark's hashes decides in the scan which places of a
text go on, so that only these become rows.  The benchmark's hashes go to every task if they are few; else
both sides are shuffled by hash.
"""

from functools import reduce

from pyspark.sql import functions as F

from rankloom.llm.common import fresh, pick
from rankloom.operators.sizing import broadcast_if, stored

WINDOW = 8
#: Of the words of an item that an occurrence must cover.
COVERAGE = 0.5
#: Of the pairs of slot values that must be one to one.
CONSISTENT = 0.8
#: Words of a window that must not be placeholders.
LITERALS = 3

NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = (
    "km kg cm mm ml mg mph kmh kwh lb lbs oz ft yd mi sec secs min mins hr hrs "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres "
    "gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches yard yards pound pounds ounce ounces ton tons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degrees"
).split()
_SPACE = r"[\x20\x09-\x0D]+"
#: Numbers of 64 bits in the table that screens places: 16 bits for each hash, up to this many numbers.
MOST_BITS = 1 << 16


def template(text):
    """The text with placeholders for names and numbers, in lower case and without punctuation; whitespace stays."""
    out = F.regexp_replace(text, f"[{NAME}-{UNIT}]", "")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{M}\p{N}])\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+", NAME)
    out = F.regexp_replace(F.lower(out), r"[$€£]?\p{Nd}++(?:[.,:/]\p{Nd}++)*+%?", NUMBER)
    return F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D" + NAME + "-" + UNIT + "]++", "")


def _typed(word):
    """A template word with a placeholder for a unit, alone or behind a number."""
    rest = F.when(F.startswith(word, F.lit(NUMBER)), F.substring(word, 2, 1 << 20))
    return F.when(word.isin(UNITS), F.lit(UNIT)).when(rest.isin(UNITS), F.lit(NUMBER + UNIT)).otherwise(word)


def words(text):
    """The template words of a text, null like empty."""
    return F.transform(F.array_remove(F.split(F.coalesce(template(text), F.lit("")), _SPACE), ""), _typed)


def _tokens(text):
    """Raw tokens that have a template word, each with it."""
    raw = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")
    both = F.transform(raw, lambda t: F.struct(t.alias("raw"), _typed(F.regexp_replace(template(t), _SPACE, "")).alias("word")))
    return F.filter(both, lambda x: x["word"] != "")


def _run_hashes(df, keys, widths):
    """``(*keys, h<width>)``: for each width the hashes of all runs of that many words of the column ``words``.

    Words are hashed once; two neighbouring runs make one of their joint length.  Each step is a column of its own
    (one element exploded), as an expression used twice would be computed twice.
    """
    df = df.select(*keys, F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("h1"))

    def joined(left, right):
        # a run of `left` words and the run of `right` words after it
        n = F.greatest(F.size(f"h{right}") - left, F.lit(0))
        pairs = F.zip_with(F.slice(f"h{left}", 1, n), F.slice(f"h{right}", left + 1, n), lambda x, y: F.xxhash64(x, y))
        return F.explode(F.array(pairs))

    have = {1}

    def with_width(df, width):
        if width in have:
            return df
        left = 1 << (width.bit_length() - 1)
        if left == width:
            left //= 2
        df = with_width(with_width(df, left), width - left)
        have.add(width)
        return df.select("*", joined(left, width - left).alias(f"h{width}"))

    for width in widths:
        df = with_width(df, width)
    return df.select(*keys, *[f"h{w}" for w in widths])


def _places(df, keys, widths, bits=None):
    """``(*keys, w, at, h)``: a row for each run of w words at place at; with bits only for those they let pass."""
    hashes = _run_hashes(df, keys, widths)

    def one(width):
        def run(h, i):
            row = F.struct(F.lit(width).alias("w"), i.alias("at"), h.alias("h"))
            return row if bits is None else F.when(bits(h), row)

        found = F.transform(f"h{width}", run)
        return found if bits is None else F.filter(found, lambda x: x.isNotNull())

    each = [one(w) for w in widths]
    return hashes.select(*keys, F.explode(F.concat(*each)).alias("r")).select(*keys, "r.w", "r.at", "r.h")


def _screen(runs, n):
    """A condition on a hash that holds for all hashes in ``runs`` and for few others."""
    log = 4
    while (1 << log) * 4 < n and 1 << log < MOST_BITS:
        log += 1
    cell, bit = F.shiftrightunsigned("item_h", 64 - log), F.pmod("item_h", F.lit(64)).cast("int")
    marked = runs.select(cell.alias("cell"), bit.alias("bit")).distinct().groupBy("cell")
    table = [0] * (1 << log)
    for row in marked.agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word")).collect():  # at most MOST_BITS rows
        table[row.cell] = row.word
    table = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>")
    return lambda h: F.getbit(F.get(table, F.shiftrightunsigned(h, 64 - log).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1


def _matches(ready, runs):
    """Runs of the column ``words`` of ready that are runs of an item, with the distance of their places."""
    widths = sorted(r[0] for r in runs.select("item_w").distinct().collect())  # at most `window` numbers
    if not widths:
        return None
    n = runs.count()
    found = _places(ready, ["doc_id", "row_key"], widths, _screen(runs, n))
    near = broadcast_if(runs, n)
    found = found.join(near, (F.col("h") == F.col("item_h")) & (F.col("w") == F.col("item_w")))
    return found.select("doc_id", "row_key", "item_id", "n", "w", "item_at", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def _item_runs(items, window):
    """``item_id, n, words, item_w, item_at, item_h``: runs of an item's words; a short item is one run."""
    keys = ["item_id", "n", "words"]
    out = None
    for width in sorted(r[0] for r in items.select(F.least("n", F.lit(window))).distinct().collect()):
        own = items.where((F.col("n") >= width) if width == window else (F.col("n") == width))
        own = _places(own, keys, [width]).select(*keys, F.col("w").alias("item_w"), F.col("at").alias("item_at"), F.col("h").alias("item_h"))
        out = own if out is None else out.union(own)
    return out


def _slots(df, keys):
    """``(*keys, place, slot)`` of the placeholders of a column ``text``."""
    at = df.select(*keys, F.posexplode(_tokens(F.col("text"))).alias("place", "x"))
    slot = F.col("x.word").rlike(f"[{NAME}{NUMBER}{UNIT}]")
    # punctuation at the ends of a token is no part of the value
    value = F.regexp_replace("x.raw", r"^[^\p{L}\p{N}$€£]+|[^\p{L}\p{N}%]+$", "")
    return at.where(slot).select(*keys, "place", value.alias("slot"))


def contaminated(docs, benchmark, window=WINDOW, coverage=COVERAGE, consistent=CONSISTENT, literals=LITERALS):
    """One row for each document and benchmark item found in it.

    docs: doc_id, text; benchmark: item_id, text.  Gives ``doc_id, item_id, row_key`` (a hash of
    doc_id and text), ``covered`` (share of the item's words), ``slots``, ``consistency``,
    ``verbatim`` (all slot values are the item's), ``place`` (the template word it starts at).

    Null texts are empty and match nothing.  An item with fewer words than the window is one
    window of its own length.  An item without a window that has enough literal words is
    found only as it stands: its windows are of raw tokens, which must be equal, and ``place`` counts raw tokens.
    Rows that repeat doc_id and text give one result; an item that
    occurs twice in a document gives its best occurrence.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    raw = F.array_remove(F.split(F.col("text"), _SPACE), "")
    items = pick(benchmark, item_id="item_id", text="text").where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.select("item_id", "text", words(F.col("text")).alias("words"), raw.alias("raw")).where(F.size("raw") > 0).distinct()
    items = stored(items.select("*", F.size("words").alias("n")), "template-items")
    empty = spark.createDataFrame([], "doc_id long, item_id long, row_key long, covered double, slots long, consistency double, verbatim boolean, place int")
    if items.isEmpty():
        return empty

    plain = F.filter(F.slice(F.col("words"), F.col("item_at") + 1, F.col("item_w")), lambda w: ~w.rlike(f"[{NAME}{NUMBER}{UNIT}]"))
    told = F.size(plain) >= F.least(F.lit(literals), F.col("item_w"))
    worded = items.where("n > 0")
    runs = _item_runs(worded, window)
    columns = ["item_id", "n", "item_w", "item_at", "item_h"]
    runs = stored(runs.where(told).select("words", *columns), "template-windows") if runs is not None else None
    bare = items
    if runs is not None:
        bare = items.join(runs.select("item_id", "words").distinct(), ["item_id", "words"], "left_anti")
    bare = stored(bare.select("item_id", F.col("raw").alias("words"), F.size("raw").alias("n")), "template-bare")

    rows = pick(docs, doc_id="doc_id", text="text").where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = []
    if runs is not None:
        found.append(_matches(rows.select("doc_id", "row_key", words(F.col("text")).alias("words")), runs.select(*columns)))
    if not bare.isEmpty():
        exact = stored(_item_runs(bare, window).select(*columns), "template-windows")
        found.append(_matches(rows.select("doc_id", "row_key", raw.alias("words")), exact))
    found = [f for f in found if f is not None]
    if not found:
        return empty
    found = stored(reduce(lambda x, y: x.union(y), found), "template-matches")

    # one occurrence: windows on one diagonal, which cover a word once
    one = ["doc_id", "row_key", "item_id", "shift"]
    spots = found.groupBy(*one).agg(F.first("n").alias("n"), F.array_sort(F.collect_set("item_at")).alias("spots"), F.max("w").alias("w"))
    more = F.aggregate(
        F.sequence(F.lit(2), F.size("spots")),
        F.col("w"),
        lambda total, i: total + F.least(F.col("w"), F.element_at("spots", i) - F.element_at("spots", i - 1)),
    )
    covered = F.when(F.size("spots") > 1, more).otherwise(F.col("w"))
    spots = spots.select(*one, (covered / F.col("n")).alias("covered"), F.element_at("spots", 1).alias("first_at"))
    spots = stored(spots.where(F.col("covered") >= coverage), "template-spots")

    # the values at the occurrence's slots, item and document side by side
    inside = found.join(spots.select(*(F.col(c).alias(f"s_{c}") for c in one)), [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in one], "left_semi")
    inside = inside.select(*one, F.explode(F.sequence(F.col("item_at"), F.col("item_at") + F.col("w") - 1)).alias("item_place")).distinct()
    item_slots = _slots(items.join(bare.select("item_id"), "item_id", "left_anti"), ["item_id"]).select(F.col("item_id").alias("i"), F.col("place").alias("at"), F.col("slot").alias("item_slot"))
    asked = inside.join(item_slots, (F.col("item_id") == F.col("i")) & (F.col("item_place") == F.col("at")))
    asked = asked.select(*one, (F.col("item_place") + F.col("shift")).alias("place"), "item_slot")
    suspects = rows.join(spots.select(F.col("row_key").alias("r")).distinct(), F.col("row_key") == F.col("r"), "left_semi").dropDuplicates(["row_key"])
    doc_slots = _slots(suspects, ["row_key"]).select(F.col("row_key").alias("r"), F.col("place").alias("p"), "slot")
    pairs = asked.join(doc_slots, (F.col("row_key") == F.col("r")) & (F.col("place") == F.col("p")), "left").select(*one, "item_slot", "slot")
    checked = pairs.groupBy(*one).agg(
        F.count("*").alias("slots"),
        F.count_distinct("item_slot", "slot").alias("pairs"),
        F.count_distinct("item_slot").alias("of_item"),
        F.count_distinct("slot").alias("of_doc"),
        F.min(F.coalesce(F.col("item_slot") == F.col("slot"), F.lit(False))).alias("verbatim"),
    )
    right = [c for c in checked.columns if c not in one]
    joined = spots.alias("s").join(checked.alias("c"), [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in one], "left")
    joined = joined.select(*(F.col(f"s.{c}").alias(c) for c in spots.columns), *(F.col(f"c.{c}").alias(c) for c in right))
    # pairs beyond one for each value, on either side, contradict
    share = F.greatest(F.lit(0.0), 1 - (2 * F.col("pairs") - F.col("of_item") - F.col("of_doc")) / F.greatest("pairs", F.lit(1)))
    out = joined.select(
        "doc_id",
        "item_id",
        "row_key",
        "covered",
        F.coalesce("slots", F.lit(0).cast("long")).alias("slots"),
        F.when(F.col("slots") > 0, share).otherwise(1.0).alias("consistency"),
        F.coalesce("verbatim", F.lit(True)).alias("verbatim"),
        (F.col("shift") + F.col("first_at")).cast("int").alias("place"),
    ).where(F.col("consistency") >= consistent)
    best = F.max_by(F.struct("covered", "slots", "consistency", "verbatim", "place"), F.struct("covered", "consistency", "verbatim", -F.col("place")))
    return out.groupBy("doc_id", "item_id", "row_key").agg(best.alias("x")).select("doc_id", "item_id", "row_key", "x.*")


def clean(docs, benchmark, **rules):
    """The rows of docs (with all their columns) in which no item is found."""
    leak = fresh(docs, "_leak_key")
    found = contaminated(docs, benchmark, **rules).select(F.col("row_key").alias(leak)).distinct()
    found = stored(found, "template-found")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    return docs.join(broadcast_if(found, found.count()), key == F.col(leak), "left_anti")
