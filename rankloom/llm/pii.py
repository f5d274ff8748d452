"""Personal data by bootstrapped contextual extraction.

Seeds are the spans that four fixed patterns find and check: e-mail and IP addresses, card
and phone numbers.  Around them Spark induces lexical patterns: the two words before a seed, and the
word before or after it together with its shape (``+9 (999) 999-9999``).  Patterns
and the identifier-like tokens that fill them make a graph, which Spark scores in
rounds: a pattern is as trustworthy as what is known so far of its fillers makes it; a token is as
likely an identifier as the patterns it fills make it, and a believed one supports further
patterns.  Tokens that end up over ``LEAST`` are identifiers the fixed patterns don't know, such as card numbers
with a wrong digit, and all their occurrences become spans.

DataFrame functions only.  Long texts are never cut; spans are counted in code points, ends exclusive.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.llm.common import pick
from rankloom.operators.sizing import broadcast_if, stored

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns, without trying again inside a run that has failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a match of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Different seed values a pattern needs.
SEEDS = 3
#: Counts against a pattern that has been seen rarely.
DOUBT = 2.0
ROUNDS = 3
LEAST = 0.8
#: Patterns or shapes that are sent to every task; more are joined by a shuffle.
MAX_CONTEXTS = 1_000_000
_MARK = "\ue000"
_GLUE = "\ue004"


def valid(kind, match):
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(rows):
    """``(row_key, kind, start, end)`` of the base spans of rows (row_key, text), kind by its number in KINDS.

    One pass marks the matches of a kind; what lies between the marks is measured and summed.
    """
    plain = F.replace(F.col("text"), F.lit(_MARK), F.lit(_GLUE))
    parts = []
    for i, kind in enumerate(KINDS):
        marked = F.split(F.regexp_replace(plain, PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK)
        piece = F.transform(marked, lambda p, at: F.struct(at.alias("at"), F.length(p).alias("size"), F.when(at % 2 == 1, p).alias("match")))
        found = rows.where(F.col("text").rlike(NEEDS[kind])).select("row_key", F.lit(i).alias("kind"), F.explode(piece).alias("p"))
        found = found.select("row_key", "kind", "p.*")
        running = F.sum("size").over(Window.partitionBy("row_key", "kind").orderBy("at"))
        found = found.withColumn("end", running).where("match IS NOT NULL").where(valid(kind, F.col("match")))
        parts.append(found.select("row_key", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))
    return reduce(lambda a, b: a.union(b), parts)


def _flat(text):
    """The text with single spaces for all whitespace; numbers written in groups stay one token.  Lengths stay as they are."""
    plain = F.replace(text, F.lit(_MARK), F.lit(_GLUE))
    glued = F.when(text.rlike("[0-9]"), F.regexp_replace(plain, r"(?<=[0-9)])\x20(?=[0-9(])", _GLUE)).otherwise(plain)
    return F.translate(glued, "\t\n\x0b\f\r", "     ")


def _even(text):
    """Words in lower case, without digits and without what is no letter around them; spaces stay."""
    return F.regexp_replace(F.lower(text), r"(?<![^\x20])[^\p{L}\x20]++|(?<=\p{L})[^\p{L}\x20]++(?![^\x20])|[0-9]", "")


def _trim(token):
    """The token without punctuation around it, and with its spaces back."""
    return F.replace(F.regexp_replace(token, r"^[^\p{L}\p{N}+(]+|[^\p{L}\p{N}]+$", ""), F.lit(_GLUE), F.lit(" "))


def _seed_kind(value):
    """The number of the kind of which the value as a whole is a base span, else null."""
    out = F.lit(None).cast("int")
    for i, kind in reversed(list(enumerate(KINDS))):
        whole = F.regexp_replace(value, "^" + PATTERNS[kind].replace(r"(?:\G|", "(?:^|") + "$", "") == ""
        out = F.when((value != "") & whole & valid(kind, value), F.lit(i)).otherwise(out)
    return out


def _shape(value):
    """Letters by runs, digits one by one, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")


def candidates(rows):
    """``(row_key, start, end, value, seed, context, left, right)`` of the identifier-like tokens of rows (row_key, text).

    These are tokens of at least four characters with a digit or an @.  context: a hash of the two words
    before, null for a first token; left, right: hashes of the shape with the word before or after.
    The tokens are marked in the text; what lies between the marks is measured and summed, as for base spans.
    """
    token = r"(?<![^\x20])[^\x200-9@]*+[0-9@][^\x20]*+"
    pieces = F.split(F.regexp_replace(_flat(F.col("text")), token, f"{_MARK}$0{_MARK}"), _MARK)
    ready = rows.where(F.col("text").rlike("[0-9@]")).select("row_key", pieces.alias("p"))

    def piece(i):
        return F.when((i >= 0) & (i < F.size("p")), F.get(F.col("p"), i)).otherwise("")

    def around(p, at):
        before = F.concat(F.substring_index(piece(at - 3), " ", -4), piece(at - 2), F.substring_index(piece(at - 1), " ", -4))
        after = F.concat(F.substring_index(piece(at + 1), " ", 3), piece(at + 2))
        odd = at % 2 == 1
        return F.struct(
            at.alias("at"),
            F.length(p).alias("size"),
            F.when(odd, p).alias("token"),
            F.when(odd, F.substring_index(before, " ", -3)).alias("before"),
            F.when(odd, F.substring_index(after, " ", 2)).alias("after"),
        )

    out = ready.select("row_key", F.explode(F.transform("p", around)).alias("c")).select("row_key", "c.*")
    out = out.withColumn("past", F.sum("size").over(Window.partitionBy("row_key").orderBy("at"))).where("size >= 4 AND token IS NOT NULL")
    cut = F.length("token") - F.length(F.regexp_replace("token", r"^[^\p{L}\p{N}+(]+", ""))
    out = out.withColumn("value", _trim(F.col("token"))).where("value != ''").withColumn("start", F.col("past") - F.col("size") + cut)
    words = F.split(_even(F.regexp_replace("before", " $", "")), " ")
    shape = _shape(F.col("value"))
    return out.select(
        "row_key",
        "start",
        (F.col("start") + F.length("value")).alias("end"),
        "value",
        _seed_kind(F.col("value")).alias("seed"),
        shape.alias("shape"),
        F.when(F.col("before") != "", F.xxhash64(words)).alias("context"),
        F.xxhash64(F.lit("left"), F.element_at(words, -1), shape).alias("left"),
        F.xxhash64(F.lit("right"), F.trim(_even(F.col("after"))), shape).alias("right"),
    )


def _occurrences(rows, contexts):
    """``(pattern, total)``: how often each of the contexts stands before any token, in all of rows.

    The pairs of words are counted before the contexts meet them: the join makes one row for each context, and what is
    shuffled are a task's different pairs, however many occurrences the contexts have.
    """
    words = rows.select(F.split(_even(_flat(F.col("text"))), " ").alias("w")).where(F.size("w") > 1)
    first = F.array(F.xxhash64(F.slice("w", 1, 1)))
    later = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.slice("w", i, F.lit(2))))
    follow = F.when(F.size("w") > 2, F.concat(first, later)).otherwise(first)
    seen = words.select(F.explode(follow).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("total"))
    contexts = broadcast_if(contexts, contexts.count(), MAX_CONTEXTS)
    return seen.join(contexts, "pattern")


def graph(rows, found, seeds=SEEDS):
    """``(pattern, value, seed, total, n)``: which values fill which patterns, how often, and how often anything does.

    A pattern is either two words before a token whatever it looks like, wanted only with ``seeds`` different
    seeds, or one word before or after a token of the shape that a seed has; ``total`` is null for the latter.
    """
    contexts = found.where("seed IS NOT NULL AND context IS NOT NULL").groupBy(F.col("context").alias("pattern"), "seed")
    contexts = contexts.agg(F.count_distinct("value").alias("n")).where(F.col("n") >= seeds).select("pattern").distinct()
    totals = stored(_occurrences(rows, stored(contexts, "pii-contexts")), "pii-totals")
    totals = broadcast_if(totals, totals.count(), MAX_CONTEXTS)
    plain = found.select(F.col("context").alias("pattern"), "value", "seed").join(totals, "pattern")
    shapes = stored(found.where("seed IS NOT NULL").select("shape").distinct(), "pii-shapes")
    like = found.join(broadcast_if(shapes, shapes.count(), MAX_CONTEXTS), "shape")
    sided = like.select(F.explode(F.array("left", "right")).alias("pattern"), "value", "seed", F.lit(None).cast("long").alias("total"))
    edges = plain.select(sided.columns).union(sided)
    return stored(edges.groupBy(edges.columns).agg(F.count("*").alias("n")), "pii-edges")


def trusted(edges, belief, seeds=SEEDS, doubt=DOUBT, least=LEAST):
    """``(pattern, kind, trust)`` of patterns filled by ``seeds`` different values that are believed to be of the kind.

    Two words alone are as trustworthy as the share of known identifiers among all that follows them.  A
    word with a shape is held against the identifiers of other kinds only: what fills it is not known to be
    none, and the shape rules plain words out.  ``doubt`` counts against both.
    """
    kinds = edges.join(belief, "value").groupBy("pattern", "kind").agg(
        F.sum("belief").alias("good"),
        F.sum(F.col("n") * F.col("belief")).alias("mass"),
        F.max("total").alias("total"),
        F.count_if(F.col("belief") >= least).alias("k"),
    )
    every = F.sum("good").over(Window.partitionBy("pattern"))  # at most one row for each kind
    trust = F.when(F.col("total").isNull(), F.col("good") / (every + doubt)).otherwise(F.col("mass") / (F.col("total") + doubt))
    return kinds.select("pattern", "kind", "k", trust.alias("trust")).where(F.col("k") >= seeds).drop("k")


def discover(rows, found, seeds=SEEDS, doubt=DOUBT, rounds=ROUNDS, least=LEAST):
    """``(value, kind)``: identifiers that trusted patterns point to, from the candidates found in rows.

    A value that is a seed itself is not given again; a value that several kinds' patterns
    point to has the kind that is surer of it, the earlier one on a tie.
    """
    edges = graph(rows, found, seeds)
    seed = edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    seed = stored(seed, "pii-seeds")
    belief, new = seed, None
    for _ in range(rounds):
        patterns = trusted(edges, belief, seeds, doubt, least)
        # noisy or over the patterns that a value fills
        doubted = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))
        new = edges.where("seed IS NULL").join(patterns, "pattern").groupBy("value", "kind")
        new = new.agg((1 - doubted).alias("belief"), F.max("trust").alias("best")).where("best >= 0.5").drop("best")
        new = stored(new, "pii-belief")
        belief = seed.union(new)
    sure = new.where(F.col("belief") >= least)
    return sure.groupBy("value").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))


def _joined(spans):
    names = F.array(*(F.lit(k) for k in KINDS))
    one = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(one, ",")


def personal_data(docs, **rules):
    """One row for each document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found``.

    docs: doc_id, text.  The counts and the digest are of the base spans, ``spans`` has those that the
    method adds too, ``n_found`` says how many these are.  A null text is empty; rows that
    repeat doc_id and text have the same result; an empty table gives an empty table.  A found
    token that overlaps a base span is no span of its own.
    """
    every = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = every.withColumn("row_key", F.xxhash64("doc_id", "text"))
    some = every.where(F.col("text").rlike("[0-9@]")).dropDuplicates(["row_key"]).select("row_key", "text")
    base = stored(base_spans(some), "pii-base")
    found = stored(candidates(some), "pii-candidates")
    new = discover(every.select("text"), found, **rules)
    more = found.where("seed IS NULL").join(new, "value")
    placed = more.select("row_key", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    b = base.select(F.col("row_key").alias("bk"), F.col("start").alias("bs"), F.col("end").alias("be"))
    placed = placed.join(b, (F.col("row_key") == F.col("bk")) & (F.col("start") < F.col("be")) & (F.col("bs") < F.col("end")), "left_anti")
    spans = base.withColumn("base", F.lit(True)).unionByName(placed.withColumn("base", F.lit(False)))
    span = F.struct("kind", "start", "end")
    by_row = spans.groupBy("row_key").agg(
        *(F.sum((F.col("base") & (F.col("kind") == i)).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.collect_list(F.when(F.col("base"), span)).alias("base_list"),
        F.collect_list(span).alias("all_list"),
    )
    by_row = by_row.select("row_key", *(f"n_{k}" for k in KINDS), _joined(F.col("base_list")).alias("base"), _joined(F.col("all_list")).alias("spans"), (F.size("all_list") - F.size("base_list")).cast("long").alias("n_found"))
    by_row = stored(by_row, "pii-rows").withColumnRenamed("row_key", "k")
    out = every.select("doc_id", "row_key").join(by_row, F.col("row_key") == F.col("k"), "left")
    return out.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found"),
    )
