"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

A text is its words in lower case (A-Z) and one end token.  The vocabulary is open and grows with
the corpus, so the model predicts one of ``CLASSES`` outcomes: the end, the most frequent
words, and groups of all other words by their last letters.  Inside a group, a word has its
share of the group's smoothed counts, with one more share for words not seen in training.
Outcomes are so normalised over all words.

The neural part is log-bilinear: each of the ``CONTEXT`` words before adds its class's vector, weighted
by place, to a predicted vector; an outcome's score is its product with the outcome's
vector, plus a bias.  It is trained with noise-contrastive estimation against the corpus's
class frequencies, in numpy.  All windows of the training texts are dealt by hash into shards
of about ``SHARD`` tokens, and every window is learned from once: the first shard alone, then the next
three side by side, then twelve, and so on.  In a round every shard starts from the same weights, and the
weights are averaged after it.  Shards and their order hang on the texts alone, not on files or tasks.
Scoring multiplies a block of contexts with all outcomes at once and normalises exactly.

What is counted and learned:

* Word counts cover all training texts: one row for each different word of a task goes through a shuffle.
* Training takes every token of every training text once.
* The counts of the ``FREQUENT`` most frequent words go to all tasks; every other token is looked
  up by a join with the counts, one row for each word of a text.

Words are known by a 64-bit hash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankloom.llm.common import batches, hashed_words, held_out, mix, pick, texts
from rankloom.operators.sizing import stored

CLASSES = 256
COMMON = 127
GROUPS = CLASSES - 1 - COMMON
CONTEXT = 4
DIMENSIONS = 24
FREQUENT = 1 << 17
NOISE = 32
#: Windows of a text that are stored in one row.
PIECE = 16_384
#: Windows that are shuffled in memory before they are learned from.
BLOCK = 65_536
#: Training tokens of a shard, of which there are at most MAX_SHARDS; beyond, shards grow.
SHARD = 4_000_000
MAX_SHARDS = 20_000
_END = np.uint64(0x0123456789ABCDEF)
_SEED = np.uint64(0xD6E8FEB86659FD93)


def group_of(start, end, data):
    """The group of each word by its last three bytes, from 0."""
    value = np.zeros(len(start), dtype=np.uint64)
    for back in range(1, 4):
        at = end - back
        letter = np.where(at >= start, data[np.maximum(at, 0)], 0).astype(np.uint64)
        value = value * np.uint64(257) + letter
    return (mix(value + _SEED) % np.uint64(GROUPS)).astype(np.int64)


def tokens(rows):
    """``(hash, doc, group)`` of the words and the end of each text, in order; the end has group -1."""
    words, doc, start, end, data = hashed_words(rows)
    group = group_of(start, end, data)
    n = len(rows)
    place = np.arange(len(words)) + doc  # each text before has one end
    size = np.bincount(doc, minlength=n) + 1
    total = len(words) + n
    out_hash, out_group = np.full(total, _END), np.full(total, -1, dtype=np.int64)
    out_hash[place], out_group[place] = words, group
    return out_hash, np.repeat(np.arange(n), size), out_group


def _counts(parts):
    held = None
    for batch in parts:
        rows = texts(batch.column("text"))
        for a, b in batches(rows):
            value, _, group = tokens(rows[a:b])
            value, at, n = np.unique(value, return_index=True, return_counts=True)
            new = (value, group[at], n)
            held = new if held is None else _merged(held, new)
            if len(held[0]) > 2_000_000:
                yield _count_batch(held)
                held = None
    if held is not None:
        yield _count_batch(held)


def _merged(one, two):
    value = np.concatenate([one[0], two[0]])
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    n = np.add.reduceat(np.concatenate([one[2], two[2]])[order], first)
    return value[first], np.concatenate([one[1], two[1]])[order][first], n


def _count_batch(held):
    value, group, n = held
    return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(group.astype(np.int16)), pa.array(n)], ["h", "g", "n"])


class Classes:
    """The class of each token: 0 the end, then the common words, then the groups."""

    def __init__(self, common):
        self.common = np.sort(np.array(common, dtype=np.int64).view(np.uint64))

    def __call__(self, value, group):
        out = np.where(group < 0, 0, 1 + COMMON + group)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, value), len(self.common) - 1)
            out = np.where((self.common[at] == value) & (group >= 0), 1 + at, out)
        return out


def contexts(classes, doc):
    """The classes of the CONTEXT tokens before each, nearest first; the end's class 0 stands before a text."""
    n = len(classes)
    out = np.zeros((n, CONTEXT), dtype=np.int64)
    for k in range(1, CONTEXT + 1):
        if n > k:
            out[k:, k - 1] = np.where(doc[k:] == doc[:-k], classes[:-k], 0)
    return out


def start_weights(frequency):
    rng = np.random.default_rng(5)
    return {
        "R": rng.normal(0, 0.1, (CLASSES, DIMENSIONS)),
        "Q": rng.normal(0, 0.1, (CLASSES, DIMENSIONS)),
        "C": np.ones((CONTEXT, DIMENSIONS)) / CONTEXT,
        "b": np.log(frequency),
    }


def pack(w):
    return np.concatenate([w[k].ravel() for k in ("R", "Q", "C", "b")])


def unpack(flat):
    shapes = {"R": (CLASSES, DIMENSIONS), "Q": (CLASSES, DIMENSIONS), "C": (CONTEXT, DIMENSIONS), "b": (CLASSES,)}
    out, at = {}, 0
    for k, shape in shapes.items():
        n = int(np.prod(shape))
        out[k] = np.array(flat[at : at + n]).reshape(shape)
        at += n
    return out


def _add_rows(out, key, rows):
    """out[key] += rows, for keys that repeat."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out[key[first]] += np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def train_pass(w, windows, frequency, rng, batch=1024, rate=0.1, sums=None):
    """The weights after one pass of noise-contrastive estimation with Adagrad over windows (target first, then context).

    A target and NOISE draws from the class frequencies, the same for a batch, are told apart by
    their scores; the scores learn to be log-probabilities, normalised up to noise.  sums: Adagrad's
    sums of squares, updated in place, so that a later pass can go on.
    """
    w = {k: v.astype(np.float32) for k, v in w.items()}
    sums = start_sums(w) if sums is None else sums
    log_noise = np.log(NOISE * frequency).astype(np.float32)
    cut = np.cumsum(frequency)
    keys = np.ascontiguousarray(windows.T.astype(np.uint8))
    places = keys.astype(np.intp)
    for at in range(0, keys.shape[1], batch):
        key, place = keys[:, at : at + batch], places[:, at : at + batch]
        target = place[0]
        table = w["R"][None, :, :] * w["C"][:, None, :]
        q = table[0].take(place[1], axis=0)
        for k in range(1, CONTEXT):
            q += table[k].take(place[k + 1], axis=0)
        noise = np.minimum(np.searchsorted(cut, rng.random(NOISE) * cut[-1]), CLASSES - 1)
        bias = w["b"] - log_noise
        q_true, q_noise = w["Q"].take(target, axis=0), w["Q"][noise]
        true = np.einsum("ij,ij->i", q, q_true) + bias[target]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = q @ q_noise.T
        down += bias[noise]
        np.clip(down, -30, 30, out=down)
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        d_q = up[:, None] * q_true
        d_q += down @ q_noise
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        _add_rows(grads["Q"], key[0], up[:, None] * q)
        np.add.at(grads["Q"], noise, down.T @ q)
        grads["b"] += np.bincount(target, weights=up, minlength=CLASSES)
        grads["b"] += np.bincount(noise, weights=down.sum(axis=0), minlength=CLASSES)
        for k in range(CONTEXT):
            moved = np.zeros_like(w["R"])
            _add_rows(moved, key[k + 1], d_q)
            grads["R"] += moved * w["C"][k]
            grads["C"][k] = (moved * w["R"]).sum(axis=0)
        for k in w:
            sums[k] += grads[k] ** 2
            w[k] += np.float32(rate) * grads[k] / np.sqrt(sums[k])
    return w


def start_sums(w):
    return {k: np.ones(v.shape, dtype=np.float32) for k, v in w.items()}


def log_probabilities(w, target, before):
    """The natural log of each target class's probability, blocks of contexts at once, in float32."""
    table = (w["R"][None, :, :] * w["C"][:, None, :]).astype(np.float32)
    q_t, b = np.ascontiguousarray(w["Q"].T, dtype=np.float32), w["b"].astype(np.float32)
    longest, highest = np.sqrt((q_t**2).sum(axis=0).max()), np.abs(b).max()
    ones = np.ones(CLASSES, dtype=np.float32)
    out = np.empty(len(target))
    for at in range(0, len(target), 512):
        now = before[at : at + 512]
        q = table[0].take(now[:, 0], axis=0)
        for k in range(1, CONTEXT):
            q += table[k].take(now[:, k], axis=0)
        score = q @ q_t
        score += b
        own = score[np.arange(len(now)), target[at : at + 512]].astype(np.float64)
        if np.sqrt((q**2).sum(axis=1).max()) * longest + highest > 60:  # exp of a score could leave float32
            top = score.max(axis=1)
            score -= top[:, None]
            own -= top
        np.exp(score, out=score)
        out[at : at + 512] = own - np.log(score @ ones)
    return out


def _windows(parts, classes):
    """``(h, piece, windows)``: all windows of each text, in pieces of ``PIECE``; h is a hash of the text."""
    for batch in parts:
        rows = texts(batch.column("text"))
        for a, b in batches(rows):
            value, doc, group = tokens(rows[a:b])
            own = classes(value, group)
            first = np.searchsorted(doc, np.arange(b - a + 1))
            turn = np.arange(len(doc)) - first[doc]
            h = np.add.reduceat(mix(value ^ mix(turn.astype(np.uint64))), first[:-1])
            table = np.concatenate([own[:, None], contexts(own, doc)], axis=1).astype(np.uint8)
            cuts = np.flatnonzero(turn % PIECE == 0)
            ends = np.append(cuts[1:], len(doc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[doc[cuts]].view(np.int64)),
                    pa.array((turn[cuts] // PIECE).astype(np.int32)),
                    pa.array([table[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()),
                ],
                ["h", "piece", "windows"],
            )


def _trained(parts, flat, frequency, rate):
    """``(at, value)``: for each shard the weights after a pass over its windows, times their number, and the number."""
    shard, w, sums, rng, held, n, waiting = None, None, None, None, [], 0, 0

    def step():
        mine = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, 1 + CONTEXT)
        return train_pass(w, mine[rng.permutation(len(mine))], frequency, rng, rate=rate, sums=sums)

    def result():
        values = np.append(pack(w) * float(n), n)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)).astype(np.int32)), pa.array(values)], ["at", "value"])

    for batch in parts:
        for now, windows in zip(batch.column("shard").to_pylist(), batch.column("windows").to_pylist(), strict=True):
            if now != shard:
                if shard is not None:
                    w = step() if held else w
                    yield result()
                shard, w, rng, held, n, waiting = now, unpack(flat), np.random.default_rng(now), [], 0, 0
                sums = start_sums(w)
            held.append(windows)
            n += len(windows) // (1 + CONTEXT)
            waiting += len(windows) // (1 + CONTEXT)
            if waiting >= BLOCK:
                w, held, waiting = step(), [], 0
    if shard is not None:
        w = step() if held else w
        yield result()


def learn(docs, common, frequency, total, shard_tokens=SHARD):
    """The weights, from all ``total`` tokens of docs (text), the training part."""
    classes = Classes(common)
    n = max(1, min(-(-total // shard_tokens), MAX_SHARDS))
    starts = [4**i for i in range(32) if 4**i < n]
    rows = docs.select("text").mapInArrow(lambda parts: _windows(parts, classes), "h long, piece int, windows binary")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("h", "piece"), F.lit(n)).cast("int"))
    rows = rows.withColumn("round", sum(((F.col("shard") >= s).cast("int") for s in starts), F.lit(0)))
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "h", "piece")
    table = stored(rows, "lm-windows")
    weights = start_weights(frequency)
    for number in range(len(starts) + 1):
        flat, rate = pack(weights), 0.1 / (1 + number)
        mine = table.where(F.col("round") == number).select("shard", "windows")
        parts = mine.mapInArrow(lambda parts, flat=flat, rate=rate: _trained(parts, flat, frequency, rate), "at int, value double")
        got = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")["value"].to_numpy()
        if len(got):
            weights = unpack(got[:-1] / got[-1])
    return weights


def score(docs, modulus=5, remainder=1):
    """One row for each document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    docs: doc_id, text.  The model learns from documents whose crc32 of doc_id modulo 5 is not 1.
    base_score: the log10 probability under smoothed word counts; score: under the neural
    model.  A null text is empty, and has its end token only.  Rows stay one for one, also those
    that repeat.  Without training documents all counts are zero and every token is unknown.
    An empty table gives an empty table.
    """
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    training = rows.where(~F.col("held_out")).select("text")
    counts = training.mapInArrow(_counts, "h long, g short, n long").groupBy("h").agg(F.max("g").alias("g"), F.sum("n").alias("n"))
    counts = stored(counts, "lm-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = total + 0.5 * (kinds + 1)
    top = counts.where("g >= 0").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow().sort_by([("n", "descending"), ("h", "ascending")])
    end = counts.where("g < 0").first()
    end_n = end["n"] if end else 0
    common = top.column("h").to_pylist()[:COMMON]
    # the mass of each group's words that aren't common, with one unseen word for each group
    is_common = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in common], "c long"))
    mass = counts.where("g >= 0").join(is_common, F.col("h") == F.col("c"), "left_anti").groupBy("g").agg((F.sum("n") + 0.5 * F.count("*")).alias("m")).collect()
    groups = np.full(GROUPS, 0.5)
    for r in mass:
        groups[r["g"]] += r["m"]
    in_order = dict(zip(common, top.column("n").to_pylist(), strict=False))
    classes = Classes(common)
    frequency = np.full(CLASSES, 1e-9)
    frequency[0] = end_n + 0.5
    for i, h in enumerate(classes.common.view(np.int64).tolist()):
        frequency[1 + i] = in_order[h] + 0.5
    frequency[1 + COMMON :] = groups
    frequency = frequency / frequency.sum()
    weights = learn(training, common, frequency, total)
    flat = pack(weights)

    order = np.argsort(top.column("h").to_numpy().view(np.uint64))
    top_hash, top_n = top.column("h").to_numpy().view(np.uint64)[order], top.column("n").to_numpy()[order]
    log_groups = np.log10(groups)
    log_scale = np.log10(scale)
    frequent = docs.sparkSession.sparkContext.broadcast((top_hash, top_n))

    def run(parts):
        top_hash, top_n = frequent.value
        w = unpack(flat)
        for batch in parts:
            found, ids, rows_ = texts(batch.column("text")), batch.column("doc_id"), batch.column("row").to_numpy()
            for a, b in batches(found):
                value, doc, group = tokens(found[a:b])
                n = b - a
                own = classes(value, group)
                log_p = log_probabilities(w, own, contexts(own, doc)) / np.log(10)
                at = np.minimum(np.searchsorted(top_hash, value), max(len(top_hash) - 1, 0))
                hit = (top_hash[at] == value) & (group >= 0) if len(top_hash) else np.zeros(len(value), bool)
                count = np.where(hit, top_n[at] if len(top_n) else 0, 0)
                count[group < 0] = end_n
                here = hit | (group < 0)
                share = np.where(here, np.log10(count + 0.5), 0.0)
                # a word in a group: its own count's part of the group
                inside = own > COMMON
                log_p -= np.where(inside, log_groups[np.maximum(own - 1 - COMMON, 0)], 0)
                log_p += np.where(inside, share, 0)
                columns = [
                    ids.slice(a, n),
                    pa.array(np.bincount(doc, minlength=n)),
                    pa.array(np.bincount(doc, weights=here & (count > 0), minlength=n).astype(np.int64)),
                    pa.array(np.bincount(doc, weights=share, minlength=n)),
                    pa.array(np.bincount(doc, weights=log_p, minlength=n)),
                ]
                whole = pa.StructArray.from_arrays(columns, ["doc_id", "size", "known", "base", "neural"])
                spread = mix(rows_[a:b].view(np.uint64) ^ _SEED).view(np.int64)
                rest = np.flatnonzero(~here)
                row = np.concatenate([rows_[a:b], rows_[a:b][doc[rest]]])
                h = np.concatenate([spread, value[rest].view(np.int64)])
                everything = pa.concat_arrays([whole, pa.nulls(len(rest), whole.type)])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(h), everything], ["row", "h", "whole"])

    numbered = rows.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    schema = "row long, h long, whole struct<doc_id:long, size:long, known:long, base:double, neural:double>"
    parts = numbered.mapInArrow(run, schema)
    rare = counts.where("g >= 0").select(F.col("h").alias("c"), "n")
    looked = parts.join(rare, F.col("h") == F.col("c"), "left")
    word = F.col("whole").isNull()
    n = F.when(word, F.coalesce("n", F.lit(0)))
    sums = looked.groupBy("row").agg(
        F.max("whole.doc_id").alias("doc_id"),
        F.sum("whole.size").alias("n_tokens"),
        (F.sum("whole.known") + F.coalesce(F.sum((n > 0).cast("long")), F.lit(0))).alias("n_known"),
        F.coalesce(F.sum(F.log10(n + 0.5)), F.lit(0.0)).alias("rest"),
        F.sum("whole.base").alias("base"),
        F.sum("whole.neural").alias("neural"),
    )
    return sums.select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest") - F.col("n_tokens") * F.lit(float(log_scale))).alias("base_score"),
        (F.col("neural") + F.col("rest")).alias("score"),
    )
