"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is a logistic model over the shape of the text (symbols,
repeats, capitals, lengths) and over the presence of telling words.  Its
probabilities are then summed by host and by path in one grouped aggregation, and each
site's rate is shrunk: a path towards its host, a host towards the whole corpus,
the more the fewer documents it has.  How much is estimated from the spread of the rates
over sites.  A document's posterior replaces the corpus rate in its odds with
its path's rate.

Two targets are modelled alike: ``quality`` (1 is good) and ``toxic`` (1 is bad).  A document is kept
if its posterior quality is at least one half and its posterior toxicity is under it.

Only the logistic model sees a sample: at most ``SAMPLE`` labelled rows, those with the
smallest hash of doc_id.  Rates, shrinkage and posteriors cover all documents.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from rankloom.llm.common import batches, fresh, hashed_words, pick, texts
from rankloom.operators.sizing import broadcast_if, stored

SAMPLE = 8_000
WORD_BINS = 1 << 16
#: Telling words for each target.
FEATURES = 128
TARGETS = ("quality", "toxic")
SHAPE = 9
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def shapes(rows):
    """``(shape, doc, bin)``: SHAPE numbers for each text, and the different word bins of each text."""
    hashes, doc, start, end, _ = hashed_words(rows)
    data = np.frombuffer(b" ".join(rows), dtype=np.uint8)
    size = np.array([len(t) for t in rows])
    last = np.cumsum(size + 1) - 1
    first = last - size

    def share(which):
        seen = np.concatenate([[0], np.cumsum(which[data])])
        return (seen[last] - seen[first]) / np.maximum(size, 1)

    n = np.bincount(doc, minlength=len(rows))
    least = np.maximum(n, 1)
    same = doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])]
    order = np.lexsort((hashes, doc))
    sorted_hash, sorted_doc = hashes[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(order)))
    most = np.zeros(len(rows))
    np.maximum.at(most, sorted_doc[at], run)
    shape = np.column_stack(
        [
            share(_MARKS),
            share(_UPPER),
            share(_DIGIT),
            np.bincount(same, minlength=len(rows)) / least,
            np.bincount(sorted_doc[at], minlength=len(rows)) / least,
            most / least,
            np.log1p(n),
            np.log1p(np.bincount(doc, weights=end - start, minlength=len(rows)) / least),
            (n < 20).astype(float),
        ]
    )
    return shape, sorted_doc[at], (sorted_hash[at] >> np.uint64(48)).astype(np.int64)


def _fit(x, y, ridge=1.0, rounds=30):
    """Logistic weights (the last one is the constant) by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs, labels, sample=SAMPLE, targets=TARGETS):
    """The model for each target, from docs (doc_id, text) and labels (doc_id and a column for each target).

    Null labels don't count, nor do labels without a document.  A target without both values
    among its labels gets a constant: the mean of its labels, or 1/2 without labels.
    """
    marks = pick(labels, doc_id="doc_id", **{t: t for t in targets}).where(F.col("doc_id").isNotNull())
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", *targets).limit(sample)
    text = pick(docs, id="doc_id", text="text")
    rows = stored(text.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).select("doc_id", "text", *targets), "quality-sample")

    def features(parts):
        for batch in parts:
            text, marks = texts(batch.column("text")), [batch.column(t).cast(pa.float64()) for t in targets]
            for a, b in batches(text):
                shape, doc, bins = shapes(text[a:b])
                first = np.searchsorted(doc, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bins.astype(np.int32)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, shape.size + 1, SHAPE, dtype=np.int32)), pa.array(shape.ravel()))
                yield pa.RecordBatch.from_arrays([flat, lists, *(m.slice(a, b - a) for m in marks)], ["shape", "bins", *targets])

    table = rows.mapInArrow(features, "shape array<double>, bins array<int>, " + ", ".join(f"`{t}` double" for t in targets)).toArrow()
    bins = table.column("bins").combine_chunks()
    flat, doc = bins.flatten().to_numpy(), np.repeat(np.arange(len(bins)), pa.compute.list_value_length(bins).to_numpy())
    shape = table.column("shape").combine_chunks().flatten().to_numpy().reshape(-1, SHAPE)
    model = {}
    for t in targets:
        y = table.column(t).to_numpy()
        have = ~np.isnan(y)
        y01 = np.where(have, y >= 0.5, 0).astype(float)
        pos, neg = int(y01[have].sum()), int(have.sum() - y01[have].sum())
        if not pos or not neg:
            model[t] = {"words": np.zeros(0, np.int64), "mean": np.zeros(SHAPE), "scale": np.ones(SHAPE), "w": np.append(np.zeros(SHAPE), [np.log((pos + 0.5) / (neg + 0.5))]), "rate": (pos + 0.5) / (pos + neg + 1)}
            continue
        mine = have[doc]
        a = np.bincount(flat[mine], weights=y01[doc[mine]], minlength=WORD_BINS)
        n = np.bincount(flat[mine], minlength=WORD_BINS)
        rate = pos / (pos + neg)
        score = (a - n * rate) ** 2 / np.maximum(n * rate * (1 - rate), 1e-9)
        score[n < 5] = 0
        words = np.sort(np.argsort(-score, kind="stable")[:FEATURES])
        words = words[score[words] > 10.8]
        where = np.full(WORD_BINS, -1)
        where[words] = np.arange(len(words))
        present = np.zeros((len(bins), len(words)))
        hit = where[flat] >= 0
        present[doc[hit], where[flat[hit]]] = 1
        mean, scale = shape[have].mean(axis=0), shape[have].std(axis=0) + 1e-6
        w = _fit(np.column_stack([(shape[have] - mean) / scale, present[have]]), y01[have])
        model[t] = {"words": words, "mean": mean, "scale": scale, "w": w, "rate": rate}
    return model


def evidence(docs, model):
    """docs (doc_id, host, path, text) -> ``doc_id, host, path`` and the model's probability for each target."""
    where = {}
    for t, m in model.items():
        where[t] = np.zeros(WORD_BINS)
        where[t][m["words"]] = m["w"][SHAPE:-1]

    def run(parts):
        for batch in parts:
            rows = texts(batch.column("text"))
            out = {t: np.zeros(len(rows)) for t in model}
            for a, b in batches(rows):
                shape, doc, bins = shapes(rows[a:b])
                for t, m in model.items():
                    z = ((shape - m["mean"]) / m["scale"]) @ m["w"][:SHAPE] + m["w"][-1]
                    z += np.bincount(doc, weights=where[t][bins], minlength=b - a)
                    out[t][a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), *map(pa.array, out.values())], ["doc_id", "host", "path", *out])

    schema = "doc_id long, host string, path string, " + ", ".join(f"`{t}` double" for t in model)
    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, schema)


def _strength(sites, rate, group):
    """How many documents' worth the prior is: method of moments on the spread of the site rates.

    sites: one row for each site with ``n`` and the sum ``rate``.  A site is shrunk towards the rate of
    its ``group``, so the spread is measured around that rate; sites alone in their group say nothing.
    """
    n, total = F.col("n"), F.col(rate)
    groups = sites.groupBy(group.alias("group")).agg(
        F.sum("n").alias("n"), F.sum(n * n).alias("squares"), (F.count("*") - 1).alias("free"), F.sum(total).alias("total"), F.sum(total * total / n).alias("raw")
    )
    mean = F.col("total") / n
    got = groups.where("free > 0").agg(
        F.sum("free").alias("free"),
        F.sum(F.col("free") * mean * (1 - mean)).alias("within"),
        F.sum(n - F.col("squares") / n).alias("width"),
        F.sum(F.col("raw") - F.col("total") * mean).alias("spread"),
    ).first()
    if not got["free"] or got["within"] <= 0:
        return 100.0
    between = (got["spread"] - got["within"]) / max(got["width"], 1e-9)
    return float(min(max(got["within"] / got["free"] / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def sites(scored, targets=TARGETS):
    """One row for each ``(host, path)``: documents, and for each target the shrunk rates ``<t>_host`` and ``<t>_path``."""
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in targets)), "quality-paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in targets)), "quality-hosts")
    whole = hosts.agg(F.sum("n"), *(F.sum(t) for t in targets)).first()
    out, up, base = paths, hosts, {}
    for i, t in enumerate(targets):
        base[t] = float(whole[i + 1] / whole[0]) if whole[0] else 0.5
        k = _strength(hosts, t, F.lit(0))
        up = up.withColumn(f"{t}_host", (F.col(t) + k * base[t]) / (F.col("n") + k))
    up = up.select(F.col("host").alias("h"), *(f"{t}_host" for t in targets))
    out = out.join(up, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    for t in targets:
        k = _strength(paths, t, F.col("host"))
        out = out.withColumn(f"{t}_path", (F.col(t) + k * F.col(f"{t}_host")) / (F.col("n") + k))
    return out.drop(*targets), base


def _logit(p):
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.log(p / (1 - p))


def posterior(scored, targets=TARGETS):
    """scored with the site rates, and each target's posterior in its own column."""
    table, base = sites(scored, targets)
    table = stored(table, "quality-sites")
    near = broadcast_if(table.withColumnsRenamed({"host": "h", "path": "p", "n": "site_docs"}), table.count())
    out = scored.join(near, F.col("h").eqNullSafe(F.col("host")) & F.col("p").eqNullSafe(F.col("path"))).drop("h", "p")
    for t in targets:
        odds = _logit(F.col(t)) - _logit(F.lit(base[t])) + _logit(F.col(f"{t}_path"))
        out = out.withColumn(f"{t}_doc", F.col(t)).withColumn(t, 1 / (1 + F.exp(-odds)))
    return out


def _judged(rows, model, least):
    """rows (doc_id, host, path, text) with posteriors, rates and ``keep``."""
    rows = rows.select(F.col("doc_id").cast("long"), F.col("host").cast("string"), F.col("path").cast("string"), "text")
    out = posterior(stored(evidence(rows, model), "quality-evidence"))
    return out.withColumn("keep", (F.col("quality") >= least) & (F.col("toxic") < least))


def classify(docs, labels, host="source", path="lang", least=0.5):
    """One row for each document: ``doc_id, host, path``, posteriors, rates, and ``keep``.

    docs: doc_id, text, a host and a path column (null is a site of its own); labels: doc_id,
    quality, toxic.  A null or empty text is scored by its (empty) shape.  Rows that
    repeat a doc_id are scored row by row.  An empty table gives an empty table.
    """
    return _judged(pick(docs, doc_id="doc_id", text="text", host=host, path=path), train(docs, labels), least)


def kept(docs, labels, host="source", path="lang", least=0.5):
    """The rows of docs (with all their columns) that ``classify`` keeps."""
    columns = [F.col(f"`{c}`") for c in ("doc_id", "text", host, path)]
    key = F.xxhash64(*columns)
    rows = docs.select(key.alias("doc_id"), columns[1].alias("text"), columns[2].alias("host"), columns[3].alias("path"))
    rejected = fresh(docs, "_rejected")
    out = _judged(rows, train(docs, labels), least).where(~F.col("keep")).select(F.col("doc_id").alias(rejected)).distinct()
    out = stored(out, "quality-rejected")
    return docs.join(broadcast_if(out, out.count()), key == F.col(rejected), "left_anti")
