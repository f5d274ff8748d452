"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1.  An n-gram binds the vectors of its
letters, the earlier ones rotated further, by multiplying them element by element; a
text bundles its n-grams by adding them up.  A language's prototype is the bundle of
all training texts in it.  A text's language is the one whose prototype has the largest
cosine with the text's vector.

Training sends one vector of integers for each language and task.  Prediction is
one pass without a shuffle; prototypes (a vector for each language) go to all tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankloom.llm.common import batches, held_out, pick, texts

WIDTH = 512
GRAM = 3
UNKNOWN = "und"
#: Letter symbols: 0 for what isn't a letter, 1-26 for a-z, the others dealt out to the rest.
SYMBOLS = 128
#: Bytes of texts that are profiled at once; a longer text is read in pieces of PIECE code points.
SLICE = 2_000_000
PIECE = 500_000
#: N-gram vectors that are held at once: those of one text, and those that the texts of a slice share.
CHUNK, SHARED = 8192, 32_768
_symbol = []


def symbols():
    """The symbol of each code point."""
    if not _symbol:
        table = np.zeros(0x110000, dtype=np.uint8)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], dtype=np.int64)
        table[letters] = 27 + letters % (SYMBOLS - 27)
        table[97:123] = np.arange(1, 27)
        _symbol.append(table)
    return _symbol[0]


def letter_vectors(width=WIDTH):
    return np.random.default_rng(71).integers(0, 2, (SYMBOLS, width)).astype(np.int8) * 2 - 1


def gram_vectors(grams, letters):
    """The bound vectors of n-grams given as numbers in base SYMBOLS."""
    out = np.ones((len(grams), letters.shape[1]), dtype=np.int8)
    rest = grams.copy()
    for i in range(GRAM):
        out *= np.roll(letters, i, axis=1)[rest % SYMBOLS]
        rest //= SYMBOLS
    return out


def profile(rows):
    """``(doc, gram, count)`` of a few texts (bytes), sorted by doc, and which texts have a letter.

    Letters are taken in lower case; a run of anything else counts as one gap, as
    does either end of a text.
    """
    points = [t.decode("utf-8", "replace").lower() for t in rows]
    size = np.array([len(p) + 1 for p in points])
    data = np.frombuffer("".join(" " + p for p in points).encode("utf-32-le", "replace"), dtype=np.uint32)
    symbol = symbols()[data].astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), size)
    gap = symbol == 0
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1]) | (doc[1:] != doc[:-1])
    symbol, doc = symbol[keep], doc[keep]
    # the gap before the next text closes this one
    symbol, doc = np.append(symbol, 0), np.append(doc, len(rows))
    code = symbol[:-2] * SYMBOLS * SYMBOLS + symbol[1:-1] * SYMBOLS + symbol[2:]
    inside = doc[1:-1] == doc[:-2]
    key = doc[:-2][inside] * SYMBOLS**GRAM + code[inside]
    key = key[code[inside] != 0]
    key, count = np.unique(key, return_counts=True)
    lettered = np.zeros(len(rows), dtype=bool)
    lettered[key // SYMBOLS**GRAM] = True
    return key // SYMBOLS**GRAM, key % SYMBOLS**GRAM, count, lettered


def long_profile(text):
    """``(gram, count)`` of one long text, from pieces of ``PIECE`` code points.

    A piece starts with the last two symbols before it, so it counts each n-gram that ends in it.
    """
    points = text.decode("utf-8", "replace").lower() + " "
    count, before = np.zeros(SYMBOLS**GRAM, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for at in range(0, len(points), PIECE):
        data = np.frombuffer(points[at : at + PIECE].encode("utf-32-le", "replace"), dtype=np.uint32)
        symbol = np.concatenate([before, symbols()[data].astype(np.int64)])
        keep = np.ones(len(symbol), dtype=bool)
        keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
        symbol = symbol[keep]
        code = symbol[:-2] * SYMBOLS * SYMBOLS + symbol[1:-1] * SYMBOLS + symbol[2:]
        count += np.bincount(code, minlength=SYMBOLS**GRAM)
        before = symbol[-2:]
    count[0] = 0
    gram = np.flatnonzero(count)
    return gram, count[gram]


def slices(rows):
    """``(first, last, doc, gram, count, lettered)`` of consecutive texts: the profile of a few, or of one long text."""
    for a, b in batches(rows, SLICE):
        short = [t if len(t) < SLICE else b"" for t in rows[a:b]]
        doc, gram, count, lettered = profile(short)
        if len(rows[b - 1]) >= SLICE:  # only the last text of a slice can be long
            more, n = long_profile(rows[b - 1])
            doc = np.append(doc, np.full(len(more), b - a - 1))
            gram, count = np.append(gram, more), np.append(count, n)
            lettered[-1] = len(more) > 0
        yield a, b, doc, gram, count, lettered


def bundle(gram, count, letters):
    """The sum of the n-grams' vectors, each as often as it is counted; ``CHUNK`` vectors are held at once."""
    out = np.zeros(letters.shape[1])
    kind = np.float32 if count.sum() < 1 << 24 else np.float64  # sums of integers stay exact
    for a in range(0, len(gram), CHUNK):
        out += count[a : a + CHUNK].astype(kind) @ gram_vectors(gram[a : a + CHUNK], letters).astype(kind)
    return out


def bundles(doc, gram, count, n, letters):
    """The vectors of n texts (float64, one row each), from their profiles, sorted by text."""
    grams, at = np.unique(gram, return_inverse=True)
    out = np.zeros((n, letters.shape[1]))
    first = np.searchsorted(doc, np.arange(n + 1))
    # texts share vectors if these are few; else each text makes its own
    bound = gram_vectors(grams, letters).astype(np.float32) if len(grams) <= SHARED else None
    for i in range(n):
        a, b = first[i], first[i + 1]
        if bound is not None and b - a <= CHUNK:
            out[i] = count[a:b].astype(np.float32) @ bound[at[a:b]]
        else:
            out[i] = bundle(gram[a:b], count[a:b], letters)
    return out


def prototypes(docs, width=WIDTH):
    """``{language: unit vector}`` from all rows of docs (text, lang) with a language and a text."""
    letters = letter_vectors(width)

    def run(parts):
        total = {}
        for batch in parts:
            langs, rows = batch.column("lang").to_pylist(), texts(batch.column("text"))
            for a, b, doc, gram, count, _ in slices(rows):
                names = np.array(langs[a:b], dtype=object)
                for name in set(names.tolist()):
                    mine = (names == name)[doc]
                    grams, at = np.unique(gram[mine], return_inverse=True)
                    seen = np.bincount(at, weights=count[mine], minlength=len(grams))
                    total[name] = total.get(name, 0) + bundle(grams, seen, letters)
        if total:
            values = np.array(list(total.values()))
            flat = pa.array(np.rint(values).astype(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)).take(pa.array(np.repeat(np.arange(len(total)), width))), pa.array(np.tile(np.arange(width), len(total)).astype(np.int32)), flat],
                ["lang", "at", "value"],
            )

    learn = pick(docs, text="text", lang="lang").where("lang IS NOT NULL AND text IS NOT NULL")
    parts = learn.mapInArrow(run, "lang string, at int, value long")
    sums = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for name, rows in sums.sort_values(["lang", "at"]).groupby("lang"):
        vector = rows["value"].to_numpy(dtype=np.float64)
        if vector.any():
            out[name] = vector / np.linalg.norm(vector)
    return out


def predict(docs, learned, width=WIDTH):
    """``(doc_id, lang_pred, score)`` for each row of docs (doc_id, text).

    score: the cosine with the language's prototype, at least 0.  A null or empty text,
    a text without a letter, and any text if nothing was learned gives ``und`` with score 0.
    Ties go to the language that is first by code point.  Rows stay one for one; the
    columns lang and source are not read.
    """
    letters = letter_vectors(width)
    names = sorted(learned)
    matrix = np.array([learned[n] for n in names]).reshape(len(names), width)

    def run(parts):
        for batch in parts:
            rows = texts(batch.column("text"))
            best, score = np.full(len(rows), -1), np.zeros(len(rows))
            for a, b, doc, gram, count, lettered in slices(rows) if names else ():
                vectors = bundles(doc, gram, count, b - a, letters)
                norm = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ matrix.T / np.where(norm, norm, 1)[:, None]
                best[a:b] = np.where(lettered, cosine.argmax(axis=1), -1)
                score[a:b] = np.where(lettered, np.clip(cosine.max(axis=1), 0, 1), 0)
            pred = [names[i] if i >= 0 else UNKNOWN for i in best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs, modulus=4, remainder=2):
    """Predictions for all of docs, learned from those whose crc32 of doc_id modulo 4 is not 2."""
    out = held_out(F.col("doc_id"), modulus, remainder)
    learned = prototypes(docs.where(~out))
    return predict(docs, learned).select("doc_id", out.alias("held_out"), "lang_pred", "score")
