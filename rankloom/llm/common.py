"""What the operators of this package share: columns, words, and word hashes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: One random odd-looking 64-bit number for each byte value, and an odd base with its inverse.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWER_BLOCK = 1 << 16


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df, **columns):
    """Only the named columns, under these names; other columns can't clash with anything."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def fresh(df, name):
    """The name, or one made from it that is no column of df, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key, modulus, remainder):
    """crc32 of the key as text; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def lower_bytes(text):
    """UTF-8 bytes with A-Z in lower case."""
    return text.translate(_LOWER)


def texts(column):
    """The rows of an Arrow text column as UTF-8 bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def batches(rows, limit=1_000_000):
    """Consecutive slices ``(first, last)`` of texts with about that many bytes each."""
    first = total = 0
    for i, text in enumerate(rows):
        total += len(text)
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(rows):
        yield first, len(rows)


def _powers(base, n):
    small = np.ones(_POWER_BLOCK, dtype=np.uint64)
    small[1:] = np.uint64(base)
    np.multiply.accumulate(small, out=small)
    blocks = -(-n // _POWER_BLOCK)
    if blocks <= 1:
        return small[:n]
    step = np.uint64(pow(base, _POWER_BLOCK, 2**64))
    large = np.full(blocks, step)
    large[0] = 1
    np.multiply.accumulate(large, out=large)
    return (large[:, None] * small[None, :]).ravel()[:n]


_cache = {}


def powers(base, n):
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _cache.get(base)
    if have is None or len(have) < n:
        have = _cache[base] = _powers(base, max(n, 1 << 20))
    return have[:n]


def mix(x):
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(rows, lower=True):
    """The words of a few texts at once: ``(hashes, doc, start, end, data)``.

    hashes: a 64-bit hash of each word; doc: the row of each; start, end: its bytes
    in ``data``, all texts after one another with a space between.  A word's
    hash is a polynomial over its bytes, read off one prefix sum of the buffer.
    """
    joined = b" ".join(rows)
    joined = lower_bytes(joined) if lower else joined
    data = np.frombuffer(joined, dtype=np.uint8)
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, data
    space = _SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = not space[0]
    edge[n] = not space[-1]
    np.not_equal(space[1:], space[:-1], out=edge[1:n])
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.multiply(_BYTE[data], powers(_BASE, n), out=prefix[1:])
    np.add.accumulate(prefix, out=prefix)
    hashes = mix((prefix[end] - prefix[start]) * powers(_INVERSE, n)[start])
    bounds = np.cumsum([len(t) + 1 for t in rows])
    return hashes, np.searchsorted(bounds, start, side="right"), start, end, data


def shingles(hashes, doc, width):
    """A hash for each run of ``width`` words in one text, and its text's row.

    A text with fewer words (but at least one) has one shingle: all its words.
    """
    n = len(hashes)
    if not n:
        return hashes, doc
    out = hashes.copy()
    for i in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([hashes[i:], np.zeros(min(i, n), np.uint64)])[:n])
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    full = np.zeros(n, dtype=bool)
    if n >= width:
        full[: n - width + 1] = doc[: n - width + 1] == doc[width - 1 :]
    for i, k in zip(first[size < width], size[size < width], strict=True):
        full[i] = True
        value = hashes[i : i + 1]
        for j in range(1, width):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + (hashes[i + j : i + j + 1] if j < k else np.zeros(1, np.uint64)))
        out[i] = value[0]
    keep = np.flatnonzero(full)
    return out[keep], doc[keep]
