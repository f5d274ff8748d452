"""Batch inference with a pluggable encoder.

An encoder is built by a function or class without arguments, given by name at
module level, so that each Python worker builds it once and keeps it.  It has

    encode_passages(texts) -> (matrix of all token vectors, tokens per text)
    encode_texts(texts)    -> matrix with one vector per text
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from rankloom.schema import DENSE_BATCH, VECTOR

HASH_WIDTH = 16


class HashEncoder:
    """Unit vectors from token hashes; for tests and checks.

    Element i of a token vector is byte i of the token's md5, centred, and the
    vector has length 1.  A text's own vector is the mean of its token vectors,
    length 1 again; an empty text has the zero vector.
    """

    width = HASH_WIDTH

    def _tokens(self, texts):
        """(distinct token vectors, number of the vector of each token, tokens per text)"""
        split = [text.split() for text in texts]
        number = {}
        used = [number.setdefault(token, len(number)) for tokens in split for token in tokens]
        digests = b"".join(hashlib.md5(token.encode()).digest() for token in number)
        vectors = np.frombuffer(digests, dtype=np.uint8).reshape(len(number), HASH_WIDTH) - 127.5
        vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        return vectors, np.array(used, dtype=np.int64), [len(tokens) for tokens in split]

    def encode_passages(self, texts):
        vectors, used, counts = self._tokens(texts)
        return vectors.astype(np.float32)[used], counts

    def encode_texts(self, texts):
        vectors, used, counts = self._tokens(texts)
        out = np.zeros((len(texts), self.width))
        np.add.at(out, np.repeat(np.arange(len(texts)), counts), vectors[used])
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0).astype(np.float32)


@functools.cache
def built(factory):
    """The encoder of this Python worker."""
    return factory()


def _lists(matrix):
    """A matrix as an Arrow list<float> column."""
    matrix = np.ascontiguousarray(matrix, dtype=np.float32)
    n, width = matrix.shape if matrix.ndim == 2 else (0, 0)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), pa.float32()))


def _tokens_of(encoder, texts):
    flat, counts = encoder.encode_passages(texts)
    counts = np.asarray(counts, dtype=np.int64)
    if counts.sum() != len(flat) or len(counts) != len(texts):
        raise ValueError("the encoder's counts do not fit its vectors")
    return flat, counts


def passages_apart(encoder, texts):
    """One matrix per text, cut out of the flat result by the counts."""
    flat, counts = _tokens_of(encoder, texts)
    return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []


def encode_tokens(
    texts, encoder=HashEncoder, key="chunk_id", text="text", position="embedding_id", batch=DENSE_BATCH
):
    """One row per token vector: ``key, position, embedding``.

    The output of a call is given out before the next call, so memory follows
    ``batch`` texts, not the Arrow batch.  Null text has no tokens.
    """
    schema = T.StructType(
        [texts.schema[key], T.StructField(position, T.IntegerType()), T.StructField("embedding", VECTOR)]
    )

    def encode(batches):
        model = built(encoder)
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                some = rows.slice(lo, batch)
                flat, counts = _tokens_of(model, [t or "" for t in some.column(1).to_pylist()])
                owner = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
                out = pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner)), pa.array(at, pa.int32()), _lists(flat)], names=schema.names
                )
                for start in range(0, out.num_rows, 20_000):
                    yield out.slice(start, 20_000)

    return texts.select(key, text).mapInArrow(encode, schema)


def encode_dense(texts, encoder=HashEncoder, key="id", text="text", name="dense_embedding", batch=DENSE_BATCH):
    """One vector per text, ``batch`` texts per call, order kept."""
    schema = T.StructType([texts.schema[key], T.StructField(name, VECTOR)])

    def encode(batches):
        model = built(encoder)
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                some = rows.slice(lo, batch)
                vectors = model.encode_texts([t or "" for t in some.column(1).to_pylist()])
                if len(vectors) != some.num_rows:
                    raise ValueError("the encoder must give one vector per text")
                yield pa.RecordBatch.from_arrays([some.column(0), _lists(vectors)], names=schema.names)

    return texts.select(key, text).mapInArrow(encode, schema)
