"""Vector arithmetic and text encoding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a zero vector or vectors of different length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def score_of_distance(distance: Column) -> Column:
    """F28"""
    return F.lit(1.0) - distance


Encoder = Callable[[list[str]], np.ndarray]


#: MD5: the words and rotations of its 64 steps, and the longest text that is digested as one block.
_WORD = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ONE_BLOCK = 55


def digest_heads(texts: list[bytes]) -> np.ndarray:
    """The first eight bytes of the MD5 of each text, one row each; short texts all at once."""
    out = np.empty((len(texts), 2), dtype="<u4")
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    for i in np.flatnonzero(size > ONE_BLOCK):
        out[i] = np.frombuffer(hashlib.md5(texts[i]).digest()[:8], dtype="<u4")
    short = np.flatnonzero(size <= ONE_BLOCK)
    size = size[short]
    block = np.zeros((len(short), 64), dtype="u1")
    block[:, :ONE_BLOCK] = np.array([texts[i] for i in short], dtype=f"S{ONE_BLOCK}").view("u1").reshape(len(short), ONE_BLOCK)
    block[np.arange(len(short)), size] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = size * 8
    a, b, c, d = (np.full(len(short), x, dtype="u4") for x in _START)
    for step in range(64):
        if step < 16:
            mixed = d ^ (b & (c ^ d))
        elif step < 32:
            mixed = c ^ (d & (b ^ c))
        elif step < 48:
            mixed = b ^ c ^ d
        else:
            mixed = c ^ (b | ~d)
        mixed += a
        mixed += words[_WORD[step]]
        mixed += _ADDED[step]
        turned = mixed << np.uint32(_TURN[step])
        turned |= mixed >> np.uint32(32 - _TURN[step])
        turned += b
        a, b, c, d = d, turned, b, c
    out[short, 0], out[short, 1] = a + np.uint32(_START[0]), b + np.uint32(_START[1])
    return out.view("u1")


def hashing_encoder(dim: int) -> Encoder:
    """Signed bag of words: no model needed, same vector on every machine. A token that comes again in a batch is digested once."""

    def slots(tokens: list[str]) -> list[int]:
        heads = digest_heads([token.encode() for token in tokens])
        places = heads[:, :4].copy().view(">u4")[:, 0].astype("int64") % dim
        return np.where(heads[:, 4] < 128, places, places + dim).tolist()

    def encode(texts: list[str]) -> np.ndarray:
        tokens = [text.lower().split() for text in texts]
        once = list(dict.fromkeys(chain.from_iterable(tokens)))
        slot = dict(zip(once, slots(once)))
        rows = np.repeat(np.arange(len(texts)), [len(own) for own in tokens])
        found = np.fromiter(map(slot.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=len(rows))
        signed = np.bincount(rows * (2 * dim) + found, minlength=len(texts) * 2 * dim).reshape(len(texts), 2, dim)
        return (signed[:, 0] - signed[:, 1]).astype("float64")

    return encode


MODEL_TEXTS, HASHED_TEXTS = 16, 1024


def encoder_udf(make: Callable[[], Encoder] | None = None, dim: int = 64, batch: int | None = None):
    """an Arrow iterator function from text to unit vector.

    ``make`` is called once per Python worker and returns the model's encode
    function; blank texts, and texts the model maps to zero, give a zero vector.
    ``batch``: texts a call, ``MODEL_TEXTS`` unless given; hashing takes more at once.
    """
    batch = batch or (MODEL_TEXTS if make else HASHED_TEXTS)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make() if make else hashing_encoder(dim)
        for texts in batches:
            texts = texts.fillna("").tolist()
            filled = [i for i, t in enumerate(texts) if t.strip()]
            out: list[np.ndarray] = [np.zeros(dim, dtype="float32")] * len(texts)
            for start in range(0, len(filled), batch):
                part = filled[start : start + batch]
                vectors = np.asarray(model([texts[i] for i in part]), dtype="float64")
                length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
                for i, v in zip(part, vectors.astype("float32")):
                    out[i] = v
            yield pd.Series(out)

    return encode
