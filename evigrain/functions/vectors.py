"""Column functions over vectors, and the hashing embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; an all-zero one stays."""
    n = norm(v)
    # the length once beside every number: what a lambda captures is computed at each call
    return F.zip_with(v, F.array_repeat(F.when(n == 0, F.lit(1.0)).otherwise(n), F.size(v)), lambda x, m: x / m)


def quantise(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.bround(x, digits))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


class Grams(dict):
    """Twice the bucket, plus one where the sign is negative, of the n-grams met so far."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, gram: str) -> int:
        d = hashlib.sha1(gram.encode()).digest()
        if len(self) > 500_000:
            self.clear()
        self[gram] = code = 2 * (int.from_bytes(d[:4], "big") % self.dimension) + d[4] % 2
        return code


def signed_counts(text: str | None, grams: Grams, n: int) -> np.ndarray:
    """Signed n-gram counts by bucket of the text in lower case between two spaces."""
    line = f" {(text or '').lower().strip()} ".ljust(n)
    codes = np.bincount([grams[line[i : i + n]] for i in range(len(line) - n + 1)], minlength=2 * grams.dimension)
    return codes[0::2] - codes[1::2]


def hash_counts(texts: DataFrame, key: str, text: str, dimension: int = 256, n: int = 4) -> DataFrame:
    """key, bucket, total: the signed n-gram counts of each text that aren't 0, as rows."""
    def run(parts):
        grams = Grams(dimension)
        for part in parts:
            counts = [signed_counts(t, grams, n) for t in part.column(1).to_pylist()]
            held = [np.flatnonzero(c) for c in counts]
            who = np.repeat(np.arange(len(held)), [len(h) for h in held])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(np.concatenate([*held, none]).astype(np.int64)), pa.array(np.concatenate([*(c[h] for c, h in zip(counts, held)), none]).astype(np.int64))], [key, "bucket", "total"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"{key} {kind}, bucket bigint, total bigint")


def hash_embedding(text: Column, dimension: int = 256, n: int = 4, digits: int = 6) -> Column:
    """The same counts as one vector of length 1 per text, rounded; Arrow batches with a cache of n-grams."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        grams = Grams(dimension)
        out = np.zeros((len(texts), dimension))
        for row, value in enumerate(texts.to_pylist()):
            out[row] = signed_counts(value, grams, n)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.round(out / np.where(lengths == 0, 1.0, lengths), digits)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dimension).cast(pa.list_(pa.float64()))

    return run(text)


def seeded(seed: int, *salt: object) -> np.random.Generator:
    """A generator from a seed and what it is for, the same on every machine: the SHA-256 of the parts' repr, each
    ended by the unit separator, gives the state (first 63 bits of the first 16 hex digits)."""
    digest = hashlib.sha256(b"".join(repr(p).encode() + b"\x1f" for p in (seed, *salt))).hexdigest()
    return np.random.default_rng(int(digest[:16], 16) % (1 << 63))
