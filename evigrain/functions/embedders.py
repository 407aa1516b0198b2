"""Embedding models by name. The hashing embedder is built in; a model that needs a package or a service is plugged in
as a function from a list of texts to an array, and runs in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from evigrain.functions import vectors

_MODELS: dict[str, tuple[Callable, dict]] = {}


def register(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int, fingerprint: str, auditable: bool = True) -> None:
    """``load`` is called once a worker and returns the encoder; ``fingerprint`` goes into certificates."""
    _MODELS[name] = load, {"dimension": dimension, "fingerprint": fingerprint, "auditable": auditable}


def fingerprint(name: str, **params) -> str:
    if name == "hash":
        return f"hash/v1(dim={params.get('dimension', 256)},ngram={params.get('n', 4)},prec={params.get('digits', 6)},norm=l2)"
    if name not in _MODELS:
        raise NotImplementedError(f"no embedder {name!r}: register it first, its package isn't part of this library")
    return _MODELS[name][1]["fingerprint"]


def finalise(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rows at length 1 (all-zero ones stay), rounded to the grid that makes results repeatable."""
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(x / np.where(lengths == 0, 1.0, lengths), digits)


def model(name: str) -> Callable | None:
    """What loads a registered model, to be carried to the tasks; None for the built-in one."""
    if name == "hash":
        return None
    fingerprint(name)
    return _MODELS[name][0]


def encoder(name: str = "hash", dimension: int = 256, n: int = 4, digits: int = 6, model: Callable | None = None) -> Callable[[list[str]], np.ndarray]:
    """The finished vectors of a list of texts, for use within a task. ``model``: what ``model(name)`` gave."""
    if name == "hash":
        grams = vectors.Grams(dimension)
        return lambda texts: finalise(np.stack([vectors.signed_counts(t, grams, n) for t in texts]).astype(float), digits)
    encode = (model or _MODELS[name][0])()
    return lambda texts: finalise(np.asarray(encode(texts), float), digits)


def embed(text: Column, name: str = "hash", **params) -> Column:
    if name == "hash":
        return vectors.hash_embedding(text, **params)
    fingerprint(name)
    load, info = _MODELS[name]

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            x = finalise(np.asarray(encode(texts), float)) if texts else np.zeros((0, info["dimension"]))
            yield pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), info["dimension"]).cast(pa.list_(pa.float64()))

    return run(text)
