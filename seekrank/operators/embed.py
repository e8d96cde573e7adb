"""I10 embedding job.

Two kinds of embedder:

* :class:`HashedBow` — deterministic bag-of-words: tokenise and hash in the JVM
  (``split``, ``md5``, ``conv``), count per bucket with one vectorised NumPy
  ``bincount`` per Arrow batch. No shuffle: each row is embedded where it lives.
* :class:`BatchEmbedder` — any model or service that maps a list of texts to
  vectors. Runs per partition through ``mapInPandas``; a primary and an optional
  fallback with the routing rules of the original worker (402/401/429 or a
  non-HTTP error → try the fallback; other HTTP statuses are final). A row that
  fails keeps a null vector and the error text; the job never fails for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FALLBACK_STATUSES = (401, 402, 429)


def hash_buckets(text, dim: int) -> Column:
    """Token buckets: lower, split on non [a-z0-9], keep length > 2, md5 → bucket."""
    col = F.col(text) if isinstance(text, str) else text
    toks = F.filter(F.split(F.lower(col), r"[^a-z0-9]+"), lambda t: F.length(t) > 2)
    return F.transform(
        toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    )


def _bincount_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def bincount(buckets: pd.Series) -> pd.Series:
        n = len(buckets)
        valid = buckets.notna().to_numpy()
        lens = np.array([len(b) if ok else 0 for b, ok in zip(buckets, valid)], dtype=np.int64)
        total = int(lens.sum())
        if total:
            flat = np.concatenate([np.asarray(b, dtype=np.int64) for b, ok in zip(buckets, valid) if ok and len(b)])
            rows = np.repeat(np.arange(n, dtype=np.int64), lens)
            counts = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim)
        else:
            counts = np.zeros((n, dim), dtype=np.int64)
        counts = counts.astype(np.float32)
        return pd.Series([counts[i] if valid[i] else None for i in range(n)])

    return bincount


@dataclass(frozen=True)
class HashedBow:
    """Deterministic hashed bag-of-words embedder with ``dim`` buckets."""

    dim: int = 64
    name: str = "hashed_bow"

    def column(self, text) -> Column:
        return _bincount_udf(self.dim)(hash_buckets(text, self.dim))


class EmbedError(Exception):
    """Error of one text; ``status`` is the HTTP status when the service answered."""

    def __init__(self, message: str, status: int | None = None, http: bool = True):
        super().__init__(message)
        self.status = status
        self.http = http


@dataclass(frozen=True)
class BatchEmbedder:
    """A pluggable embedder: ``fn(texts) -> list[vector | EmbedError]``, called with ``max_texts`` at most."""

    name: str
    fn: Callable[[Sequence[str]], Sequence[object]]
    max_texts: int = 64


class EmptyEmbedding(EmbedError):
    """The service answered with an empty vector: an answer, so no other service is asked."""

    def __init__(self):
        super().__init__("Generated embedding is empty", http=False)


def _should_fall_back(err: EmbedError) -> bool:
    return not isinstance(err, EmptyEmbedding) and ((not err.http) or err.status in FALLBACK_STATUSES)


def _vector(answer: object) -> object:
    """A float vector, or the error that the answer stands for."""
    if isinstance(answer, EmbedError):
        return answer
    if answer is None:
        return EmptyEmbedding()
    try:
        vec = np.asarray(answer, dtype=np.float32)
    except (TypeError, ValueError) as e:
        return EmbedError(f"Generated embedding is not a vector: {e}", http=False)
    if vec.ndim != 1:
        return EmbedError("Generated embedding is not a vector", http=False)
    return vec if len(vec) else EmptyEmbedding()


def _call(embedder: BatchEmbedder, texts: list[str]) -> list[object]:
    """One answer per text; a call that fails or answers too few or too many is repeated text by text."""
    try:
        out = list(embedder.fn(texts))
        if len(out) == len(texts):
            return [_vector(v) for v in out]
        problem: object = EmbedError(f"{len(out)} embeddings for {len(texts)} texts", http=False)
    except EmbedError as e:
        problem = e
    except Exception as e:  # not raised by the HTTP client
        problem = EmbedError(str(e), http=False)
    if len(texts) == 1:
        return [problem]
    return [_call(embedder, [t])[0] for t in texts]


def _run(embedder: BatchEmbedder, texts: list[str]) -> list[object]:
    return [v for lo in range(0, len(texts), embedder.max_texts) for v in _call(embedder, texts[lo:lo + embedder.max_texts])]


def embed(df: DataFrame, text_col: str, embedder, fallback: BatchEmbedder | None = None,
          out_col: str = "vector") -> DataFrame:
    """Add ``vector`` (array<float>), ``provider`` and ``error`` columns."""
    if isinstance(embedder, HashedBow):
        return (df.withColumn(out_col, embedder.column(text_col))
                  .withColumn("provider", F.lit(embedder.name))
                  .withColumn("error", F.lit(None).cast("string")))

    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.FloatType())),
        T.StructField("provider", T.StringType()),
        T.StructField("error", T.StringType()),
    ])

    def per_batch(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            first = _run(embedder, texts)
            retry = [i for i, r in enumerate(first) if isinstance(r, EmbedError) and _should_fall_back(r)]
            second = {}
            if fallback is not None and retry:
                for i, r in zip(retry, _run(fallback, [texts[i] for i in retry])):
                    second[i] = r
            vecs, provs, errs = [], [], []
            for i, r in enumerate(first):
                if not isinstance(r, EmbedError):
                    vecs.append(r); provs.append(embedder.name); errs.append(None)
                elif i in second and not isinstance(second[i], EmbedError):
                    vecs.append(second[i]); provs.append(fallback.name); errs.append(None)
                elif i in second:
                    vecs.append(None); provs.append(None)
                    errs.append(f"Embedding generation failed: {embedder.name} failed ({r}), "
                                f"{fallback.name} fallback also failed ({second[i]})")
                else:
                    vecs.append(None); provs.append(None)
                    errs.append(f"Embedding generation failed: {r}")
            yield pdf.assign(**{out_col: vecs, "provider": provs, "error": errs})

    return df.mapInPandas(per_batch, schema)
