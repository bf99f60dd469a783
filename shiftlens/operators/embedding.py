"""Chunks to vectors: any batch function, or the built-in hashed bag of words."""

from __future__ import annotations

import logging
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.functions.fixed import BATCH_TEXTS
from shiftlens.functions.vectors import DIMENSIONS, hashed_vector, hashed_weights

_log = logging.getLogger(__name__)

Embedder = Callable[[list[str]], list[list[float]]]
Answer = tuple[list[float] | None, str | None]


def _vector(given: object, dims: int | None) -> Answer:
    """One vector of an answer, or what is wrong with it."""
    if given is None:
        return None, "no vector"
    try:
        vector = [float(x) for x in given]
    except (TypeError, ValueError):
        return None, "not a vector of numbers"
    if dims is not None and len(vector) != dims:
        return None, f"{len(vector)} components, not {dims}"
    if not all(map(math.isfinite, vector)):
        return None, "a component is not finite"
    return vector, None


def _called(embed: Embedder, texts: list[str], dims: int | None) -> list[Answer] | str:
    """The checked vectors of one call, or why the call as a whole has failed."""
    try:
        vectors = embed(texts)
        if vectors is None:
            return "no answer"
        vectors = list(vectors)
    except Exception as reason:
        _log.exception("embedding failed for a batch of %d texts", len(texts))
        return f"{type(reason).__name__}: {reason}"
    if len(vectors) != len(texts):
        return f"{len(vectors)} vectors for {len(texts)} texts"
    if dims is None and len(vectors) > 1:  # the length that most have
        sizes = Counter(len(v) for v in vectors if hasattr(v, "__len__"))
        dims = max(sizes, key=lambda n: (sizes[n], n), default=None)
    return [_vector(v, dims) for v in vectors]


def embedded_texts(embed: Embedder, texts: list[str], dims: int | None = None) -> list[Answer]:
    """Each text's vector, or none and the reason.

    A call that fails as a whole is halved, so that a text that no call survives stands alone in the end. While
    nothing works at all that is given up: after more calls in a row than halving down to one bad
    text takes, what is left of the batch gets the last reason.
    """
    out: list[Answer] = [(None, None)] * len(texts)
    waiting, failed, reason = [(0, len(texts))], 0, None
    patience = 2 * len(texts).bit_length() + 2
    while waiting:
        low, high = waiting.pop()
        if low == high:
            continue
        if failed > patience:
            out[low:high] = [(None, reason)] * (high - low)
            continue
        answer = _called(embed, texts[low:high], dims)
        if not isinstance(answer, str):
            out[low:high], failed = answer, 0
            continue
        failed, reason = failed + 1, answer
        if high - low == 1:
            out[low] = None, reason
        else:
            middle = (low + high) // 2
            waiting += [(middle, high), (low, middle)]
    return out


def embed_batches(chunks: DataFrame, embed: Embedder, text: str = "chunk_text", batch: int = BATCH_TEXTS, dims: int | None = None) -> DataFrame:
    """Add ``embedding``, the vectors that ``embed`` returns for up to ``batch`` texts per call, and ``error``.

    No row is lost. A call that raises, answers nothing or with another number of vectors is halved until
    the text at fault stands alone; a vector that is missing, not made of finite numbers or not as long as ``dims``
    (or else as most of its call) is left out. Such rows have no vector and say why; they stay missing
    in the store and are tried again by the next build; ``embedding_errors`` counts them. Columns of ``chunks`` by the
    names ``embedding`` and ``error`` are replaced.
    """
    kept = chunks.drop("embedding", "error")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]
    )
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low in range(0, rows.num_rows, batch):
                part = rows.slice(low, batch)
                answers = embedded_texts(embed, part.column(text).to_pylist(), dims)
                vectors = pa.array([a[0] for a in answers], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors, pa.array([a[1] for a in answers], pa.string())], names=names)

    return kept.mapInArrow(run, schema)


def embedding_errors(embedded: DataFrame) -> DataFrame:
    """How many chunks have no vector, by reason."""
    return embedded.where(F.col("embedding").isNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n_chunks"))


def embed_hashed(df: DataFrame, text: str = "chunk_text", dims: int = DIMENSIONS) -> DataFrame:
    """Add ``embedding``, the unit vector of the text's word buckets: a projection, no shuffle."""
    return df.withColumn("embedding", hashed_vector(F.col(text), dims))


def sparse_weights(df: DataFrame, keys: Sequence[str], text: str, dims: int = DIMENSIONS) -> DataFrame:
    """The same vector in sparse form: one row per key and non-zero bucket."""
    return df.select(*keys, F.inline(hashed_weights(F.col(text), dims)))


def cosine_sparse(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Cosine of the two texts under each key, from their sparse unit vectors.

    The join key is the pair's key and the bucket, so no bucket pairs with the rows of other keys.
    Pairs that share no bucket have similarity 0 and do not appear.
    """
    a = left.withColumnRenamed("weight", "__a")
    b = right.withColumnRenamed("weight", "__b")
    return a.join(b, [*on, "bucket"]).groupBy(*on).agg(F.round(F.sum(F.col("__a") * F.col("__b")), 6).alias("score"))
