"""Vector column expressions over plain arrays, and the hashed bag-of-words embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftlens.functions.text import words

DIMENSIONS = 256


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two vectors of equal length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def mean_of(v: Column) -> Column:
    """Mean of the components; null for an empty vector."""
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(v) > 0, total / F.size(v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 when a vector is missing, empty or zero.

    Pass the norms when they are columns already, so that they are not worked out per pair.
    """
    length = (norm_a if norm_a is not None else l2_norm(a)) * (norm_b if norm_b is not None else l2_norm(b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def word_bucket(word: Column, dims: int = DIMENSIONS) -> Column:
    """Bucket of a word: its first 32 MD5 bits modulo ``dims``."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once.

    A one-element transform binds it to a lambda variable. A plain column would be merged into the
    lambdas that refer to it and worked out again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sorted_buckets(text: Column, dims: int = DIMENSIONS) -> Column:
    """Ascending buckets of all words of a text, repeats kept."""
    return F.sort_array(F.transform(words(text), lambda w: word_bucket(w, dims)))


def _run_ends(buckets: Column) -> Column:
    """(bucket, end) of each run of equal values in a sorted array, ends counted from 1."""
    following = F.concat(F.slice(buckets, 2, F.greatest(F.size(buckets), F.lit(1))), F.array(F.lit(-1)))
    placed = F.transform(buckets, lambda b, i: F.struct(b.alias("bucket"), (i + 1).alias("end")))
    marked = F.zip_with(placed, following, lambda p, after: F.when(p["bucket"] != after, p))
    return F.filter(marked, lambda p: p.isNotNull())


def bucket_counts(text: Column, dims: int = DIMENSIONS) -> Column:
    """``array<struct<bucket, n>>`` of a text's words, buckets ascending.

    The buckets are sorted inside the row and their runs measured, so nothing is shuffled.
    """
    def lengths(ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e["end"]))
        return F.transform(
            F.arrays_zip(ends.alias("here"), F.slice(before, 1, F.size(ends)).alias("before")),
            lambda z: F.struct(z["here"]["bucket"].alias("bucket"), (z["here"]["end"] - z["before"]).alias("n")),
        )

    return _bound(sorted_buckets(text, dims), lambda b: _bound(_run_ends(b), lengths))


def counts_norm(counts: Column) -> Column:
    """Euclidean length of the counts."""
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c["n"] * c["n"]))


def unit_weights(counts: Column) -> Column:
    """``array<struct<bucket, weight>>``: the counts scaled to length 1."""
    return _bound(
        counts_norm(counts),
        lambda norm: F.transform(
            counts, lambda c: F.struct(c["bucket"].alias("bucket"), (c["n"] / norm).alias("weight"))
        ),
    )


def dense(weights: Column, dims: int = DIMENSIONS) -> Column:
    """Vector of ``dims`` components from ascending sparse weights; zeros when there are none."""
    def filled(w: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(w, lambda x: x["bucket"]))
        runs = F.transform(
            F.arrays_zip(w.alias("here"), F.slice(before, 1, F.size(w)).alias("before")),
            lambda z: F.concat(
                F.array_repeat(F.lit(0.0), z["here"]["bucket"] - z["before"] - 1), F.array(z["here"]["weight"])
            ),
        )
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), F.lit(dims - 1) - F.element_at(before, -1)))

    return _bound(weights, filled)


def hashed_weights(text: Column, dims: int = DIMENSIONS) -> Column:
    """Unit vector of a text's word buckets in sparse form."""
    return _bound(bucket_counts(text, dims), unit_weights)


def hashed_vector(text: Column, dims: int = DIMENSIONS) -> Column:
    """The same unit vector as an array of ``dims`` components."""
    return dense(hashed_weights(text, dims), dims)
