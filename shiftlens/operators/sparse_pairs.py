"""Pairs of sparse unit vectors whose cosine reaches a threshold, by an inverted index on short prefixes.

The components of every vector are put in one order, the rarest first. The chunks' vectors have index
entries only up to where the rest can still reach the threshold by itself; the rest is bounded by its length
and by the largest weights that queries have in the same components. A query meets a chunk through the
components that it shares with the chunk's entries, whose products add up to a part of the cosine. Pairs
whose part and rest together stay below the threshold are dropped, the others measured in full. Common
components come last, so hot ones hardly ever have entries, and a pair that only shares those never meets.

With few dimensions or long texts every component is common, and the pairs that meet are more than all pairs
are worth. The rows that the index would join are therefore counted first, by component. Where they cost
more than the products of all pairs, blocks of queries meet lanes of chunks (``plans.grid``): a task screens them with
matrix products in single precision, whose error is bounded, and measures in full what may reach the threshold.

Equal vectors of a side are one class while pairs are sought, so copies don't multiply the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.vectors import DIMENSIONS, hashed_weights
from shiftlens.operators.retrieval import single_error
from shiftlens.plans.grid import TASK_BYTES, plan_grid
from shiftlens.plans.scratch import written

DIGITS = 6
#: A pair is measured if its bound comes this near to the threshold: more than rounding takes away.
MARGIN = 1e-6
#: Multiplications of a matrix product in the time that one joined row of the index takes.
ROW_COST = 10_000
#: Products that a task works out at once, and pairs that it measures at once.
_TILE = 2_000_000
_PAIRS = 4_000


def weighted(df: DataFrame, key: str, text: str, dims: int = DIMENSIONS) -> DataFrame:
    """``key`` and ``weights``, the hashed unit vector of ``text`` in sparse form."""
    return df.select(F.col(key).alias("key"), hashed_weights(F.col(text), dims).alias("weights"))


def _classes(side: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Each different vector once, named by its smallest key, and the class of every key."""
    kept = written(side.where(F.col("key").isNotNull() & (F.size("weights") > 0)).select("key", "weights"), label)
    named = written(kept.groupBy("weights").agg(F.min("key").alias("class")), f"{label}-classes")
    return named, kept.join(named, "weights").select("key", "class")


def _facts(classes: DataFrame) -> DataFrame:
    return classes.select(F.explode("weights").alias("w")).groupBy("w.bucket").agg(F.count(F.lit(1)).alias("n"), F.max("w.weight").alias("most"))


def prefix_entries(weights: pa.ListArray, rank: np.ndarray, most: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """The index entries of vectors: row, bucket and weight, and what the row's components without an entry can add."""
    sizes = np.diff(weights.offsets.to_numpy())
    flat = weights.flatten()
    bucket, weight = flat.field("bucket").to_numpy(), flat.field("weight").to_numpy()
    row = np.repeat(np.arange(len(weights)), sizes)
    order = np.lexsort((rank[bucket], row))
    row, bucket, weight = row[order], bucket[order], weight[order]

    def rest(values: np.ndarray) -> np.ndarray:
        """Of each row the sum from this entry to its last."""
        upto = np.concatenate([[0.0], np.cumsum(values)])
        return upto[np.cumsum(sizes)][row] - upto[:-1]

    bound = np.minimum(np.sqrt(np.maximum(rest(weight * weight), 0)), rest(weight * most[bucket]))
    needed = bound >= threshold - MARGIN  # bounds fall along a row, so these are its first entries
    left = np.zeros(len(weights))
    np.maximum.at(left, row[~needed], bound[~needed])
    return row[needed], bucket[needed], weight[needed], left[row[needed]]


def _entries(classes: DataFrame, rank: np.ndarray, most: np.ndarray, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, weight, left = prefix_entries(batch.column("weights"), rank, most, threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class").take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(weight), pa.array(left)], names=["b", "bucket", "b_weight", "left"]
            )

    kind = classes.schema["class"].dataType.simpleString()
    return classes.select("class", "weights").mapInArrow(run, f"b {kind}, bucket int, b_weight double, left double")


def _dense(weights: pa.ListArray, dims: int) -> np.ndarray:
    out = np.zeros((len(weights), dims))
    flat = weights.flatten()
    out[np.repeat(np.arange(len(weights)), np.diff(weights.offsets.to_numpy())), flat.field("bucket").to_numpy()] = flat.field("weight").to_numpy()
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round((a * b).sum(axis=1), DIGITS)


def block_pairs(asked: pa.ListArray, stored: pa.ListArray, threshold: float, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``asked`` and ``stored``, and scores, of the pairs that reach the threshold."""
    queries = _dense(asked, dims)
    single, least = queries.astype(np.float32).T, np.float32(threshold - MARGIN - single_error(dims))
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, min(_TILE // max(1, len(queries)), _TILE // dims))
    for low in range(0, len(stored), step):
        rows = _dense(pa.concat_arrays([stored.slice(low, step)]), dims)
        near = np.flatnonzero(rows.astype(np.float32) @ single >= least)
        for start in range(0, len(near), _PAIRS):
            b, a = np.divmod(near[start : start + _PAIRS], len(queries))
            score = _exact(queries[a], rows[b])
            kept = score >= threshold
            found.append((a[kept], b[kept] + low, score[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _all_measured(a: DataFrame, b: DataFrame, threshold: float, dims: int, counts: tuple[int, int], task_bytes: int) -> DataFrame:
    """``a, b, score`` of all pairs that reach the threshold, block by lane."""
    width, cores = 8 * dims, a.sparkSession.sparkContext.defaultParallelism
    grid = plan_grid(counts[0] * width, counts[1] * width, max(task_bytes, 4 * width), cores)
    kinds = [f"{n} {f.schema['class'].dataType.simpleString()}" for n, f in (("a", a), ("b", b))]

    def run(_: tuple, block: pa.Table, lane: pa.Table) -> pa.Table:
        sides = [(t.column("class").combine_chunks(), pa.concat_arrays(t.column("weights").chunks)) if t.num_rows else (t.column("class").combine_chunks(), None) for t in (block, lane)]
        if sides[0][1] is None or sides[1][1] is None:
            none = pa.array([], pa.int64())
            return pa.table([sides[0][0].take(none), sides[1][0].take(none), pa.array([], pa.float64())], names=["a", "b", "score"])
        left, right, score = block_pairs(sides[0][1], sides[1][1], threshold, dims)
        return pa.table([sides[0][0].take(pa.array(left)), sides[1][0].take(pa.array(right)), pa.array(score)], names=["a", "b", "score"])

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = a.withColumn("block", part(grid.blocks)).withColumn("lane", every(grid.lanes))
    spread = b.withColumn("lane", part(grid.lanes)).withColumn("block", every(grid.blocks))
    return dealt.groupBy("block", "lane").cogroup(spread.groupBy("block", "lane")).applyInArrow(run, ", ".join([*kinds, "score double"]))


def _measured(pairs: DataFrame, dims: int) -> DataFrame:
    """``a, b, score`` from both vectors of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                sides = [_dense(pa.concat_arrays([part.column(c)]), dims) for c in ("a_weights", "b_weights")]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(_exact(*sides))], names=["a", "b", "score"])

    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b")]
    return pairs.mapInArrow(run, ", ".join([*kinds, "score double"]))


def similar_classes(
    left: DataFrame, right: DataFrame, threshold: float, dims: int = DIMENSIONS, row_cost: float = ROW_COST, task_bytes: int = TASK_BYTES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``left_class, right_class, score`` of different vectors, and the classes of the left and the right keys.

    Sides have ``key`` and ``weights`` (buckets below ``dims``, each once, of a vector of length 1; weights are not negative).
    ``threshold`` is above 0. Scores are rounded to six digits and then compared. Null keys and empty
    vectors pair with nothing. ``row_cost`` weighs a joined row of the index against a multiplication of the full products.
    """
    if not threshold > 0:
        raise ValueError("a pair that shares nothing scores 0: the threshold must be above it")
    (a, a_keys), (b, b_keys) = _classes(left, "left"), _classes(right, "right")
    asks, counts, most = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    for is_query, frame in ((True, a), (False, b)):
        for r in _facts(frame).collect():  # no more rows than buckets
            counts[r["bucket"]] += r["n"]
            if is_query:
                asks[r["bucket"]], most[r["bucket"]] = r["n"], r["most"]
    rank = np.empty(dims, np.int64)
    rank[np.lexsort((np.arange(dims), counts))] = np.arange(dims)
    entries = written(_entries(b, rank, most, threshold), "entries")
    met_rows = sum(asks[r["bucket"]] * r["count"] for r in entries.groupBy("bucket").count().collect())
    n_a, n_b = a.count(), b.count()
    if met_rows * row_cost > n_a * n_b * dims:
        measured = _all_measured(a, b, threshold, dims, (n_a, n_b), task_bytes)
    else:
        asked = a.select(F.col("class").alias("a"), F.explode("weights").alias("w")).select("a", F.col("w.bucket").alias("bucket"), F.col("w.weight").alias("a_weight"))
        part = asked.join(entries, "bucket").groupBy("a", "b").agg(F.sum(F.col("a_weight") * F.col("b_weight")).alias("part"), F.max("left").alias("left"))
        near = written(part.where(F.col("part") + F.col("left") >= threshold - MARGIN).select("a", "b"), "candidates")
        vectors = [f.select(F.col("class").alias(n), F.col("weights").alias(f"{n}_weights")) for f, n in ((a, "a"), (b, "b"))]
        measured = _measured(near.join(vectors[0], "a").join(vectors[1], "b"), dims)
    pairs = measured.where(F.col("score") >= threshold).select(F.col("a").alias("left_class"), F.col("b").alias("right_class"), "score")
    return pairs, a_keys.withColumnRenamed("class", "left_class"), b_keys.withColumnRenamed("class", "right_class")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, dims: int = DIMENSIONS, row_cost: float = ROW_COST, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``left_key, right_key, score`` of all pairs whose cosine reaches the threshold; see :func:`similar_classes`."""
    pairs, left_keys, right_keys = similar_classes(left, right, threshold, dims, row_cost, task_bytes)
    named = pairs.join(left_keys.withColumnRenamed("key", "left_key"), "left_class").join(right_keys.withColumnRenamed("key", "right_key"), "right_class")
    return named.select("left_key", "right_key", "score")
