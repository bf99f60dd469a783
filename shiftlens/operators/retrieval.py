"""Top chunks for batches of queries by cosine similarity, exact.

Queries are dealt to blocks by hashes of their keys; how many there are follows from their bytes
(``plans.grid``). The store's vectors are scaled and saved once, and a lane is a range of the saved rows, mostly all of them:
a task holds one block and reads its lane from the files, so the store isn't shuffled, what lies on disk follows
the bytes of both sides and not their product, and a query has few part results. A task scores with matrix products, keeping only the best
k per query and source: products in single precision, whose error is bounded, screen out what cannot be among them,
and the rest is scored in double precision. Batches are taken in slices, so a task's memory does not follow theirs. Queries that are counted to fit in a single small block are sent to the
store's own scan instead, which is not saved either. The pairs themselves are never written out, and
a source that holds much of the store is spread over the lanes like any other.

Scores are rounded before they are ranked; equal scores rank by source and chunk id. A vector that is
missing, empty, zero, not finite or of another length than the batch's scores 0 with everything;
``vector_faults`` lists such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shiftlens.functions.fixed import TOP_K
from shiftlens.plans.grid import TASK_BYTES, Grid, plan_streams
from shiftlens.plans.ordering import with_row_index
from shiftlens.plans.scratch import place, written
from shiftlens.plans.sizing import broadcast_if_small
from shiftlens.sources.tables import known_rows

SCORE_DIGITS = 6
SMALL_BYTES = 8 << 20  # vectors of queries that are sent to every task of the store's scan
LIST_COPIES = 16  # of the fallback list, so that many queries without a vector are spread
_SLICE_BYTES = 4 << 20  # vectors of the store that a task makes ready at once
_SCALE_BYTES = 512 << 10  # vectors scaled at once, which takes some copies of them
_TILE = 2_000_000  # scores worked out at once in a task
_HEAD = 32  # rows scored in full before there is anything to screen by
_PAIRS = 4_000  # pairs scored in full at once
_HELD = 4_000_000  # part results a task keeps before it passes them on
_MOST_PARTITIONS = 2_000  # that the pairs of blocks and lanes are dealt to
_TASKS_A_CORE = 3  # at least, so that cores end together
_READ_BYTES = 1 << 20  # read from a saved file at once

_STORED = "source string, chunk_id bigint, unit binary"
_NO_CHUNK = np.iinfo(np.int64).max
_NULL_ID = np.iinfo(np.int64).min  # stands for a missing chunk id, which comes first among equal scores


def unit_rows(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors scaled to length 1, as a matrix; those without a direction in ``dims`` components are zero rows.

    A vector is divided by its largest component first, so that no square overflows or vanishes.
    """
    out = np.zeros((len(vectors), dims))
    step = max(1, _SCALE_BYTES // (8 * max(1, dims)))
    for low in range(0, len(vectors) if dims else 0, step):
        out[low : low + step] = _unit_slice(vectors.slice(low, step), dims)
    return out


def _unit_slice(vectors: pa.Array, dims: int) -> np.ndarray:
    rows = np.zeros((len(vectors), dims))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    whole = lengths == dims
    fitting = vectors if whole.all() else vectors.filter(pa.array(whole))
    # a null component has no value, so its row has no direction
    rows[whole] = pc.fill_null(pc.cast(fitting.flatten(), pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    rows[~np.isfinite(rows).all(axis=1)] = 0.0
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = np.divide(rows, largest, out=np.zeros_like(rows), where=largest > 0)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def common_length(rows: DataFrame) -> int:
    """The length that most vectors of ``embedding`` have, of equally many the largest; 0 if there are none."""
    sizes = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    return top["dims"] if top else 0


def vector_faults(rows: DataFrame, dims: int, *keys: str) -> DataFrame:
    """``keys`` of the rows whose ``embedding`` scores 0 with everything, its length, and why."""
    value = F.col("embedding").cast("array<double>")
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fault = (
        F.when(value.isNull(), "missing").when(F.size(value) == 0, "empty").when(F.size(value) != dims, "length")
        .when(odd, "not finite").when(F.forall(value, lambda x: x == 0), "zero")
    )
    return rows.select(*keys, F.when(value.isNotNull(), F.size(value)).alias("n_dims"), fault.alias("fault")).where(F.col("fault").isNotNull())


def _slice_rows(dims: int) -> int:
    return max(1, _SLICE_BYTES // (8 * max(1, dims)))


def _packed(units: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    offsets = np.arange(len(units) + 1, dtype=np.int32) * (8 * units.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(units, "<f8"))])


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The matrix of :func:`_packed`."""
    _, offsets, data = column.buffers()
    if not len(column) or not dims:
        return np.zeros((len(column), dims))
    start = int(np.frombuffer(offsets, np.int32, 1, 4 * column.offset)[0])
    return np.frombuffer(data, "<f8", len(column) * dims, start).reshape(-1, dims)


def _packing(dims: int) -> Callable:
    """Batches of the store with their vectors scaled to length 1, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _slice_rows(dims)):
                part = batch.slice(low, _slice_rows(dims))
                packed = _packed(unit_rows(part.column("embedding"), dims))
                yield pa.RecordBatch.from_arrays([part.column("source"), part.column("chunk_id"), packed], names=["source", "chunk_id", "unit"])

    return run


def _stored(lane: pa.Table, dims: int) -> Iterator[pa.RecordBatch]:
    """The saved rows of a lane: those from ``low`` to ``high`` of each of its files, a few at a time."""
    for file in lane.select(["path", "low", "high"]).to_pylist():
        files, path = place(file["path"])
        with files.open_input_file(path) as opened:
            saved = pq.ParquetFile(opened, buffer_size=_READ_BYTES)
            start = 0
            for group in range(saved.num_row_groups):
                end = start + saved.metadata.row_group(group).num_rows
                if start < file["high"] and end > file["low"]:
                    at = start
                    for batch in saved.iter_batches(_slice_rows(dims), row_groups=[group], use_threads=False):
                        low, high = max(file["low"] - at, 0), min(file["high"] - at, batch.num_rows)
                        if low < high:
                            yield batch.slice(low, high - low)
                        at += batch.num_rows
                start = end


def _lane_places(counts: list[tuple[str, int]], lanes: int) -> list[tuple[int, str, int, int]]:
    """(lane, path, first row, row after the last): files of so many rows, cut into lanes of equally many."""
    total, start, out = sum(n for _, n in counts), 0, []
    edges = [total * lane // lanes for lane in range(lanes + 1)]
    for path, n in counts:
        for lane in range(lanes):
            low, high = max(edges[lane], start), min(edges[lane + 1], start + n)
            if low < high:
                out.append((lane, path, low - start, high - start))
        start += n
    return out


def _parts(batches, dims: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(source, chunk ids ascending, unit vectors) of each source in each slice of each batch, given or as :func:`_packing` saves them."""
    step = _slice_rows(dims)
    for batch in batches:
        packed = "unit" in batch.schema.names
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            rows = _unpacked(part.column("unit"), dims) if packed else unit_rows(part.column("embedding"), dims)
            ids = pc.fill_null(part.column("chunk_id"), _NULL_ID).to_numpy(zero_copy_only=False)
            sources = part.column("source").dictionary_encode()
            codes = sources.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, codes))
            for code in np.unique(codes):
                mine = order[codes[order] == code]
                yield sources.dictionary[code].as_py(), ids[mine], rows[mine]


def _scored_tiles(batches, units: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(source, chunk ids ascending, scores by chunk and query) of each part of each batch."""
    tile = max(1, _TILE // max(1, len(units)))
    for source, ids, rows in _parts(batches, units.shape[1]):
        for start in range(0, len(ids), tile):
            yield source, ids[start : start + tile], rows[start : start + tile] @ units.T


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores as they are ranked."""
    return np.round(scores, SCORE_DIGITS) + 0.0  # no negative zero


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query; ``ids`` ascend, so the first maximum wins a tie."""
    n, columns = scores.shape[0], np.arange(scores.shape[1])
    left = rounded(scores)
    top_scores = np.full((k, scores.shape[1]), -np.inf)
    top_ids = np.full((k, scores.shape[1]), _NO_CHUNK)
    for rank in range(min(k, n)):
        at = left.argmax(axis=0)
        top_scores[rank], top_ids[rank] = left[at, columns], ids[at]
        left[at, columns] = -np.inf
    return top_scores, top_ids


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int):
    """The k best of two results of :func:`_best`."""
    scores, ids = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -scores), axis=0)[:k]
    return np.take_along_axis(scores, order, axis=0), np.take_along_axis(ids, order, axis=0)


def single_error(dims: int) -> float:
    """More than a product of two vectors of length 1 is off in single precision: each term and each sum rounds once."""
    return 4 * (dims + 4) * 2.0**-24


class BestRows:
    """The k best (scores, ids) of each query so far, by rounded score, then id; ranks by queries.

    ``floors`` are scores below which a row is not wanted. ``single`` are the queries' ``units`` in single precision.
    """

    def __init__(self, units: np.ndarray, single: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.units, self.single, self.k, self.seen = units, single, k, 0
        self.scores = np.full((k, len(units)), -np.inf)
        self.ids = np.full((k, len(units)), _NO_CHUNK)
        self.floors = np.full(len(units), -np.inf) if floors is None else floors.copy()
        # a row's rounded score may be above its score by half a digit
        self.slack = 10.0**-SCORE_DIGITS + single_error(units.shape[1])

    def add(self, ids: np.ndarray, rows: np.ndarray, among: np.ndarray | None = None) -> None:
        """Rows with ascending ``ids``, for all queries or those at the places ``among``."""
        n = len(self.units) if among is None else len(among)
        single = self.single if among is None else self.single[among]
        start = 0
        while n and start < len(ids):
            step = max(1, _TILE // n)
            if among is None:  # few rows seen screen little
                step = min(step, max(_HEAD, self.seen))
                self.seen += min(step, len(ids) - start)
            self._tile(ids[start : start + step], rows[start : start + step], single, among)
            start += step

    def _tile(self, ids: np.ndarray, rows: np.ndarray, single: np.ndarray, among: np.ndarray | None) -> None:
        at = slice(None) if among is None else among
        floors = self.floors[at]
        open_ended = np.count_nonzero(np.isneginf(floors))
        if 16 * open_ended <= len(floors):
            near = np.flatnonzero(rows.astype(np.float32) @ single.T >= (floors - self.slack).astype(np.float32))
            if 16 * len(near) <= len(ids) * len(floors):
                row, column = np.divmod(near, len(floors))
                self._take(ids, rows, row, column if among is None else among[column])
                return
        # too much is left to be taken one by one
        found = _best(ids, rows @ self.units[at].T, self.k)
        self._set(at, *_merge((self.scores[:, at], self.ids[:, at]), found, self.k))

    def _take(self, ids: np.ndarray, rows: np.ndarray, row: np.ndarray, column: np.ndarray) -> None:
        exact = np.empty(len(row))
        for low in range(0, len(row), _PAIRS):
            part = slice(low, low + _PAIRS)
            exact[part] = rounded(np.einsum("ij,ij->i", rows[row[part]], self.units[column[part]]))
        own, last, last_id = ids[row], self.scores[-1, column], self.ids[-1, column]
        better = (exact > last) | ((exact == last) & (own < last_id))
        exact, own, column = exact[better], own[better], column[better]
        if not len(column):
            return
        at = np.unique(column)
        of = np.concatenate([np.repeat(at, self.k), column])
        scores = np.concatenate([self.scores[:, at].T.ravel(), exact])
        every = np.concatenate([self.ids[:, at].T.ravel(), own])
        order = np.lexsort((every, -scores, of))
        firsts = np.searchsorted(of[order], at)  # a query has k places, so k rows at least
        taken = order[firsts[:, None] + np.arange(self.k)]
        self._set(at, scores[taken].T, every[taken].T)

    def _set(self, at, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scores[:, at], self.ids[:, at] = scores, ids
        self.floors[at] = np.maximum(self.floors[at], scores[-1])


def _top_k_task(k: int) -> Callable:
    """A block's queries and Arrow batches of the store to the best k rows per query and source of a task."""
    def rows(query_ids, source, best):
        held = best.ids != _NO_CHUNK
        _, query = np.nonzero(held)
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(query)), pa.array([source] * len(query), pa.string()),
             pa.array(best.ids[held]), pa.array(best.scores[held])],
            names=["query_id", "source", "chunk_id", "score"],
        )

    def run(query_ids, units, batches):
        best: dict[str, BestRows] = {}
        single, tile = units.astype(np.float32), max(1, _TILE // max(1, len(units)))
        for source, ids, vectors in _parts(batches, units.shape[1]):
            for start in range(0, len(ids), tile):
                if source not in best:
                    best[source] = BestRows(units, single, k)
                best[source].add(ids[start : start + tile], vectors[start : start + tile])
                if len(best) * k * len(units) > _HELD:
                    # Part results are merged after the shuffle anyway.
                    yield from (rows(query_ids, name, found) for name, found in best.items())
                    best = {}
        yield from (rows(query_ids, name, found) for name, found in best.items())

    return run


def _summary_task() -> Callable:
    """A block's queries and Arrow batches of the store to one summary row per query and source of a task."""
    def rows(query_ids, source, n, low, high, total):
        return pa.RecordBatch.from_arrays(
            [query_ids, pa.array([source] * len(n), pa.string()), pa.array(n), pa.array(low), pa.array(high), pa.array(total)],
            names=["query_id", "source", "n", "low", "high", "total"],
        )

    def run(query_ids, units, batches):
        sums: dict[str, tuple[np.ndarray, ...]] = {}
        for source, ids, scores in _scored_tiles(batches, units):
            n = np.full(len(units), len(ids), dtype="int64")
            part = (n, rounded(scores.min(axis=0)), rounded(scores.max(axis=0)), scores.sum(axis=0))
            if source in sums:
                held = sums[source]
                part = (held[0] + part[0], np.minimum(held[1], part[1]), np.maximum(held[2], part[2]), held[3] + part[3])
            sums[source] = part
            if len(sums) * len(units) > _HELD:
                yield from (rows(query_ids, name, *s) for name, s in sums.items())
                sums = {}
        yield from (rows(query_ids, name, *s) for name, s in sums.items())

    return run


def vector_grid(queries: DataFrame, store: DataFrame, task_bytes: int = TASK_BYTES, kept: int = 1) -> tuple[Grid, int]:
    """The grid for scoring all pairs, and the common length of the queries' vectors.

    Both sides are counted; a vector takes 8 bytes a component. ``kept`` rows of a source are held for each query.
    """
    dims = common_length(queries)
    width = 8 * max(1, dims)
    cores = store.sparkSession.sparkContext.defaultParallelism
    room = min(max(task_bytes, 4 * width), 4 * width * max(1, _HELD // kept))
    return plan_streams(queries.count() * width, store.count() * width, room, _TASKS_A_CORE * cores), dims


def _per_block(queries: DataFrame, store: DataFrame, task: Callable, schema: T.StructType, task_bytes: int, small_bytes: int, kept: int = 1) -> DataFrame:
    """``task``, which holds ``kept`` rows per query and source, for every block of queries and part of the store, as one plan.

    Unless the queries are few, the store's scaled vectors are saved before.
    """
    rows = store.select(
        F.col("table_name").cast("string").alias("source"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding"
    )
    found = to_arrow_schema(schema)
    asked = queries.select("query_id", "embedding")
    size = F.lit(8) * F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(1)) + F.coalesce(F.octet_length(F.col("query_id").cast("string")), F.lit(0))
    held = asked.select(size.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if held <= small_bytes:  # counted: no more than this passes through the driver
        block = asked.toArrow().combine_chunks()
        dims = _dims_of(block.column("embedding"))
        ids, units = block.column("query_id").combine_chunks(), unit_rows(block.column("embedding").combine_chunks(), dims)
        shared = store.sparkSession.sparkContext.broadcast((ids, units))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(shared.value[0]):
                yield from (part.cast(found) for part in task(*shared.value, batches))

        return rows.mapInArrow(scan, schema)
    asked = written(asked, "queries")
    grid, dims = vector_grid(asked, rows, task_bytes, kept)

    packed = rows.mapInArrow(_packing(dims), _STORED)
    block_queries = -(-grid.left_bytes // (8 * max(1, dims) * grid.blocks))
    if 2 * rows.select("source").distinct().count() * kept * block_queries > _HELD:
        packed = packed.sortWithinPartitions("source")  # a task is done with most sources of a file before it passes results on
    saved = written(packed, "store-units")
    held_in = saved.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy("path")
    places = _lane_places([(r["path"], r["n"]) for r in held_in.collect()], grid.lanes)  # a row for each file and lane

    def run(_: tuple, block: pa.Table, lane: pa.Table) -> pa.Table:
        ids = block.column("query_id").combine_chunks()
        if not len(ids) or not lane.num_rows:
            return pa.Table.from_batches([], found)
        units = unit_rows(block.column("embedding").combine_chunks(), dims)
        return pa.Table.from_batches(list(task(ids, units, _stored(lane, dims))), found)

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(grid.blocks)).cast("int")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.lit(grid.lanes - 1)))
    )
    read = known_rows(store.sparkSession, places, "lane int, path string, low bigint, high bigint").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(grid.blocks - 1)))
    )
    # The work follows the pairs, not the bytes: partitions that were merged by their bytes would leave cores idle.
    tasks = min(grid.blocks * grid.lanes, _MOST_PARTITIONS)
    dealt, read = dealt.repartition(tasks, "block", "lane"), read.repartition(tasks, "block", "lane")
    return dealt.groupBy("block", "lane").cogroup(read.groupBy("block", "lane")).applyInArrow(run, schema)


def _dims_of(vectors: pa.ChunkedArray) -> int:
    """:func:`common_length` of vectors at hand."""
    sizes = pc.drop_null(pc.list_value_length(vectors)).to_numpy()
    sizes, counts = np.unique(sizes[sizes > 0], return_counts=True)
    return int(sizes[counts == counts.max()].max()) if len(sizes) else 0


def topk_per_source(queries: DataFrame, store: DataFrame, k: int = TOP_K, task_bytes: int = TASK_BYTES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The k best chunks of every source for every query: query_id, source, rank, chunk_id, score.

    ``queries`` has query_id and embedding; ``store`` has table_name, chunk_id and embedding. Vectors without
    a direction in the queries' space score 0.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("source", T.StringType()),
            T.StructField("chunk_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "chunk_id")
    found = _per_block(queries, store, _top_k_task(k), schema, task_bytes, small_bytes, k)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_overall(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best of each query's per-source hits."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve_topk(queries: DataFrame, store: DataFrame, k: int = TOP_K, task_bytes: int = TASK_BYTES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The k best chunks of each query over all sources."""
    return best_overall(topk_per_source(queries, store, k, task_bytes, small_bytes), k)


def score_summary(queries: DataFrame, store: DataFrame, task_bytes: int = TASK_BYTES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """How every query scores against all chunks of every source: count, min, max and mean score.

    Every pair is scored; what leaves a task is one row per query and source.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("source", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
            T.StructField("total", T.DoubleType()),
        ]
    )

    found = _per_block(queries, store, _summary_task(), schema, task_bytes, small_bytes)
    return found.groupBy("query_id", "source").agg(
        F.sum("n").alias("n_pairs"),
        F.min("low").alias("min_score"),
        F.max("high").alias("max_score"),
        F.round(F.sum("total") / F.sum("n"), 6).alias("mean_score"),
    )


def retrieve_fallback(store: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first k chunks of each table, without score: for queries that have no vector.

    The row-number filter becomes a group limit on the map side, so k rows per table and task are
    shuffled.
    """
    order = Window.partitionBy("source").orderBy("chunk_id")
    return (
        store.select(F.col("table_name").cast("string").alias("source"), "chunk_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("score", F.lit(None).cast("double"))
    )


def retrieve_contexts(queries: DataFrame, store: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best chunks of each query; a query without a vector gets the first k of every table.

    The fallback rows, k per table, are a frame that the queries without a vector are joined with behind a size check.
    """
    has_vector = F.coalesce(F.size("embedding") > 0, F.lit(False))
    found = retrieve_topk(queries.where(has_vector), store, k)
    first = retrieve_fallback(store, k).select("source", "chunk_id", F.col("rank").alias("__i"))
    numbered = written(with_row_index(first, ["source", "__i"], "__position"), "fallback")
    every = broadcast_if_small(numbered.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(LIST_COPIES - 1)))))
    copy = F.pmod(F.xxhash64("query_id"), F.lit(LIST_COPIES)).cast("int").alias("__copy")
    listed = queries.where(~has_vector).select("query_id", copy).join(every, "__copy").select(
        "query_id", "source", "chunk_id", F.lit(None).cast("double").alias("score"), (F.col("__position") + 1).cast("int").alias("rank")
    )
    return found.unionByName(listed)


def with_chunk_text(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Hits with their text, read only after the ranking; ``store`` has each chunk once, as :func:`refresh_store` returns it.

    The hits are saved and counted first: a short list is broadcast so that the store is scanned in
    place, a long one is joined by shuffle.
    """
    saved = written(hits, "hits")
    texts = store.select(F.col("table_name").alias("source"), "chunk_id", "chunk_text")
    return texts.join(broadcast_if_small(saved), ["source", "chunk_id"])


def context_text(hits: DataFrame) -> DataFrame:
    """``From {source}: {text}`` lines of each query, best first; k lines at most."""
    line = F.concat(F.lit("From "), "source", F.lit(": "), "chunk_text")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), line.alias("line"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context")
    )


def route_tables(best: DataFrame, threshold: float) -> DataFrame:
    """The tables a query concerns: those whose best chunk reaches the threshold, else all.

    ``best`` is :func:`topk_per_source` with k = 1, so a query has one row per table.
    """
    top = F.max("score").over(Window.partitionBy("query_id"))
    return (
        best.withColumn("__top", top)
        .where((F.col("score") >= threshold) | (F.col("__top") < threshold))
        .select("query_id", "source", "score")
    )
