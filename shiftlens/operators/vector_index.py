"""Exact retrieval that opens only a part of the store: an index of cells with angular radii.

Cells are made of a bounded sample by spherical k-means; then every stored vector goes to the cell whose
centre is nearest in angle, and each cell keeps the largest angle of its members to the centre. A
query's angle to the centre less that radius bounds the cosine with anything in the cell from above. The
queries first score the cells with the best bounds; then blocks of queries meet lanes of cells (``plans.grid``), and a
task scores only cells whose bound is not below a query's ``k``-th score so far, so no list of queries and
cells is made. What remains cannot hold a hit, so the result is that of the full search, row for
row, for any data; how much is left out depends on how the vectors cluster, and is reported.

The index is saved in a folder: ``members`` by cell, cut into pieces of limited size, and ``cells``.
Vectors that score 0 with everything (missing, empty, zero, not finite or of another length) are a cell of
their own with the bound 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.functions.fixed import TOP_K
from shiftlens.operators.retrieval import SCORE_DIGITS, BestRows, common_length, rounded, unit_rows
from shiftlens.plans.grid import TASK_BYTES, plan_grid
from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: The sample that centres are made of, in rows and bytes, and the bytes of all centres: what reaches the driver
#: and every task does not grow with the store.
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 16 << 20
CENTRE_BYTES = 8 << 20
#: Rows that a cell should hold, cells at most, rounds of k-means.
CELL_ROWS = 512
MAX_CELLS = 4096
ROUNDS = 8
#: Stored rows of a piece and queries of a block: what a task holds at once.
PIECE_ROWS = 16_384
BLOCK_QUERIES = 16_384
#: Cells that a query scores before its bound is known.
FIRST_CELLS = 2
#: Angles are kept wider than worked out by this much, far more than they are wrong by.
SLACK = 1e-6

#: The cell of vectors without a direction.
APART = -1
_TILE = 2_000_000
_MEMBERS = "cell bigint, source string, chunk_id bigint, unit array<double>"
_FOUND = "query bigint, source string, chunk_id bigint, score double"
_TARGETS = "query bigint, unit array<double>, cells array<bigint>"


@dataclass
class VectorIndex:
    """A saved index; ``centres`` and ``radii`` of all cells are small enough for every task."""

    path: str
    dims: int
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    apart: int

    def members(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_MEMBERS}, piece int").parquet(f"{self.path}/members")

    @property
    def rows(self) -> int:
        return int(self.counts.sum()) + self.apart


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to each vector."""
    step = max(1, _TILE // len(centres))
    return np.concatenate([(units[low : low + step] @ centres.T).argmax(axis=1) for low in range(0, max(1, len(units)), step)])


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(3)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        home = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def build_index(store: DataFrame, path: str, cell_rows: int = CELL_ROWS) -> VectorIndex:
    """Index ``store`` (``table_name, chunk_id, embedding``) in the folder ``path``.

    The common length of its vectors is that of the index; every row is in it, in the cell apart if its
    vector has no direction in that space.
    """
    spark = store.sparkSession
    rows = store.select(F.col("table_name").cast("string").alias("source"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    dims = common_length(rows)
    wanted = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * max(1, dims))))
    picked = rows.where(F.size("embedding") == dims).orderBy(F.xxhash64("source", "chunk_id"), "source", "chunk_id").limit(wanted)
    sample = unit_rows(picked.select("embedding").toArrow().column(0).combine_chunks(), dims) if dims else np.zeros((0, 0))
    sample = sample[(sample != 0).any(axis=1)]
    total = rows.count()
    cells = min(MAX_CELLS, max(1, total // cell_rows), max(1, CENTRE_BYTES // (8 * max(1, dims))))
    centres = _centres(sample, cells) if len(sample) else np.zeros((0, dims))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(batch.column("embedding"), dims)
            cell = np.full(len(units), APART)
            pointed = (units != 0).any(axis=1)
            if len(centres):
                cell[pointed] = _nearest(units[pointed], centres)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("source"), batch.column("chunk_id"), _lists(units)], names=["cell", "source", "chunk_id", "unit"])

    placed = written(rows.mapInArrow(place, _MEMBERS), "index-rows")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii, counts = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            counts += np.bincount(np.where(cell == APART, len(centres), cell), minlength=len(counts))
            pointed = cell != APART
            if pointed.any():
                units = _matrix(batch.column("unit"), dims)[pointed]
                far = np.arccos(np.clip((units * centres[cell[pointed]]).sum(axis=1), -1, 1))
                np.maximum.at(radii, cell[pointed], far)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen]), pa.array(radii[seen])], names=["at", "n", "radius"])

    parts = placed.select("cell", "unit").mapInArrow(measure, "at bigint, n bigint, radius double")
    facts = parts.groupBy("at").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # a row for each cell
    counts, radii = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres) + 1)
    for r in facts:
        counts[r["at"]], radii[r["at"]] = r["n"], r["radius"]
    pieces = spark.createDataFrame([(i if i < len(centres) else APART, -(-int(n) // PIECE_ROWS)) for i, n in enumerate(counts)], "cell bigint, pieces int")
    cut = placed.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("source", "chunk_id"), "pieces").cast("int")).drop("pieces")
    cut.repartition("cell", "piece").sortWithinPartitions("cell", "piece").write.parquet(f"{path}/members")
    table = [(i, centres[i].tolist(), float(radii[i]), int(counts[i])) for i in range(len(centres))] + [(APART, [0.0] * dims, 0.0, int(counts[-1]))]
    spark.createDataFrame(table, "cell bigint, centre array<double>, radius double, n bigint").coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(path, dims, centres, radii[:-1], counts[:-1], int(counts[-1]))


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that :func:`build_index` has saved."""
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS rows at most, and one
    apart, cells = table[0], table[1:]
    dims = len(apart["centre"])
    return VectorIndex(
        path, dims, np.array([c["centre"] for c in cells]).reshape(-1, dims), np.array([c["radius"] for c in cells]),
        np.array([c["n"] for c in cells], np.int64), apart["n"],
    )


def upper_bounds(index: VectorIndex, units: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """For each query and cell, last the cell apart, no lower than the rounded score of any member; or for the given cells alone."""
    at = np.arange(len(index.centres) + 1) if cells is None else np.where(cells == APART, len(index.centres), cells)
    out = np.empty((len(units), len(at)))
    apart = at == len(index.centres)
    out[:, apart] = 0.0 if index.apart else -np.inf
    at = at[~apart]
    if len(at):
        near = np.cos(np.maximum(0, angles(units, index.centres[at]) - index.radii[at] - SLACK))
        near = np.where(index.counts[at] > 0, near + 10.0**-SCORE_DIGITS, -np.inf)
        zero = ~(units != 0).any(axis=1)
        out[:, ~apart] = np.where(zero[:, None] & (index.counts[at] > 0), 0.0, near)
    return out


def _targets(index: VectorIndex, queries: DataFrame, first: int) -> DataFrame:
    """Each query with the ``first`` cells by bound."""
    step = max(1, _TILE // (len(index.centres) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                bounds = upper_bounds(index, _matrix(part.column("unit"), index.dims))
                order = np.argsort(-bounds, axis=1, kind="stable")[:, :first]
                usable = np.isfinite(np.take_along_axis(bounds, order, axis=1))
                cells = np.where(order == len(index.centres), APART, order)[usable].astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(usable.sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells))
                yield pa.RecordBatch.from_arrays([part.column("query"), part.column("unit"), lists], names=["query", "unit", "cells"])

    return queries.mapInArrow(run, _TARGETS)


def _best(queries: pa.Table, members: pa.Table, dims: int, k: int) -> pa.Table:
    """Each query's ``k`` best members by rounded score, source and chunk id."""
    members = members.sort_by([("source", "ascending"), ("chunk_id", "ascending")])
    rows, asked = _matrix(members.column("unit"), dims), queries.column("query").to_numpy()
    units = _matrix(queries.column("unit"), dims)
    found: tuple[list, list, list] = ([], [], [])
    step = max(1, _TILE // max(1, len(rows)))
    for low in range(0, len(units), step):
        left = rounded(units[low : low + step] @ rows.T)
        lines = np.arange(len(left))
        for _ in range(min(k, len(rows))):
            at = left.argmax(axis=1)  # the first of equal scores
            for out, values in zip(found, (asked[low : low + step], at, left[lines, at]), strict=True):
                out.append(values.copy())
            left[lines, at] = -np.inf
    at = np.concatenate(found[1])
    taken = members.select(["source", "chunk_id"]).take(pa.array(at))
    return pa.Table.from_arrays([pa.array(np.concatenate(found[0])), taken.column(0), taken.column(1), pa.array(np.concatenate(found[2]))], names=["query", "source", "chunk_id", "score"])


def _scored(index: VectorIndex, targets: DataFrame, k: int) -> DataFrame:
    """The ``k`` best members of every piece of a target's cell; queries of a cell are cut into blocks of limited size."""
    schema = pa.schema([("query", pa.int64()), ("source", pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64())])
    dims = index.dims

    def run(_: tuple, queries: pa.Table, members: pa.Table) -> pa.Table:
        return _best(queries, members, dims, k).cast(schema) if queries.num_rows and members.num_rows else schema.empty_table()

    asked = {r["cell"]: r["count"] for r in targets.groupBy("cell").count().collect()}  # a row for each cell
    counts = [*enumerate(index.counts), (APART, index.apart)]
    shape = [(int(i), max(1, -(-int(n) // PIECE_ROWS)), -(-asked[i] // BLOCK_QUERIES)) for i, n in counts if i in asked]
    cut = F.broadcast(targets.sparkSession.createDataFrame(shape, "cell bigint, pieces int, blocks int"))
    dealt = targets.join(cut, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int")).drop("pieces", "blocks")
    copies = index.members(targets.sparkSession).join(cut, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("pieces", "blocks")
    keys = ["cell", "piece", "block"]
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(run, _FOUND)


def _lane_best(index: VectorIndex, queries: pa.Table, members: pa.Table, k: int) -> tuple[pa.Table, int]:
    """Each query's ``k`` best members of the cells that can hold one and are not among its ``cells``, and how many pairs were scored."""
    units = _matrix(queries.column("unit"), index.dims)
    known, lists = queries.column("floor").to_numpy(), queries.column("cells").combine_chunks()
    passed, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(units)), np.diff(lists.offsets.to_numpy()))
    members = members.sort_by([("source", "ascending"), ("chunk_id", "ascending")])
    rows, cell = _matrix(members.column("unit"), index.dims), members.column("cell").to_numpy()
    best, scored = BestRows(units, units.astype(np.float32), k, known), 0
    step = max(1, _TILE // len(units))
    cells = np.unique(cell)
    for low in range(0, len(cells), step):
        bounds = upper_bounds(index, units, cells[low : low + step])
        for i, c in enumerate(cells[low : low + step]):
            wanted = bounds[:, i] >= best.floors
            wanted[of[passed == c]] = False
            asking, at = np.flatnonzero(wanted), np.flatnonzero(cell == c)
            best.add(at, rows[at], asking)
            scored += len(asking) * len(at)
    held = best.ids < len(rows)
    _, query = np.nonzero(held)
    taken = members.select(["source", "chunk_id"]).take(pa.array(best.ids[held]))
    return pa.table([queries.column("query").take(pa.array(query)), taken.column(0), taken.column(1), pa.array(best.scores[held])], names=["query", "source", "chunk_id", "score"]), scored


def _others(index: VectorIndex, queries: DataFrame, k: int, n: int) -> DataFrame:
    """The best members of all cells but the first of each query; ``scored``, on a row of its own for each task, counts pairs.

    ``queries`` has ``query, unit, cells, floor``: the cells that were scored and the score that a hit must reach.
    """
    schema = pa.schema([("query", pa.int64()), ("source", pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64()), ("scored", pa.int64())])
    spark, width = queries.sparkSession, 8 * max(1, index.dims)
    grid = plan_grid(n * width, index.rows * width, max(TASK_BYTES, 4 * width), spark.sparkContext.defaultParallelism)

    def run(_: tuple, block: pa.Table, lane: pa.Table) -> pa.Table:
        if not block.num_rows or not lane.num_rows:
            return schema.empty_table()
        found, scored = _lane_best(index, block, lane, k)
        found = found.append_column("scored", pa.nulls(found.num_rows, pa.int64())).cast(schema)
        return pa.concat_tables([found, pa.Table.from_pylist([{"scored": scored}], schema)])

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(grid.blocks)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(grid.lanes - 1))))
    spread = index.members(spark).withColumn("lane", F.pmod(F.xxhash64("cell", "piece"), F.lit(grid.lanes)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(grid.blocks - 1))))
    return dealt.groupBy("block", "lane").cogroup(spread.groupBy("block", "lane")).applyInArrow(run, f"{_FOUND}, scored bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "source", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_index(index: VectorIndex, queries: DataFrame, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best chunks of each query, as :func:`retrieve_topk` ranks them, and what was scored.

    ``queries`` has ``query_id`` and ``embedding``. The second frame has one row: queries, stored chunks, pairs that
    were scored and their share of all pairs.
    """
    spark, dims = queries.sparkSession, index.dims

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("query"), _lists(unit_rows(batch.column("embedding"), dims))], names=["query", "unit"])

    named = written(queries.select(F.monotonically_increasing_id().alias("query"), "query_id", "embedding"), "queries")
    asked = written(named.select("query", "embedding").mapInArrow(units, "query bigint, unit array<double>"), "query-units")
    n = asked.count()
    nearest = written(_targets(index, asked, FIRST_CELLS), "first-cells")
    targets = nearest.select("query", F.explode("cells").alias("cell"), "unit")
    first = written(_ranked(_scored(index, targets, k), k), "first-hits")
    floors = first.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    known = nearest.join(broadcast_if_small(floors), "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    others = written(_others(index, known, k, n), "other-hits")
    hits = _ranked(first.drop("rank").unionByName(others.where("query is not null").drop("scored")), k)
    sizes = spark.createDataFrame([(int(i), int(c)) for i, c in [*enumerate(index.counts), (APART, index.apart)]], "cell bigint, n bigint")
    visited = targets.groupBy("cell").agg(F.count("*").alias("q")).join(F.broadcast(sizes), "cell").select((F.col("q") * F.col("n")).alias("pairs"))
    visited = visited.unionByName(others.select(F.col("scored").alias("pairs")))
    pairs = F.coalesce(F.sum("pairs"), F.lit(0))
    report = visited.agg(pairs.alias("n_scored")).select(
        F.lit(n).cast("bigint").alias("n_queries"), F.lit(index.rows).cast("bigint").alias("n_chunks"), "n_scored",
        F.when(F.lit(n * index.rows > 0), F.col("n_scored") / F.lit(float(max(1, n * index.rows)))).alias("share"),
    )
    return hits.join(named.select("query", "query_id"), "query").select("query_id", "source", "rank", "chunk_id", "score"), report


def retrieve_indexed(queries: DataFrame, index: VectorIndex, k: int = TOP_K) -> DataFrame:
    """The ``k`` best chunks of each query over all sources, found in the index: what :func:`retrieve_topk` gives."""
    return search_index(index, queries, k)[0]
