"""Approximate nearest neighbours by cosine: a neighbour graph from NN-descent, and greedy search in it.

Equal vectors are one node. The graph begins with the best neighbours inside the cells of a few random
hyperplane partitions; a cell that is still large is cut by further planes, through its own medians.
Rounds go on until hardly a link changes (``TOLERANCE``). Each round of NN-descent joins a node's neighbours, reverse ones included, with
their vectors: they are compared among themselves, and what beats a node's worst neighbour replaces
it. A query walks the graph from its own node and from ``ENTRIES`` nodes of its length chosen by hash, so
that a node that the graph ties to nothing, or to a few, still meets the others: its best unexpanded
nodes are joined with their neighbours until none is left among the best ``beam``. The graph covers every vector; scores are made anew on the original
vectors at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.plans.scratch import fresh_path, written
from shiftlens.plans.sizing import broadcast_if_small

#: Vectors compared with each other in a cell at the start.
CELL = 512
#: Rounds of NN-descent go on until one changes no more than this share of the links.
TOLERANCE = 0.01
#: Nodes of each length that every search of that length also starts from. A length with no more nodes
#: than this is compared whole.
ENTRIES = 32


def _unit(df: DataFrame) -> DataFrame:
    """``node, dims, vec``: each different vector once, at unit length in 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(pc.list_value_length(column).to_numpy())
            parts = [flat[a:z] for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)] if len(ends) else []
            vec = []
            for p in parts:
                p = p / np.abs(p).max()  # no overflow in the squares
                vec.append((p / np.sqrt(p @ p)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("dims"), pa.array(vec, pa.binary())], ["node", "dims", "vec"])

    return df.mapInArrow(run, "node bigint, dims int, vec binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of some candidates, each id once, best first, ties to the smaller id."""
    order = np.lexsort((-scores, ids))
    ids, scores = ids[order], scores[order]
    fresh = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    ids, scores = ids[fresh], scores[fresh]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _graph_batch(nodes, ids: list[np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), _lists(ids, pa.int64()), _lists(scores, pa.float32())], ["node", "ids", "scores"]
    )


_GRAPH = "node bigint, ids array<bigint>, scores array<float>"


def _cells(points: DataFrame, trees: int, k: int, seed: int) -> DataFrame:
    """The best neighbours of each node inside its cells, one row per node and partition.

    Each length has as many planes as its own number of nodes asks for.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            out = []
            planned = batch.column("levels").to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                levels = int(planned[rows[0]])
                vec = np.stack([np.frombuffer(batch.column("vec")[int(r)].as_py(), np.float32) for r in rows])
                for tree in range(trees):
                    planes = np.random.default_rng([seed, tree, int(d)]).normal(size=(int(d), levels)).astype(np.float32)
                    code = ((vec @ planes) > 0) @ (1 << np.arange(levels, dtype=np.int64)) if levels else np.zeros(len(rows), np.int64)
                    out += [(tree, int(d), int(c), int(r)) for c, r in zip(code, rows, strict=True)]
            take = pa.array([r for _, _, _, r in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _, _, _ in out], pa.int32()), pa.array([d for _, d, _, _ in out], pa.int32()),
                    pa.array([c for _, _, c, _ in out], pa.int64()), batch.column("node").take(take), batch.column("vec").take(take),
                ],
                ["tree", "dims", "code", "node", "vec"],
            )

    def join(key: tuple, group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        vec = np.stack([np.frombuffer(v.as_py(), np.float32) for v in group["vec"]])
        ids, scores = [], []
        most = min(k, len(node) - 1)
        for low in range(0, len(node), 1024):
            s = vec[low : low + 1024] @ vec.T
            s[np.arange(len(s)), low + np.arange(len(s))] = -2
            if not most:
                ids += [np.zeros(0, np.int64)] * len(s)
                scores += [np.zeros(0, np.float32)] * len(s)
                continue
            top = np.argpartition(-s, most - 1, axis=1)[:, :most]
            ids += list(node[top])
            scores += list(np.take_along_axis(s, top, 1))
        return pa.Table.from_batches([_graph_batch(node, ids, scores)])

    levels = F.greatest(F.lit(0.0), F.ceil(F.log2(F.count("*") / F.lit(float(CELL))))).cast("int").alias("levels")
    planned = points.join(broadcast_if_small(points.groupBy("dims").agg(levels)), "dims")
    placed = written(planned.mapInArrow(place, "tree int, dims int, code bigint, node bigint, vec binary"), "cells")
    parted = _parted(placed, seed).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / F.lit(2.0 * CELL)).cast("int")))
    return parted.groupBy("tree", "dims", "code", "part").applyInArrow(join, _GRAPH)


def _parted(placed: DataFrame, seed: int) -> DataFrame:
    """``tree, dims, code, node, vec, n``: cells of over ``2 * CELL`` nodes cut by planes through their medians.

    A cell that four planes do not part by a tenth holds vectors that are all but equal; it keeps its
    ``n`` over the bound.
    """
    cell, bound = ["tree", "dims", "code"], 2 * CELL
    columns = [*cell, "node", "vec", "n"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, dims, turns = (batch.column(c).to_numpy() for c in ("tree", "dims", "turn"))
            out = np.zeros((batch.num_rows, 4))
            for t, d, turn in {*zip(tree.tolist(), dims.tolist(), turns.tolist(), strict=True)}:
                rows = np.flatnonzero((tree == t) & (dims == d))
                planes = np.random.default_rng([seed, t, d, turn]).normal(size=(d, 4))
                packs = batch.column("vec").take(pa.array(rows)).to_pylist()
                out[rows] = np.frombuffer(b"".join(packs), np.float32).reshape(len(rows), d) @ planes
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(out[:, i]) for i in range(4))], [*columns, *sides])

    sides = [f"s{i}" for i in range(4)]
    kind = "tree int, dims int, code bigint, node bigint, vec binary, n bigint, " + ", ".join(f"{c} double" for c in sides)
    parts, turn = [], 0
    hot = placed.withColumn("was", F.lit(None).cast("bigint"))
    while True:
        sizes = written(hot.groupBy(*cell, "was").agg(F.count("*").alias("n")), "sizes")
        stays = (F.col("n") <= bound) | F.coalesce(F.col("n") > 0.9 * F.col("was"), F.lit(False))
        sized = hot.drop("was").join(broadcast_if_small(sizes.select(*cell, "n", stays.alias("stays"))), cell)
        parts.append(sized.where("stays").select(columns))
        if sizes.where(~stays).isEmpty():
            return functools.reduce(DataFrame.unionByName, parts)
        turn += 1
        cast = written(sized.where("not stays").withColumn("turn", F.lit(turn)).mapInArrow(project, kind), "sides")
        middle = cast.groupBy(*cell).agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"m{c}") for c in sides))
        bits = [(F.col(c) > F.col(f"m{c}")).cast("int") for c in sides]
        hot = cast.join(broadcast_if_small(middle), cell).withColumn("code", F.xxhash64("code", *bits)).select(*cell, "node", "vec", F.col("n").alias("was"))
        hot = written(hot, "cells")


def _merged(candidates: DataFrame, k: int) -> DataFrame:
    """One row per node with its ``k`` best neighbours of all rows for it, and how many no ``old`` row had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_ids, out_scores, changed = [], [], []
            for rows in batch.column("rows"):
                lists = rows.values
                one = lists.field("ids").flatten().to_numpy(zero_copy_only=False)
                two = lists.field("scores").flatten().to_numpy(zero_copy_only=False)
                had = lists.filter(lists.field("old")).field("ids").flatten().to_numpy(zero_copy_only=False)
                best = _best(one, two, k)
                out_ids.append(best[0])
                out_scores.append(best[1])
                changed.append(int((~np.isin(best[0], had)).sum()))
            if len(out_ids):
                yield _graph_batch(batch.column("node"), out_ids, out_scores).append_column("changed", pa.array(changed, pa.int64()))

    gathered = candidates.groupBy("node").agg(F.collect_list(F.struct("ids", "scores", "old")).alias("rows"))
    return gathered.mapInArrow(run, f"{_GRAPH}, changed bigint")


def _links(graph: DataFrame, reverse: int) -> DataFrame:
    """``node, other``: neighbours, and for each node the ``reverse`` best of those that name it."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.scores").alias("score"))
    order = Window.partitionBy("other").orderBy(F.col("score").desc(), "node")
    back = edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reverse)
    return edges.select("node", "other").unionByName(back.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def _round(graph: DataFrame, small: DataFrame, k: int, reverse: int, per_list: int) -> DataFrame:
    """One round of NN-descent: neighbours of a node are compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids, scores = [], [], []
            for members in batch.column("members"):
                rows = members.values
                name = rows.field("other").to_numpy(zero_copy_only=False)
                worst = rows.field("worst").to_numpy(zero_copy_only=False)
                scale = rows.field("scale").to_numpy(zero_copy_only=False)
                packs = [np.frombuffer(v, np.int8) for v in rows.field("vec").to_pylist()]
                if len({len(p) for p in packs}) > 1:
                    continue
                vec = np.stack(packs).astype(np.float32) * scale[:, None]
                s = vec @ vec.T
                np.fill_diagonal(s, -2)
                if s.shape[0] > per_list:
                    top = np.argpartition(-s, per_list - 1, axis=1)[:, :per_list]
                else:
                    top = np.tile(np.arange(s.shape[0]), (s.shape[0], 1))
                value = np.take_along_axis(s, top, 1)
                better = value > worst[:, None]
                for r in np.flatnonzero(better.any(1)):
                    nodes.append(name[r])
                    ids.append(name[top[r][better[r]]])
                    scores.append(value[r][better[r]])
            if nodes:
                yield _graph_batch(nodes, ids, scores)

    worst = graph.select(F.col("node").alias("other"), F.when(F.size("scores") >= k, F.array_min("scores")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    known = small.withColumnRenamed("node", "other").join(worst, "other")
    around = _links(graph, reverse).unionByName(graph.select("node", F.col("node").alias("other")))
    lists = around.join(known, "other").groupBy("node").agg(F.collect_list(F.struct("other", "worst", "scale", "vec")).alias("members"))
    found = lists.select("members").mapInArrow(run, _GRAPH)
    return _merged(graph.withColumn("old", F.lit(True)).unionByName(found.withColumn("old", F.lit(False))), k)


def _small(points: DataFrame) -> DataFrame:
    """``node, scale, vec`` with 8 bits a component: enough to build the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scales, packs = [], []
            for v in batch.column("vec"):
                one = np.frombuffer(v.as_py(), np.float32)
                step = max(float(np.abs(one).max()) / 127, 1e-30)
                scales.append(step)
                packs.append(np.rint(one / step).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(scales, pa.float32()), pa.array(packs, pa.binary())], ["node", "scale", "vec"])

    return points.mapInArrow(run, "node bigint, scale float, vec binary")


def neighbour_graph(points: DataFrame, k: int = 24, trees: int = 4, rounds: int | None = None, reverse: int = 12, per_list: int = 6, seed: int = 8) -> DataFrame:
    """``node, ids, scores``: up to ``k`` near neighbours of each node of ``points`` (``node, dims, vec``).

    Rounds end when one changes no more than ``TOLERANCE`` of the links, or after ``rounds`` if a caller bounds them.
    """
    count = points.count()
    graph = written(_merged(_cells(points, trees, k, seed).withColumn("old", F.lit(False)), k).drop("changed"), "graph")
    if count <= CELL:
        return graph  # every pair has been compared
    small = written(_small(points), "small")
    turn, changed = 0, 1.0
    while turn != rounds and changed > TOLERANCE:
        fresh = written(_round(graph, small, k, reverse, per_list), "graph")
        moved = fresh.agg(F.sum("changed").alias("changed"), F.sum(F.size("ids")).alias("links")).first()
        graph, changed = fresh.drop("changed"), moved["changed"] / max(1, moved["links"])
        turn += 1
        points.sparkSession.sparkContext._jvm.System.gc()  # the driver lets go of the round's plans and shuffles
    return graph


_STATE = "q bigint, vec binary, ids array<bigint>, scores array<float>, done array<boolean>, seen binary"


def _entries(points: DataFrame, entries: int) -> DataFrame:
    """``dims, node, vec``: the ``entries`` nodes of each length with the smallest hashes."""
    order = Window.partitionBy("dims").orderBy(F.xxhash64("node", F.lit("entry")), "node")
    chosen = points.select("dims", "node").withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries)
    return points.join(broadcast_if_small(chosen.select("node")), "node").select("dims", "node", "vec")


def _walk(graph: DataFrame, points: DataFrame, queries: DataFrame, reverse: int, beam: int, rounds: int | None, entries: int = ENTRIES) -> DataFrame:
    """``q, ids``: the best nodes that greedy search finds for each query node (``q``), itself included.

    Each round expands every open node of every beam. A query with none left is done and leaves the
    state, so late rounds carry only the queries that still move; the walk ends when none does, or
    after ``rounds`` if a caller bounds it.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, scores = [], []
            for q, vec, name, other in zip(*(batch.column(c) for c in ("q", "vec", "entry", "other")), strict=True):
                one = np.frombuffer(vec.as_py(), np.float32)
                every = name.values.to_numpy(zero_copy_only=False) if name.is_valid else np.zeros(0, np.int64)
                worth = np.frombuffer(b"".join(other.as_py() or ()), np.float32).reshape(len(every), len(one)) @ one
                here = every != q.as_py()
                every, worth = np.r_[q.as_py(), every[here]], np.r_[np.float32(1), worth[here]]
                order = np.r_[0, 1 + np.lexsort((every[1:], -worth[1:]))][:beam]
                ids.append(every[order])
                scores.append(worth[order])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("q"), batch.column("vec"), _lists(ids, pa.int64()), _lists(scores, pa.float32()),
                    _lists([np.zeros(len(i), bool) for i in ids], pa.bool_()), pa.array([i.astype(np.uint32).tobytes() for i in ids], pa.binary()),
                ],
                _NAMES,
            )

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours of what is expanded now that the query has not met yet."""
        for batch in batches:
            qs, found = [], []
            for q, seen, near in zip(batch.column("q").to_numpy(), batch.column("seen"), batch.column("near"), strict=True):
                ids = np.unique(near.values.flatten().to_numpy(zero_copy_only=False))
                ids = ids[~np.isin(ids.astype(np.uint32), np.frombuffer(seen.as_py(), np.uint32))]
                qs.append(np.full(len(ids), q, np.int64))
                found.append(ids)
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(found), pa.int64())], ["q", "node"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (b"".join(batch.column(c).to_pylist()) for c in ("vec", "qvec"))
            same = batch.column("same").to_numpy(zero_copy_only=False)
            width = batch.column("dims").to_numpy()
            value = np.full(batch.num_rows, -2, np.float32)
            if len(np.unique(width)) == 1 and same.all():
                shape = (batch.num_rows, int(width[0]))
                value = np.einsum("ij,ij->i", np.frombuffer(one, np.float32).reshape(shape), np.frombuffer(two, np.float32).reshape(shape))
            else:
                for r in np.flatnonzero(same):
                    value[r] = np.frombuffer(batch.column("vec")[int(r)].as_py(), np.float32) @ np.frombuffer(batch.column("qvec")[int(r)].as_py(), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(value, pa.float32())], ["q", "node", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores, done, seen = [], [], [], []
            for i in range(batch.num_rows):
                old, value, was = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "scores", "done"))
                met = batch.column("seen")[i].as_py()
                new = batch.column("new")[i].values
                add = new.field("node").to_numpy(zero_copy_only=False) if new is not None else np.zeros(0, np.int64)
                gain = new.field("score").to_numpy(zero_copy_only=False) if new is not None else np.zeros(0, np.float32)
                every, worth = np.concatenate([old, add]), np.concatenate([value, gain])
                state = np.concatenate([np.ones(len(old), bool), np.zeros(len(add), bool)])
                order = np.lexsort((every, -worth))[:beam]
                ids.append(every[order])
                scores.append(worth[order])
                done.append(state[order])
                seen.append(met + add.astype(np.uint32).tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q"), batch.column("vec"), _lists(ids, pa.int64()), _lists(scores, pa.float32()), _lists(done, pa.bool_()), pa.array(seen, pa.binary())],
                    _NAMES,
                )

    adjacent = written(_links(graph, reverse).groupBy("node").agg(F.collect_list("other").alias("near")), "adjacent")
    spark = points.sparkSession
    ended = fresh_path(spark, "walked")
    doors = written(_entries(points, entries).groupBy("dims").agg(F.collect_list("node").alias("entry"), F.collect_list("vec").alias("other")), "entries")
    state = written(queries.join(broadcast_if_small(doors, 1000), "dims", "left").mapInArrow(begin, _STATE), "walk")
    vectors = broadcast_if_small(queries.select("q", F.col("vec").alias("qvec"), F.col("dims").alias("qdims")), 50_000)
    moves, turn = F.exists("done", lambda d: ~d), 0
    while True:
        moving = state.where(moves)
        last = turn == rounds or moving.isEmpty()
        (state if last else state.where(~moves)).select("q", "ids").write.parquet(f"{ended}/turn={turn}")
        if last:
            break
        open_ends = moving.select("q", F.explode(F.arrays_zip("ids", "done")).alias("e")).where("not e.done").select("q", F.col("e.ids").alias("node"))
        near = open_ends.join(adjacent, "node").groupBy("q").agg(F.collect_list("near").alias("near"))
        pairs = near.join(moving.select("q", "seen"), "q").mapInArrow(fresh, "q bigint, node bigint")
        measured = pairs.join(points, "node").join(vectors, "q").select("q", "node", "dims", "vec", "qvec", (F.col("dims") == F.col("qdims")).alias("same"))
        scored = measured.mapInArrow(score, "q bigint, node bigint, score float")
        new = scored.groupBy("q").agg(F.collect_list(F.struct("node", "score")).alias("new"))
        state = written(moving.join(new, "q", "left").mapInArrow(merge, _STATE), "walk")
        turn += 1
        spark.sparkContext._jvm.System.gc()  # the driver lets go of the round's broadcasts, plans and shuffles
    return spark.read.schema("q bigint, ids array<bigint>").parquet(ended).select("q", "ids")


_NAMES = ["q", "vec", "ids", "scores", "done", "seen"]


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, graph_k: int = 24, rounds: int | None = None, beam: int = 256, walk: int | None = None, reverse: int = 12
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row whose ``vec_id`` divides by ``every``.

    ``vectors`` has ``vec_id`` and ``embedding``. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without a ``vec_id``; vectors of another length are
    no candidates for a query. Repeated rows count once. Scores are cosines in double precision on the
    original vectors; ties go to the smaller ``vec_id``, also among any number of equal vectors, of
    which each needs only its ``k + 1`` smallest ids. Fewer candidates give fewer rows. Searches go on
    until their ``beam`` holds no unexpanded node; only a caller's ``walk`` ends them after so many rounds.
    """
    values = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        vectors.select("vec_id", values.alias("embedding"))
        .where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))
        .withColumn("node", F.xxhash64("embedding"))
    )
    rows = written(rows, "vectors")
    different = rows.groupBy("node").agg(F.first("embedding").alias("embedding"))
    points = written(_unit(different.select("node", F.size("embedding").alias("dims"), "embedding")), "points")
    graph = neighbour_graph(points, graph_k, rounds=rounds, reverse=reverse)
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "node").distinct()
    queries = written(points.join(asked.select("node").distinct(), "node").withColumnRenamed("node", "q"), "queries")
    # with k + 1 entries and as wide a beam, every query has k others wherever its length has as many
    found = _walk(graph, points, queries, reverse, max(beam, k + 1), walk, max(ENTRIES, k + 1))
    near = found.select("q", F.explode(F.slice("ids", 1, 4 * k + 4)).alias("node"))
    scored = (
        near.join(different, "node")
        .join(different.select(F.col("node").alias("q"), F.col("embedding").alias("asked")), "q")
        .where(F.size("embedding") == F.size("asked"))
        .select("q", "node", _cosine("embedding", "asked").alias("score"))
    )
    members = rows.select("node", "vec_id").distinct()
    smallest = members.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    # per query node first: k + 1 rows serve every query with that vector
    answers = scored.join(smallest, "node").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "vec_id", "score")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(answers, "q").where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _cosine(a: str, b: str) -> F.Column:
    """The cosine of two vectors; where squares could overflow or vanish both are divided by their largest component first."""

    def total(values: F.Column) -> F.Column:
        return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)

    def safe(name: str) -> F.Column:
        largest = F.array_max(F.transform(name, lambda x: F.abs(x)))
        return F.when(largest.between(1e-120, 1e120), F.col(name)).otherwise(F.transform(name, lambda x: x / largest))

    product = total(F.zip_with(safe(a), safe(b), lambda x, y: x * y))
    length = [F.sqrt(total(F.transform(safe(c), lambda x: x * x))) for c in (a, b)]
    return product / length[0] / length[1]
