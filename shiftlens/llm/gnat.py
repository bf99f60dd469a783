"""Exact search for scores inside windows with a multiway hyperplane tree, and hard negatives from it.

The tree is a geometric near-neighbour access tree: a node has a few split points, and a vector goes to
the nearest of them. Its skeleton is made of a bounded sample; then every vector is sent down it, and
for every split point of a node and every subtree beside it the least and largest distance from the
point to the subtree's vectors are kept, with the least and largest length of these. A query asks for
the best rows whose inner product with it lies in a window. For a subtree a window is an annulus around
the query; a sibling split point at distance ``d`` from the query meets the annulus only between
``d - outer`` (or ``inner - d``) and ``d + outer``, so a subtree whose range from that point lies outside holds
nothing. What is left are leaves, which are scored whole. A query first scores the leaf that it falls
into; its ``k``-th best score there narrows the window for the others.

Leaves are cut into pieces and queries into blocks, both of limited size, and a task meets one piece
with one block, whatever a leaf holds. Scores are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: Split points of a node; rows that a leaf should hold; leaves at most, beyond which they grow.
FANOUT = 8
LEAF_ROWS = 1024
MAX_LEAVES = 4096
#: The sample that the skeleton is made of, in rows and bytes, and the bytes of all split points. All reach
#: the driver and every task, so they don't grow with the table.
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 16 << 20
SKELETON_BYTES = 16 << 20
#: Rows of a piece and queries of a block.
PIECE_ROWS = 16_384
BLOCK_QUERIES = 16_384
#: Hard negatives score between these percentages of their positive.
SHARE = (50, 95)

_TILE = 2_000_000
_MOST = 2**63 - 1
_NONE = -(2**63)
#: Leaf of the vectors that are not as long as those of the skeleton; nothing is known of it.
_APART = -1
_SLACK = 1e-9


@dataclass
class Split:
    """A node: its split points, and for each subtree a node's or (negative, less one) a leaf's number."""

    points: np.ndarray
    below: list[int]


@dataclass
class Tree:
    """The skeleton and, by node, split point and subtree, the ranges of the distances and of the lengths."""

    dims: int
    splits: list[Split]
    leaves: int
    ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float, float]] | None = None


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of ``floor(256 * x)``, exact also where a double overflows."""
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * 256)
    if not np.isfinite(scaled).all():  # so large a number has no fraction
        scaled = np.array([int(x) * 256 if abs(x) > 1e300 else int(np.floor(x * 256)) for x in flat.tolist()], object)
    return scaled.reshape(len(vectors), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``; beyond 64 bits the largest number of that sign."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(abs(a).max()) * int(abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < _MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    ints = [np.array([[int(x) for x in row] for row in m.tolist()], object) for m in (a, b)]
    return np.clip(ints[0] @ ints[1].T, -_MOST, _MOST).astype(np.int64)


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(((rows[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))


def _near(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The nearest split point of each row; where distances overflow, the first."""
    return np.nan_to_num(_distances(rows, points), nan=np.inf).argmin(axis=1)


def build(sample: np.ndarray, rows: int) -> Tree:
    """The skeleton for a table of so many rows, of which ``sample`` has some."""
    dims = sample.shape[1]
    budget = min(MAX_LEAVES, max(1, -(-rows // LEAF_ROWS)), max(1, SKELETON_BYTES // (8 * max(1, dims))))
    scale, rng = rows / max(1, len(sample)), np.random.default_rng(12)
    tree, waiting = Tree(dims, [], 1), [(None, np.arange(len(sample)))]
    while waiting:
        waiting.sort(key=lambda w: -len(w[1]))
        parent, members = waiting.pop(0)
        points = _spread(sample[members], rng) if len(members) * scale > LEAF_ROWS and tree.leaves + FANOUT - 1 <= budget else []
        if len(points) < 2:
            if parent is not None:
                node, child = parent
                tree.splits[node].below[child] = -1 - sum(b < 0 for s in tree.splits for b in s.below)
            continue
        at = len(tree.splits)
        tree.splits.append(Split(points, [0] * len(points)))
        if parent is not None:
            tree.splits[parent[0]].below[parent[1]] = at
        tree.leaves += len(points) - 1
        home = _near(sample[members], points)
        waiting += [((at, i), members[home == i]) for i in range(len(points))]
    return tree


def _spread(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Split points that lie apart: of some random rows one, then always the farthest from those chosen."""
    some = np.unique(rows[rng.choice(len(rows), min(len(rows), 4 * FANOUT), replace=False)], axis=0)
    chosen = [0]
    far = _distances(some, some[:1])[:, 0]
    while len(chosen) < min(FANOUT, len(some)) and np.nanmax(far) > 0:
        chosen.append(int(np.nanargmax(far)))
        far = np.minimum(far, _distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def leaf_of(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into."""
    out = np.zeros(len(rows), np.int64)
    waiting = [(0, np.arange(len(rows)))] if tree.splits else []
    while waiting:
        node, members = waiting.pop()
        split = tree.splits[node]
        home = _near(rows[members], split.points)
        for child, below in enumerate(split.below):
            mine = members[home == child]
            if below < 0:
                out[mine] = -1 - below
            elif len(mine):
                waiting.append((below, mine))
    return out


def ranges_of(tree: Tree, rows: np.ndarray, into: dict) -> None:
    """Widen the ranges ``into`` by ``rows``: of distances from each split point, and of lengths, by node and subtree."""
    waiting = [(0, rows)] if tree.splits else []
    while waiting:
        node, members = waiting.pop()
        split = tree.splits[node]
        far = _distances(members, split.points)
        home = np.nan_to_num(far, nan=np.inf).argmin(axis=1)
        with np.errstate(all="ignore"):
            length = np.sqrt((members**2).sum(axis=1))
        for child, below in enumerate(split.below):
            mine = home == child
            if not mine.any():
                continue
            new = (far[mine].min(axis=0), far[mine].max(axis=0), length[mine].min(), length[mine].max())
            old = into.get((node, child))
            into[node, child] = new if old is None else tuple(f(a, b) for f, a, b in zip((np.minimum, np.maximum, min, max), old, new, strict=True))
            if below >= 0:
                waiting.append((below, members[mine]))


def surviving(tree: Tree, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[int]:
    """Leaves that may hold a row whose product with ``query`` lies in one of the windows ``low .. high``.

    Only what lies outside by more than the rounding of the distances is left out; a distance that
    overflows leaves nothing out.
    """
    if not tree.splits:
        return [0]
    out, waiting = [], [0]
    with np.errstate(all="ignore"):
        size = np.sqrt((query**2).sum())
        while waiting:
            node = waiting.pop()
            split = tree.splits[node]
            d = _distances(query[None], split.points)[0]
            for child, below in enumerate(split.below):
                known = tree.ranges.get((node, child))
                if known is None:  # no row at all
                    continue
                least, most, short, long = known
                slack = _SLACK * (1 + size + long + np.abs(d).max() + most.max())
                # |q - x|^2 = |q|^2 + |x|^2 - 2 qx: the annulus of the window for lengths short .. long
                outer = np.sqrt(np.maximum(size**2 + long**2 - 2 * low, 0)) + slack
                inner = np.sqrt(np.maximum(size**2 + short**2 - 2 * high, 0)) - slack
                outside = low > size * long * (1 + _SLACK) + slack
                outside |= high < -size * long * (1 + _SLACK) - slack
                near = np.maximum(d[:, None] - outer, inner - d[:, None])
                outside |= ((most[:, None] + slack < near) | (least[:, None] - slack > d[:, None] + outer)).any(axis=0)
                if not outside.all():
                    if below < 0:
                        out.append(-1 - below)
                    else:
                        waiting.append(below)
    return out


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def _floats(matrix: np.ndarray) -> np.ndarray:
    """For distances: numbers beyond a double are infinite, and nothing is concluded from them."""
    if matrix.dtype != object:
        return matrix
    return np.array([[float(x) if abs(x) < 10**300 else np.inf for x in row] for row in matrix.tolist()]).reshape(matrix.shape)


@dataclass
class Index:
    """The tree and its members: ``dims, leaf, piece, vec_id, label, vec``; ``pieces`` has the pieces of each leaf."""

    tree: Tree
    members: DataFrame
    pieces: DataFrame


def index(rows: DataFrame) -> Index:
    """Put every row of ``rows`` (``vec_id, label, vec``, no nulls) into a leaf."""
    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims, n = (lengths["dims"], lengths["n"]) if lengths else (0, 0)
    wanted = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * max(1, dims))))
    picked = rows.where(F.size("vec") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("vec").toArrow()
    vectors = picked.column("vec").combine_chunks()
    sample = _floats(whole_numbers(vectors)) if len(vectors) and dims else np.zeros((0, dims))
    tree = build(sample[np.isfinite(sample).all(axis=1)], n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _groups(batch, "vec"):
                apart = np.full(part.num_rows, _APART)
                leaf = leaf_of(tree, _floats(whole_numbers(part.column("vec")))) if size == tree.dims else apart
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, size, np.int32)), pa.array(leaf, pa.int64()), *(part.column(c) for c in ("vec_id", "label", "vec"))],
                    names=["dims", "leaf", "vec_id", "label", "vec"],
                )

    placed = written(rows.mapInArrow(place, "dims int, leaf bigint, vec_id bigint, label bigint, vec array<double>"), "leaves")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for _, part in _groups(batch, "vec"):
                ranges_of(tree, _floats(whole_numbers(part.column("vec"))), found)
        if found:
            columns = list(zip(*[(*at, a.tolist(), z.tolist(), s, t) for at, (a, z, s, t) in found.items()], strict=True))
            lists = pa.list_(pa.float64())
            kinds = [pa.int64(), pa.int64(), lists, lists, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "child", "least", "most", "short", "long"])

    parts = placed.where(F.col("leaf") >= 0).select("vec").mapInArrow(
        measure, "node bigint, child bigint, least array<double>, most array<double>, short double, long double"
    )
    each = parts.select("node", "child", F.posexplode(F.arrays_zip("least", "most")).alias("i", "r"), "short", "long")
    merged = each.groupBy("node", "child", "i").agg(F.min("r.least").alias("least"), F.max("r.most").alias("most"), F.min("short").alias("short"), F.max("long").alias("long"))
    tree.ranges = {}
    for r in merged.orderBy("node", "child", "i").collect():  # a row for each split point and subtree of the skeleton
        a, z, _, _ = tree.ranges.setdefault((r["node"], r["child"]), ([], [], r["short"], r["long"]))
        a.append(r["least"])
        z.append(r["most"])
    tree.ranges = {at: (np.array(a), np.array(z), s, t) for at, (a, z, s, t) in tree.ranges.items()}
    counts = placed.groupBy("dims", "leaf").agg(F.count("*").alias("n"))
    pieces = written(counts.select("dims", "leaf", F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces")), "pieces")
    members = placed.join(broadcast_if_small(pieces), ["dims", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int")).drop("pieces")
    return Index(tree, written(members, "members"), pieces)


_TARGETS = "leaf bigint, query_id bigint, label bigint, dims int, vec array<double>, windows array<struct<key:bigint,low:bigint,high:bigint>>"


def _targets(tree: Tree, queries: DataFrame, first: bool) -> DataFrame:
    """A row for every query and leaf that it has to score: its own, or all others that survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _groups(batch, "vec"):
                at, leaves = [], []
                if size != tree.dims:
                    at, leaves = (list(range(part.num_rows)), [_APART] * part.num_rows) if first else ([], [])
                else:
                    rows = _floats(whole_numbers(part.column("vec")))
                    home = leaf_of(tree, rows)
                    if first:
                        at, leaves = list(range(len(rows))), home.tolist()
                    else:
                        for i, windows in enumerate(part.column("windows").to_pylist()):
                            low, high = (np.array([w[c] for w in windows], float) for c in ("low", "high"))
                            open_ = low <= high
                            found = surviving(tree, rows[i], low[open_], high[open_]) if open_.any() else []
                            found = [leaf for leaf in found if leaf != home[i]]
                            at += [i] * len(found)
                            leaves += found
                if at:
                    taken = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaves, pa.int64()), taken.column("query_id"), taken.column("label"), pa.array(np.full(len(at), size, np.int32)), taken.column("vec"), taken.column("windows")],
                        names=["leaf", "query_id", "label", "dims", "vec", "windows"],
                    )

    return queries.select("query_id", "label", "vec", "windows").mapInArrow(run, _TARGETS)


_FOUND = "query_id bigint, key bigint, vec_id bigint, score bigint"


def _best(queries: pa.Table, piece: pa.Table, k: int, same: bool) -> dict[str, list]:
    """Each window's ``k`` best rows of a piece, from all their scores."""
    out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(", ")}
    piece = piece.sort_by("vec_id")  # so that the first of equal scores has the smallest id
    ids, labels = piece.column("vec_id").to_numpy(), piece.column("label").to_numpy()
    rows = whole_numbers(piece.column("vec").combine_chunks())
    step = max(1, _TILE // max(1, len(ids)))
    for low in range(0, queries.num_rows, step):
        part = queries.slice(low, step)
        asked, label = part.column("query_id").to_numpy(), part.column("label").to_numpy()
        scores = products(whole_numbers(part.column("vec").combine_chunks()), rows)
        fits = labels[None, :] == label[:, None] if same else labels[None, :] != label[:, None]
        fits &= ids[None, :] != asked[:, None]
        for i, windows in enumerate(part.column("windows").to_pylist()):
            for window in windows:
                inside = fits[i] & (scores[i] >= window["low"]) & (scores[i] <= window["high"])
                left = np.where(inside, scores[i], _NONE)
                for _ in range(k):
                    j = int(left.argmax())
                    if left[j] == _NONE:
                        break
                    for name, value in zip(out, (int(asked[i]), window["key"], int(ids[j]), int(left[j])), strict=True):
                        out[name].append(value)
                    left[j] = _NONE
    return out


def _scored(index: Index, targets: DataFrame, k: int, same: bool, blocks: int) -> DataFrame:
    """The best rows of every window in every piece of the leaves that its query is sent to."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])

    def run(_: tuple, queries: pa.Table, piece: pa.Table) -> pa.Table:
        if not queries.num_rows or not piece.num_rows:
            return schema.empty_table()
        return pa.Table.from_pydict(_best(queries, piece, k, same), schema=schema)

    dealt = (
        targets.join(broadcast_if_small(index.pieces), ["dims", "leaf"])
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    )
    copies = index.members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dims", "leaf", "piece", "block"]
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """``query_id, key, rank, vec_id, score``: each window's ``k`` best rows of the same label, or of other labels.

    ``queries`` has ``query_id`` (unique), ``label``, ``vec`` and ``windows``, an array of ``key, low, high`` with
    inclusive bounds of the score. The row with the query's own id is no candidate, nor is one whose
    vector has another length. Ties go to the smaller ``vec_id``; fewer candidates give fewer rows.
    """
    queries = written(queries.select("query_id", "label", "vec", "windows"), "asked")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    first = written(_ranked(_scored(index, _targets(index.tree, queries, True), k, same, blocks), k), "first")
    bounds = first.groupBy("query_id", "key").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    by_query = bounds.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "floor"))).alias("floors"))

    def narrowed(window: Column) -> Column:
        floor = F.coalesce(F.try_element_at("floors", window["key"]), window["low"])
        return F.struct(window["key"].alias("key"), F.greatest(window["low"], floor).alias("low"), window["high"].alias("high"))

    again = queries.join(by_query, "query_id", "left").select("query_id", "label", "vec", F.transform("windows", narrowed).alias("windows"))
    rest = _scored(index, _targets(index.tree, again, False), k, same, blocks)
    return _ranked(first.drop("rank").unionByName(rest), k)


def eliminated(index: Index, queries: DataFrame) -> float:
    """The share of the leaves that the ranges rule out for the queries' windows."""
    asked = queries.count() * max(1, index.tree.leaves)
    left = _targets(index.tree, queries, False).count() + queries.count()
    return 1 - left / asked if asked else 0.0


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vec``: rows that take part, each id once.

    Left out are rows with a null id, label or vector and vectors that hold nulls or non-finite numbers. Of
    rows that repeat an id the one with the smallest label, then the smallest vector, stays.
    """
    value = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), value.alias("embedding"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    one = kept.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    return one.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("row.label").alias("label"), F.col("row.embedding").alias("vec"))


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id`` (unique), ``label`` and ``vec``, as :func:`usable` gives. Scores are inner products of the
    vectors' ``floor(256 * x)``, exact in 64 bits (beyond them the largest such number). Anchors are rows
    whose id divides by ``every``; an anchor's positives are its best rows of the same label, and a
    positive's negatives the best rows of other labels that score between ``SHARE`` percent of it. Ties
    go to the smaller id. An empty table, and anchors without positives, give no rows.
    """
    tree = index(written(rows, "mined"))
    anchors = written(tree.members.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "label", "vec"), "anchors")

    def window(key: Column, low: Column, high: Column) -> Column:
        return F.struct(key.cast("bigint").alias("key"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    whole = F.array(window(F.lit(0), F.lit(-_MOST), F.lit(_MOST)))
    best = written(search(tree, anchors.withColumn("windows", whole), positives, same=True), "positives")
    # low percent of p, rounded up, to high percent of it, rounded down; a negative score has no such window
    low = F.expr(f"score div 100 * {SHARE[0]} + (score % 100 * {SHARE[0]} + 99) div 100")
    high = F.expr(f"score div 100 * {SHARE[1]} + (score % 100 * {SHARE[1]}) div 100")
    windows = best.where("score >= 0").groupBy("query_id").agg(F.collect_list(window(F.col("vec_id"), low, high)).alias("windows"))
    found = search(tree, anchors.join(windows, "query_id"), negatives, same=False)
    scores = best.select("query_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
    return found.join(scores, ["query_id", "key"]).select(
        F.col("query_id").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
