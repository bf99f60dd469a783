"""A Merkle manifest of a dataset as a persistent tree: every version shares the nodes that it does not change.

Each row is a leaf, each group of rows (a source) a tree, and the trees' roots are the leaves of one more
tree. Leaves lie in aligned blocks of ``FANOUT ** BAND`` rows: a task builds the levels of whole blocks, and the
blocks' own roots, far fewer, are leaves of the next band, until a tree has one block. The nodes so made are
the first version. A changed leaf makes a version of its own: the task that holds its block copies the
leaf's ancestors there, path by path, and the copies go on upwards through the siblings of the bands
above, found by a join on the block. Nothing else is copied or computed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.plans.ordering import with_rank_in_group, with_row_index
from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: Children of a node, and levels of an aligned block (2,187 leaves).
FANOUT = 3
BAND = 7

_NODES = "key string, tree string, position bigint, digest string, changed string"
_BANDED = f"{_NODES}, block bigint, lefts array<string>, rights array<string>, top string, copied array<string>, shared array<array<string>>"
_TEXTS = pa.list_(pa.string())
_ARROW = pa.schema(
    [("key", pa.string()), ("tree", pa.string()), ("position", pa.int64()), ("digest", pa.string()), ("changed", pa.string()), ("block", pa.int64()),
     ("lefts", _TEXTS), ("rights", _TEXTS), ("top", pa.string()), ("copied", _TEXTS), ("shared", pa.list_(_TEXTS))]
)


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values in turn: ``-`` for a null, else the byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def raise_block(leaves: list[str], levels: int | None) -> list[list[str]]:
    """The levels above ``leaves``, theirs included: so many, or (None) until one node is left."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_hash("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def _rows_of(tree: str, block: int, rows: list[tuple], height: int) -> dict[str, list]:
    """One block's rows with their siblings and, for changed leaves, the copied ancestors."""
    # A first block that is not full is a whole tree, which ends at one node; any other is raised to the block's full height.
    whole = block == 0 and len(rows) < FANOUT**height
    levels = raise_block([r[1] for r in rows], None if whole else height)
    sides = []
    for nodes in levels[:-1]:
        runs = [i - i % FANOUT for i in range(len(nodes))]
        sides.append([("".join(nodes[a:i]), "".join(nodes[i + 1 : a + FANOUT])) for i, a in enumerate(runs)])
    out: dict[str, list] = {f.name: [] for f in _ARROW}
    for i, (key, digest, changed, position) in enumerate(rows):
        path = [side[i // FANOUT**up] for up, side in enumerate(sides)]
        copied, at = None, changed
        if changed is not None:
            copied = [at := _hash(left + at + right) for left, right in path]
        values = (key, tree, position, digest, changed, block, [p[0] for p in path], [p[1] for p in path], levels[-1][0], copied, levels if i == 0 else None)
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return out


def _band(nodes: DataFrame, height: int) -> DataFrame:
    """Every node with its block of this band, its siblings up to the block's root, and that root.

    ``shared``, on a block's first row, has all digests of the block by level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("tree", "block", "key", "digest", "changed", "position")]
            for tree, block, *row in zip(*columns, strict=True):
                if here != (tree, block):
                    if rows:
                        yield pa.RecordBatch.from_pydict(_rows_of(*here, rows, height), schema=_ARROW)
                    here, rows = (tree, block), []
                rows.append(tuple(row))
        if rows:
            yield pa.RecordBatch.from_pydict(_rows_of(*here, rows, height), schema=_ARROW)

    placed = nodes.withColumn("block", F.expr(f"position div {FANOUT**height}"))
    dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    return written(dealt.mapInArrow(run, _BANDED), "merkle-band")


def _raised(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The bands above ``nodes``, lowest first, and each tree's root as ``tree, position (0), digest``."""
    bands = []
    while True:
        bands.append(_band(nodes, height))
        tops = bands[-1].where(F.col("position") % FANOUT**height == 0).select("tree", F.col("block").alias("position"), F.col("top").alias("digest"))
        if not tops.where("position > 0").limit(1).count():
            return bands, tops
        nothing = F.lit(None).cast("string")
        nodes = tops.select(nothing.alias("key"), "tree", "position", "digest", nothing.alias("changed"))


def _continued(copied: Column, changed: Column, lefts: Column, rights: Column) -> Column:
    """``copied`` ancestors, continued through the siblings of the bands above; null where nothing changed."""
    sides = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("left"), b.alias("right")))

    def up(path: Column, side: Column) -> Column:
        last = F.coalesce(F.get(path, F.size(path) - 1), changed)
        return F.concat(path, F.array(F.sha2(F.concat(side["left"], last, side["right"]), 256)))

    return F.when(changed.isNotNull(), F.aggregate(sides, copied, up))


def _lowered(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest band with their siblings up to where ``above`` (``tree, position, lefts, rights`` and more) ends."""
    more = [c for c in above.columns if c not in ("tree", "position", "lefts", "rights")]
    for band in reversed(bands):
        upper = above.select("tree", F.col("position").alias("block"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), *more)
        above = (
            band.drop("shared", "top").join(broadcast_if_small(upper), ["tree", "block"])
            .withColumn("copied", _continued(F.col("copied"), F.col("changed"), F.col("up_lefts"), F.col("up_rights")))
            .withColumn("lefts", F.concat("lefts", "up_lefts")).withColumn("rights", F.concat("rights", "up_rights"))
        )
        if band is not bands[0]:
            above = written(above.select("tree", "position", "lefts", "rights", *more), "merkle-above")
    return above.select("key", "tree", "position", "digest", "changed", "copied", "lefts", "rights", *more)


def _tree_key(source: Column) -> Column:
    """A name for a source's tree that sorts like the source: null first, then by bytes."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def merkle_manifest(leaves: DataFrame, height: int = BAND) -> tuple[DataFrame, DataFrame]:
    """The tree over ``leaves`` and its shared nodes.

    ``leaves`` has ``key`` (a string, or null), ``source``, ``rank_by`` (the order inside a source), ``digest``
    and ``changed`` (the digest of a changed row, null where nothing changed); other columns are not
    read. Blocks are ``height`` levels high. Rows follow ``rank_by``, nulls first, then the digest; equal rows are leaves of their own.

    The first frame has a row per leaf: ``key, tree, position, digest, changed, lefts, rights`` (the siblings
    on either side, level by level up to the dataset's root), ``subroot, root``, and ``copied``: the nodes of
    the version that the changed leaf makes, from its parent to that version's root. Node ``h`` levels
    above leaf ``i`` of a version is ``copied[h - 1]`` on its path and the shared node anywhere else. The
    second has the shared nodes: ``tree, band, block, levels``. Sources' trees are named ``=`` and the
    source, the null one by an empty name; the tree over them is ``*``. No leaves give empty frames.
    """
    rows = written(leaves.select("key", _tree_key(F.col("source")).alias("tree"), "rank_by", "digest", "changed"), "merkle-leaves")
    placed = with_rank_in_group(
        rows.withColumn("read_at", F.monotonically_increasing_id()), ["tree"], ["rank_by", "digest", F.coalesce("changed", F.lit("")), "read_at"]
    )
    bands, subroots = _raised(placed.select("key", "tree", (F.col("rank") - 1).alias("position"), "digest", "changed"), height)
    nothing, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    ordered = with_row_index(subroots.select(F.col("tree").alias("key"), "digest"), ["key"], "position")
    top_bands, top = _raised(ordered.select("key", F.lit("*").alias("tree"), "position", "digest", nothing.alias("changed")), height)
    root = top.select("tree", "position", empty.alias("lefts"), empty.alias("rights"), F.col("digest").alias("root"))
    over = written(_lowered(top_bands, root), "merkle-sources")
    sources = over.select(F.col("key").alias("tree"), F.lit(0).cast("bigint").alias("position"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    shared = None
    for kind, made in (("tree", bands), ("top", top_bands)):
        for i, band in enumerate(made):
            part = band.where(F.col("shared").isNotNull()).select("tree", F.lit(f"{kind} {i}").alias("band"), "block", F.col("shared").alias("levels"))
            shared = part if shared is None else shared.unionByName(part)
    return _lowered(bands, sources), shared


def folded(digest: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings give."""
    sides = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.aggregate(sides, digest, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """SHA-256 of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def document_manifest(documents: DataFrame, tampered: Column | None = None, changed_text: Column | None = None, height: int = BAND) -> DataFrame:
    """Every document's place in the manifest, and whether the row as it is now still belongs to it.

    ``documents`` has ``doc_id, source, lang, n_chars, text``, any of them null. Where ``tampered`` holds
    the row now has ``changed_text`` instead of its text. Documents of a source lie in order of ``doc_id``, a
    null one first; rows that repeat an id follow by their digest. Returns ``doc_id, source, leaf, subroot,
    root, lefts, rights, proof_sha256, copied, folded_root, verified``: a changed row's root is the root
    of the version that it makes, any other is folded from its leaf and siblings.
    """

    def leaf(text: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    digested = documents.select(F.col("doc_id").alias("rank_by"), F.col("doc_id").cast("string").alias("key"), "source", leaf(F.col("text")).alias("digest"),
                                F.when(tampered, leaf(changed_text)).alias("now") if tampered is not None else F.lit(None).cast("string").alias("now"))
    entries, _ = merkle_manifest(digested.withColumn("changed", F.when(F.col("now") != F.col("digest"), F.col("now"))), height)
    root_now = F.coalesce(F.get("copied", F.size("copied") - 1), F.col("changed"), folded(F.col("digest"), F.col("lefts"), F.col("rights")))
    return entries.select(
        F.col("key").cast(documents.schema["doc_id"].dataType).alias("doc_id"),
        F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source"),
        F.col("digest").alias("leaf"), "subroot", "root", "lefts", "rights", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"),
        "copied", root_now.alias("folded_root"), (root_now == F.col("root")).alias("verified"),
    )
