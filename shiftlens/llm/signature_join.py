"""Exact n-gram Jaccard join with signature trees.

1. A document becomes the set of its shingle hashes; equal sets form one class.
2. Each class sends its smallest hashes (its *head*) to buckets of the hash space. A hash that only
   one class has cannot be shared; a class with too many of those has no partner and leaves.
3. The others are routed by their rarest shared hashes: two linked classes have one of them in common.
   What hangs together by routes is a family.
4. Families are laid out as signature trees: inner nodes hold the OR of the token bitmaps below and
   their size range. A dual traversal follows only node pairs whose largest possible overlap is
   enough; what remains is compared exactly. A large family is cut into blocks of similar size, and
   block pairs are tasks of their own.
5. Links join to components. Inside a task, classes that already hang together are not compared
   again, so groups of copies cost about one comparison a member.

No step drops, caps or samples anything: the bounds of 2, 3 and 4 are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.batches import saved
from shiftlens.llm.components import components
from shiftlens.llm.fingerprints import grams, slices, words_of
from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: Tokens sorted together in a bucket, and held by a tree.
BUCKET_TOKENS = 700_000
TREE_TOKENS = 1_500_000
#: Classes whose shared tokens are looked at together.
CHUNK_CLASSES = 40_000
#: Tokens gathered in a task before they are dealt to buckets.
FLUSH_TOKENS = 1_500_000
FANOUT = 16


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word runs; of the whole sequence if it is shorter."""
    return np.unique(grams(hashes, min(k, max(1, len(hashes)))))


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest hashes that a class of ``n`` shares with any class that it links with."""
    return -(-percent * n // 100)


def _head(n, percent: int):
    """How many of its smallest hashes a class sends.

    A class may lack ``n - least overlap`` hashes of a partner. With twice as many and two more in
    the head, the heads of two linked classes share more than either may lack (``percent`` >= 50).
    """
    lacking = n - _least_overlap(n, percent)
    return np.minimum(n, 2 * lacking + 2)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"), lower=True)
            yield part, [shingle_set(words.hashes[a:z], k) for _, a, z in words.rows()]


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _mark(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, key`` of every row; a null key where there is no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "key"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, key binary")


def _heads(docs: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """Packed arrays, one row per task's load and bucket: tokens, their owners, the owners' marks and sizes."""

    def packed(tokens: list[np.ndarray], marks: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        if not tokens:
            return
        token = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
        rest = ((token << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        mark, size = np.array(marks, np.int64), np.array(sizes, np.int32)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        rows = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            who, index = np.unique(owner[low:high], return_inverse=True)
            blobs = (rest[low:high], index.astype(np.int32), mark[who], size[who])
            rows.append((int(bucket[low]), *(b.tobytes() for b in blobs)))
        yield _batch(rows, _HEADS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, marks, sizes, held, seen = [], [], [], 0, set()
        for _, sets in _sets(batches, k):
            for one in sets:
                mark = _mark(_key(one))
                if not len(one) or mark in seen:
                    continue
                seen.add(mark)
                tokens.append(one[: int(_head(np.int64(len(one)), percent))].copy())
                marks.append(mark)
                sizes.append(len(one))
                held += len(tokens[-1])
            if held > FLUSH_TOKENS:
                yield from packed(tokens, marks, sizes)
                tokens, marks, sizes, held, seen = [], [], [], 0, set()
        yield from packed(tokens, marks, sizes)

    return docs.mapInArrow(run, _HEADS)


_HEADS = "bucket int, tokens binary, owners binary, marks binary, sizes binary"
_SHARED = "chunk int, bucket int, marks binary, sizes binary, counts binary, tokens binary, often binary"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], layout: str) -> pa.RecordBatch:
    fields = [f.split() for f in layout.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _read(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), kind) for v in column]


class _Owned:
    """Shared tokens by class: parallel arrays, one entry per class and token."""

    def __init__(self, mark: np.ndarray, size: np.ndarray, token: np.ndarray, often: np.ndarray):
        self.mark, self.size, self.token, self.often = mark, size, token, often

    def kept(self, which: np.ndarray) -> _Owned:
        return _Owned(self.mark[which], self.size[which], self.token[which], self.often[which])

    @classmethod
    def read(cls, group: pa.Table) -> tuple[_Owned, np.ndarray]:
        """The entries of some packed rows, and the bucket of each."""
        counts = _read(group["counts"], np.int32)
        each = np.concatenate(counts)
        mark = np.repeat(np.concatenate(_read(group["marks"], np.int64)), each)
        size = np.repeat(np.concatenate(_read(group["sizes"], np.int32)), each)
        bucket = np.repeat(group["bucket"].to_numpy(), [int(c.sum()) for c in counts])
        return cls(mark, size, np.concatenate(_read(group["tokens"], np.uint32)), np.concatenate(_read(group["often"], np.int32))), bucket

    def rows(self, bucket: int, chunks: int) -> list[tuple]:
        """Packed rows of one bucket, one for each chunk of classes."""
        chunk = (self.mark.view(np.uint64) % np.uint64(chunks)).astype(np.int32)
        order = np.lexsort((self.token, self.mark, chunk))
        chunk, mark, size, token, often = chunk[order], self.mark[order], self.size[order], self.token[order], self.often[order]
        out = []
        edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(chunk) else np.zeros(1, int)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            at = low + np.flatnonzero(np.r_[True, mark[low + 1 : high] != mark[low : high - 1]])
            counts = np.diff(np.r_[at, high]).astype(np.int32)
            blobs = (mark[at], size[at], counts, token[low:high], often[low:high].astype(np.int32))
            out.append((int(chunk[low]), bucket, *(b.tobytes() for b in blobs)))
        return out

    def spare(self, percent: int) -> np.ndarray:
        """For each entry, how many more shared tokens its class has than it must have.

        The head of a class with a partner has more shared tokens than the class may lack.
        """
        _, index, have = np.unique(self.mark, return_inverse=True, return_counts=True)
        size = self.size.astype(np.int64)
        return have[index] - (size - _least_overlap(size, percent)) - 1


def _table(rows: list[tuple], layout: str) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, layout)])


def _often(token: np.ndarray) -> np.ndarray:
    _, index, count = np.unique(token, return_inverse=True, return_counts=True)
    return count[index].astype(np.int32)


def _shared(heads: DataFrame, chunks: int) -> DataFrame:
    """Per bucket, the tokens that more than one class has."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        owners = _read(group["owners"], np.int32)
        token = np.concatenate(_read(group["tokens"], np.uint32))
        mark = np.concatenate([m[o] for m, o in zip(_read(group["marks"], np.int64), owners, strict=True)])
        size = np.concatenate([z[o] for z, o in zip(_read(group["sizes"], np.int32), owners, strict=True)])
        order = np.lexsort((mark, token))
        token, mark, size = token[order], mark[order], size[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1])]  # a class in several loads
        token, mark, size = token[fresh], mark[fresh], size[fresh]
        owned = _Owned(mark, size, token, _often(token))
        return _table(owned.kept(owned.often > 1).rows(key[0].as_py(), chunks), _SHARED)

    return heads.groupBy("bucket").applyInArrow(run, _SHARED)


def _able(shared: DataFrame, percent: int, chunks: int) -> DataFrame:
    """The same rows without the classes that can have no partner."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        owned, bucket = _Owned.read(group)
        keep = owned.spare(percent) >= 0
        owned, bucket = owned.kept(keep), bucket[keep]
        rows = []
        for b in np.unique(bucket):
            rows += owned.kept(bucket == b).rows(int(b), chunks)
        return _table(rows, _SHARED)

    return shared.groupBy("chunk").applyInArrow(run, _SHARED)


def _recount(shared: DataFrame, chunks: int) -> DataFrame:
    """The same rows without tokens that only one class still has."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        owned, _ = _Owned.read(group)
        owned.often = _often(owned.token)
        return _table(owned.kept(owned.often > 1).rows(key[0].as_py(), chunks), _SHARED)

    return shared.groupBy("bucket").applyInArrow(run, _SHARED)


def _routes(shared: DataFrame, percent: int) -> DataFrame:
    """``mark, route``: of each class the ``spare + 1`` rarest shared tokens; linked classes have one in common."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        owned, bucket = _Owned.read(group)
        spare = owned.spare(percent)
        token = owned.token.astype(np.int64) | (bucket.astype(np.int64) << 32)
        order = np.lexsort((token, owned.often, owned.mark))
        mark = owned.mark[order]
        begins = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]) if len(mark) else np.zeros(0, int)
        place = np.arange(len(mark)) - np.repeat(begins, np.diff(np.r_[begins, len(mark)]))
        keep = place <= spare[order]
        return pa.table({"mark": pa.array(mark[keep]), "route": pa.array(token[order][keep])})

    return shared.groupBy("chunk").applyInArrow(run, "mark bigint, route bigint")


class _Tree:
    """A signature tree over token sets: bitmaps, sizes, and levels of OR-combined nodes."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, one in enumerate(sets):
            flags = np.zeros(bits, np.uint8)
            flags[one & np.uint64(bits - 1)] = 1
            maps[i] = np.packbits(flags).view(np.uint64)
        excess = self.size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, self.size, self.size, excess)]
        while len(self.levels[-1][0]) > FANOUT:
            maps, low, high, excess = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut))
            )


def _possible(one: tuple, i: np.ndarray, other: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """True for the node pairs that may hold a linked pair: sizes near enough, overlap large enough."""
    low_i, low_j = one[1][i], other[1][j]
    keep = (100 * other[2][j] >= percent * low_i) & (100 * one[2][i] >= percent * low_j)
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(keep)
    step = max(1, (1 << 21) // max(1, one[0].shape[1]))
    for k in range(0, len(at), step):
        p = at[k : k + step]
        most = np.bitwise_count(one[0][i[p]] & other[0][j[p]]).sum(1, dtype=np.int64) + np.minimum(one[3][i[p]], other[3][j[p]])
        out[p] = (100 + percent) * most >= percent * (low_i[p] + low_j[p])
    return out


def _children(n: int, i: np.ndarray, j: np.ndarray, n_other: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    a = (i[:, None] * FANOUT + np.arange(FANOUT)).repeat(FANOUT, 1).ravel()
    b = np.tile(j[:, None] * FANOUT + np.arange(FANOUT), (1, FANOUT)).ravel()
    keep = (a < n) & (b < n_other) & ((a <= b) if same else True)
    return a[keep], b[keep]


def spanning_links(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that hold together what links: within ``sets``, or between ``sets`` and ``others``.

    Places count on from ``sets`` into ``others``. The traversal runs depth first, some node pairs
    at a time, so the pairs in hand stay few.
    """
    same = others is None
    if not sets or not (same or others):
        return []
    typical = int(np.median([len(s) for s in [*sets, *(others or [])]]))
    bits = 1 << min(16, max(8, int(np.ceil(np.log2(4 * max(1, typical))))))
    one = _Tree(sets, bits)
    other = one if same else _Tree(others, bits)
    every = sets if same else [*sets, *others]
    base = 0 if same else len(sets)
    label = np.arange(len(every))
    links: list[tuple[int, int]] = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), (j + base).tolist(), strict=True):
            if label[a] == label[b]:
                continue
            x, y = every[a], every[b]
            if len(x) > len(y):
                x, y = y, x
            place = np.searchsorted(y, x)
            common = int(np.count_nonzero(y[np.minimum(place, len(y) - 1)] == x))
            if 100 * common >= percent * (len(x) + len(y) - common):
                links.append((a, b))
                label[label == label[b]] = label[a]

    def depth(tree: _Tree) -> int:
        return len(tree.levels) - 1

    top = min(depth(one), depth(other))
    i, j = np.meshgrid(np.arange(len(one.levels[top][0])), np.arange(len(other.levels[top][0])), indexing="ij")
    i, j = i.ravel(), j.ravel()
    if same:
        i, j = i[i <= j], j[i <= j]
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 64 * FANOUT:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        if level == 0:
            keep = (label[i] != label[j + base]) & ((i < j) if same else True)
            i, j = i[keep], j[keep]
        fits = _possible(one.levels[level], i, other.levels[level], j, percent)
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if level == 0:
            compare(i, j)
        else:
            a, b = _children(len(one.levels[level - 1][0]), i, j, len(other.levels[level - 1][0]), same)
            stack.append((level - 1, a, b))
    return links


def _tree_links(placed: DataFrame, percent: int) -> DataFrame:
    """``a, b``: keys of linked classes, from every tree (``side`` 0 only) or pair of blocks."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys, sides = group["key"].to_pylist(), group["side"].to_pylist()
        sets = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
        # like sets come together: by their smallest hashes
        order = sorted(range(len(sets)), key=lambda r: (sides[r], sets[r][:3].tolist()))
        here = [r for r in order if sides[r] == 0]
        there = [r for r in order if sides[r] == 1]
        found = spanning_links([sets[r] for r in here], [sets[r] for r in there] if key[1].as_py() else None, percent)
        at = here + there if key[1].as_py() else here
        return pa.table(
            {"a": pa.array([keys[at[a]] for a, _ in found], pa.binary()), "b": pa.array([keys[at[b]] for _, b in found], pa.binary())}
        )

    return placed.groupBy("tree", "paired").applyInArrow(run, "a binary, b binary")


def _placed(sets: DataFrame) -> DataFrame:
    """Where each class's set is compared: ``tree, paired, side, key, tokens``.

    Small families are packed into common trees. A large one is cut into size bands (a link joins the
    same or neighbouring bands) and those into blocks of about one load, compared pair by pair.
    """
    spark = sets.sparkSession
    sizes = sets.groupBy("family").agg(F.sum("size").alias("total"))
    small = sizes.where(F.col("total") <= TREE_TOKENS)
    load = small.agg(F.sum("total").alias("t")).first()["t"] or 0
    trees = max(2 * spark.sparkContext.defaultParallelism, int(2 * load / TREE_TOKENS) + 1)
    whole = (
        sets.join(small.select("family"), "family")
        .select(F.concat(F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(trees))).alias("tree"), F.lit(False).alias("paired"), F.lit(0).alias("side"), "key", "tokens")
    )
    if not sizes.where(F.col("total") > TREE_TOKENS).limit(1).count():
        return whole
    banded = sets.join(sizes.where(F.col("total") > TREE_TOKENS).select("family"), "family").withColumn(
        "band", F.floor(F.log(F.col("size")) / F.log(F.lit(1.3))).cast("int")
    )
    loads = banded.groupBy("family", "band").agg(F.ceil(F.sum("size") / F.lit(TREE_TOKENS / 2.0)).cast("int").alias("blocks"))
    blocks = written(loads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "blocks")
    one, two = blocks.alias("one"), blocks.alias("two")
    pairs = one.join(
        two.withColumn("near", F.explode(F.array(F.col("band"), F.col("band") - 1))),
        (F.col("one.family") == F.col("two.family")) & (F.col("one.band") == F.col("near"))
        & ((F.col("two.band") > F.col("one.band")) | (F.col("two.block") >= F.col("one.block"))),
    ).select(
        F.col("one.family").alias("family"), F.col("one.band").alias("band"), F.col("one.block").alias("block"),
        F.col("two.band").alias("band2"), F.col("two.block").alias("block2"),
    )
    tree = F.concat_ws("|", F.lit("b"), F.col("family").cast("string"), "band", "block", "band2", "block2")
    alone = (F.col("band") == F.col("band2")) & (F.col("block") == F.col("block2"))
    pairs = pairs.select("family", "band", "block", "band2", "block2", tree.alias("tree"), (~alone).alias("paired"))
    sides = pairs.select("family", "band", "block", "tree", "paired", F.lit(0).alias("side")).unionByName(
        pairs.where("paired").select("family", F.col("band2").alias("band"), F.col("block2").alias("block"), "tree", "paired", F.lit(1).alias("side"))
    )
    cut = (
        banded.join(loads, ["family", "band"])
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .join(sides, ["family", "band", "block"])
        .select("tree", "paired", "side", "key", "tokens")
    )
    return whole.unionByName(cut)


def signature_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs without ASCII white space, A-Z folded. Two documents link when their sets of
    ``k``-word shingles have a Jaccard similarity of ``percent`` or more; fewer words make one shingle.
    ``component_id`` is the smallest ``doc_id`` reachable by links. A null, empty or blank text has no
    shingle and is linked with nothing: its component is itself. A row without a ``doc_id`` takes no
    part and has no component. Rows that repeat a ``doc_id`` are documents of their own with that number.
    Other columns are not read. ``percent`` is 50 to 100.
    """
    docs = docs.select("doc_id", "text")
    rows = saved(_classes(docs, k), "shingles")
    classes = (
        rows.where("key is not null and doc_id is not null").groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.count("*").alias("copies"))
    )
    classes = written(_with_mark(classes), "classes")
    facts = classes.agg(F.sum("size").alias("tokens"), F.count("*").alias("n")).first()
    bits = min(20, max(4, int(np.ceil(np.log2(max(1.0, 0.4 * (facts["tokens"] or 0) / BUCKET_TOKENS))))))
    chunks = max(8, facts["n"] // CHUNK_CLASSES + 1)
    known = docs.where("doc_id is not null")
    shared = saved(_shared(_heads(known, k, percent, bits), chunks), "shared")
    shared = written(_recount(_able(shared, percent, chunks), chunks), "shared")
    routes = written(_routes(shared, percent), "routes")
    first = routes.groupBy("route").agg(F.min("mark").alias("first"), F.count("*").alias("n")).where("n > 1")
    families = components(routes.join(first, "route").where("mark <> first").select("mark", "first"))
    families = families.withColumnsRenamed({"node": "mark", "root": "family"})
    wanted = classes.join(families, "mark").select(F.col("rep").alias("doc_id"), F.col("key").alias("wanted"), "family")
    sets = saved(_sets_of(known, wanted, k), "sets")
    links = saved(_tree_links(_placed(sets), percent), "links")
    joined = components(links).withColumnsRenamed({"node": "key"})
    least = classes.join(joined, "key").select("key", "root", "rep")
    least = least.join(least.groupBy("root").agg(F.min("rep").alias("component")), "root").select("key", "component")
    alike = classes.where("copies > 1").join(least, "key", "left_anti").select("key", F.col("rep").alias("component"))
    return rows.join(least.unionByName(alike), "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def _with_mark(classes: DataFrame) -> DataFrame:
    """The 64-bit number of a class, the first half of its key."""
    number = F.lit(0).cast("bigint")
    for byte in range(8):
        part = F.conv(F.hex(F.substring("key", byte + 1, 1)), 16, 10).cast("bigint")
        number = number.bitwiseOR(F.shiftleft(part, 8 * byte))
    return classes.withColumn("mark", number)


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``key, family, size, tokens`` of the classes that are to be compared.

    A class comes twice when its ``doc_id`` does; equal sets then just link with themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            key, family = part.column("wanted").to_pylist(), part.column("family")
            keep = [r for r, s in enumerate(sets) if len(s) and _key(s) == key[r]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key[r] for r in keep], pa.binary()),
                    family.take(pa.array(keep, pa.int64())),
                    pa.array([len(sets[r]) for r in keep], pa.int64()),
                    pa.array([sets[r].tobytes() for r in keep], pa.binary()),
                ],
                ["key", "family", "size", "tokens"],
            )

    texts = docs.join(broadcast_if_small(wanted), "doc_id")
    return texts.mapInArrow(run, "key binary, family bigint, size bigint, tokens binary")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that with the smallest ``doc_id``.

    Texts without words and rows without a ``doc_id`` stay. Rows that repeat both ``doc_id`` and text become one.
    """
    facts = written(signature_join(docs, k, percent).select("doc_id", "component_id"), "components")
    gone = facts.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    repeated = facts.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    repeated = broadcast_if_small(repeated)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)
