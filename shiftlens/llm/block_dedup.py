"""Exact substring deduplication with fixed-block anchors.

A repeated run of ``window`` words holds a whole block of ``window // 2`` words that starts at a multiple
of that length, wherever the run lies. So:

1. Index and probe: every document gives its non-overlapping blocks and, as probes, all its rolling
   windows of block length. A block is an anchor where its hash is probed a second time.
2. Extend: windows of full length around anchors are looked up by their hash; the first place of each
   in document order stays, and consecutive later places run together to maximal repeats.
3. The words that a repeat covers go.

Hashes travel packed, by ranges of their value, in bounded loads. What a task can tell by itself (a
hash twice in its own load) does not go to the hash's bucket, so no hash has more entries there than
there are loads, however many documents share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.batches import saved
from shiftlens.llm.fingerprints import grams, slices, words_of
from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: Words hashed in a task before they are dealt to buckets, and hashes sorted together in a bucket.
LOAD_WORDS = 1_500_000
BUCKET_HASHES = 2_000_000
#: Documents whose places are gathered together.
CHUNK_DOCS = 40_000

_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_PROBES = "bucket int, seen binary, twice binary, blocks binary, keys binary, places binary, sure binary, sure_counts binary, sure_places binary"
_WINDOWS = "bucket int, hashes binary, at binary, starts binary, keys binary, orders binary, sure binary, sure_counts binary, sure_places binary"
_PLACES = "chunk int, keys binary, counts binary, places binary"


def _batch(rows: list[tuple], layout: str) -> pa.RecordBatch:
    fields = [f.split() for f in layout.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    parts = [np.frombuffer(v.as_py(), kind) for v in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _packed(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, how many places each has, and the places, in order."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[at], np.diff(np.r_[at, len(key)]).astype(np.int32), place.astype(np.uint32)


def _split(key: np.ndarray, place: np.ndarray, chunks: int) -> list[tuple]:
    """Rows of ``_PLACES``, one for each chunk of documents."""
    chunk = (key.view(np.uint64) % np.uint64(chunks)).astype(np.int32)
    out = []
    for c in np.unique(chunk):
        mine = chunk == c
        out.append((int(c), *(a.tobytes() for a in _packed(key[mine], place[mine]))))
    return out


def _spread(key: np.ndarray, place: np.ndarray, n: int) -> list[tuple[bytes, bytes, bytes]]:
    """Places that need no look-up, in ``n`` parts to travel with the rows of a load."""
    cuts = np.linspace(0, len(key), n + 1).astype(int)
    return [tuple(a.tobytes() for a in _packed(key[a:z], place[a:z])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below those of the bucket: enough to find anchors, as a false one costs only a look-up."""
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _anchored(docs: DataFrame, window: int, bits: int, chunks: int) -> DataFrame:
    """Rows of ``_PLACES``: the blocks of each document that occur a second time anywhere."""
    block = window // 2

    def packed(hashes: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        every = np.concatenate(hashes)
        length = [len(h) for h in hashes]
        place = np.concatenate([np.arange(n, dtype=np.uint32) for n in length])
        key = np.repeat(np.array(keys, np.int64), length)
        order = np.argsort(every, kind="stable")
        every, place, key = every[order], place[order], key[order]
        first = np.r_[True, every[1:] != every[:-1]]
        count = np.diff(np.r_[np.flatnonzero(first), len(every)])
        again = np.repeat(count > 1, count)
        index = place % block == 0
        sure = index & again  # twice in this load: an anchor whatever the others have
        ask = index & ~again
        values, doubled = every[first], every[first][count > 1]
        asked, ask_key, ask_place = every[ask], key[ask], place[ask]
        n = 1 << bits
        parts = _spread(key[sure], place[sure], n)
        edges = [np.searchsorted(_bucket(a, bits), np.arange(n + 1)) for a in (values, doubled, asked)]
        rows = []
        for b in range(n):
            (a0, z0), (a1, z1), (a2, z2) = ((e[b], e[b + 1]) for e in edges)
            blobs = (_short(values[a0:z0], bits), _short(doubled[a1:z1], bits), _short(asked[a2:z2], bits), ask_key[a2:z2], ask_place[a2:z2])
            rows.append((b, *(x.tobytes() for x in blobs), *parts[b]))
        yield _batch(rows, _PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                key = part.column("key").to_numpy()
                for r, a, z in words.rows():
                    if z - a >= window:
                        hashes.append(grams(words.hashes[a:z], block))
                        keys.append(key[r])
                        held += z - a
                if held > LOAD_WORDS:
                    yield from packed(hashes, keys)
                    hashes, keys, held = [], [], 0
        yield from packed(hashes, keys)

    def look_up(_: tuple, group: pa.Table) -> pa.Table:
        seen, count = np.unique(_joined(group["seen"], np.uint32), return_counts=True)
        found = np.union1d(seen[count > 1], _joined(group["twice"], np.uint32))
        block_hash = _joined(group["blocks"], np.uint32)
        at = np.searchsorted(found, block_hash)
        hit = found[np.minimum(at, len(found) - 1)] == block_hash if len(found) else np.zeros(len(block_hash), bool)
        return _chunked(group, _joined(group["keys"], np.int64)[hit], _joined(group["places"], np.uint32)[hit], chunks)

    return docs.mapInArrow(run, _PROBES).groupBy("bucket").applyInArrow(look_up, _PLACES)


def _chunked(group: pa.Table, key: np.ndarray, place: np.ndarray, chunks: int) -> pa.Table:
    """The places found in a bucket, and those that only travelled with it, by chunk of documents."""
    sure = np.repeat(_joined(group["sure"], np.int64), _joined(group["sure_counts"], np.int32))
    key, place = np.concatenate([key, sure]), np.concatenate([place, _joined(group["sure_places"], np.uint32)])
    return pa.Table.from_batches([_batch(_split(key, place, chunks), _PLACES)])


def _per_document(places: DataFrame, name: str) -> DataFrame:
    """``key`` and the sorted places of each document as packed 32-bit numbers."""

    def run(_: tuple, group: pa.Table) -> pa.Table:
        key = np.repeat(_joined(group["keys"], np.int64), _joined(group["counts"], np.int32))
        keys, counts, place = _packed(key, _joined(group["places"], np.uint32))
        ends = np.cumsum(counts)
        return pa.table(
            {"key": pa.array(keys), name: pa.array([place[z - n : z].tobytes() for n, z in zip(counts, ends, strict=True)], pa.binary())}
        )

    return places.groupBy("chunk").applyInArrow(run, f"key bigint, {name} binary")


def _later(docs: DataFrame, window: int, bits: int, chunks: int) -> DataFrame:
    """Rows of ``_PLACES``: starts of the windows around anchors that also start earlier."""
    block = window // 2

    def packed(held: list[tuple[np.ndarray, np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        length = [len(h) for h, _, _, _ in held]
        every = np.concatenate([h for h, _, _, _ in held])
        place = np.concatenate([p for _, p, _, _ in held]).astype(np.int64)
        doc = np.repeat(np.arange(len(held)), length)
        key, order_of = np.array([k for _, _, k, _ in held], np.int64), np.array([o for _, _, _, o in held], np.int64)
        order = np.lexsort((place, order_of[doc], every))
        every, place, doc = every[order], place[order], doc[order]
        first = np.r_[True, every[1:] != every[:-1]]
        lead = np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(every)]))
        here = (order_of[doc] == order_of[doc[lead]]) & (place == place[lead])
        n = 1 << bits
        parts = _spread(key[doc[~here]], place[~here], n)
        every, place, doc = every[here], place[here], doc[here]
        edges = np.searchsorted(_bucket(every, bits), np.arange(n + 1))
        rows = []
        for b in range(n):
            a, z = edges[b], edges[b + 1]
            who, index = np.unique(doc[a:z], return_inverse=True)
            # a window's number counts on from document to document, so 32 bits tell both
            most = np.zeros(len(who), np.int64)
            np.maximum.at(most, index, place[a:z] + 1)
            starts = np.r_[0, np.cumsum(most)[:-1]] if len(who) else most
            blobs = (every[a:z], (starts[index] + place[a:z]).astype(np.uint32), starts.astype(np.uint32), key[who], order_of[who])
            rows.append((b, *(x.tobytes() for x in blobs), *parts[b]))
        yield _batch(rows, _WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                key, order, anchors = part.column("key").to_numpy(), part.column("order").to_numpy(), part.column("anchors")
                for r, a, z in words.rows():
                    hashes = grams(words.hashes[a:z], window)
                    at = np.frombuffer(anchors[r].as_py(), np.uint32).astype(np.int64)
                    near = np.zeros(len(hashes) + 1, np.int64)
                    np.add.at(near, np.clip(at - (window - block), 0, len(hashes)), 1)
                    np.add.at(near, np.clip(at + 1, 0, len(hashes)), -1)
                    place = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                    if len(place):
                        held.append((hashes[place], place, int(key[r]), int(order[r])))
                        total += len(place)
                if total > LOAD_WORDS // 2:
                    yield from packed(held)
                    held, total = [], 0
        yield from packed(held)

    def look_up(_: tuple, group: pa.Table) -> pa.Table:
        hashes, places, keys, orders = [], [], [], []
        for row in range(group.num_rows):
            blob = {c: group[c][row].as_py() for c in ("hashes", "at", "starts", "keys", "orders")}
            at, starts = np.frombuffer(blob["at"], np.uint32), np.frombuffer(blob["starts"], np.uint32)
            doc = np.searchsorted(starts, at, "right") - 1
            hashes.append(np.frombuffer(blob["hashes"], np.uint64))
            places.append(at - starts[doc])
            keys.append(np.frombuffer(blob["keys"], np.int64)[doc])
            orders.append(np.frombuffer(blob["orders"], np.int64)[doc])
        every, place, key, order = (np.concatenate(x) for x in (hashes, places, keys, orders))
        rank = np.lexsort((place, order, every))
        every, place, key, order = every[rank], place[rank], key[rank], order[rank]
        begins = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
        lead = np.repeat(begins, np.diff(np.r_[begins, len(every)]))
        later = (order != order[lead]) | (place != place[lead])
        return _chunked(group, key[later], place[later], chunks)

    return docs.mapInArrow(run, _WINDOWS).groupBy("bucket").applyInArrow(look_up, _PLACES)


def _finished(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` with the words of later windows taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, digests, texts = [], [], [], []
            for text, starts in zip(batch.column("text"), batch.column("later"), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space only
                kept = words
                if starts.is_valid:
                    at = np.frombuffer(starts.as_py(), np.uint32).astype(np.int64)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    kept = [words[i] for i in np.flatnonzero(keep)]
                whole = b" ".join(kept)
                totals.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(whole).hexdigest())
                texts.append(whole.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def _bits(hashes: float) -> int:
    return min(16, max(4, int(np.ceil(np.log2(max(1.0, hashes / BUCKET_HASHES))))))


def block_dedup(docs: DataFrame, window: int = 20, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept`` for every row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``; words are runs without ASCII white space. A word goes when it
    is covered by a run of ``window`` words that also starts earlier: in a document with a smaller id,
    or earlier in the same one. Runs are judged on the texts as they come in. A null or empty text has
    no words; a text shorter than ``window`` keeps all. A null ``doc_id`` comes after all others. Rows that
    repeat a ``doc_id`` are one document as far as order goes: of equal runs at equal places in them
    none is earlier. ``window`` is even. Other columns are not read.
    """
    number = F.col("doc_id").cast("bigint")
    rows = docs.select(
        number.alias("doc_id"), "text", F.coalesce(number, F.lit((1 << 63) - 1)).alias("order"), F.xxhash64(number, "text").alias("key")
    )
    facts = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    chunks = max(8, facts["n"] // CHUNK_DOCS + 1)
    anchored = _anchored(rows.where("text is not null").select("key", "text"), window, _bits((facts["chars"] or 0) / 6), chunks)
    anchors = saved(_per_document(anchored, "anchors"), "anchors")
    blocks = anchors.agg(F.sum(F.length("anchors") / 4).alias("n")).first()["n"] or 0
    some = broadcast_if_small(anchors)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]
    alone = rows.join(broadcast_if_small(anchors.select("key")), "key", "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("later"))
    alone = saved(_finished(alone, window).select(*columns), "alone")
    repeated = written(rows.join(some, "key").select("doc_id", "order", "key", "text", "anchors"), "repeated")
    later = _later(repeated.select("key", "order", "text", "anchors"), window, _bits(blocks * (window - window // 2 + 1)), chunks)
    starts = saved(_per_document(later, "later"), "later")
    cleaned = repeated.select("doc_id", "key", "text").join(starts, "key", "left").select("doc_id", "text", "later")
    return alone.unionByName(saved(_finished(cleaned, window).select(*columns), "cleaned"))
