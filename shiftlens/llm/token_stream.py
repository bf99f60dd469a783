"""Token ids of a corpus as files: ids ranked by frequency, in byte-aligned codes with control bytes apart.

Texts are encoded once and their ids saved. The counts of all ids rank the vocabulary, so that the
frequent ids are small numbers; a rank takes one to four bytes, whose count is two bits of a control
byte that serves four ranks. Documents are range partitioned by id, and each task writes its part in
order, block by block, each block with its documents' ids and lengths. A block is decoded without a
loop: a table gives, for every control byte, the places that its data bytes take among the 16 of four
32-bit numbers.

Files are written under names of their own and renamed when the manifest knows them, so a task that
runs twice disturbs nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.llm.batches import saved
from shiftlens.plans.ordering import ROW_BITS
from shiftlens.plans.scratch import written

#: Ids of a block, which ends with the document that fills it, and of a file, likewise.
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 24
#: Pieces of a text up to this length are remembered by a worker, twice this many of them at a time.
KEPT_LENGTH = 48
KEPT_PIECES = 700_000
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:;=-@[-`{-~"
#: For tokenizers that drop white space and part letters from signs: Latin letters before a sign or a space, signs before
#: letters, any other word whole. Apostrophes, which may begin an ending, and what begins a special token are no signs here.
WORDS = rf"[{_LETTERS}]++(?=[{_SIGNS} \t\n\r]|\Z)|[{_SIGNS}]++(?=[{_LETTERS} \t\n\r]|\Z)|[^ \t\n\r]+"
#: Control bytes decoded at a time.
_SLICE = 1 << 18
_MAGIC = b"RTOK"
_HEAD = struct.Struct("<4sIQQQQI")

MANIFEST = "name string, part string, place bigint, documents bigint, tokens bigint, bytes bigint, sha256 string"
_MANIFEST_ARROW = pa.schema(
    [(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in MANIFEST.split(", ")]
)

_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: For each control byte: which of 16 bytes its data fill, and how many these are.
_FILLS = (np.arange(4) <= _CODES[:, :, None]).reshape(256, 16)
_SIZES = _FILLS.sum(axis=1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers; the last four are filled up with zeros."""
    control, data = [], []
    for low in range(0, len(values), 4 * _SLICE):
        part = values[low : low + 4 * _SLICE].astype("<u4")
        part = np.concatenate([part, np.zeros(-len(part) % 4, "<u4")])
        codes = (part > 0xFF).astype(np.uint8) + (part > 0xFFFF) + (part > 0xFFFFFF)
        quads = codes.reshape(-1, 4)
        control.append((quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8).tobytes())
        data.append(part.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that :func:`pack` made of."""
    marks, bytes_ = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    out, at = np.zeros((len(marks), 16), np.uint8), 0
    for low in range(0, len(marks), _SLICE):
        part = marks[low : low + _SLICE]
        size = int(_SIZES[part].sum())
        out[low : low + _SLICE][_FILLS[part]] = bytes_[at : at + size]
        at += size
    return out.view("<u4").ravel()[:n]


def _block(doc_ids: list[int | None], sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    nulls = np.packbits([d is None for d in doc_ids]).tobytes()
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    size_marks, size_data = pack(sizes)
    marks, data = pack(ranks)
    body = nulls + numbers + size_marks + size_data + marks + data
    return _HEAD.pack(_MAGIC, len(doc_ids), len(ranks), len(size_data), len(data), len(body), zlib.crc32(body)) + body


def _blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """``doc_ids, sizes, ranks`` of each block of a file; a damaged block raises."""
    while head := stream.read(_HEAD.size):
        magic, docs, ids, size_bytes, id_bytes, length, check = _HEAD.unpack(head)
        body = stream.read(length)
        if magic != _MAGIC or len(body) != length or zlib.crc32(body) != check:
            raise ValueError("a block of token ids is damaged")
        view, at = memoryview(body), 0

        def take(n: int) -> memoryview:
            nonlocal at
            at += n
            return view[at - n : at]

        nulls = np.unpackbits(np.frombuffer(take(-(-docs // 8)), np.uint8))[:docs]
        numbers = np.frombuffer(take(8 * docs), "<i8").tolist()
        sizes = unpack(take(-(-docs // 4)), take(size_bytes), docs)
        ranks = unpack(take(-(-ids // 4)), take(id_bytes), ids)
        yield [None if missing else d for d, missing in zip(numbers, nulls, strict=True)], sizes, ranks


class _Pieces(dict):
    """The ids of pieces of text, as bytes; pieces not seen for long are forgotten.

    When ``KEPT_PIECES`` have been added these become the older half, from which a piece comes back
    when it is seen again.
    """

    def __init__(self, tokenizer: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.older = Tokenizer.from_str(tokenizer), kind, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        steps = json.loads(tokenizer).get("normalizer") or {}
        self.lowers = any(step["type"] == "Lowercase" for step in steps.get("normalizers", [steps]) if step)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None and self.lowers and piece.isascii() and not piece.islower() and piece.isalpha():
            ids = self[piece.lower()]
        elif ids is None:
            ids = array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_KNOWN: dict[tuple[str, str], _Pieces] = {}


class Encoder:
    """Texts to ids, as little-endian numbers of ``kind``.

    The parts of a text that match ``piece`` are encoded one by one, each of them once while it is remembered;
    with None texts are encoded whole. A worker's tasks share what is known.
    """

    def __init__(self, tokenizer: str, kind: np.dtype, piece: str | None):
        key = (hashlib.sha256(tokenizer.encode()).hexdigest(), kind.str)
        if key not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[key] = _Pieces(tokenizer, "H" if kind.itemsize == 2 else "I")
        self.pieces, self.cut = _KNOWN[key], piece and re.compile(piece).findall

    def __call__(self, text: str) -> bytes:
        if self.cut is None:
            return self.pieces.__missing__(text)
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))


def _id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def tokenized(documents: DataFrame, tokenizer: str, end_id: int, piece: str | None) -> tuple[DataFrame, int]:
    """``doc_id, n_tokens, ids`` (little-endian, two or four bytes each), saved, and the size of the vocabulary."""
    from tokenizers import Tokenizer

    vocabulary = max(end_id, *Tokenizer.from_str(tokenizer).get_vocab(with_added_tokens=True).values()) + 1
    kind, shared = _id_type(vocabulary), documents.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(shared.value, kind, piece), np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [encode(text.as_py() or "") + end for text in batch.column("text")]
            sizes = pa.array([len(x) // kind.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(read.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary"), "token-ids", 500), vocabulary


def ranked_ids(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """``rank, id, n``: the vocabulary by the count of each id over all rows, the most frequent first, equal ones by id.

    A task counts what it reads in one array; as many rows as the vocabulary has ids are ranked.
    """
    kind = _id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], names=["id", "n"])

    every = tokens.sparkSession.range(vocabulary).select("id", F.lit(0).cast("bigint").alias("n"))
    counted = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").unionByName(every).groupBy("id").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("n"), "id")  # as many rows as the vocabulary has ids
    return counted.select((F.row_number().over(order) - 1).alias("rank"), "id", "n")


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class _File:
    """A file that is being written under a temporary name."""

    def __init__(self, folder: str, place: int):
        self.place, self.documents, self.tokens, self.bytes, self.sha = place, 0, 0, 0, hashlib.sha256()
        self.part = f"_temporary/{uuid.uuid4().hex}"
        store, root = _place(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        self.out = store.open_output_stream(f"{root}/{self.part}", compression=None)

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ranks: np.ndarray) -> None:
        block = _block(doc_ids, sizes, ranks)
        self.out.write(block)
        self.sha.update(block)
        self.documents, self.tokens, self.bytes = self.documents + len(doc_ids), self.tokens + len(ranks), self.bytes + len(block)

    def close(self) -> dict:
        self.out.close()
        name = f"tokens-{self.place >> ROW_BITS:06d}-{self.place & (1 << ROW_BITS) - 1:06d}.rtok"
        return {"name": name, "part": self.part, "place": self.place, "documents": self.documents, "tokens": self.tokens, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def write_tokens(
    documents: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 1,
    piece: str | None = WORDS,
    block_ids: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode ``documents`` (``doc_id, text``) into ``folder`` and return the manifest, one row a file.

    ``tokenizer_path`` is a file of the tokenizers library, read on the driver; special tokens are not
    added, ``end_id`` follows every document, and a null text is an empty one. Parts of a text that
    match ``piece`` are encoded apart from each other, and nothing else is: the pattern must cut only where
    the tokenizer does, and pass over only what gives no id. None encodes whole texts. Documents are written in order
    of ``doc_id``, nulls first; rows that repeat an id follow by a hash of their ids. An empty table gives
    an empty manifest. ``folder`` must be one that every executor reaches; ``ranks`` in it has the
    vocabulary by rank, ``manifest`` the files and the number of ids before each, and is written last.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokens, vocabulary = tokenized(documents, f.read(), end_id, piece)
    kind = _id_type(vocabulary)
    ranked_ids(tokens, vocabulary).coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.empty(vocabulary, "<u4")
    rank_of[_id_of(spark, folder)] = np.arange(vocabulary, dtype="<u4")
    shared = spark.sparkContext.broadcast(rank_of)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, place, out, done = shared.value, TaskContext.get().partitionId() << ROW_BITS, None, []
        held: tuple[list, list, list] = ([], [], [])

        def flush() -> None:
            if held[0]:
                out.add(held[0], np.array(held[1], "<u4"), ranks[np.concatenate(held[2])])
                for part in held:
                    part.clear()

        waiting = 0
        for batch in batches:
            for doc_id, size, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                if out is None:
                    out = _File(folder, place)
                held[0].append(doc_id)
                held[1].append(size)
                held[2].append(np.frombuffer(ids.as_buffer(), kind))
                waiting += size
                if waiting >= block_ids:
                    flush()
                    waiting = 0
                    if out.tokens >= file_ids:
                        done.append(out.close())
                        out, place = None, place + 1
        if out is not None:
            flush()
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST_ARROW)

    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    numbered = tokens.withColumn("mixed", F.xxhash64("ids")).withColumn("read_at", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), "mixed", "read_at"]
    parts = max(1, min(20_000, -(-total // file_ids)))
    ordered = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "ids")
    return _committed(saved(ordered.mapInArrow(run, MANIFEST), "token-files", 500), folder)


def _committed(files: DataFrame, folder: str) -> DataFrame:
    """Give the files their final names, then write the manifest with the number of ids before each file.

    A rename that was done before is passed over, so a task may run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        for batch in batches:
            for name, part in zip(batch.column("name").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{part}").type != pafs.FileType.NotFound:
                    store.move(f"{root}/{part}", f"{root}/{name}")
            yield batch

    spark = files.sparkSession
    renamed = written(files.repartition(max(1, min(1000, files.count() // 4)), "name").mapInArrow(run, MANIFEST), "token-manifest")
    task = F.shiftright("place", ROW_BITS)
    inside = Window.partitionBy(task).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    starts = renamed.groupBy(task.alias("task")).agg(F.sum("tokens").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    first = F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    manifest = renamed.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("first_token", first).drop("task", "start", "part")
    manifest.write.parquet(f"{folder}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.parquet(f"{folder}/manifest")


def _id_of(spark: SparkSession, folder: str) -> np.ndarray:
    """The id of each rank: as many numbers as the vocabulary has ids."""
    ranks = spark.read.schema("rank int, id bigint").parquet(f"{folder}/ranks").orderBy("rank").toArrow()
    return ranks.column("id").to_numpy()


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of a committed folder: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` (an array).

    ``start`` is the number of ids before the document; ``ids_crc32`` is over its ids as little-endian 32-bit
    numbers. Files are read in tasks of their own, block by block.
    """
    shared = spark.sparkContext.broadcast(_id_of(spark, folder).astype("<u4"))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for doc_ids, sizes, ranks in _blocks(stream):
                        ids, ends = shared.value[ranks], np.cumsum(sizes, dtype=np.int64)
                        starts = ends - sizes
                        raw = ids.view(np.uint8)
                        checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(sizes.astype(np.int64)), pa.array(checks, pa.int64())]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)
                        start += len(ids)

    files = spark.read.parquet(f"{folder}/manifest").select("name", "first_token")
    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return files.repartition(max(1, min(20_000, files.count())), "name").mapInArrow(run, out)
