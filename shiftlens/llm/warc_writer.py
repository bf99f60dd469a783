"""Sharded WARC archives with the same bytes on every run.

Pages are range-sorted by id and payload digest and cut into shards of equal bytes, at places that follow
from the data alone. A task writes one shard in that order, one gzip member a record, and starts a new
file when the compressed size is reached. Headers and digests are made anew. Files are written under names of their own, so a task that
runs twice disturbs nothing; the manifest names the files of the attempts that succeeded, and only
those are renamed and committed.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written

#: Shards at most; beyond, each holds more than asked for. Their first keys (60 bytes each) reach the driver.
MAX_SHARDS = 20_000
#: What a record is counted to need besides its payload.
RECORD_BYTES = 100
#: Rows alike in id and payload that are dealt to several shards; fewer stay together.
ALIKE = 100
MANIFEST = "name string, part string, shard bigint, number int, records bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own; nothing in it depends on the time or the machine."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int) -> bytes:
    """A response with its payload, or a revisit that names the response with the same payload."""
    digest = _digest(payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-unknown")
    fields = [
        ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", fields, head + payload, level)
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Truncated", "length")]
    return _record("revisit", fields, head, level)


class _File:
    """An archive that is being written under a temporary name."""

    def __init__(self, folder: str, prefix: str, shard: int, number: int, date: str, level: int):
        self.shard, self.number, self.records, self.bytes, self.sha = shard, number, 0, 0, hashlib.sha256()
        self.name = f"{prefix}-{shard:08d}-{number:04d}.warc.gz"
        self.part = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        self.first = self.last = None
        store, root = _place(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        self.out = store.open_output_stream(f"{root}/{self.part}", compression=None)
        info = f"software: sharded page writer\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        fields = [("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._put(_record("warcinfo", fields, info, level))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def add(self, page_id: int | None, data: bytes) -> None:
        self._put(data)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id

    def close(self) -> tuple:
        self.out.close()
        return (self.name, self.part, self.shard, self.number, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last)


def _key() -> Column:
    """Text that sorts as ``page_id`` (nulls first) and then ``sha`` do, for all 64-bit ids."""
    moved = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), moved), F.lit("0")), F.lit("-"), F.col("sha"))


def _bounds(facts: DataFrame, shard_bytes: int) -> list[str]:
    """The keys at which new shards begin: where the bytes in key order pass each multiple of a shard.

    They follow from the data alone. Sizes are summed by key first, the keys are range-sorted, and running
    sums within a range are moved by the sums of the ranges before. A key of ``ALIKE`` rows with the bytes of
    several shards is listed once for each. At most ``MAX_SHARDS`` keys reach the driver.
    """
    keys = facts.groupBy(_key().alias("key")).agg(F.sum(F.col("size") + RECORD_BYTES).alias("bytes"), F.count("*").alias("n"))
    ranges = written(keys.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "page-keys")
    sums = ranges.groupBy("range").agg(F.sum("bytes").alias("bytes")).orderBy("range").collect()  # one row a range
    step = max(shard_bytes, -(-sum(r["bytes"] for r in sums) // MAX_SHARDS))
    before, offsets = 0, []
    for row in sums:
        offsets.append((row["range"], before))
        before += row["bytes"]
    if before <= step:
        return []
    start = F.broadcast(facts.sparkSession.createDataFrame(offsets, "range int, start bigint"))
    end = F.sum("bytes").over(Window.partitionBy("range").orderBy("key")) + F.col("start")
    placed = ranges.join(start, "range").select("key", "n", end.alias("end"), (end - F.col("bytes")).alias("begin"))
    first = F.greatest(F.lit(1), F.expr(f"(begin + {step - 1}L) div {step}L"))
    last = F.expr(f"(end - 1L) div {step}L")
    cuts = placed.withColumns({"first": first, "last": last}).where("first <= last")
    begins = F.when(F.col("n") < ALIKE, F.col("last")).otherwise(F.col("first"))
    found = cuts.select("key", F.explode(F.sequence(begins, F.col("last"))).alias("shard")).collect()
    return sorted(r["key"] for r in found)


def _passed(bounds: list[str], key: Column, same: bool) -> Column:
    """How many of the sorted ``bounds`` come before ``key`` (with ``same``, or equal it), by halving."""
    if not bounds:
        return F.lit(0)
    listed = F.split(F.lit(",".join(bounds)), ",")  # folded to one literal
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def move(at: Column, step: Column) -> Column:
        bound = F.get(listed, at + step - 1)
        return F.when((bound <= key) if same else (bound < key), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), move)


def write_warc(
    pages: DataFrame,
    folder: str,
    prefix: str = "pages",
    shard_bytes: int = 64 << 20,
    file_bytes: int = 32 << 20,
    min_revisit_bytes: int = 0,
    date: str = "2025-01-01T00:00:00Z",
    level: int = 4,
) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to ``folder`` and return the committed manifest.

    The payload is the html in UTF-8; a null html is the empty payload and a null url a placeholder.
    Of the pages with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest
    ``page_id`` is written whole, those with a smaller id or none become revisits of it; rows that
    repeat that id are written whole as well. Payloads that only rows without an id have are all
    written whole. At least ``ALIKE`` rows of one id and payload that fill several shards are dealt to them by url
    and by where they were read; all others have one place. An empty table gives an empty manifest. ``folder`` must be one that every executor
    reaches and is committed by ``manifest``, a Parquet table that is written last.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("html"),
        F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload.cast("binary")).alias("sha"),
    )
    facts = written(pages.select("page_id", "size", "sha"), "payloads")
    bounds = _bounds(facts, shard_bytes)
    whole = (
        facts.where(F.col("size") >= min_revisit_bytes).groupBy("sha")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    )
    again = facts.join(whole, "sha").where("page_id is null or page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    nothing = F.lit(None).cast("string")
    low, high = (_passed(bounds, _key(), same).alias(name) for same, name in ((False, "low"), (True, "high")))
    spread = F.col("low") + 1 + F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.col("high") - F.col("low")).cast("int")
    shard = F.when(F.col("high") - F.col("low") > 1, spread).otherwise(F.col("high"))
    pages = pages.select("*", low, high).withColumn("shard", shard)
    names = F.explode(F.sequence(F.least(F.col("low") + 1, F.col("high")), F.col("high"))).alias("shard")
    again = again.select("*", low, high).select(names, "page_id", "sha", "refers_to")
    rows = pages.select("shard", "page_id", F.lit(1).alias("kind"), "sha", "url", "html", F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        again.select("shard", "page_id", F.lit(0).alias("kind"), "sha", nothing.alias("url"), nothing.alias("html"), "refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        out, here, refers = None, None, None
        for batch in batches:
            for shard, page_id, kind, sha, url, html, refers_to in zip(*(batch.column(i) for i in range(7)), strict=True):
                shard, page_id, sha = shard.as_py(), page_id.as_py(), sha.as_py()
                if here != (page_id, sha):
                    here, refers = (page_id, sha), None
                if kind.as_py() == 0:
                    refers = refers_to.as_py()
                    continue
                if out is not None and (out.shard != shard or out.bytes >= file_bytes):
                    done.append(out.close())
                    out = _File(folder, prefix, shard, out.number + 1 if out.shard == shard else 0, date, level)
                elif out is None:
                    out = _File(folder, prefix, shard, 0, date, level)
                out.add(page_id, page_record(page_id, url.as_py(), html.as_py().encode(), refers, date, level))
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, row, strict=True)) for row in done], schema=_ARROW)

    dealt = rows.repartitionById(len(bounds) + 1, "shard")  # a task a shard
    ordered = dealt.sortWithinPartitions(F.col("page_id").asc_nulls_first(), "sha", "kind", "url")
    manifest = written(ordered.mapInArrow(run, MANIFEST), "manifest")
    return _committed(spark, manifest, folder)


_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in MANIFEST.split(", ")])


def _committed(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Give the files of the manifest their final names, then write the manifest beside them.

    A rename that was done before is passed over, so a task may run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        for batch in batches:
            for name, part in zip(batch.column("name").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{part}").type != pafs.FileType.NotFound:
                    store.move(f"{root}/{part}", f"{root}/{name}")
            yield batch

    files = manifest.repartition(max(1, min(1000, manifest.count() // 4)), "name")
    files.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an archive, unpacked one by one."""
    data, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        out.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(out)
            data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{_digest(block)}":
        raise ValueError(f"block of {fields['WARC-Record-ID']} does not match its digest")
    return fields, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of a committed folder, their digests checked.

    ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``; a revisit has the
    size and digest of the payload that it stands for, and a null payload. Files are read in tasks of
    their own, record by record; a damaged record raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        fields, block = _parsed(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = fields["WARC-Type"] == "response"
                        if whole and (len(payload) != size or _digest(payload) != digest):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                        named = [fields.get(f, ":::").split(":")[2] for f in ("WARC-Record-ID", "WARC-Refers-To")]
                        ids = [int(n) if n else None for n in named]
                        rows.append((ids[0], fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, ids[1], payload if whole else None))
                        held += len(payload) + 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    spread = files.repartition(max(1, min(20_000, files.count())), "name")
    return spread.mapInArrow(
        run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
