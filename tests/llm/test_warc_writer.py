"""Archives: round trip, same bytes, revisits, and tasks that run twice."""

import base64
import hashlib
import os
from collections import defaultdict

import pytest

from shiftlens.llm.warc_writer import read_warc, write_warc

SCHEMA = "page_id bigint, url string, html string, shard string"


def _written(spark, tmp_path, rows, **kw):
    folder = f"file://{tmp_path}/out"
    manifest = write_warc(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), folder, **kw)
    return manifest, read_warc(spark, folder).collect()


def _expected(rows, least=0):
    largest = defaultdict(lambda: None)
    for page_id, _, html in rows:
        data = (html or "").encode()
        if page_id is not None:
            largest[data] = page_id if largest[data] is None else max(largest[data], page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = largest[data] if len(data) >= least else None
        again = top is not None and (page_id is None or page_id < top)
        out.append((page_id, len(data), digest, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def _got(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str)


ROWS = [(i, f"http://h/{i % 7}", ("é<p>" * (i % 5)) + str(i % 9 if i % 3 else i)) for i in range(-40, 200)]
ROWS += [(300, None, None), (301, "http://a b\n", ""), (302, "", None), (None, "http://x", "alone"), (None, "u", "1"), (302, "", None)]


@pytest.mark.parametrize("kw", [{}, {"shard_bytes": 300, "file_bytes": 2000}, {"min_revisit_bytes": 5}])
def test_round_trip(spark, tmp_path, kw):
    manifest, records = _written(spark, tmp_path, ROWS, **kw)
    assert _got(records) == _expected(ROWS, kw.get("min_revisit_bytes", 0))
    texts = {r.page_id: r.payload for r in records if r.record_type == "response"}
    assert all(texts[i] == (h or "").encode() for i, _, h in ROWS if i in texts and i is not None and i < 300)
    names = {r.name for r in manifest.collect()}
    assert names == {f for f in os.listdir(tmp_path / "out") if f.endswith(".gz")} and "_temporary" not in os.listdir(tmp_path / "out")
    if kw.get("file_bytes"):
        assert len(names) > 5


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    sums = []
    for n in (1, 7):
        pages = spark.createDataFrame([(*r, "") for r in ROWS], SCHEMA).repartition(n)
        manifest = write_warc(pages, f"file://{tmp_path}/{n}", shard_bytes=500, file_bytes=1500)
        sums.append(sorted((r.name, r.sha256, r.first_id, r.last_id) for r in manifest.collect()))
    assert sums[0] == sums[1]


def test_hot_payload_and_long_page(spark, tmp_path):
    rows = [(i, "http://h/", "same") for i in range(500)] + [(1000, "http://h/", "x" * 3_000_000)]
    assert _got(_written(spark, tmp_path, rows)[1]) == _expected(rows)


def test_empty_table(spark, tmp_path):
    manifest, records = _written(spark, tmp_path, [])
    assert manifest.count() == 0 and records == []


def test_outlying_extreme_and_missing_ids_make_even_shards(spark, tmp_path):
    ids = [*range(400), 10**18, -(2**63), 2**63 - 1, *[None] * 200]
    rows = [(i, "http://h/", f"{n} " + "y" * 3000) for n, i in enumerate(ids)]
    manifest, records = _written(spark, tmp_path, rows, shard_bytes=60_000)
    assert _got(records) == _expected(rows)
    held = defaultdict(int)
    for row in manifest.collect():
        held[row.shard] += row.records
    assert len(held) > 25 and max(held.values()) <= 21


def test_one_repeated_row_fills_several_shards(spark, tmp_path):
    rows = [(5, "http://h/", "z" * 2000)] * 300 + [(9, "http://h/", "z" * 2000)] + [(7, "u", "w")] * 100
    manifest, records = _written(spark, tmp_path, rows, shard_bytes=50_000)
    assert _got(records) == _expected(rows)
    alike = [r.records for r in manifest.collect() if r.first_id == r.last_id == 5]
    assert len(alike) > 8 and max(alike) < 60


def test_shards_are_ranges_of_ids(spark, tmp_path):
    manifest, _ = _written(spark, tmp_path, [(i * i, "u", f"p{i}" * 100) for i in range(-300, 300, 7)], shard_bytes=9_000)
    files = sorted((r.shard, r.number, r.first_id, r.last_id) for r in manifest.collect())
    assert len(files) >= 5 and all(a[3] <= b[2] for a, b in zip(files, files[1:], strict=False))
