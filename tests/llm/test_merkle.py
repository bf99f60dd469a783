"""Manifest trees against a plain build, with blocks small enough to have several bands."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shiftlens.llm.merkle import document_manifest, merkle_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, position int, key string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i - i % 3
        out.append((nodes[run:i], nodes[i + 1 : run + 3]))
        i //= 3
    return out


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r))) for s in order}
    levels = {s: _levels([_leaf(*r) for r in trees[s]]) for s in order}
    top = _levels([levels[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            path = _siblings(levels[s], i) + _siblings(top, at)
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                now = (r[0], r[1].replace("\n", ""), *r[2:])
            fold = _leaf(*now)
            for left, right in path:
                fold = _h(*left, fold, *right)
            out.append((r[0], _leaf(*r), levels[s][-1][0], top[-1][0], _h(*(x for p in path for x in p[0] + p[1])), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def _got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA).repartition(3)
    found = document_manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""), **kw)
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def _rows(n, sources=3):
    return [(i, f"text {i}\n\nmore" if i % 3 else f"é{i}", "en" if i % 5 else None, f"s{min(i, 10**6) % sources}", i if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("n,sources", [(1, 1), (2, 1), (3, 1), (9, 1), (10, 1), (28, 1), (100, 3), (40, 40), (130, 2)])
def test_equals_a_plain_build(spark, n, sources):
    assert _got(spark, _rows(n, sources), height=2) == _plain(_rows(n, sources))


def test_full_blocks(spark):
    rows = _rows(2187 + 700, 1) + [(10**9 + i, "a\nb", "de", "other", 3) for i in range(5)]
    assert _got(spark, rows) == _plain(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "\n", None, None, 1), (2, None, "en", None, None), (2, None, "en", None, None), (2, "", "en", "", 0)]
    rows += [(7, "x\n" * 400_000, "", "é", 1), (-(2**63), "\n\n", "en", "z", 1), (2**63 - 1, "\n", "en", "z", 1)]
    assert _got(spark, rows) == _plain(rows)


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_versions_share_all_but_the_path(spark):
    """A changed leaf's copies and the shared nodes together are the tree that a rebuild would give."""
    leaves = [(str(i), "a", i, _h(str(i)), _h(f"new{i}") if i == 17 else None) for i in range(40)]
    entries, shared = merkle_manifest(spark.createDataFrame(leaves, "key string, source string, rank_by int, digest string, changed string"), 2)
    rebuilt = _levels([r[4] or r[3] for r in leaves])
    before = _levels([r[3] for r in leaves])
    rows = {r.key: r for r in entries.collect()}
    assert rows["17"].copied == [rebuilt[h][17 // 3**h] for h in range(1, len(rebuilt))] and rows["16"].copied is None
    assert rows["17"].root == before[-1][0]
    nodes = {(r.band, r.block): r.levels for r in shared.where("tree = '=a'").collect()}
    for height, level in enumerate(before[:-1]):
        band, inside = divmod(height, 2)
        for i, digest in enumerate(level):
            block, at = divmod(i, 9 // 3**inside)
            assert nodes[(f"tree {band}", block)][inside][at] == digest
    assert sum(a != b for x, y in zip(before, rebuilt, strict=True) for a, b in zip(x, y, strict=True)) == len(rebuilt)
