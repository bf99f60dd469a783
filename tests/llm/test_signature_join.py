"""The n-gram Jaccard join against plain code."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from shiftlens.llm import signature_join as module
from shiftlens.llm.signature_join import one_of_each, signature_join, spanning_links

SCHEMA = "doc_id bigint, text string, key string"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain(rows, k=5, percent=80):
    """All pairs, and components by repeated relabelling."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least[g] if i is not None else None) for g, (i, _), s in zip(group, rows, sets, strict=True)), key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in signature_join(docs, **kw).collect()), key=str)


def edited(seed, groups=12, size=9):
    rng = random.Random(seed)
    letters = [f"w{i}" for i in range(300)] + ["É", "ß", "Mixed"]
    passage = [rng.choice(letters) for _ in range(30)]
    rows = []
    for g in range(groups):
        words = [rng.choice(letters) for _ in range(rng.choice([3, 5, 6, 8, 14, 40, 120, 300]))]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(letters)
            if rng.random() < 0.3:
                copy += passage[: rng.randrange(30)]
            rows.append((len(rows) * 37 % 1009, rng.choice([" ", "\n", "\t"]).join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = edited(seed)
    assert run(spark, rows) == plain(rows)


def test_small_trees_blocks_and_buckets(spark, monkeypatch):
    for name, value in (("TREE_TOKENS", 800), ("BUCKET_TOKENS", 100), ("CHUNK_CLASSES", 7)):
        monkeypatch.setattr(module, name, value)
    rows = edited(3, 6, 20)
    assert run(spark, rows) == plain(rows)


def test_other_similarity_and_length(spark):
    rows = edited(4, 8)
    assert run(spark, rows, k=2, percent=60) == plain(rows, 2, 60)


def test_nulls_short_repeated_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A B\tC"), (6, "a b"), (7, long), (8, long + " y"), (9, "z"), (9, "z"), (10, "z z z z z z z")]
    assert run(spark, rows) == plain(rows)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (3, text + " x"), (9, text), (9, text), (4, "other words here"), (4, "other words here"), (None, text), (6, None), (7, "")]
    got = one_of_each(spark.createDataFrame([(*r, "k") for r in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, text + " x"), (4, "other words here"), (None, text), (6, None), (7, "")], key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("paired", [False, True])
def test_tree_traversal_loses_no_link(paired):
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (4, 30, 200, 900)]
    sets = []
    for _ in range(150):
        one = base[rng.integers(len(base))]
        sets.append(np.unique(np.r_[one[rng.random(len(one)) > rng.choice([0, 0.05, 0.3])], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)]))
    sets = [s for s in sets if len(s)]
    cut = len(sets) // 2
    links = spanning_links(sets[:cut], sets[cut:], 80) if paired else spanning_links(sets, None, 80)
    wanted = np.arange(len(sets))
    got = wanted.copy()
    for a, b in combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and (not paired or (a < cut) != (b < cut)):
            wanted[wanted == wanted[b]] = wanted[a]
    for a, b in links:
        got[got == got[b]] = got[a]
    assert len(set(zip(wanted.tolist(), got.tolist(), strict=True))) == len(set(wanted.tolist())) == len(set(got.tolist()))
