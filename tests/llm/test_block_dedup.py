"""Substring deduplication against plain code."""

import hashlib
import random
import re

import pytest

from shiftlens.llm import block_dedup as module
from shiftlens.llm.block_dedup import block_dedup

SCHEMA = "doc_id bigint, text string, n_words string"


def plain(rows, window=20):
    """The definition, word by word."""
    last = 1 << 63
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [last if i is None else i for i, _ in rows]
    for r, w in enumerate(words):
        for p in range(len(w) - window + 1):
            run = tuple(w[p : p + window])
            first[run] = min(first.get(run, (last + 1, 0)), (order[r], p))
    out = []
    for r, w in enumerate(words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (order[r], p):
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((rows[r][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in block_dedup(docs, keep_text=False, **kw).collect()), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    letters = [f"w{i}" for i in range(400)] + ["É", "ß x", "日本"]
    passages = [[rng.choice(letters) for _ in range(k)] for k in (19, 20, 21, 29, 30, 64, 200)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randrange(40))]
        rows.append((i * 3 % n, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(spark, monkeypatch, seed):
    if seed == 2:  # many loads
        monkeypatch.setattr(module, "LOAD_WORDS", 200)
    rows = texts(seed)
    assert run(spark, rows) == plain(rows)


def test_nulls_repeats_short_and_periodic_texts(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(None, long), (None, None), (1, None), (2, ""), (3, long), (3, long), (3, "a " + long), (4, "a " * 500), (5, " \n"), (6, long + " tail")]
    assert run(spark, rows) == plain(rows)


def test_other_lengths_and_kept_text(spark):
    rows = texts(5, 20)
    assert run(spark, rows, window=8) == plain(rows, 8)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "z a b c d y")], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in block_dedup(docs, window=4).collect()} == {1: "a b c d e f", 2: "z y"}


def test_empty_table(spark):
    assert run(spark, []) == []
