"""Words and hashes against plain code; components against relabelling."""

import random
import re

import numpy as np
import pyarrow as pa

from shiftlens.llm import fingerprints as fp
from shiftlens.llm.components import components


def test_words_equal_plain_cutting():
    rng = random.Random(1)
    signs = ["a", "B", "é", "日", " ", "\n", "\x0b", "\t", "\x1f", "-", "Z9"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, " ", "end "]
    words = fp.words_of(pa.array(texts), lower=True)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = {}
    for i, a, z in words.rows():
        want = re.findall(r"[^\x20\x09-\x0D]+", (texts[i] or "").translate(fold))
        assert [words.text(w).decode().translate(fold) for w in range(a, z)] == want
        for w, word in zip(range(a, z), want, strict=True):
            assert seen.setdefault(word, words.hashes[w]) == words.hashes[w]
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_place_or_slice():
    long = "x" * (3 * fp.SLICE + 5)
    text = " ".join(["alpha"] * (fp.SLICE // 4) + [long, "omega", "alpha", long])
    words = fp.words_of(pa.array(["alpha omega", None, text]))
    assert words.hashes[0] == words.hashes[2] == words.hashes[-2] and words.hashes[1] == words.hashes[-3]
    assert words.hashes[-1] == words.hashes[-4] and len(set(words.hashes.tolist())) == 3


def test_sliced_columns_and_grams():
    column = pa.array(["zero", "a b c", None, "b c a b c"]).slice(1)
    words = fp.words_of(column)
    assert words.first.tolist() == [0, 3, 3, 8]
    one, two = fp.grams(words.hashes[:3], 2), fp.grams(words.hashes[3:], 2)
    assert one.tolist() == [two[2], two[0]] == [two[2], two[3]] and not len(fp.grams(words.hashes[:1], 2))
    parts = list(fp.slices(pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 7 + ["y" * 100])], ["t"]), "t", 25))
    assert [p.num_rows for p in parts] == [2, 2, 2, 1, 1]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(80)]
    label = {}
    for a, b in pairs:
        la, lb = label.setdefault(a, a), label.setdefault(b, b)
        if la != lb:
            low, high = min(la, lb), max(la, lb)
            label = {n: low if x == high else x for n, x in label.items()}
    rows = [*pairs, (None, 1), (7, None), (9, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "x bigint, y bigint")).collect()}
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: label[n] for n in linked}
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0
