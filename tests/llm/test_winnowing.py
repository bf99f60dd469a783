"""Decontamination against plain code."""

import hashlib
import random
import re

from shiftlens.llm import winnowing
from shiftlens.llm.winnowing import decontaminate
from shiftlens.plans.scratch import written
from tests.conftest import plan_of

DOCS, ITEMS = "doc_id bigint, text string, n_words string", "item_id bigint, text string, key string"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))


def plain(docs, items, window=10):
    runs = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            runs.setdefault(tuple(w[p : p + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(r) for r in runs}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in runs:
                    hit.update(range(p, p + n))
                    found |= runs[tuple(w[p : p + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    frames = [spark.createDataFrame([(*r, "clash") for r in rows], schema) for rows, schema in ((docs, DOCS), (items, ITEMS))]
    return sorted((tuple(r) for r in decontaminate(*frames, **kw).collect()), key=str)


def passages(seed, short):
    rng = random.Random(seed)
    letters = [f"w{i}" for i in range(40)] + ["É", "日本", "UPPER", "x1"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate([10, 11, 25, 60, *([1, 2, 9] if short else [])])]
    docs = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(4)):
            cut = rng.choice(items)[1].split()
            low = rng.randrange(len(cut))
            text += cut[low : low + rng.randrange(30)] if rng.random() < 0.7 else [rng.choice(letters) for _ in range(12)]
        docs.append((i, rng.choice([" ", ", ", "--\n"]).join(text)))
    return docs, items


def test_against_the_definition(spark):
    for short in (False, True):
        docs, items = passages(3, short)
        assert run(spark, docs, items) == plain(docs, items)


def test_nulls_repeats_and_long_texts(spark):
    item = "One two THREE four five six seven eight nine ten eleven"
    docs = [(None, item), (1, None), (2, ""), (3, "... !"), (4, "a " * 60_000 + item), (5, item), (5, item), (5, "other"), (6, "one two three")]
    items = [(7, item), (7, "one two three four five six seven eight nine ten"), (None, "x y z " * 5), (8, None), (9, " "), (70, item)]
    assert run(spark, docs, items) == plain(docs, items)


def test_other_sizes_and_empty_tables(spark):
    docs, items = passages(4, True)
    assert run(spark, docs, items, window=6, k=3) == plain(docs, items, 6)
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, [], items) == []


def test_the_same_without_broadcasts_and_no_words_in_the_join(spark, monkeypatch):
    docs, items = passages(5, True)
    monkeypatch.setattr(winnowing, "broadcast_if_small", lambda frame: frame.hint("shuffle_hash"))
    assert run(spark, docs, items) == plain(docs, items)
    rows = written(spark.createDataFrame([(i, i, t) for i, t in docs], "doc_id bigint, key bigint, text string"), "docs")
    frame = written(spark.createDataFrame(items, "item_id bigint, text string"), "items")
    marks = written(winnowing.benchmark_windows(frame, 10, 5).select("mark", "length").distinct(), "marks")
    plan = plan_of(winnowing._candidates(rows, marks.hint("shuffle_hash"), [1, 2, 9], 10, 5))
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: (.*)", plan)
    names = {n for m in moved for n in re.findall(r"(\w+)#", m)}
    assert names == {"doc_id", "key", "n_words", "at", "mark", "length", "found"}


def test_few_different_words(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("ab") for _ in range(n))) for i, n in enumerate([10, 14, 40, 7])] + [(9, "a " * 30)]
    docs = [(i, " ".join(rng.choice("aab") for _ in range(rng.randrange(90)))) for i in range(60)] + [(99, "a " * 500)]
    for k in (1, 5, 10):
        assert run(spark, docs, items, k=k) == plain(docs, items)


def test_fingerprints_are_thinner_than_windows(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))
    docs = spark.createDataFrame([(1, 5, text)], "doc_id bigint, key bigint, text string")
    marks = winnowing.benchmark_windows(spark.createDataFrame([(1, text)], "item_id bigint, text string"), 10, 5).select("mark", "length")
    places = winnowing._candidates(docs, marks.distinct(), [], 10, 5).where("length > 0").count()
    assert places < 4000 * 0.36  # two of seven windows are expected
