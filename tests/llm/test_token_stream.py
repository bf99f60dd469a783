"""Token files: the codes, the round trip against plain encoding, order and starts."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shiftlens.llm.token_stream import WORDS, Encoder, pack, read_tokens, unpack, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, start int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24])))
def test_codes_round_trip(values):
    numbers = np.array(values, "<u4")
    control, data = pack(numbers)
    assert unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(1 + (v > 255) + (v > 65535) + (v > 2**24 - 1) for v in values) + -len(values) % 4


def _plain(rows):
    t = Tokenizer.from_file(PATH)
    coded = [(d, t.encode(text or "", add_special_tokens=False).ids + [1]) for d, text in rows]
    return sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0))


ODD = ["", None, " ", "<|endoftext|>x <|startoftext|>", "á ́b ë", "café CAFÉ İ ΣΣ", "a b c\x0bd\x0ce\x1cf\x85g",
       "it's we'll I'd 's 't", "1234 5,6.7", "你好世界 \U0001f600\U0001f600", "x" * 5000, "a\x00b", "﻿q ​", "word " * 3000, "\n\t\r\n", "<|endof text|>"]


def test_words_apart_are_encoded_like_whole_texts(monkeypatch):
    """Splitting at white space gives what the library gives for the whole text."""
    t, rng = Tokenizer.from_file(PATH), random.Random(4)
    marks = ["a", "B", "́", " ", "\n", "\t", "'s", "7", "é", "!", " ", "ᄀ", "ᅡ", "<|endoftext|>", "İ", "\r", "ͅ", "‍", "\x85", "ཱ", "ß", "ÿ", "È", "-", "<", "|", ".", "²", "×"]
    texts = [x or "" for x in ODD] + ["".join(rng.choices(marks, k=rng.randrange(30))) for _ in range(20000)]
    monkeypatch.setattr("shiftlens.llm.token_stream.KEPT_PIECES", 30)
    encode = Encoder(open(PATH, encoding="utf-8").read(), np.dtype("<u2"), WORDS)
    assert [np.frombuffer(encode(x), "<u2").tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kw", [{}, {"block_ids": 50, "file_ids": 400}, {"piece": None}])
def test_round_trip(spark, tmp_path, kw):
    rows = [(i * 3, f"Document {i} has words, " * (i % 9)) for i in range(120)] + list(zip(range(1000, 2000), ODD, strict=False))
    rows += [(-(2**63), "least"), (2**63 - 1, "most")]
    random.Random(1).shuffle(rows)
    folder = f"file://{tmp_path}/out"
    manifest = write_tokens(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5), folder, PATH, **kw).collect()
    want, at = [], 0
    for doc_id, ids in _plain(rows):
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", "ids").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == want
    assert sum(r.tokens for r in manifest) == at and {r.name for r in manifest} == {f for f in os.listdir(tmp_path / "out") if f.endswith(".rtok")}
    assert "_temporary" not in os.listdir(tmp_path / "out") and (len(manifest) > 3 or "file_ids" not in kw)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True) and sum(r.n for r in ranks) == at


def test_nulls_and_repeats(spark, tmp_path):
    rows = [(None, "null id"), (None, None), (5, "same"), (5, "same"), (5, "other words here")] + [(7, "hot")] * 300
    folder = f"file://{tmp_path}/out"
    write_tokens(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).repartition(3), folder, PATH, block_ids=20, file_ids=100)
    got = read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 2 + [5] * 3 + [7] * 300
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(ids) for _, ids in _plain(rows))


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    assert write_tokens(spark.createDataFrame([], SCHEMA), folder, PATH).count() == 0
    assert read_tokens(spark, folder).count() == 0


def test_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    name = write_tokens(spark.createDataFrame([(1, "some words", "", 1)], SCHEMA), folder, PATH).first().name
    path = tmp_path / "out" / name
    data = bytearray(path.read_bytes())
    data[-1] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        read_tokens(spark, folder).collect()
