"""Segment-tree encoding against the tokenizers library, and decoding."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, WORLD! it's we'll 2024", "ΑΣ ΌΣΟΣ İstanbul ẞ é é", "<|startoftext|>a <|endoftext|><|endoftext|>b<|endof", "", None, "   \t\n", "a\x1c\x1db\x85c　d",
    "Hello, WORLD! it's we'll 2024", "漢字 😀 ﬁﬂ ①", "x" * 40_000, "many words here " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Bpe(f.read())


def test_columns_and_round_trip(spark, library):
    rows = [(None if k == 2 else k // 2, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("taken")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(df, PATH), PATH, "_ids")
    assert out.columns == ["doc_id", "text", "ids", "decoded", "_ids", "_decoded"]
    got = sorted((str(r["text"]), str(r["doc_id"]), bytes(r["_ids"]), r["_decoded"]) for r in out.collect())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(t), str(d), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_random_texts_like_the_library(own, library):
    rnd = random.Random(1)
    letters = [chr(c) for c in range(0x20, 0x250)] + list("'stremdl 0123αβγς") + ["'s", "'ll", " ", "<|endoftext|>", "ing", "the"]
    for _ in range(3_000):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ties_take_the_leftmost_pair(own, library):
    for n in range(1, 80):
        word = "ab"[n % 2] * n + "a" * (n % 5)
        assert np.frombuffer(own.word(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_a_text_beyond_the_block_bound(own, library):
    text = "Ein langer Text\x1cmit Σ und 'll " * 60_000
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_no_rows(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        source = f.read()
    with pytest.raises((ValueError, TypeError)):
        bpe.Bpe(source)
