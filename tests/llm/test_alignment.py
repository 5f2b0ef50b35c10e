"""Tokenizer alignment against a plain merge of both token streams."""

import collections
import gc
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, it's 1234 foxes.", "naïve 漢字 😀 ﬁ", "<|endoftext|> <s> </s> <0x41> <unk>", "a▁b spells differently", "", None, " ", "\n\n\ttabs  and   runs", "é\x00\x1f odd",
    "repeat repeat repeat", "repeat repeat repeat", "Ünïcödé " * 900, "x" * 5_000, "word " * 20_000,
]


def plain(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    pieces, alphabet = {i: p for p, i in a.get_vocab().items()}, alignment.byte_alphabet()
    seen, out = collections.Counter(), []
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p = [bytes(alphabet[c] for c in pieces[i]) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole, links, groups, i, j, at, bt, left, right = (" " + (text or "")).encode(), [], [], 0, 0, 0, 0, [], []
        if b"".join(p) != whole or b"".join(q) != whole:
            x, y = [], []
        while i < len(x) and j < len(y):
            links.append((x[i], y[j]))
            end_a, end_b = at + len(p[i]), bt + len(q[j])
            if end_a <= end_b:
                left.append(x[i])
                at, i = end_a, i + 1
            if end_b <= end_a:
                right.append(y[j])
                bt, j = end_b, j + 1
            if end_a == end_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        seen.update(links)
        out.append((doc, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    top = collections.Counter()
    for (_, k), n in seen.items():
        top[k] = max(top[k], n)
    return sorted((str(d), m, n, g, len(l), sum(seen[p] == top[p[1]] for p in l), sum(seen[p] for p in l), s) for d, m, n, g, l, s in out)


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_equals_plain_python(spark, monkeypatch, frequent):
    """With 20 pairs at most broadcast, nearly all counts come from the join by pair."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(TEXTS)]  # null and repeated ids
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("clash")).withColumn("a_ids", F.lit(0)).repartition(3)
    got = alignment.align(df, A, B)[0].collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain(rows)


def test_pair_counts_name_the_best_of_each_id(spark):
    links = spark.createDataFrame([(1, 9), (1, 9), (2, 9), (2, 9), (3, 9), (3, 8)], "a int, b int")
    got = {(r["a"], r["b"]): (r["n"], r["best"]) for r in alignment.pair_counts(links).collect()}
    assert got == {(1, 9): (2, True), (2, 9): (2, True), (3, 9): (1, False), (3, 8): (1, True)}


def test_no_rows(spark):
    out, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0 and pairs.count() == 0


def test_another_kind_of_vocabulary_is_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        source = f.read()
    with open(B, "rb") as f, pytest.raises((ValueError, KeyError)):
        alignment.Pair(source, f.read())


def test_runs_are_cut_only_where_both_sides_stay_the_same():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    with open(A, "rb") as f, open(B, "rb") as g:
        pair = alignment.Pair(f.read(), g.read())
    rnd = random.Random(4)
    parts = [" "] * 12 + ["\n", "\t", "  ", "\u00a0", "\u3000", "a", "the", "'s", "'", "12", "é", "漢", "<s>", "\x1c", ".", "naïve", "😀"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 20))) for _ in range(4_000)]
    for text, found in zip(texts, pair(texts), strict=True):
        assert found and found[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids and found[1].tolist() == b.encode(text)


def test_a_run_that_comes_again_is_given_once(spark):
    """Spark gets each distinct run of a block once, and makes of it the groups and links of every place."""
    texts = ["repeat repeat naïve 漢字"] * 300 + ["naïve  repeat", " naïve", "a▁b repeat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = alignment.blocks(df, A, B).select(F.size("docs").alias("docs"), F.size("runs").alias("runs")).collect()
    assert sum(r["docs"] for r in got) == len(texts) and sum(r["runs"] for r in got) == len(got) * 3 + 3
    assert sorted((str(r[0]), *r[1:]) for r in alignment.align(df, A, B)[0].collect()) == plain(enumerate(texts))


def test_a_block_leaves_nothing_behind():
    """A block's runs are freed with it: held in a cycle, those of many blocks piled up in a worker."""
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = alignment.Pair(a.read(), b.read())
    texts = ["one two  three", "two three four", "", None]
    pair.block(texts)
    gc.collect()
    gc.disable()
    try:
        pair.block(texts)
        assert gc.collect() == 0
    finally:
        gc.enable()
