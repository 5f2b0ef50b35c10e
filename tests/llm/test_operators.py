"""Operators against plain Python on small tables, with nulls, empty texts, repeated rows and no rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import decontamination, embeddings, kneser_ney, licenses, lines, mixing, quality, simhash, suffixes, toxicity

WORDS = [f"w{k}" for k in range(40)]


def some_text(seed, n, cut=12):
    rng = np.random.default_rng(seed)
    out = [WORDS[int(x)] for x in rng.integers(0, 40, n)]
    return "\n".join(" ".join(out[k : k + cut]) for k in range(0, n, cut))


@pytest.fixture(scope="module")
def docs(spark):
    base = [some_text(k, 90 + k) for k in range(12)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    near = base[0].split("\n")
    near[1] = near[1].replace("w", "W", 1)
    rows += [(20, base[1], "s0"), (21, "\n".join(near), None), (22, "", "s1"), (23, None, "s2"), (None, base[2], "s1"), (20, base[1], "s0")]
    rows += [(24, "Released under the MIT License.\n" + base[3], "s1"), (25, base[4] + " " + base[5][:300], "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("hits", F.lit(1)).cache()


@pytest.fixture(scope="module")
def bench(spark, docs):
    t = [r["text"] for r in docs.where("doc_id in (3, 4)").collect()]
    items = [(1, " ".join(t[0].split()[5:30])), (2, "no such words here at all in any text of them"), (3, None), (4, "w1 w2"), (5, " ".join(t[1].split()[-11:]).upper())]
    return spark.createDataFrame(items, "item_id long, text string")


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_decontamination(docs, bench):
    items = [(r["item_id"], decontamination.words(r["text"])) for r in bench.collect()]
    want = []
    for i, t in plain(docs):
        w, hit, found = decontamination.words(t), set(), set()
        for j, x in items:
            n = min(10, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        hit.update(range(p, p + n))
                        found.add(j)
        want.append((str(i), len(w), len(hit), len(found), decontamination.digest(sorted(found))))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontamination.report(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    assert decontamination.remove_contaminated(docs, bench).columns == docs.columns


def longest(w, items):
    """(words, place, item, place in the item) of the longest match, extended word by word."""
    best = None
    for j, x in items:
        n = min(10, len(x))
        for a in range(len(x) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                m = n
                if w[p : p + n] == x[a : a + n]:
                    while p + m < len(w) and a + m < len(x) and w[p + m] == x[a + m]:
                        m += 1
                    best = min(best or (0,), (-m, p, j is None, j or 0, a))
    return (-best[0], best[1], None if best[2] else best[3], best[4]) if best else (0, None, None, None)


@pytest.mark.parametrize("block_chars", [8_000_000, 60])
def test_longest_matches(spark, docs, bench, block_chars):
    more = spark.createDataFrame([(11, "w1"), (12, "w2"), (13, "w3"), (None, " ".join(some_text(3, 93).split()[7:33]))], bench.schema)
    bench = bench.unionByName(more)
    items = [(r["item_id"], decontamination.words(r["text"])) for r in bench.collect()]
    want = [(str(i), *longest(decontamination.words(t), items)) for i, t in [*plain(docs), (50, "w1 w2 w3 w1 w2"), (51, "w2")]]
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "w1 w2 w3 w1 w2"), (51, "w2")], "doc_id long, text string"))
    got = decontamination.with_hits(texts.repartition(2), bench, block_chars=block_chars).select("doc_id", "hits.longest").collect()
    got = [(str(r[0]), r[1]["n"], r[1]["at"], r[1]["item"], r[1]["item_at"]) if r[1] else (str(r[0]), 0, None, None, None) for r in got]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert max(m[1] for m in want) >= 25


def test_suffixes(docs):
    rows = plain(docs)
    words = [suffixes.word_spans(t) for _, t in rows]
    seen = collections.Counter(tuple(w[s : s + 50]) for w in words for s in range(len(w) - 49))
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        m = set()
        for s in range(len(w) - 49):
            if seen[tuple(w[s : s + 50])] > 1:
                m.update(range(s, s + 50))
        want.append((str(i), len(w), len(m)))
    got = [(str(r["doc_id"]), r["n_words"], r["n_repeated"]) for r in suffixes.report(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.remove_later(docs).columns == docs.columns


def test_lines(docs):
    rows = sorted(set(plain(docs)), key=lambda r: (r[0] is None, r[0] or 0))
    before, want = [], {}
    for i, t in rows:
        gone = []
        for p, line in enumerate(t.split("\n") if t is not None else []):
            s = set(line.lower().split())
            if s and any(len(s & b) / len(s | b) >= 0.8 - 1e-12 for b in before):
                gone.append(p)
            if s:
                before.append(s)
        want[i] = gone
    for r in lines.report(docs).collect():
        assert r["removed"] == want[r["doc_id"]], r
    out = lines.remove_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_simhash(docs):
    rows = plain(docs)
    fps = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for c, (i, _) in zip(comp, rows, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), f & (1 << 64) - 1, least.get(c)) for c, f, (i, _) in zip(comp, fps, rows, strict=True))
    got = sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.components(docs).collect())
    assert got == want
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_of_null_and_repeated_ids(spark):
    a, b, c, d = (some_text(k, 80) for k in range(50, 54))
    rows = [(None, a), (None, b), (7, c), (7, d), (9, c), (9, d), (None, c)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(None, a), (None, b), (7, c), (7, d)])


def test_keep_one_finds_near_copies(spark):
    rng, rows = np.random.default_rng(8), []
    for k in range(70):
        base = [f"v{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((3 * k, " ".join(base)))
        for j, changed in ((1, 2), (2, 4)):
            own = list(base)
            for x in rng.choice(200, changed, replace=False):
                own[x] = f"new{x}"
            rows.append((3 * k + j, " ".join(own)))
    hot = [f"c{x}" for x in range(300)]
    rows += [(1000 + k, " ".join([*hot, f"tail{k}"])) for k in range(90)] + [(2000, "a b"), (2001, "A  b"), (2002, "a c"), (2003, None), (2004, " ")]
    sets = [{tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if comp[a] != comp[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    want = [rows[k][0] for k in sorted(set(comp))]
    assert sorted(r[0] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
    far = [(simhash.fingerprint(rows[3 * k][1]) ^ simhash.fingerprint(rows[3 * k + 1][1])) & (1 << 64) - 1 for k in range(70)]
    assert max(x.bit_count() for x in far) > simhash.LIMIT


def test_mixing(docs):
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    a, b = (sorted(map(tuple, mixing.mix_sizes(sizes).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == docs.count()
    for source in {r[1] for r in a}:
        own = [r for r in a if r[1] == source]
        assert abs(sum(r[6] for r in own) - own[0][4]) <= max(r[2] for r in own)
        assert all(r[6] <= 3 * r[2] for r in own)


def test_kneser_ney(spark, docs):
    model = kneser_ney.fit(docs.where("doc_id < 8").select("text")).open()
    ids = np.r_[np.arange(model.size), model.size + 1].astype(np.int64)
    ctx = int(model.array("ctx", 0, "bigrams")[0])
    keys = np.sort(np.uint64(ctx) << np.uint64(32) | ids.astype(np.uint64))
    n, total, gamma = model.bigrams(keys)
    low = kneser_ney._discounted(model.continuations(ids), model.low_discount) / model.types + model.low_gamma / (model.size + 1)
    p = kneser_ney._discounted(n, model.discount) / total + gamma * low
    assert abs(p.sum() - 1) < 1e-9
    tokens = collections.Counter(w for _, t in plain(docs) if _ is not None and _ < 8 for w in [*kneser_ney.words(t), b"\n"])
    rows = kneser_ney.score(docs, model).collect()
    for r in rows:
        own = [*kneser_ney.words(r["text"]), b"\n"]
        base = sum(math.log10((tokens[w] + 1) / (tokens.total() + len(tokens) + 1)) for w in own)
        assert abs(base - r["kn_base"]) < 1e-9 and r["kn_tokens"] == len(own)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0] + 0.08 * rng.normal(size=(40, 16))
    x[150] = x[151]
    rows = [(k, [float(v) for v in x[k]], int(k % 2)) for k in range(300)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 0), (303, [1.0] * 16, None)]
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (y @ y.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2) & ~np.eye(300, dtype=bool)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=64, block=50).collect()}
    assert len(got) == 304 and all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(300, 304))
    assert sum(got[k]["n_links"] for k in range(300)) >= 0.95 * link.sum()
    assert all(got[k]["n_links"] <= link[k].sum() for k in range(300))


def test_embeddings_of_null_and_repeated_ids(spark):
    at = lambda a: [math.cos(a), math.sin(a), 0.0]  # noqa: E731  0.3 apart: linked, 0.6 apart: not
    rows = [(None, at(0.0), 1), (5, at(0.3), 1), (7, at(0.6), 1), (7, at(2.0), 1), (7, at(0.3), 1), (None, at(4.0), 1), (None, at(5.0), 1), (2, at(0.0), 2), (3, None, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embeddings.near_duplicates(df).collect())
    want = [("None", 2, "5", False), ("5", 3, "5", True), ("7", 2, "5", False), ("7", 0, "7", True), ("7", 3, "5", False), ("None", 0, "None", True), ("None", 0, "None", True), ("2", 0, "2", True), ("3", 0, "3", True), ("None", 0, "None", True)]
    assert got == sorted(want)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_shingle_sets_stay_below_the_limit_of_open_files(tmp_path):
    resource = pytest.importorskip("resource")
    names = []
    for k in range(400):
        np.arange(k, k + 5, dtype="<u4").tofile(tmp_path / str(k))
        names.append(str(k))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(__import__("os").listdir("/proc/self/fd")) + 150, hard))
    try:
        sets = simhash._Sets(str(tmp_path), names)
        held = [sets(k, 1, 3) for k in range(400)]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert all(x.tolist() == [k + 1, k + 2, k + 3] for k, x in enumerate(held)) and len(sets.open) == 96
    with pytest.raises(FileNotFoundError):
        simhash._Sets(str(tmp_path), ["absent"])(0, 0, 1)


def test_embeddings_scan_where_audits_fail():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + 0.05 * rng.normal(size=(200, 16))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    blind = embeddings.Graph(y.astype(np.float32), np.zeros(400, int), [np.full((400, 24), -1, np.int32)])  # no edges: searches find their entry only
    blind.y = y
    want = int((y @ y.T >= 0.93).sum()) - 400
    assert sum(len(a) for a, _, _ in embeddings.neighbours(blind, y, own=np.arange(400))) == want
    far = np.array([y[7], *rng.normal(size=(200, 16))])  # few links: nothing to audit by
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    assert sum(len(a) for a, _, _ in embeddings.neighbours(blind, far)) == int((far @ y.T >= 0.93).sum()) > 0


def test_embeddings_count_both_ends(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + 0.05 * rng.normal(size=(300, 16))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (y @ y.T >= 0.93) & ~np.eye(600, dtype=bool)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], 0) for k in range(600)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, shard=200, block=100).collect()}
    assert [got[k] for k in range(600)] == link.sum(1).tolist()


def test_licenses(docs):
    got = {r["doc_id"]: r["families"] for r in licenses.report(docs.where("doc_id is not null")).collect()}
    assert got[24] == "MIT" and got[3] == "" and got[23] == ""


def test_wrapped_licenses(spark, docs):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = (
        "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
        "# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    )
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at'
    narrow = "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software\nand associated documentation\nfiles"
    text = some_text(60, 90)
    cases = [(bsd, "BSD"), (gpl.format(3), "GPL-3.0"), (gpl.format(2), "GPL-2.0"), (apache, "Apache-2.0"), (narrow, "MIT"), ("Released under the MIT License.\n" + bsd, "BSD,MIT"), (text, "")]
    rows = [(100 + k, f"{text}\n\n{t}\n\n{text}") for k, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: (r["families"], r["n_licensed"]) for r in licenses.report(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got[100 + k][0] for k in range(len(cases))] == [f for _, f in cases]
    assert got[100][1] == 1 and got[105][1] == 2


def test_every_notice_is_found_and_near_misses_are_not(spark, docs):
    prose = some_text(61, 40)
    cases = [(f"{prose}\n\n" + "\n".join(" ".join(t.split()[k : k + 4]) for k in range(0, len(t.split()), 4)), f) for f, t in licenses.TEMPLATES]
    cases += [(f"{prose}\n{t[0].upper()}{t[1:]}.\n{prose}", f) for f, t in licenses.TEMPLATES]
    cases += [(f"{prose}\n{t}\n{prose}", "") for t in licenses.NEAR_MISSES]
    cases += [
        ('Licensed under the Apache License, Version 2.0 (the "License");', "Apache-2.0"), ("Licensed under the Apache License, Version 1.1", ""), ("SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("Licensed under the GNU Lesser General Public License", "LGPL"), ("A license to sell wine was granted.", ""),
    ]
    rows = [(100 + k, t) for k, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: r["families"] for r in licenses.report(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [(t, got[100 + k]) for k, (t, _) in enumerate(cases)] == cases


def test_licenses_without_cue_words_are_found(spark, docs):
    prose = some_text(62, 40)
    cases = [
        ("distributed under CC-BY 4.0", "CC-BY-4.0"), ("Use of this source code is governed by a BSD-style file", "BSD"),
        ("This work is under a Creative Commons Attribution-ShareAlike 4.0 International agreement", "CC-BY-SA-4.0"), ("made under the terms of the Eclipse Public 2.0", ""),
    ]
    rows = [(100 + k, f"{prose}\n{t}.\n{prose}") for k, (t, _) in enumerate(cases)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert not licenses.cue_windows(texts).count()
    got = {r["doc_id"]: r["families"] for r in licenses.report(docs.select("doc_id", "text").unionByName(texts)).collect()}
    assert [(t, got[100 + k]) for k, (t, _) in enumerate(cases)] == cases


def test_only_paragraphs_that_cannot_confirm_are_passed_over(spark):
    draw = random.Random(63)
    for _, text in licenses.TEMPLATES:
        pairs, versions, need = licenses._needed(text)
        must, some, least = licenses._strings(text)
        for _ in range(40):
            own = {*versions, *draw.sample(pairs, max(need - len(versions), 0))}
            own |= set(draw.sample(pairs, need)) if len(own) < need else set()
            words = {w for p in own for w in p.split()}
            assert set(must) <= words and words & set(some) and len(words) >= least


def test_classifiers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        bad = k % 3 == 0
        t = some_text(k, 60) + (" you pathetic grukko grukka" if bad else "")
        rows.append((k, t if rng.random() < 0.98 else "", int(bad), int(k % 5 > 0)))
        if not rows[-1][3]:
            rows[-1] = (k, "zap zap " * 40, int(bad), 0)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    tox = toxicity.report(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert len(tox) == 300 and all(0 <= r["score"] <= 1 for r in tox)
    clean = {r[0]: r for r in rows if r[1] and r[3]}
    held = [r for r in tox if r["held_out"] and r["doc_id"] in clean]
    assert np.mean([r["predicted"] == clean[r["doc_id"]][2] for r in held]) > 0.9
    good = quality.report(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    own = {r[0]: r for r in rows if r[1]}
    held = [r for r in good if r["held_out"] and r["doc_id"] in own]
    assert np.mean([r["predicted"] == own[r["doc_id"]][3] for r in held]) > 0.9


def test_quality_sample_passes_over_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(quality, "train", lambda texts, y: sorted(texts))
    rows = [(k, "x" * 2000 if k % 2 else f"short {k}", 1) for k in range(40)]
    got = quality.learn(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    assert got == sorted(t for k, t, _ in rows if k % 2 == 0)


def test_texts_are_not_joined_with_labels(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id long, toxic int, quality int")
    plain, seen = type(docs).join, []
    monkeypatch.setattr(type(docs), "join", lambda self, other, *how: seen.append((self.columns, other.columns)) or plain(self, other, *how))
    assert quality.report(docs, labels).count() == toxicity.report(docs, labels).count() == docs.count()
    met = [(a, b) for a, b in seen if {"toxic", "quality"} & {*a, *b}]
    assert met and not any("text" in (*a, *b) for a, b in met)


def test_toxicity_reads_whole_texts():
    text = "quiet " * 700 + "LOUD! " * 4000
    assert toxicity._patterns(text, toxicity.words(text))[2] == 1
    assert toxicity.words("y" * 50 + " z") == {"y" * 50: 1, "z": 1}


def test_label_model_contradicts_noisy_labels():
    rng = np.random.default_rng(1)
    truth = (rng.random(4000) < 0.3).astype(int)
    votes = np.where(rng.random((4000, 14)) < 0.95, 2 * truth[:, None] - 1, 1 - 2 * truth[:, None])
    label = np.where(rng.random(4000) < 0.25, 1 - truth, truth)
    post, rates, _, _ = toxicity.label_model(votes, label)
    assert ((post > 0.5) == truth).mean() > 0.96
    assert abs(rates[-1][0] - 0.75) < 0.15 and abs(rates[-1][1] - 0.25) < 0.05  # the labels' own rates are found
    assert np.abs(rates[:-1] - [0.95, 0.05]).max() < 0.06


def test_samples_of_repeated_rows_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y: seen.append(len(texts)))
    quality.learn(spark.createDataFrame([(1, "same text", k % 2) for k in range(500)], "doc_id long, text string, quality int"), sample=100)
    assert seen == [1]


def test_null_benchmark_ids_count(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, item), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, "ONE two"), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) for r in decontamination.report(docs, bench).collect()}
    assert got[1] == (11, 2, True, decontamination.digest([7])) and got[2][:3] == got[3][:3] == (0, 0, False)


def test_missing_arrays_are_errors(tmp_path):
    model = kneser_ney.Model(str(tmp_path), tokens=10, offsets=[0], size=3, filled={"words": frozenset([0])}).open()
    with pytest.raises(FileNotFoundError):
        model.number(np.array([5], np.uint64))
    with pytest.raises(FileNotFoundError):
        suffixes.Repeated(str(tmp_path), "gram", frozenset([0]), 1, False).find(np.array([5], np.uint64))


def test_open_maps_are_bounded(tmp_path):
    from tidepanel.llm.common import Maps, save_array

    for k in range(300):
        save_array(f"{tmp_path}/x-{k}.npy", np.arange(k, k + 3))
    maps = Maps(str(tmp_path), most=16)
    assert [int(maps(f"x-{k}")[1]) for k in range(300)] == list(range(1, 301)) and len(maps.held) == 16


def test_no_rows(spark, docs, bench):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        decontamination.report(none, bench), suffixes.report(none), lines.report(none), simhash.components(none), licenses.report(none), kneser_ney.report(none),
        toxicity.report(none, labels), quality.report(none, labels), mixing.mix_documents(none),
    ):
        assert out.count() == 0
