"""Pipeline stages on a small table with a null, an empty and a repeated row, and the language model's score against plain Python."""

import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import kneser_ney, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    every = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = every.orderBy("doc_id").limit(2).collect()
    odd = [one.asDict() | change for change in ({}, {"doc_id": None}, {"doc_id": 9_000_001, "text": None}, {"doc_id": 9_000_002, "text": ""})]
    odd.append(two.asDict() | {"doc_id": 9_000_003, "text": two["text"].replace(" ", "  ", 1)})
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy(F.length("text").desc()).first()["text"]
    odd.append(two.asDict() | {"doc_id": 9_000_004, "text": "some words before " + item.upper() + " and after"})
    return every.unionByName(spark.createDataFrame(odd, every.schema)).cache()


def brute_clusters(rows):
    """Groups of rows linked by a Jaccard of 0.8 over five-word shingles, of rows that have five words."""
    sets = [(k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for k, r in enumerate(rows) if len(w := (r["text"] or "").lower().split()) >= 5]
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by = defaultdict(list)
    for k, s in sets:
        for g in s:
            by[g].append(k)
    near, of = {tuple(sorted((a, b))) for ks in by.values() for a in ks for b in ks if a != b}, dict(sets)
    for a, b in near:
        if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]):
            root[find(a)] = find(b)
    out = defaultdict(list)
    for k, _ in sets:
        out[find(k)].append(k)
    return list(out.values())


def test_toxicity_keeps_odd_rows(spark, docs):
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert out.columns == docs.columns
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    left, had = Counter(r["doc_id"] for r in out.collect()), Counter(r["doc_id"] for r in docs.collect())
    assert left[9_000_001] == left[9_000_002] == 1 and all(left[i] in (0, n) for i, n in had.items())
    gone = {i for i in had if not left[i]}
    # some eleven toxic rows are few to learn from: seven are found
    assert len(gone & toxic) >= 0.5 * len(toxic & set(had)) and len(gone - toxic) <= 0.05 * len(had)


def test_line_dedup_keeps_rows(spark, docs):
    out = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    was = {(r["doc_id"], i): r["text"] for i, r in enumerate(docs.where("doc_id >= 9000001").orderBy("doc_id").collect())}
    got = {(r["doc_id"], i): r["text"] for i, r in enumerate(out.where("doc_id >= 9000001").orderBy("doc_id").collect())}
    assert got[(9_000_001, 0)] is None and got[(9_000_002, 1)] == "" and was.keys() == got.keys()
    assert set((got[(9_000_003, 2)] or "").split("\n")) <= set(was[(9_000_003, 2)].split("\n")) | {""}


def test_near_dedup_leaves_one_of_each_group(spark, docs):
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    rows, kept = docs.collect(), Counter((r["doc_id"], r["text"]) for r in out.collect())
    groups = brute_clusters(rows)
    assert any(len(g) > 1 for g in groups)
    for g in groups:
        stays = {(rows[k]["doc_id"], rows[k]["text"]) for k in g}
        assert sum(kept[x] for x in stays) == 1
        ids = [rows[k]["doc_id"] for k in g if rows[k]["doc_id"] is not None]
        assert not ids or kept[next(x for x in stays if kept[x])] and next(x for x in stays if kept[x])[0] == min(ids)


def test_near_dedup_takes_the_links_of_fingerprints(spark, docs):
    """Where one shingle is most of a text the fingerprint is its hash, however unlike the sets of five-word shingles are."""
    made = [(1, "q " * 20 + "one two three"), (2, "Q " * 20 + "four five six"), (3, "other words here"), (4, None), (5, "")]
    rows = spark.createDataFrame(made, "doc_id long, text string")
    of = {r["doc_id"]: r["component_id"] for r in simhash.components(rows).collect()}
    assert of == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert {r["doc_id"] for r in simhash.keep_one(rows).collect()} == {1, 3, 4}
    every = docs.where("doc_id is not null").select("doc_id", "text")
    of = {r["doc_id"]: r["component_id"] for r in simhash.components(every).collect()}
    assert max(Counter(of[r["doc_id"]] for r in simhash.keep_one(every).collect()).values()) == 1


def test_decontamination_drops_what_holds_ten_words(spark, docs):
    out = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
    assert out.columns == docs.columns
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    find = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = find(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    clean = lambda t: not any(tuple(w[i : i + n]) in windows for w in [find(t)] for n in sizes for i in range(len(w) - n + 1))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r["doc_id"], r["text"]) for r in docs.collect() if clean(r["text"]))
    assert not out.where("doc_id = 9000004").count()


def test_mix_takes_documents_of_its_input(spark, docs):
    out = corpus_pipeline.mix(spark, docs, SF)
    assert set(docs.columns) <= set(out.columns)
    had = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert all(had[(r["doc_id"], r["text"])] for r in out.collect())


def test_score_against_plain_python(spark, docs):
    texts = [r["text"] for r in docs.where("doc_id % 3 = 0 or doc_id is null").collect()]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    count, pairs = Counter(), Counter()
    for t in texts:
        own = [*kneser_ney.words(t), "end"]
        count.update(own)
        pairs.update(zip(["begin", *own[:-1]], own, strict=True))
    total, ends, after = Counter(), Counter(w for _, w in pairs), defaultdict(list)
    for (a, _), n in pairs.items():
        total[a] += n
        after[a].append(n)

    def steps(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        assert all(n)
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))]

    high, low = steps(list(pairs.values())), steps(list(ends.values()))
    spare = sum(low[min(n, 3)] for n in ends.values()) / len(pairs)

    def log10(t):
        own, out = [*kneser_ney.words(t), "end"], 0.0
        for a, w in zip(["begin", *own[:-1]], own, strict=True):
            p = max(ends[w] - low[min(ends[w], 3)], 0) / len(pairs) + spare / (len(count) + 1)
            if total[a]:
                n = pairs[(a, w)]
                p = max(n - high[min(n, 3)], 0) / total[a] + sum(high[min(x, 3)] for x in after[a]) / total[a] * p
            out += math.log10(p)
        return out

    for r in kneser_ney.score(docs, model).collect():
        assert math.isclose(r["kn_score"], log10(r["text"]), rel_tol=1e-9), r["doc_id"]
