"""Line deduplication against brute force on thousands of lines, and the SQL of corpus queries against DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import lines, queries


def brute(rows):
    """Removed places per document: a matrix of common tokens over all lines."""
    every = [(i, p, frozenset(line.lower().split())) for i, t in sorted(rows) for p, line in enumerate(t.split("\n"))]
    every = [x for x in every if x[2]]
    number = {w: k for k, w in enumerate(sorted({w for _, _, s in every for w in s}))}
    x = np.zeros((len(every), len(number)), np.float32)
    for k, (_, _, s) in enumerate(every):
        x[k, [number[w] for w in s]] = 1
    size, out = x.sum(1), {}
    for k, (i, p, _) in enumerate(every):
        common = x[:k] @ x[k]
        if (common >= 0.8 * (size[:k] + size[k] - common) - 1e-6).any():
            out.setdefault(i, []).append(p)
    return out


@pytest.mark.parametrize("crowd", [256, 8])
def test_five_thousand_lines(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "BROADCAST", 100_000 if crowd > 8 else 0)
    rng, rows = np.random.default_rng(9), []
    words = [f"w{k}" for k in range(3000)]
    zipf = 1 / np.arange(1, 3001)
    base = [list(rng.choice(words, rng.integers(1, 40), p=zipf / zipf.sum())) for _ in range(1500)]
    for i in range(500):
        text = []
        for _ in range(10):
            own = list(base[int(rng.integers(1500))]) if rng.random() < 0.7 else list(rng.choice(words, rng.integers(1, 40)))
            if rng.random() < 0.5:
                own[int(rng.integers(len(own)))] = f"x{rng.integers(10**6)}"
            text.append(" ".join(own).upper() if rng.random() < 0.2 else "\t".join(own))
        if i % 5 == 0:
            text[3] = "one very common line of this corpus"
        rows.append((i, "\n".join(text)))
    got = {r["doc_id"]: r["removed"] for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["removed"]}
    assert got == brute(rows)


def test_long_lines_around_the_wide_signature(spark):
    rng, rows = np.random.default_rng(4), []
    words = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(words, int(n), replace=False)) for n in rng.integers(lines.LONG - 15, lines.LONG + 90, 40)]
    for i in range(160):
        own = list(base[int(rng.integers(40))])
        for _ in range(int(rng.integers(0, 14))):
            own[int(rng.integers(len(own)))] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(own[: len(own) - int(rng.integers(0, 12))])))
    got = {r["doc_id"]: r["removed"] for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["removed"]}
    want = brute(rows)
    assert got == want and 20 < len(want) < 140


def test_very_long_line_and_ties(spark):
    long = " ".join(f"l{k}" for k in range(20_000))
    five = "a b c d e"  # four of five words: 4/6 is below the bound, five of six above it
    rows = [(1, long), (2, long + " more"), (3, f"{five}\na b c d x\na b c d e f"), (4, ""), (5, None), (5, None), (None, five)]
    got = {r["doc_id"]: r["removed"] for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [2], 4: [], 5: [], None: [0]}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name, tmp_path):
    home = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{home}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, home)
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


def test_ranks_are_neither_in_the_plan_nor_in_its_rows(spark, tmp_path):
    """A constant of half a million ranks took the driver's memory with every description of the plan."""
    df = spark.createDataFrame([(1, "a b c d\ne\tf g\rh"), (2, "a b c e")], "doc_id long, text string")
    rows = lines._lines(df).select("doc_id", "th", "pos", "id", lines.tokens(F.col("line")).alias("toks"))
    rows.select("*", F.size("toks").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("h")).write.parquet(f"{tmp_path}/sets")
    heads = lines._heads(spark.read.parquet(f"{tmp_path}/sets"), 0.8)
    plan = heads._jdf.queryExecution().toString()
    top = heads._jdf.queryExecution().executedPlan().toString().split("Subquery", 1)[0]
    assert len(plan) < 50_000 and top.count("Project") == 1
    assert sorted((r["doc_id"], len(r["head"])) for r in heads.collect()) == [(1, 1), (1, 1), (2, 1)]
