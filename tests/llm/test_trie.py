"""Conversation trie against plain Python: shared heads, hot turns, ties, nulls, repeated rows, no rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import trie
from tidepanel.llm.queries import SQL


def plain(rows):
    own, nodes = {}, {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{r}\n{x}".encode()).hexdigest(), (r, x)))
    own = {c: [q[2] for q in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
        for d in range(len(seq[c]) + 1):
            nodes.setdefault(seq[c][:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + ((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(seq[c]) == len(p)))) for p, m in nodes.items()}
    return sorted(
        (len(p), min(m), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()
    )


def flat(rows):
    return sorted((r["depth"], r["conv_id"], -1 if r["depth"] == 0 else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows)


KIND = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(3)
    rows = []
    for c in range(-30, 170):
        for t in range(rnd.randint(1, 7)):
            first = t == 0 and rnd.random() < 0.6
            rows.append((c, t, "system" if first else rnd.choice(["user", "bot"]), "be kind\tand  brief" if first else rnd.choice(["a", "b b", "", "c\x0bd e"])))
    rows += [(c, t, "user", f"same {t} words") for c in (200, 220, 240, 241, 260, 281) for t in range(4)]  # copies
    rows += [(300, None, None, None), (300, 1, "user", None), (301, 0, "user", "x"), (301, 0, "user", "x"), (301, 0, "bot", "y"), (None, 0, "user", "lost")]
    rows += [(320, t, "user", "long " * 3_000 if t == 5 else str(t // 2)) for t in range(200)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_size", [None, 2])
def test_equals_plain_python(spark, talk, local_size):
    df = spark.createDataFrame(talk, KIND).withColumn("b", F.lit("clash")).withColumn("ids", F.lit(1))
    got = trie.trie(trie.sequences(trie.share_heads(trie.turns(df))), local_size)
    assert got.columns == [x.split()[0] for x in trie.NODE.split(", ")]
    assert flat(got.collect()) == plain(talk)


def test_sql_says_the_same(talk):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talk)
    got = con.execute(SQL["op11_conversation_trie"]).fetchall()
    assert sorted((d, c, -1 if d == 0 else p, *rest) for c, d, p, *rest in got) == plain(talk)


def test_members_of_a_hot_sequence_are_hashed_in_order_across_tasks(spark):
    rows = [(c, 0, "user", "hi") for c in range(0, 9_000)]
    root, hot = sorted(trie.report(spark.createDataFrame(rows, KIND).repartition(7)).collect(), key=lambda r: r["depth"])
    assert root["n_convs"] == 9_000 and hot["saved_tokens"] == 8_999
    assert hot["ends_sha256"] == hashlib.sha256(",".join(map(str, range(9_000))).encode()).hexdigest()


def test_a_turnless_conversation_is_a_member_of_the_root_only(spark):
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # its base is absent and its only turn goes
    rows = trie.report(spark.createDataFrame([(turnless, 0, "user", "gone")], KIND)).collect()
    assert flat(rows) == [(0, turnless, -1, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_no_rows_give_no_nodes(spark):
    empty = spark.createDataFrame([], KIND)
    assert trie.report(empty).count() == 0
    assert trie.report(spark.createDataFrame([(None, 1, "user", "x")], KIND)).count() == 0


def test_deep_chains_need_no_recursion():
    ids = list(range(20_000))
    rows = [(ids, [1] * len(ids), 5, 2, "e"), ([*ids, 7], [1] * (len(ids) + 1), 9, 1, "f")]
    nodes = list(trie.multikey(rows, 0, None))
    assert len(nodes) == 20_002 and nodes[-1] == (5, 0, None, 3, 1, 1, 40_000, trie.NOBODY)
