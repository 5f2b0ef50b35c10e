"""Prefix trie of conversations by distributed MSD radix partitioning and multikey quicksort (operator 11).

Turns are numbered by a dictionary of distinct (role, text), so a conversation is an array of turn ids. Equal
conversations become one weighted sequence first, however many there are. The radix rounds deal the sequences of
every large bucket by their next turn id; a bucket is the set of sequences below one trie node, named by the node's
smallest conversation. Buckets of ``local_size`` sequences or fewer go to one task, where multikey quicksort orders
them turn by turn and its recursion emits the nodes. Nodes of the large buckets are counted by plain aggregates on
the way down and get the sums of their subtrees on the way up.

No bucket that grows with the data meets in one task: at most ``LARGE`` buckets of a round can be larger than a
``LARGE``-th of all sequences, so the large ones are broadcast and the small ones are bounded. The one sequential
step is the hash of a node's members, a single SHA-256 stream by its definition: the ids are sorted and joined to
chunks by all tasks, and the task that has a hot group only reads its chunks in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Sequences of a bucket that one task finishes, at least; and large buckets of a round, at most.
LOCAL, LARGE = 256, 65_536
#: Nodes of an emitted batch and ids of a chunk.
BATCH, CHUNK = 8_192, 4_096
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODES = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in NODE.split(", ")] + [("top", pa.bool_())])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): one row per conversation, its turns in order as dictionary ids with their word counts.

    Order: turn, null first; equal turns by the SHA-256 of role, a line feed and text (a defined order that needs no
    text in the sort). Null role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    Other columns are ignored. Texts are told apart by role and SHA-256, so no text is shuffled. A conversation's ids
    are one row, which Spark bounds by 2 GB (some 200 million turns).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(role, F.lit("\n"), text), 256).alias("mark"),
        F.sha2(F.concat_ws(":", F.length(role), role, text), 256).alias("word"), words.alias("words"),
    )
    rows = cut(rows)
    dictionary = cut(rows.groupBy("word").agg(F.min("words").alias("words")).withColumn("id", F.monotonically_increasing_id()))
    # a very common turn is a skewed key of this join only, which adaptive execution splits
    coded = rows.drop("words").join(dictionary.hint("merge"), "word")
    one = F.sort_array(F.collect_list(F.struct("turn", "mark", "id", "words")))
    return coded.groupBy("conv_id").agg(one.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def share_heads(convs: DataFrame, every: int = 20, modulus: int = 4) -> DataFrame:
    """Rebuild: the first h turns of conversation c - c % ``every``, then c's own turns after its first h.

    h is crc32 of the decimal c, modulo ``modulus``. An absent base adds nothing. At most 2 * ``every`` - 1
    conversations share a base, so no key is hot.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(base == F.col("conv_id")).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, modulus - 1).alias("base_ids"), F.slice("words", 1, modulus - 1).alias("base_words")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    both = convs.withColumn("h", h).withColumn("base", base).join(heads, "base", "left")

    def rebuilt(name: str):
        head = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.array().cast("array<long>"))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))).alias(name)

    return both.select("conv_id", rebuilt("ids"), rebuilt("words"))


def sequences(convs: DataFrame) -> DataFrame:
    """(ids, words, conv, n, ends): distinct sequences with their smallest conversation, number and hash of members.

    Conversations are range-partitioned by sequence and id, so a hot group is dealt over tasks and sorted there;
    each task joins runs of decimal ids to chunks, and one stream per group hashes its chunks in order.
    """
    schema = "ids array<long>, words array<long>, first long, n long, part string"
    arrow = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("first", pa.int64()), ("n", pa.int64()), ("part", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, run = None, None, []
        done: list[dict] = []

        def close() -> None:
            if run:
                done.append({"ids": ids, "words": words, "first": run[0], "n": len(run), "part": ",".join(map(str, run))})

        for b in batches:
            for c, i, w in zip(b.column("conv_id").to_pylist(), b.column("ids").to_pylist(), b.column("words").to_pylist(), strict=True):
                if i != ids or len(run) == CHUNK:
                    close()
                    ids, words, run = i, w, []
                run.append(c)
                if len(done) == BATCH:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "words", "conv", "n", "ends"]
        arrays = [*arrow.types[:2], pa.int64(), pa.int64(), pa.string()]
        kind = pa.schema(list(zip(names, arrays, strict=True)))
        open_, done, stream = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if open_ is not None and r["ids"] == open_["ids"]:
                    stream.update(b"," + r["part"].encode())
                    open_["n"] += r["n"]
                    continue
                if open_ is not None:
                    done.append(open_ | {"ends": stream.hexdigest()})
                open_ = {"ids": r["ids"], "words": r["words"], "conv": r["first"], "n": r["n"]}
                stream = hashlib.sha256(r["part"].encode())
                if len(done) == BATCH:
                    yield pa.RecordBatch.from_pylist(done, kind)
                    done = []
        if open_ is not None:
            done.append(open_ | {"ends": stream.hexdigest()})
            yield pa.RecordBatch.from_pylist(done, kind)

    packed = convs.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(chunks, schema)
    joined = packed.repartition("ids").sortWithinPartitions("ids", "first")
    return joined.mapInArrow(hashed, "ids array<long>, words array<long>, conv long, n long, ends string")


def multikey(rows: list[tuple], depth: int, parent: int) -> Iterator[tuple]:
    """Nodes of one bucket: ``rows`` are distinct (ids, words, conv, n, ends) that agree on their first ``depth`` turns.

    Multikey quicksort: three-way splits by the turn at the current depth; the equal part is the child node, one turn
    deeper. Children come before their parent. An own stack takes the place of recursion, so depth is not limited by
    Python; what stays of a bucket with a single sequence is a chain and is emitted without splits.
    """
    work: list[tuple] = [(rows, depth, parent, None)]
    while work:
        rows, depth, parent, up = work.pop()
        if rows is None:  # all children are done
            conv, n, word, ends, children, leaves, saved = node = up[0]
            saved += (n - 1) * word
            yield (conv, depth, parent, n, children, max(leaves, 1), saved, ends)
            if up[1]:
                above = up[1][0]
                above[4:] = above[4] + 1, above[5] + max(leaves, 1), above[6] + saved
            continue
        if len(rows) == 1:
            ids, words, conv, n, ends = rows[0]
            saved = 0
            for d in range(len(ids), depth - 1, -1):
                saved += (n - 1) * words[d - 1] if d else 0
                last = d == len(ids)
                yield (conv, d, (parent if d == depth else conv), n, 0 if last else 1, 1, saved, ends if last else NOBODY)
            if up:
                above = up[0]
                above[4:] = above[4] + 1, above[5] + 1, above[6] + saved
            continue
        conv = min(r[2] for r in rows)
        own = [r for r in rows if len(r[0]) == depth]
        word = rows[0][1][depth - 1] if depth else 0
        frame = ([conv, sum(r[3] for r in rows), word, own[0][4] if own else NOBODY, 0, 0, 0], up)
        work.append((None, depth, parent, frame))
        parts = [[r for r in rows if len(r[0]) > depth] if own else rows]
        while parts:
            part = parts.pop()
            pivot = part[len(part) // 2][0][depth]
            low, same, high = [], [], []
            for r in part:
                at = r[0][depth]
                (same if at == pivot else low if at < pivot else high).append(r)
            parts += [x for x in (low, high) if x]
            work.append((same, depth + 1, conv, frame))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole and one after another: sorted by parent and next turn, all at one depth."""
    key, rows, depth, out = None, [], 0, []

    def nodes() -> Iterator[tuple]:
        for x in multikey(rows, depth + 1, key[0]) if rows else ():
            yield (*x, x[1] == depth + 1)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _NODES.types, strict=True)], schema=_NODES)

    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("b", "next", "depth", "ids", "words", "conv", "n", "ends")), strict=True):
            if r[:2] != key:
                for x in nodes():
                    out.append(x)
                    if len(out) == BATCH:
                        yield batch()
                        out = []
                key, rows, depth = r[:2], [], r[2]
            rows.append(r[3:])
    for x in nodes():
        out.append(x)
        if len(out) == BATCH:
            yield batch()
            out = []
    if out:
        yield batch()


def trie(found: DataFrame, local_size: int | None = None) -> DataFrame:
    """Nodes of the trie over ``found`` (rows of ``sequences``): one row per distinct prefix, columns as ``NODE``.

    No rows give no nodes, not even a root: there is no conversation to name it.
    """
    found = cut(found.withColumn("b", F.lit(None).cast("long")))
    total, least, members = found.agg(F.count(F.lit(1)), F.min("conv"), F.sum("n")).first()
    size = local_size or max(LOCAL, -(-total // LARGE))
    if not total:
        return found.sparkSession.createDataFrame([], NODE)
    # the root is a large bucket by definition
    here = found.withColumn("b", F.lit(least))
    large = [found.sparkSession.createDataFrame([(least, None, members, 0)], "conv_id long, parent_conv_id long, n_convs long, word long")]
    finished, ended, depth = [], [], 0
    while True:
        at = F.get("ids", F.lit(depth))
        ended.append(here.where(F.size("ids") == depth).select(F.col("b").alias("conv_id"), F.col("ends").alias("ends_sha256")))
        here = here.where(F.size("ids") > depth).withColumn("next", at)
        kids = here.groupBy("b", "next").agg(
            F.count(F.lit(1)).alias("rows"), F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(F.get("words", F.lit(depth))).alias("word")
        )
        # fewer than total / size <= LARGE rows, so they can be broadcast
        big = cut(kids.where(F.col("rows") > size).select("b", "next", "conv_id", F.col("b").alias("parent_conv_id"), "n_convs", "word"))
        names = F.broadcast(big.select("b", "next", F.col("conv_id").alias("kid")))
        small = here.join(names, ["b", "next"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        small = small.select("b", "next", "depth", "ids", "words", "conv", "n", "ends").repartition("b", "next").sortWithinPartitions("b", "next")
        finished.append(cut(small.mapInArrow(_finish, NODE + ", top boolean")))
        if big.isEmpty():
            break
        large.append(big.select("conv_id", "parent_conv_id", "n_convs", "word"))
        here = cut(here.join(names, ["b", "next"]).withColumn("b", F.col("kid")).drop("kid", "next"))
        depth += 1

    out, above = None, None
    for d in range(depth, -1, -1):
        kids = finished[d].where("top").select("parent_conv_id", "n_leaves", "saved_tokens")
        if above is not None:
            kids = kids.unionByName(above.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")
        )
        above = large[d].join(sums, "conv_id", "left").join(ended[d], "conv_id", "left").select(
            "conv_id", F.lit(d).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("word")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
        )
        above = cut(above)
        level = finished[d].drop("top").unionByName(above)
        out = level if out is None else out.unionByName(level)
    return out


def report(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie over the rebuilt conversations, see ``turns``, ``share_heads`` and ``trie``."""
    return trie(sequences(share_heads(turns(conversations))))
