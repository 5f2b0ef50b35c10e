"""Alignment of two tokenizers over the same texts (operator 12).

Texts fall apart at single spaces into runs, where tokens of both sides end. Python cuts texts and tokenises the distinct
runs of a block of texts; it gives their ids, byte end offsets and lengths, and of each text the numbers of its runs. From
there on everything is Spark's array functions. In a run, the offsets where tokens of both sides end
(``array_intersect`` of the end arrays) cut the tokens into groups. A token number per
byte (``array_repeat`` and ``flatten``) makes every look-up a plain index, so groups and links (pairs of overlapping
tokens) are built by ``transform`` over ``sequence`` in time linear in
the run (``slice`` would read the whole array at each call). A text's groups and links are those of its runs, in order.

Counts of linked id pairs are needed at every link again. Pairs that hold at least a ``FREQUENT``-th of all links are
at most ``FREQUENT`` rows and are broadcast; the links of all other pairs are joined by the pair, and none of those
pairs is hot. Tokens are not stored: the one table written holds ids of links and digests of groups.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Most pairs that are broadcast (about 16 MB).
FREQUENT = 1 << 18
#: Texts of a block, by number and by characters; runs that are encoded in one call.
TEXTS, CHARS, TOGETHER = 1_024, 1 << 21, 2_048
#: Where a text is cut: at a single space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how byte-level vocabularies cut a text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SIDES = [f"{x}_{c}" for x in "ab" for c in ("ids", "ends", "lens")]
BLOCKS = f"docs array<struct<rid: long, doc_id: long, n_a: long, n_b: long, runs: array<int>>>, runs array<struct<{', '.join(f'{c}: array<int>' for c in _SIDES)}>>"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers of a block of texts at once.

    No token of either side holds a space after another character (both files are checked for it), so a text falls
    apart at each single space between two characters that are no white space, and what stands between two such spaces
    has the same tokens wherever it stands. Each distinct run of a block is encoded once, many in one call.
    """

    def __init__(self, byte_source: bytes, piece_source: bytes):
        import sentencepiece
        import tiktoken

        spec, alphabet = json.loads(byte_source), byte_alphabet()
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in spec["model"]["merges"]]
        # ids in the order of merges are ranks, which tiktoken reads; its ids are then the same
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        if not plain or merged != sorted(set(merged)) or not set(alphabet) <= set(vocab):
            raise ValueError("not a plain byte-level vocabulary whose ids follow its merges")
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items()}
        self.a = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_source)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_table = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        a_table = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            a_table[i] = piece
        self.a_bytes = list(map(len, a_table))
        self.a_length, self.b_length = (np.array(list(map(len, t)), np.int32) for t in (a_table, self.b_table))
        apart = not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode("x") == self.b.encode("y x")[-len(self.b.encode("x")) :]
        self.apart = apart

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; nothing where a side does not spell the text back after a space."""
        whole, a, b = (" " + text).encode(), self.a.encode_ordinary(" " + text), self.b.encode(text)
        # the byte-level side has all bytes, so its length tells
        same = b"".join(map(self.b_table.__getitem__, b)) == whole and sum(map(self.a_bytes.__getitem__, a)) == len(whole)
        return (np.array(a, np.int32), np.array(b, np.int32)) if same else None

    def together(self, runs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids, and tokens of each run, of either side: all runs in one call, or one by one where they are not spelled back."""
        found = self.encode(" ".join(runs))
        if found is not None:
            ends = np.cumsum(np.fromiter((len(r.encode()) + 1 for r in runs), np.int64, len(runs)))
            upto = [np.searchsorted(np.cumsum(n[x]), ends, "right") for x, n in zip(found, (self.a_length, self.b_length), strict=True)]
            return [(x, np.diff(n, prepend=0)) for x, n in zip(found, upto, strict=True)]
        return self.single(runs)

    def single(self, runs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        none = (np.zeros(0, np.int32),) * 2
        found = [self.encode(r) or none for r in runs]
        return [(np.concatenate([none[0], *x]), np.fromiter(map(len, x), np.int64, len(x))) for x in ([f[k] for f in found] for k in (0, 1))]

    def block(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """Numbers of each text's runs (none where it has no tokens), and ids and number of tokens of each run, of either side."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__

        def numbers(runs: list[str]) -> np.ndarray:
            return np.fromiter(map(number.__getitem__, runs), np.int32, len(runs))

        def edged(runs: list[str]) -> np.ndarray:
            """Runs that are empty or have white space at either end: there the text is cut with more care, or not at all."""
            return np.fromiter((not r or r[0].isspace() or r[-1].isspace() for r in runs), bool, len(runs))

        of = [numbers(t.split(" ") if self.apart else [t]) if t else numbers([]) for t in texts]
        first = list(number)
        edge = edged(first)
        again = [k for k, x in enumerate(of) if edge[x].any()] if self.apart else []
        for k in again:
            of[k] = numbers(_CUT.split(texts[k]))
        runs = list(number)
        number.default_factory = None  # which holds the numbers in a cycle: without this they stay until Python looks for cycles, block after block
        edge = np.concatenate([edge, edged(runs[len(first) :])]) if self.apart else np.ones(len(runs), bool)
        used = np.zeros(len(runs), bool)
        for x in of:
            used[x] = True
        # of runs with an edge and the others; the former are encoded one by one
        plain, odd = (np.flatnonzero(used & x) for x in (~edge, edge))
        order, parts = np.concatenate([plain, odd]), []
        for at in range(0, len(plain), TOGETHER):
            parts.append(self.together([runs[k] for k in plain[at : at + TOGETHER]]))
        parts.append(self.single([runs[k] for k in odd]))
        sides = [(np.concatenate([p[k][0] for p in parts]), np.concatenate([p[k][1] for p in parts])) for k in (0, 1)]
        place = np.zeros(len(runs), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        known = sides[0][1] > 0
        of = [place[x] for x in of]
        return [x if known[x].all() else x[:0] for x in of], sides

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text of both sides."""
        of, sides = self.block(texts)
        cut = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in sides]
        return [tuple(np.concatenate([c[k] for k in x]) for c in cut) if len(x) else None for x in of]


@lru_cache(1)
def _pair(byte_source: bytes, piece_source: bytes) -> Pair:
    return Pair(byte_source, piece_source)


def blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Blocks of rows of ``docs`` (doc_id, text): ``docs`` (rid, doc_id, tokens of both sides, numbers of the text's runs), ``runs`` (of both sides ids, and ends and lens where both have several).

    Null and empty texts, and texts that either side does not spell back byte for byte, have no runs. Blocks are
    bounded in texts and characters; a text longer than that is a block of its own.
    Vocabulary files are read by the driver and broadcast (both are of fixed size).
    """
    sources = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as f:
            sources.append(f.read())
    held = docs.sparkSession.sparkContext.broadcast(sources)
    ints = pa.list_(pa.int32())
    doc, run = pa.struct([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("runs", ints)]), pa.struct([(c, ints) for c in _SIDES])
    schema = pa.schema([("docs", pa.list_(doc)), ("runs", pa.list_(run))])

    def lists(values: np.ndarray, n: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        mask = None if there is None else pa.array(~there)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32)), mask=mask).cast(ints)

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def side(ids: np.ndarray, n: np.ndarray, length: np.ndarray, several: np.ndarray) -> list[pa.Array]:
        """Ids, ends and lengths; the latter two only of runs with several tokens on both sides."""
        lens = length[ids]
        ends = np.cumsum(lens)
        before = np.concatenate([[0], ends])[np.cumsum(n) - n]
        keep, some = np.repeat(several, n), np.where(several, n, 0)
        return [lists(ids, n), *(lists(x[keep], some, several) for x in (ends - np.repeat(before, n), lens))]

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*held.value)

        def block(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            of, ((a, n), (b, m)) = pair.block(texts)
            numbers = lists(np.concatenate([np.zeros(0, np.int32), *of]), np.array([len(x) for x in of]))
            n_a, n_b = (pa.array([int(c[x].sum()) for x in of], pa.int64()) for c in (n, m))
            rows = pa.StructArray.from_arrays([batch.column("rid"), batch.column("doc_id"), n_a, n_b, numbers], fields=list(doc))
            several = (n > 1) & (m > 1)
            runs = pa.StructArray.from_arrays([*side(a, n, pair.a_length, several), *side(b, m, pair.b_length, several)], fields=list(run))
            return pa.RecordBatch.from_arrays([one(rows).cast(schema.field(0).type), one(runs).cast(schema.field(1).type)], schema=schema)

        for batch in batches:
            start, chars, texts = 0, 0, []
            for k, t in enumerate(batch.column("text")):
                t = t.as_py()
                n = len(t or "")
                if texts and (len(texts) >= TEXTS or chars + n > CHARS):
                    yield block(batch.slice(start, k - start), texts)
                    start, chars, texts = k, 0, []
                texts.append(t)
                chars += n
            if texts:
                yield block(batch.slice(start), texts)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tokenised, BLOCKS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside reads it, and not copied, as ``transform`` would."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def _token_at(lens: Column) -> Column:
    """Number of the token that covers each byte."""
    return F.flatten(F.transform(lens, lambda n, i: F.array_repeat(i, n)))


def _groups_and_links(run: Column) -> Column:
    """Of a run: ``groups`` (``a1,a2|b1`` joined by semicolons) and links (``a``, ``b``, arrays of ids side by side)."""

    def side(name: str, at: Column, cuts: Column) -> Column:
        """Ids of each group, comma-joined. Nearly all groups have one token a side."""

        def group(high: Column, k: Column, last: Column) -> Column:
            low = F.coalesce(F.get(last, k - 1), F.lit(-1)) + 1
            many = F.array_join(F.transform(F.sequence(low, high), lambda j: F.get(run[name], j).cast("string")), ",")
            return F.when(low == high, F.get(run[name], high).cast("string")).otherwise(many)

        last_tokens = F.transform(cuts, lambda c: F.get(at, c - 1))
        return _let(last_tokens, lambda last: F.transform(last, lambda high, k: group(high, k, last)))

    def links(at_a: Column, at_b: Column, ends: Column) -> Column:
        def ids(name: str, at: Column) -> Column:
            return F.transform(ends, lambda e: F.get(run[name], F.get(at, e - 1)))

        # between two ends that follow one another, of whichever side, exactly one pair of tokens overlaps
        return F.struct(ids("a_ids", at_a).alias("a"), ids("b_ids", at_b).alias("b"))

    def all_(at_a: Column, at_b: Column, cuts: Column) -> Column:
        both = F.zip_with(side("a_ids", at_a, cuts), side("b_ids", at_b, cuts), lambda a, b: F.concat(a, F.lit("|"), b))
        made = _let(F.sort_array(F.array_union(run["a_ends"], run["b_ends"])), lambda u: links(at_a, at_b, u))
        return _let(made, lambda x: F.struct(F.array_join(both, ";").alias("groups"), x["a"].alias("a"), x["b"].alias("b")))

    def cut(at_a: Column, at_b: Column) -> Column:
        return _let(F.array_intersect(run["a_ends"], run["b_ends"]), lambda cuts: all_(at_a, at_b, cuts))

    a_ids, b_ids, sizes = run["a_ids"], run["b_ids"], (F.size(run["a_ids"]), F.size(run["b_ids"]))
    names = [x.cast("array<string>") for x in (a_ids, b_ids)]
    # tokens that end alike are groups of one a side, and one token of a side is linked with all of the other; only other runs are to be cut
    only = F.concat(F.get(a_ids, F.lit(0)).cast("string"), F.lit("|"), F.get(b_ids, F.lit(0)).cast("string"))
    alike = F.array_join(F.zip_with(*names, lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    lone = F.concat(F.array_join(names[0], ","), F.lit("|"), F.array_join(names[1], ","))
    every = [F.when(n == 1, F.array_repeat(F.get(x, F.lit(0)), m)).otherwise(x) for x, n, m in ((a_ids, *sizes), (b_ids, *sizes[::-1]))]
    several = _let(_token_at(run["a_lens"]), lambda at_a: _let(_token_at(run["b_lens"]), lambda at_b: cut(at_a, at_b)))

    def made(groups: Column, a: Column, b: Column) -> Column:
        return F.struct(groups.alias("groups"), a.alias("a"), b.alias("b"))

    found = F.when((sizes[0] == 1) & (sizes[1] == 1), made(only, a_ids, b_ids)).when(run["a_ends"].isNull(), made(lone, *every))
    return found.when(run["a_ends"] == run["b_ends"], made(alike, a_ids, b_ids)).otherwise(several)


def groups_and_links(rows: DataFrame) -> DataFrame:
    """One row per text of ``blocks``: its counts, digest of groups and links (``link_a``, ``link_b``, arrays of ids side by side)."""

    def doc(d: Column, made: Column) -> Column:
        def all_(name: str) -> Column:
            return F.transform(d["runs"], lambda i: F.get(made, i)[name])

        digest = F.when(F.size(d["runs"]) > 0, F.sha2(F.array_join(all_("groups"), ";"), 256)).otherwise("")
        whole = [d[c].alias(c) for c in ("rid", "doc_id", "n_a", "n_b")]
        return F.struct(*whole, digest.alias("groups_sha256"), F.flatten(all_("a")).alias("link_a"), F.flatten(all_("b")).alias("link_b"))

    return rows.select(F.inline(_let(F.transform("runs", _groups_and_links), lambda made: F.transform("docs", lambda d: doc(d, made)))))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each id pair over all rows, and whether n is the highest of its b."""
    counts = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    highest = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most one row per id of a vocabulary
    return counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of documents and pair counts, from tables written to the shared folder.

    The first has one row per row of ``docs`` (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256);
    rows without tokens have zeros and ''. Null or repeated doc_ids stay rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    home = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    rows = groups_and_links(blocks(docs, byte_path, piece_path))
    # Python gets no more texts at once than a block has
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(TEXTS))
    try:
        rows.write.option("compression", "zstd").parquet(f"{home}/rows")
    finally:
        spark.conf.set(batch, before)
    rows = spark.read.parquet(f"{home}/rows")
    links = rows.select("rid", "link_b", F.posexplode("link_a").alias("i", "a")).select("rid", "a", F.get("link_b", F.col("i")).alias("b"))
    pair_counts(links).write.parquet(f"{home}/pairs")
    pairs = spark.read.parquet(f"{home}/pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    key = (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("pair")
    known = pairs.select(key, "n", F.col("best").cast("long").alias("best"))
    often, seldom = known.where(F.col("n") * FREQUENT >= total), known.where(F.col("n") * FREQUENT < total)
    keyed = links.select("rid", key)
    here = keyed.join(F.broadcast(often), "pair", "left")
    # one row per document, and one per document and seldom pair
    here = here.groupBy("rid", F.when(F.col("n").isNull(), F.col("pair")).alias("pair")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("best").alias("best"))
    there = here.where("pair is not null").select("rid", "pair", "c").join(seldom, "pair").select("rid", (F.col("c") * F.col("n")).alias("n"), (F.col("c") * F.col("best")).alias("best"))
    sums = here.where("pair is null").select("rid", "n", "best").unionByName(there).groupBy("rid").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    n_links = F.size("link_a").cast("long")
    # a group of n and m tokens has n + m - 1 links
    out = rows.select("rid", "doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - n_links).alias("n_groups"), n_links.alias("n_links"), "groups_sha256").join(sums, "rid", "left")
    whole = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    return whole, pairs
