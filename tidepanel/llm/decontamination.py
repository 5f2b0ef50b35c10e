"""Benchmark decontamination with suffix arrays over the training shards (operator 5).

Each task takes its documents in shards of bounded size. A shard's suffix array holds the word
suffixes of its documents in word order; suffixes that cannot match (their first words are no word
sequence of any benchmark item) are left out before the sort. Every suffix of every benchmark item is
then binary-searched in the array, all of them at once and one word deeper each round, so the range of
equal prefixes after w rounds holds all verbatim occurrences of a window of w words. Windows that follow
one another in both the document and the item are one match, as long as the texts agree; the longest one of
each document is kept with its places. Nothing is shuffled: a document's words, hits and items all
come from its own shard, so a passage that many documents share costs each of them the same.

The benchmark reaches the tasks in blocks of at most ``BLOCK_CHARS`` characters; a larger benchmark
takes several passes over the same rows in one job, and what the passes find is united per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WINDOW = 10
#: Characters of benchmark text that go to the tasks at once.
BLOCK_CHARS = 8_000_000
#: Words that one suffix array covers (a longer document is a shard of its own).
SHARD_WORDS = 1_500_000
#: Words that must match the benchmark for a suffix to enter the array.
GRAM = 4
#: ASCII bytes that are not letters or digits separate words; A-Z is lower-cased; other bytes stay.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Python also splits at these bytes, which are separators here as well, and at no byte above 0x7F.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _grams(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` ids from each position on (fewer positions than ids)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Items:
    """A block of benchmark items: word ids and all their suffixes, cut at the item's end."""

    def __init__(self, rows: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.window = window
        own = [(i, w) for i, t in rows if (w := words(t))]
        self.item = [i for i, _ in own]
        toks = [np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int64) for _, w in own]
        self.flat = np.concatenate([*toks, np.zeros(1, np.int64)])
        length = np.array([len(t) for t in toks], np.int64)
        begin = np.cumsum(length) - length
        self.of = np.repeat(np.arange(len(toks)), length)
        self.begin = begin
        self.start = np.arange(len(self.of))
        self.left = (begin + length)[self.of] - self.start  # words to the item's end
        # the window that begins here: ten words, or the whole of a shorter item
        short = length[self.of] < window
        self.wide = np.where(short & (self.start == begin[self.of]), length[self.of], np.where(~short & (self.left >= window), window, 0))
        self.least = int(min([window, *length])) if len(toks) else 0
        self.gram = min(GRAM, self.least)
        grams = [_grams(t, self.gram) for t in toks]
        self.known = np.unique(np.concatenate(grams)) if grams and self.gram else np.zeros(0, np.uint64)


def suffix_array(ids: np.ndarray, ends: np.ndarray, items: Items) -> np.ndarray:
    """Positions of the shard in the order of their suffixes, compared to ``WINDOW`` words."""
    if not len(items.known) or len(ids) < items.gram:
        return np.zeros(0, np.int64)
    g = _grams(ids, items.gram)
    at = np.searchsorted(items.known, g)
    hit = items.known[np.minimum(at, len(items.known) - 1)] == g
    pos = np.flatnonzero(hit)
    pos = pos[pos + items.gram <= ends[pos]]
    columns = [_word(ids, ends, pos, d) for d in range(items.window)]
    return pos[np.lexsort(columns[::-1])]


def _word(ids: np.ndarray, ends: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """The word ``depth`` places on from each position; -1 beyond the document's end."""
    at = pos + depth
    return np.where(at < ends[pos], ids[np.minimum(at, len(ids) - 1)], -1)


def search(sa: np.ndarray, ids: np.ndarray, ends: np.ndarray, items: Items) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth 1.. the benchmark suffixes that match so deep, and their ranges in the array."""
    suffix, low = np.arange(len(items.of)), np.zeros(len(items.of), np.int64)
    high = np.full(len(items.of), len(sa), np.int64)
    found = []
    for depth in range(items.window):
        keep = items.left[suffix] > depth
        suffix, low, high = suffix[keep], low[keep], high[keep]
        want = items.flat[items.start[suffix] + depth]
        column = _word(ids, ends, sa, depth)

        def bound(right: bool, low=low, high=high, want=want, column=column) -> np.ndarray:
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                x = column[np.minimum(mid, len(column) - 1)] if len(column) else a
                less = (x <= want) if right else (x < want)
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            return a

        lo, hi = bound(False), bound(True)
        keep = lo < hi
        suffix, low, high = suffix[keep], lo[keep], hi[keep]
        found.append((suffix, low, high))
    return found


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and which range each is of."""
    n = high - low
    k = np.repeat(np.arange(len(n)), n)
    return low[k] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), k


def _longest(p: np.ndarray, s: np.ndarray, wide: np.ndarray, doc: np.ndarray, begin: np.ndarray, items: Items) -> dict[int, dict]:
    """Document -> its longest match, from all windows (place p in the shard, s in the items, width).

    Windows on one diagonal whose places follow one another are one match. Of equally long ones the first
    in the document counts, then the item of the smallest id (null last), then the first place in the item.
    """
    order = np.lexsort((p, p - s))
    p, s, wide = p[order], s[order], wide[order]
    other = (np.diff(doc[p]) != 0) | (np.diff(items.of[s]) != 0)
    first = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(s) != 1) | other])
    n = np.diff(np.r_[first, len(p)]) + wide[first] - 1
    p, s = p[first], s[first]
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in items.item], np.int64)[items.of[s]]
    order = np.lexsort((s, ids, p, -n, doc[p]))
    best = order[np.flatnonzero(np.r_[True, np.diff(doc[p[order]]) > 0])]
    own = zip(*(x.tolist() for x in (doc[p[best]], n[best], p[best] - begin[doc[p[best]]], items.of[s[best]], s[best] - items.begin[items.of[s[best]]])), strict=True)
    return {d: {"n": n, "at": at, "item": items.item[k], "item_at": j} for d, n, at, k, j in own}


def shard_hits(texts: list[str | None], items: Items) -> list[tuple[int, np.ndarray, list[int], dict | None]]:
    """Per document: number of words, sorted positions of hit words, sorted distinct item indexes, longest match."""
    get = items.ids.get
    toks = [np.array([get(w, 0) for w in words(t)], np.int64) for t in texts]
    size = np.array([len(t) for t in toks], np.int64)
    if not size.sum():
        return [(0, np.zeros(0, np.int64), [], None) for _ in toks]
    ids = np.concatenate(toks)
    stop = np.cumsum(size)
    doc = np.repeat(np.arange(len(toks)), size)
    ends = stop[doc]
    sa = suffix_array(ids, ends, items)
    mark = np.zeros(len(ids) + 1, np.int64)
    pairs, windows = [], []
    for depth, (suffix, low, high) in enumerate(search(sa, ids, ends, items), 1):
        whole = items.wide[suffix] == depth
        if not whole.any():
            continue
        at, k = _expand(low[whole], high[whole])
        np.add.at(mark, sa[at], 1)
        np.add.at(mark, sa[at] + depth, -1)
        windows.append((sa[at], suffix[whole][k], np.full(len(at), depth)))
        pairs.append(np.unique(doc[sa[at]] * len(items.item) + items.of[suffix[whole]][k]))
    hit = np.cumsum(mark[:-1]) > 0
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    longest = _longest(*(np.concatenate(c) for c in zip(*windows, strict=True)), doc, stop - size, items) if len(both) else {}
    first, last = np.searchsorted(both, np.arange(len(toks)) * len(items.item)), np.searchsorted(both, (np.arange(len(toks)) + 1) * len(items.item))
    return [(int(n), np.flatnonzero(hit[e - n : e]), (both[a:b] - k * len(items.item)).tolist(), longest.get(k)) for k, (n, e, a, b) in enumerate(zip(size, stop, first, last, strict=True))]


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    """Sorted positions -> runs [first, last]."""
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]], strict=True)]


def _order(match: dict) -> tuple:
    return -match["n"], match["at"], match["item"] is None, match["item"] or 0, match["item_at"]


STATE = "struct<n_words:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<bigint>,longest:struct<n:bigint,at:bigint,item:bigint,item_at:bigint>>"


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "hits", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, spans of hit words [a, b], sorted item ids, longest.

    ``longest`` is the longest verbatim match of a window or more: its words, its place (in words, from 0) in
    the document, the item and the place there; null without any.

    A null text has no words. An item without words has no windows. Items of null id are one item, the
    last of ``items``. Columns of any name pass through; ``name`` must be new.
    """
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text").where("text is not null")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars) if total > block_chars else 1)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))  # rows of one id may be many, equal rows are one
    bench = bench.distinct() if blocks > 1 else bench
    at = docs.columns.index(text)
    out = docs.withColumn(name, F.lit(None).cast(STATE))
    schema = out.schema

    def run_block(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(held.value, window)

            def done(b: pa.RecordBatch) -> pa.RecordBatch:
                own, before = [], b.column(b.num_columns - 1).to_pylist()
                texts = b.column(at).to_pylist()
                lo = 0
                while lo < len(texts):
                    hi, n = lo, 0
                    while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= 3 * SHARD_WORDS):
                        n += len(texts[hi] or "")
                        hi += 1
                    own += shard_hits(texts[lo:hi], items)
                    lo = hi
                state = []
                for (n, hit, of, longest), old in zip(own, before, strict=True):
                    found = [items.item[k] for k in of]
                    if old and old["spans"]:
                        hit = np.unique(np.concatenate([hit, *(np.arange(s["a"], s["b"] + 1) for s in old["spans"])]))
                    if old:
                        found = found + old["items"]
                        longest = min((m for m in (longest, old["longest"]) if m), key=_order, default=None)
                    state.append({"n_words": n, "spans": _runs(hit), "items": sorted(set(found), key=lambda i: (i is None, i or 0)), "longest": longest})
                last = pa.array(state, b.schema.types[-1])
                return pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=b.schema.names)

            for b in batches:
                yield done(b)

        return run

    for k in range(blocks):
        rows = [(r[0], r[1]) for r in (bench.where(part == k) if blocks > 1 else bench).collect()]  # of bounded size
        out = out.mapInArrow(run_block(spark.sparkContext.broadcast(rows)), schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at, longest_item, longest_item_at; one row per document row.

    The last four are the longest match (0 and nulls without any).

    Items of null id count as one and have no part in the digest. Empty texts have no words; repeated rows
    have equal results; of equal items each id counts.
    """
    found = with_hits(docs.select("doc_id", "text"), benchmark).drop("text")
    listed = F.array_join(F.array_sort(F.transform("hits.items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"] + 1)
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("hits.longest.n", F.lit(0)).cast("long").alias("longest"), F.col("hits.longest.at").alias("longest_at"),
        F.col("hits.longest.item").alias("longest_item"), F.col("hits.longest.item_at").alias("longest_item_at"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of any benchmark item."""
    name = fresh(docs.columns, "hits")
    return with_hits(docs, benchmark, name=name).where(F.size(f"{name}.spans") == 0).drop(name)


def digest(items: list[int]) -> str:
    """What ``report`` gives as items_sha256 for these item ids."""
    return hashlib.sha256(",".join(sorted(str(i) for i in items if i is not None)).encode()).hexdigest()
