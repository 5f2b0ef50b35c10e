"""Repeated passages with sparse suffix arrays (operator 7).

A passage is at least ``PASSAGE`` words that occur twice anywhere in the corpus. Of all suffixes only
those at content-selected positions are retained: of every ``PASSAGE`` words the position whose first
``GRAM`` words hash lowest. Equal passages select equal positions, so two occurrences always keep a
suffix in common. The suffixes are sorted and compared with their neighbours by their first words; those
that equal a neighbour are extended left and right to the passages around them, which are sorted and
compared in turn, and runs of repeated passages join to maximal spans.

Tasks sort a batch of documents at a time and ship packed runs of distinct keys per bucket of the hash
range, so a passage that a third of the corpus shares is one entry per batch. What repeats is written as
sorted arrays below the shared folder, which workers memory-map in the next pass over the documents.
Files are written under a temporary name and renamed, so repeated tasks do no harm; workers keep a bounded
number of maps open, and an array that a worker does not find is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Maps, cut, fresh, save_array, shared_path

PASSAGE = 50
GRAM = 25
#: Words that are worked on at once (a longer document is a batch of its own), and entries of a bucket.
CHUNK = 400_000
ENTRIES = 3_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LAST = np.iinfo(np.int64).max


def word_spans(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all word runs of a given length, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, words: list[bytes], memo: dict[bytes, int]):
        if len(memo) > 1_000_000:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w, 3)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _BASE)], dtype=np.uint64)
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _INVERSE)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64)]

    def runs(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def selected(grams: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` neighbouring grams the position of the lowest, the last of equal ones."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    out = np.empty(n, np.int64)
    for a in range(0, n, 65536):
        out[a : a + 65536] = width - 1 - view[a : a + 65536, ::-1].argmin(axis=1)
    return out + np.arange(n)


def _pack(keys: np.ndarray, many: np.ndarray, docs: np.ndarray | None) -> bytes:
    columns = [np.diff(keys, prepend=np.uint64(0)), *([docs.view(np.uint64)] if docs is not None else [])]
    planes = [c.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]
    return zstandard.compress(np.concatenate([*planes, many.astype(np.uint8)]).tobytes(), 1)


def _unpack(blob: bytes, with_docs: bool) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    wide = 17 if with_docs else 9
    n = len(raw) // wide
    part = lambda k: np.ascontiguousarray(raw[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(part(0), dtype=np.uint64), raw[(wide - 1) * n :].astype(bool), part(1).view(np.int64) if with_docs else np.zeros(n, np.int64)


def _distinct(keys: np.ndarray, many: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; whether each is repeated; its least document."""
    o = np.argsort(keys, kind="stable")
    keys, many, docs = keys[o], many[o], docs[o]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, many, docs
    again = np.diff(np.r_[first, len(keys)]) > 1
    return keys[first], again | np.logical_or.reduceat(many, first), np.minimum.reduceat(docs, first)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Repeated:
    """Sorted arrays of repeated keys, memory-mapped; ``filled`` says which buckets have one."""

    def __init__(self, path: str, kind: str, filled: frozenset[int], buckets: int, with_docs: bool):
        self.maps, self.kind, self.filled, self.buckets, self.with_docs = Maps(path), kind, filled, buckets, with_docs

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys repeat, and the least document of each that does."""
        hit, docs = np.zeros(len(keys), bool), np.full(len(keys), _LAST)
        order = np.argsort(keys)  # neighbouring lookups touch neighbouring pages
        sorted_ = keys[order]
        cuts = np.searchsorted(_bucket(sorted_, self.buckets), np.arange(self.buckets + 1))
        for b in range(self.buckets):
            a, e = cuts[b], cuts[b + 1]
            if a == e or b not in self.filled:
                continue
            array = self.maps(f"{self.kind}-key-{b}")
            if not len(array):
                continue
            i = np.minimum(np.searchsorted(array, sorted_[a:e]), len(array) - 1)
            same = array[i] == sorted_[a:e]
            hit[order[a:e]] = same
            if self.with_docs and same.any():
                docs[order[a:e][same]] = self.maps(f"{self.kind}-doc-{b}")[i[same]]
        return hit, docs


def _texts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    for b in batches:
        held, n, first = [], 0, 0
        for k, t in enumerate(b.column(text)):
            held.append(word_spans(t.as_py()))
            n += len(held[-1])
            if n >= CHUNK:
                yield b, first, held
                held, n, first = [], 0, k + 1
        if held:
            yield b, first, held


def _ids(b: pa.RecordBatch, column: int, first: int, n: int) -> list[int]:
    return [_LAST if x is None else x for x in b.column(column).slice(first, n).to_pylist()]


def _runs_of(mask: np.ndarray, width: int, n: int) -> list[dict[str, int]]:
    """Union of [s, s + width) over the true s, as spans [a, b] of words."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    inside = np.r_[0, (np.cumsum(change[:-1]) > 0).astype(np.int8), 0]
    edge = np.diff(inside)
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True)]


STATE = "struct<n_words:bigint,repeated:array<struct<a:bigint,b:bigint>>,later:array<struct<a:bigint,b:bigint>>,first_docs:array<bigint>>"


def with_repeats(docs: DataFrame, name: str = "repeats", passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a struct column ``name``.

    n_words; ``repeated``: spans [a, b] of words in passages that occur twice; ``later``: spans of those
    whose first occurrence is in a document of a smaller id, or earlier in this one; ``first_docs``: the
    documents of those first occurrences. A null or short text has none; a null id comes last.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    chars = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // (6 * ENTRIES)))
    path = shared_path(spark, "suffixes")
    width = passage - gram + 1
    filled: dict[str, frozenset[int]] = {}

    def write(kind: str, with_docs: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
                keys, many, least = _distinct(*(np.concatenate(x) for x in zip(*(_unpack(x, with_docs) for x in blobs), strict=True)))
                save_array(f"{path}/{kind}-key-{bucket}.npy", keys[many])
                if with_docs:
                    save_array(f"{path}/{kind}-doc-{bucket}.npy", least[many])
                return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64())], names=["n"])

            bucket, held = None, []
            for b in batches:
                for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if held and k != bucket:
                        yield out(bucket, held)
                        held = []
                    bucket = k
                    held.append(blob)
            if held:
                yield out(bucket, held)

        return run

    def ship(keys: np.ndarray, least: np.ndarray, with_docs: bool) -> pa.RecordBatch:
        keys, many, least = _distinct(keys, np.zeros(len(keys), bool), least)
        cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
        some = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
        blobs = [_pack(keys[cuts[k] : cuts[k + 1]], many[cuts[k] : cuts[k + 1]], least[cuts[k] : cuts[k + 1]] if with_docs else None) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for _, _, rows in _texts(batches, 1):
            found = []
            for w in rows:
                if len(w) >= passage:
                    g = Hashes(w, memo).runs(gram)
                    found.append(g[np.unique(selected(g, width))])
            if found:
                keys = np.concatenate(found)
                yield ship(keys, np.zeros(len(keys), np.int64), False)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        grams = Repeated(path, "gram", filled["gram"], buckets, False)
        for b, first, rows in _texts(batches, 1):
            found, least = [], []
            for of, keys, _, _ in around(rows, _ids(b, 0, first, len(rows)), grams, memo):
                found.append(keys)
                least.append(np.full(len(keys), of, np.int64))
            if found:
                yield ship(np.concatenate(found), np.concatenate(least), True)

    def around(rows: list[list[bytes]], ids: list[int], grams: Repeated, memo: dict[bytes, int]):
        """(document, keys of the passages around suffixes that repeat, their places, row) of each row that has any."""
        held = []
        for k, w in enumerate(rows):
            if len(w) >= passage:
                h = Hashes(w, memo)
                g = h.runs(gram)
                held.append((k, h.runs(passage), g, selected(g, width)))
        if not held:
            return
        picked = [g[s] for _, _, g, s in held]
        distinct, back = np.unique(np.concatenate(picked), return_inverse=True)
        hit = grams.find(distinct)[0][back]
        at = 0
        for k, runs, _, s in held:
            place = np.flatnonzero(hit[at : at + len(s)])
            at += len(s)
            if len(place):
                yield ids[k], runs[place], place, k

    last = docs.columns.index("text"), docs.columns.index("doc_id")
    plain = docs.withColumn(name, F.lit(None).cast(STATE))
    kind_of = plain.schema

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        grams, passages = Repeated(path, "gram", filled["gram"], buckets, False), Repeated(path, "passage", filled["passage"], buckets, True)
        for b, first, rows in _texts(batches, last[0]):
            state = [{"n_words": len(w), "repeated": [], "later": [], "first_docs": []} for w in rows]
            held = list(around(rows, _ids(b, last[1], first, len(rows)), grams, memo))
            if held:
                hit, docs_of = passages.find(np.concatenate([keys for _, keys, _, _ in held]))
                at = 0
                for own, keys, place, k in held:
                    again, least = hit[at : at + len(keys)], docs_of[at : at + len(keys)]
                    at += len(keys)
                    n = len(rows[k])
                    earlier = np.ones(len(keys), bool)
                    earlier[np.unique(keys, return_index=True)[1]] = False  # seen before in this document
                    later = again & ((least < own) | earlier)
                    both = np.zeros((2, n), bool)
                    both[0, place[again]], both[1, place[later]] = True, True
                    state[k] |= {"repeated": _runs_of(both[0], passage, n), "later": _runs_of(both[1], passage, n), "first_docs": np.unique(least[later & (least < _LAST)]).tolist()}
            own = b.slice(first, len(rows))
            yield pa.RecordBatch.from_arrays([*own.columns[: len(own.columns) - 1], pa.array(state, own.schema.types[-1])], names=own.schema.names)

    for kind, emit, with_docs in (("gram", suffixes, False), ("passage", extended, True)):
        runs = slim.mapInArrow(emit, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        filled[kind] = frozenset(r[0] for r in cut(runs.mapInArrow(write(kind, with_docs), "n long")).collect())  # bucket numbers
    return plain.mapInArrow(marked, kind_of)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated, n_later, first_docs; one row per document row."""
    words = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"] + 1)
    return with_repeats(docs.select("doc_id", "text")).select(
        "doc_id", F.col("repeats.n_words").alias("n_words"), words("repeats.repeated").alias("n_repeated"),
        words("repeats.later").alias("n_later"), F.col("repeats.first_docs").alias("first_docs"),
    )


def remove_later(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of later occurrences cut from the text; what is left keeps its own spacing."""
    name = fresh(docs.columns, "repeats")
    found = with_repeats(docs, name)
    at, where = docs.columns.index("text"), len(docs.columns)
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for k, s in enumerate(b.column(where).to_pylist()):
                if s["later"]:
                    raw = texts[k].encode("utf-8", "surrogatepass")
                    edges = [(m.start(), m.end()) for m in word.finditer(raw)]
                    left, to = [], 0
                    for span in s["later"]:
                        left.append(raw[to : edges[span["a"]][0]])
                        to = edges[span["b"]][1]
                    texts[k] = b"".join([*left, raw[to:]]).decode("utf-8", "surrogatepass")
            columns = [pa.array(texts, b.schema.types[at]) if k == at else c for k, c in enumerate(b.columns[:where])]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:where])

    return found.mapInArrow(run, docs.schema)
