"""Interpolated modified Kneser-Ney language model over word bigrams (operator 10).

Counting runs in Spark in three passes: words; bigrams of word numbers; contexts that a word continues.
Tasks count whole batches with numpy first and ship sorted, packed runs per bucket, so a frequent bigram
is one entry per batch and no key is hot. The model is a folder of sorted arrays below the shared
folder: word hashes with counts (a word's number is its rank in hash order), bigram keys with counts,
context totals, continuation counts. Buckets are of bounded size and their number follows the tokens.
Workers memory-map the arrays and look up a batch's distinct words and bigrams by binary search.

Files are written under a temporary name and renamed, so a task that runs again after its executor was
lost replaces its own output with the same bytes. Workers open a bucket's array when they need it and keep a
bounded number open; an array that a worker does not find is an error, never an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Maps, cut, fold, fresh, save_array, shared_path

HELD_MODULUS, HELD = 7, 2
#: Words of a batch that are counted at once, and entries of a bucket.
CHUNK = 400_000
ENTRIES = 3_000_000
_END, _BEGIN = (xxhash.xxh64_intdigest(x, 1) for x in (b"\n end", b"\n begin"))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 1) for w in found), np.uint64, len(found))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts; gaps and counts are stored byte plane by byte plane."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    planes = np.concatenate([gaps.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    if len(counts) and counts.max() >= 1 << 32:
        raise OverflowError("a chunk has more occurrences of an entry than 32 bits count")
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n = len(planes) // 12
    gaps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    o = np.argsort(keys, kind="stable")
    keys, counts = keys[o], counts[o]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _bucket_of(ctx: np.ndarray, buckets: int) -> np.ndarray:
    return ((ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)


@dataclass
class Model:
    """Where the arrays are and the few numbers that all lookups share."""

    path: str
    tokens: int = 0
    offsets: list[int] = field(default_factory=list)  # first word number of each vocabulary bucket
    size: int = 0  # distinct words, the end included
    begin: int = 0  # number of the context before the first word
    buckets: int = 1
    types: int = 0
    discount: tuple[float, float, float] = (0.5, 1.0, 1.5)
    low_discount: tuple[float, float, float] = (0.5, 1.0, 1.5)
    low_gamma: float = 1.0
    span: int = 1
    #: Buckets that hold something, by kind; their files must be there.
    filled: dict[str, frozenset[int]] = field(default_factory=dict)

    def open(self) -> Model:
        self.maps = Maps(self.path)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "maps"}  # every worker opens its own

    def array(self, kind: str, bucket: int, group: str) -> np.ndarray:
        return self.maps(f"{kind}-{bucket}") if bucket in self.filled[group] else np.zeros(0, np.uint64)

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (``size`` + 1 if unknown) and training counts of sorted hashes."""
        ids, count = np.full(len(hashes), self.size + 1, np.int64), np.zeros(len(hashes), np.int64)
        if self.tokens:
            of = _vocabulary_bucket(hashes, len(self.offsets))
            for b in np.unique(of).tolist():
                k = np.flatnonzero(of == b)
                i, hit = _find(self.array("hash", b, "words"), hashes[k])
                if hit.any():
                    ids[k[hit]], count[k[hit]] = i[hit] + self.offsets[b], self.maps(f"count-{b}")[i[hit]]
        return ids, count

    def continuations(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for b in np.unique(ids // self.span).tolist():
            k = np.flatnonzero((ids // self.span == b) & (ids < self.size))
            if len(k):
                out[k] = self.maps(f"cont-{b}")[ids[k] - b * self.span] if b in self.filled["words at ends"] else 0
        return out

    def bigrams(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, context total and interpolation weight of sorted keys (context number << 32 | word number)."""
        n, total, gamma = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys))
        ctx = (keys >> np.uint64(32)).astype(np.int64)
        of = _bucket_of(ctx, self.buckets)
        d = np.array(self.discount)
        for b in np.unique(of).tolist():
            k = np.flatnonzero(of == b)
            i, hit = _find(self.array("key", b, "bigrams"), keys[k])
            if hit.any():
                n[k[hit]] = self.maps(f"n-{b}")[i[hit]]
            i, hit = _find(self.array("ctx", b, "bigrams"), ctx[k])
            if hit.any():
                total[k[hit]] = self.maps(f"total-{b}")[i[hit]]
                gamma[k[hit]] = self.maps(f"kinds-{b}")[i[hit]] @ d / total[k[hit]]
        return n, total, gamma


def _find(array: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(array):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(array, wanted), len(array) - 1)
    return i, array[i] == wanted


def _vocabulary_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal spans of the hash range."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """From the counts of counts one to four; fixed steps where a class is empty."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.01) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    """Runs of rows of about ``CHUNK`` words: batch, first row, words of each row."""
    for b in batches:
        held, n, first = [], 0, 0
        for k, t in enumerate(b.column(column)):
            held.append(words(t.as_py()))
            n += len(held[-1])
            if n >= CHUNK:
                yield b, first, held
                held, n, first = [], 0, k + 1
        if held:
            yield b, first, held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, rows in _chunks(batches, 0):
        c = Counter(w for r in rows for w in r)
        h = np.r_[_hashes(list(c)), np.uint64(_END)]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([*c.values(), len(rows)], pa.int64())], names=["h", "c"])


def _numbered(model: Model, rows: list[list[bytes]], seen: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and training counts of all tokens of the rows, each row's end included."""
    new = list({w for r in rows for w in r if w not in seen})
    if len(seen) > 1_000_000:
        seen.clear()
        new = list({w for r in rows for w in r})
    if new or b"" not in seen:
        h = np.r_[_hashes(new), np.uint64(_END)]
        o = np.argsort(h)
        ids, count = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        ids[o], count[o] = model.number(h[o])
        seen.update(zip([*new, b""], zip(ids.tolist(), count.tolist(), strict=True), strict=True))
    n = sum(map(len, rows)) + len(rows)
    end = seen[b""]
    both = np.fromiter((x for r in rows for x in (*map(seen.__getitem__, r), end)), np.dtype((np.int64, 2)), n)
    return both[:, 0], both[:, 1]


def _keys(model: Model, ids: np.ndarray, rows: list[list[bytes]]) -> np.ndarray:
    before = np.r_[np.int64(0), ids[:-1]]
    before[np.cumsum([0, *(len(r) + 1 for r in rows[:-1])])] = model.begin
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def fit(texts: DataFrame) -> Model:
    """Model of a one-column frame of texts (null: empty). The frame is read twice."""
    spark = texts.sparkSession
    model = Model(shared_path(spark, "kneser-ney"))
    vocabulary = cut(texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    model.tokens, model.size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if not model.tokens:
        return model
    if model.size >= 1 << 31:
        raise ValueError("more distinct words than word numbers")
    word_buckets = max(1, -(-model.size // ENTRIES))
    model.buckets = max(1, -(-model.tokens // ENTRIES))
    model.begin = model.size + 2
    model.span = ENTRIES
    path = model.path
    span_of = F.shiftrightunsigned("h", 32) * word_buckets

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (h, c) in _groups(batches):
            save_array(f"{path}/hash-{bucket}.npy", h.view(np.uint64))
            save_array(f"{path}/count-{bucket}.npy", c)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([len(h)], pa.int64())], names=["bucket", "n"])

    ordered = vocabulary.withColumn("bucket", F.shiftrightunsigned(span_of, 32)).repartition(word_buckets, "bucket")
    # unsigned order of the hashes
    ordered = ordered.sortWithinPartitions("bucket", F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).select("bucket", "h", "c")
    sizes = dict(cut(ordered.mapInArrow(write_words, "bucket long, n long")).collect())
    model.filled["words"] = frozenset(sizes)
    model.offsets = np.cumsum([0, *(sizes.get(b, 0) for b in range(word_buckets))])[:-1].tolist()

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        seen: dict[bytes, tuple[int, int]] = {}
        for part in _joined(np.unique(_keys(model, _numbered(model, rows, seen)[0], rows), return_counts=True) for _, _, rows in _chunks(batches, 0)):
            yield _dealt(*part, _bucket_of((part[0] >> np.uint64(32)).astype(np.int64), model.buckets))

    def write_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (blobs,) in _groups(batches, binary=True):
            keys, counts = _merge(blobs)
            ctx = (keys >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
            kind = np.minimum(counts, 3)
            small = counts.max(initial=0) < 256
            save_array(f"{path}/key-{bucket}.npy", keys)
            save_array(f"{path}/n-{bucket}.npy", counts.astype(np.uint8 if small else np.int64))
            save_array(f"{path}/ctx-{bucket}.npy", ctx[first])
            save_array(f"{path}/total-{bucket}.npy", np.add.reduceat(counts, first))
            save_array(f"{path}/kinds-{bucket}.npy", np.stack([np.add.reduceat((kind == k).astype(np.int64), first) for k in (1, 2, 3)], axis=1))
            word, times = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
            out = _dealt(word.astype(np.uint64), times, (word // model.span).astype(np.uint64))
            per = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([[0] * 6] * (out.num_rows - 1) + [[len(keys), *per, bucket + 1]], pa.list_(pa.int64()))], names=["bucket", "blob", "stats"])

    def write_continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (blobs,) in _groups(batches, binary=True):
            dense = np.zeros(min(model.span, model.size - bucket * model.span), np.int64)
            for blob in blobs:
                word, times = _unpack(blob)
                dense[word.astype(np.int64) - bucket * model.span] += times
            save_array(f"{path}/cont-{bucket}.npy", dense)
            per = [int((dense == k).sum()) for k in (1, 2, 3, 4)] + [int((dense >= 3).sum()), bucket]
            yield pa.RecordBatch.from_arrays([pa.array([per], pa.list_(pa.int64()))], names=["stats"])

    found = texts.mapInArrow(count_bigrams, "bucket long, blob binary").repartition(model.buckets, "bucket").sortWithinPartitions("bucket")
    found = cut(found.mapInArrow(write_bigrams, "bucket long, blob binary, stats array<long>"))
    at = [F.sum(F.col("stats")[k]) for k in range(5)]
    model.types, *per = found.agg(*at).first()
    model.filled["bigrams"] = frozenset(r[0] - 1 for r in found.select(F.col("stats")[5].alias("of")).where("of > 0").distinct().collect())
    model.discount = _discounts(per)
    spans = -(-model.size // model.span)
    low = cut(found.select("bucket", "blob").repartition(spans, "bucket").sortWithinPartitions("bucket").mapInArrow(write_continuations, "stats array<long>"))
    *per, more = low.agg(*at).first()
    model.filled["words at ends"] = frozenset(r[0] for r in low.select(F.col("stats")[5]).collect())
    model.low_discount = _discounts(per)
    model.low_gamma = sum(d * n for d, n in zip(model.low_discount, (per[0], per[1], more), strict=True)) / model.types
    return model


def _joined(parts: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A few chunks' sorted counts merged into one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        o = np.argsort(keys, kind="stable")
        keys, counts = keys[o], counts[o]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(counts, first)

    for p in parts:
        held.append(p)
        if len(held) == most:
            yield merged()
            held = []
    if held:
        yield merged()


def _dealt(keys: np.ndarray, counts: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and counts as one packed run per bucket."""
    o = np.argsort(of, kind="stable")
    of, keys, counts = of[o], keys[o], counts[o]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    ends = np.r_[cuts[1:], len(of)]
    blobs = [_pack(keys[a:b], counts[a:b]) for a, b in zip(cuts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(of[cuts].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _groups(batches: Iterator[pa.RecordBatch], binary: bool = False) -> Iterator[tuple[int, list]]:
    """Rows sorted by their first column -> (bucket, the other columns: arrays, or lists of binaries)."""
    bucket, held = None, []

    def out() -> list:
        return [sum(x, []) if binary else np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        of = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        for a, e in zip(cuts, np.r_[cuts[1:], len(of)].astype(int) if len(of) else [], strict=True):
            if held and of[a] != bucket:
                yield int(bucket), out()
                held = []
            bucket = of[a]
            held.append([c.slice(a, e - a).to_pylist() if binary else c.slice(a, e - a).to_numpy() for c in b.columns[1:]])
    if held:
        yield int(bucket), out()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with kn_tokens, kn_known, kn_base and kn_score (log10 probability of the whole text) appended, each prefixed where the name is taken."""

    at = docs.columns.index(text)
    names = [fresh(docs.columns, n) for n in ("kn_tokens", "kn_known", "kn_base", "kn_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        seen: dict[bytes, tuple[int, int]] = {}
        for b, first, rows in _chunks(batches, at):
            ids, count = _numbered(model, rows, seen)
            base = np.log10((count + 1) / (model.tokens + model.size + 1))
            low = np.full(len(ids), 1.0 / (model.size + 1))
            p = low
            if model.tokens:
                word, back = np.unique(ids, return_inverse=True)
                p = _discounted(model.continuations(word), model.low_discount) / model.types + model.low_gamma / (model.size + 1)
                p = p[back]
                key, back = np.unique(_keys(model, ids, rows), return_inverse=True)
                n, total, gamma = model.bigrams(key)
                direct = np.where(total > 0, _discounted(n, model.discount) / np.maximum(total, 1), 0.0)
                p = direct[back] + gamma[back] * p
            starts = np.cumsum([0, *(len(r) + 1 for r in rows[:-1])])
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(ids), np.int64), (count > 0).astype(np.int64), base, np.log10(p))]
            own = b.slice(first, len(rows))
            yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, sums)], names=[*own.schema.names, *names])

    schema = docs.select("*", *(F.lit(None).cast("long" if k < 2 else "double").alias(n) for k, n in enumerate(names))).schema
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; one row per document row.

    Rows whose fold is ``HELD`` are not learned from; a null id counts as learned. A null text is empty
    and has one token, the end. With nothing to learn from every score is that of a uniform guess.
    """
    held = F.coalesce(fold(F.col("doc_id"), HELD_MODULUS) == HELD, F.lit(False))
    model = fit(docs.where(~held).select("text"))
    out = score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return out.select(
        "doc_id", "held_out", F.col("kn_tokens").alias("n_tokens"), F.col("kn_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("kn_base").alias("base_score"), F.col("kn_score").alias("score"), F.pow(F.lit(10.0), -F.col("kn_score") / F.col("kn_tokens")).alias("perplexity"),
    )
