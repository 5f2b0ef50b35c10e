"""SimHash near-duplicates with a Gray-order hierarchical index (operator 3).

Fingerprints are one pass of numpy per document. Linking works on distinct fingerprints only, so
copies cost nothing. The index has two kinds of nodes. Its upper nodes are shared masked bit patterns:
four masks of 16 bits cover the fingerprint, and two fingerprints that differ in at most three bits
agree in one mask whole; (mask, pattern) is the shuffle key that sends a fingerprint to its nodes. An
over-full node is refined by four masks of 12 bits over the 48 bits that are left, by the same argument,
and one that is over-full even then is dealt out as pairs of blocks; both are exact. Below, the
fingerprints of a node stand in Gray rank order, runs of them share masked patterns that are
factored upwards level by level, and pairs of runs are dropped as whole groups as soon as the bit
differences accumulated from the root exceed the limit.

A node emits a spanning forest of what it linked, never all pairs; components come from the forests.

``LIMIT`` and ``SHINGLE`` are the contract of operator 3. Removal (``keep_one``) takes the same links, and as texts
with a Jaccard of 0.8 differ in ten of 64 bits and more, at which no masks are both exact and selective, it
adds to them the links of an exact prefix join over the sets of five-word shingles.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, join_by_hot_key, shared_path

SEED = 42
LIMIT = 3
SHINGLE = 3
#: Of ``keep_one``: words of a shingle, and Jaccard of near copies.
WIDE_SHINGLE, LIKE = 5, 0.8
BUCKETS = 1 << 16
#: Fingerprints that one node holds before it is refined.
NODE = 40_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint (as a signed number) of a whole text; null or no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros((8, 256))
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.bincount((part + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = ((ones @ _BITS).ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with a long column ``name`` appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(x.as_py()) for x in b.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, name])

    at = docs.columns.index(text)
    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("long").alias(name)).schema)


def gray_rank(x: Column) -> Column:
    """Position of ``x`` in the reflected binary code."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = parent[i]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _find(parent, i), _find(parent, j)
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _pairs(a_start, a_count, b_start, b_count):
    """For each k all (x, y) with x in run a_k and y in run b_k; also k."""
    n = a_count * b_count
    k = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a_start[k] + at // b_count[k], b_start[k] + at % b_count[k], k


def link_nodes(keys: np.ndarray, fps: np.ndarray, limit: int = LIMIT, fan: int = 8) -> np.ndarray:
    """Root of each position after linking equal-key fingerprints at ``limit`` or fewer bits.

    ``keys`` are sorted and complete; ``fps`` (uint64) stand in Gray order within a key.
    """
    n = len(fps)
    parent = np.arange(n)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    levels = []  # from leaves up: starts of runs in the level below, their counts, masks, patterns
    low, high, group = fps, fps, np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    while True:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        run = np.flatnonzero(place % fan == 0)
        low, high, group = np.bitwise_and.reduceat(low, run), np.bitwise_or.reduceat(high, run), group[run]
        levels.append((run, np.diff(np.r_[run, len(place)]), ~(low ^ high), low))
        if len(run) == len(starts):
            break
    zero = np.zeros(len(starts), np.uint64)
    roots = np.arange(len(starts))
    stack = [(len(levels) - 1, roots, roots, zero, np.zeros(len(starts), np.int64))]
    while stack:
        level, a, b, known, acc = stack.pop()
        if len(a) > 8192:
            for k in range(0, len(a), 8192):
                s = slice(k, k + 8192)
                stack.append((level, a[s], b[s], known[s], acc[s]))
            continue
        run, count, _, _ = levels[level]
        x, y, k = _pairs(run[a], count[a], run[b], count[b])
        keep = (x < y) if level == 0 else (x <= y)
        x, y, k = x[keep], y[keep], k[keep]
        if level == 0:
            near = np.bitwise_count(fps[x] ^ fps[y]) <= limit
            _unite(parent, x[near], y[near])
            continue
        _, _, mask, pattern = levels[level - 1]
        shared = mask[x] & mask[y]
        more = acc[k] + np.bitwise_count((pattern[x] ^ pattern[y]) & shared & ~known[k])
        near = more <= limit
        if near.any():
            stack.append((level - 1, x[near], y[near], shared[near], more[near]))
    return _find(parent, np.arange(n))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) sorted by key and Gray rank -> (src, dst) spanning edges of each node."""

    def done(keys, fps):
        root = link_nodes(keys, fps.view(np.uint64))
        own = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[root[own]])], names=["src", "dst"])

    keys, fps, held = [], [], 0
    for b in batches:
        keys.append(b.column(0).to_numpy(zero_copy_only=False))
        fps.append(b.column(1).to_numpy(zero_copy_only=False))
        held += len(keys[-1])
        if held < 100_000 or not len(keys[-1]):
            continue
        k, f = np.concatenate(keys), np.concatenate(fps)
        whole = int(np.searchsorted(k, k[-1]))  # the last key may go on
        if whole:
            yield done(k[:whole], f[:whole])
        keys, fps, held = [k[whole:]], [f[whole:]], len(k) - whole
    if held:
        yield done(np.concatenate(keys), np.concatenate(fps))


def _upper(fp: Column, masks: list[tuple[int, int]], prefix: list[Column]) -> Column:
    """Array of node keys of ``fp``: one per (shift, width) mask."""
    return F.array(*[F.xxhash64(*prefix, F.lit(s), F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1))) for s, w in masks])


def link_fingerprints(fps: DataFrame, node: int = NODE) -> DataFrame:
    """Distinct (fp) -> (src, dst) edges that connect whatever ``LIMIT`` bits connect."""
    wide = [(0, 16), (16, 16), (32, 16), (48, 16)]
    rows = fps.select("fp", F.posexplode(_upper(F.col("fp"), wide, [])).alias("m", "key"))
    crowded = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node).select("key", "n"))
    parts = [rows.select("key", "fp")]
    if not crowded.isEmpty():
        parts = [rows.join(crowded, "key", "left_anti").select("key", "fp")]
        # the 48 bits beside mask m, as four fields of 12
        bits = F.col("fp")
        rest = F.when(F.col("m") == 3, bits.bitwiseAND(F.lit((1 << 48) - 1)))
        for m in (0, 1, 2):
            low = bits.bitwiseAND(F.lit((1 << (16 * m)) - 1))
            rest = rest.when(F.col("m") == m, F.shiftleft(F.shiftrightunsigned(bits, 16 * (m + 1)), 16 * m).bitwiseOR(low))
        narrow = [(0, 12), (12, 12), (24, 12), (36, 12)]
        fine = rows.join(crowded.select("key"), "key").withColumn("rest", rest)
        fine = fine.select("fp", F.explode(_upper(F.col("rest"), narrow, [F.col("key")])).alias("key"))
        still = cut(fine.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node).select("key", "n"))
        if still.isEmpty():
            parts.append(fine.select("key", "fp"))
        else:
            parts.append(fine.join(still, "key", "left_anti").select("key", "fp"))
            blocks = F.ceil(F.col("n") * 2 / node)
            dense = fine.join(still, "key").withColumn("b", F.pmod(F.xxhash64("fp"), blocks))
            dense = dense.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            parts.append(dense.select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("key"), "fp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp"))).mapInArrow(_forests, "src long, dst long").distinct()


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows -> doc_id, fp, component_id; rows of null id get the least id of the others.

    component_id is the smallest doc_id among the documents whose fingerprints are reachable over
    links. A null text has no words; texts without words share fingerprint zero.
    """
    rows = cut(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return attach_components(rows)


def attach_components(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id); ``rows`` is read more than once."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows")))
    linked = connected_components(link_fingerprints(fps.select("fp")))
    of = fps.join(linked, fps.fp == linked.node, "left").select("fp", "least", "n_rows", F.coalesce("component", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return join_by_hot_key(rows, of.join(low, "root").select("fp", "component_id", "n_rows"), "fp", "n_rows").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's runs of ``size`` words (of the whole text where it has fewer)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    one = {w: digest(w, SEED) for w in set(words)}
    h = np.fromiter(map(one.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def _with_sets(docs: DataFrame, size: int, path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, h (of the text), fp, g (of its shingle set), and where below ``path`` the set stands: file, at, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, at, rows = uuid.uuid4().hex, 0, []
            with open(f"{path}/{name}", "wb") as f:
                for x in b.column(1):
                    own = shingle_set(x.as_py(), size)
                    f.write(own.astype("<u4").tobytes())
                    rows.append((xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0, at, len(own)))
                    at += len(own)
            g, at, n = np.array(rows, dtype=np.uint64).reshape(-1, 3).T.copy()
            fps = pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())
            columns = [fps, pa.array(g.view(np.int64)), pa.array([name] * len(g), pa.string()), pa.array(at.view(np.int64)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], names=["doc_id", "h", "fp", "g", "file", "at", "n"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    schema = rows.select("doc_id", "h", *(F.lit(None).cast(t).alias(c) for c, t in (("fp", "long"), ("g", "long"), ("file", "string"), ("at", "long"), ("n", "int")))).schema
    return rows.mapInArrow(run, schema)


class _Sets:
    """Shingle sets in memory-mapped files, of which at most ``most`` are open at once. One that is missing is an error."""

    def __init__(self, path: str, files: list[str], most: int = 96):
        self.path, self.files, self.most = path, files, most
        self.open: OrderedDict[int, np.ndarray] = OrderedDict()

    def __call__(self, file: int, at: int, n: int) -> np.ndarray:
        if file in self.open:
            self.open.move_to_end(file)
        else:
            while len(self.open) >= self.most:
                self.open.popitem(last=False)
            self.open[file] = np.memmap(f"{self.path}/{self.files[file]}", "<u4", "r")
        return np.array(self.open[file][at : at + n])  # a copy: what is held must not keep a map open


def _rarity(nodes: DataFrame, sets: _Sets) -> np.ndarray:
    """Number of shingles of the sets in each of ``BUCKETS`` hash buckets."""
    part = BUCKETS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for own in zip(*(b.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
                np.add.at(total, sets(*own) & np.uint32(BUCKETS - 1), 1)
        yield packed({k: total[k * part : (k + 1) * part] for k in range(64)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(n, np.int64)
        yield packed(held)

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n.tobytes() for n in held.values()], pa.binary())], names=["part", "n"])

    total = np.zeros(BUCKETS, np.int64)
    for r in nodes.mapInArrow(count, "part int, n binary").repartition("part").mapInArrow(add, "part int, n binary").collect():
        total[r["part"] * part : (r["part"] + 1) * part] += np.frombuffer(r["n"], np.int64)
    return total


def _least_common(n: np.ndarray, m: np.ndarray, like: float) -> np.ndarray:
    return (n + m) * (like / (1 + like)) - 1e-9


def link_sets(nodes: DataFrame, path: str, like: float = LIKE) -> DataFrame:
    """(g, file, at, n) of distinct sets -> (src, dst) edges that connect whatever pairs with a Jaccard of ``like`` or more connect.

    Two such sets share an element among the first of either in any common order, as many as the least
    overlap leaves; the order is by rarity. Sets that meet in one are compared whole, unless they are
    connected already: a group of near copies is compared with few of its members.
    """
    files = sorted(r["file"] for r in nodes.select("file").distinct().collect())
    number = {f: k for k, f in enumerate(files)}
    sets = _Sets(path, files)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([number[x] for x in b.column(1).to_pylist()], pa.int32()), b.column(2), b.column(3)], names=["g", "file", "at", "n"])

    nodes = cut(nodes.where("n > 0").select("g", "file", "at", "n").mapInArrow(numbered, "g long, file int, at long, n int"))
    rank = _rarity(nodes, sets)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                out, count = [], []
                for own in zip(*(s.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
                    x = sets(*own)
                    o = np.lexsort((x, rank[x & np.uint32(BUCKETS - 1)]))
                    out.append(x[o[: len(x) - int(np.ceil(like * len(x) - 1e-9)) + 1]])
                    count.append(len(out[-1]))
                rows = np.repeat(np.arange(len(s)), count)
                i = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                key = pa.array(np.concatenate(out).view(np.int32) if out else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([key, *(s.column(c).take(pa.array(rows)) for c in range(4)), pa.array(i.astype(np.int32))], names=["key", "g", "file", "at", "n", "i"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, g, *rest in _whole_keys(batches):
            a, b = _similar(key, g, *rest, sets, like)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    rows = nodes.mapInArrow(prefixes, "key int, g long, file int, at long, n int, i int")
    return rows.repartition("key").sortWithinPartitions("key", "n", "g").mapInArrow(run, "src long, dst long").distinct()


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, in runs that hold each key whole."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(h[0]) for h in held) < 200_000 or held[0][0][0] == held[-1][0][-1]:
            continue
        both = [np.concatenate(c) for c in zip(*held, strict=True)]
        whole = int(np.searchsorted(both[0], both[0][-1]))  # the last key may go on
        yield [c[:whole] for c in both]
        held = [[c[whole:] for c in both]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _similar(key, g, file, at, n, i, sets: _Sets, like: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the similar pairs among rows of equal key."""
    names, first, of = np.unique(g, return_index=True, return_inverse=True)
    parent = np.arange(len(names))
    n = n.astype(np.int64)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length and position filters: the first common element of a similar pair passes both."""
        need = _least_common(n[x], n[y], like)
        return (np.minimum(n[x], n[y]) >= like * np.maximum(n[x], n[y]) - 1e-9) & (n[x] - i[x] >= need) & (n[y] - i[y] >= need)

    def unite(x: int, y: int) -> None:
        a, b = (sets(file[k], at[k], n[k]) for k in (first[x], first[y]))
        common = len(np.intersect1d(a, b, assume_unique=True))
        if common >= like * (len(a) + len(b) - common) - 1e-9:
            _unite(parent, np.array([x]), np.array([y]))

    def apart(x: int, y: int) -> bool:
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        return x != y

    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[start, len(key)])
    few = (count > 1) & (count <= 64)
    place, size = start[few], count[few]
    tried: set[tuple[int, int]] = set()
    for lo in range(0, len(place), 4096):
        x, y, _ = _pairs(place[lo : lo + 4096], size[lo : lo + 4096], place[lo : lo + 4096], size[lo : lo + 4096])
        x, y = x[x < y], y[x < y]
        ok = near(x, y)
        pairs = np.unique(np.sort(np.stack([of[x[ok]], of[y[ok]]], axis=1), axis=1), axis=0)
        for a, b in pairs.tolist():
            if (a, b) not in tried and apart(a, b):
                tried.add((a, b))
                unite(a, b)
    for lo, m in zip(start[count > 64], count[count > 64], strict=True):
        own = np.arange(lo, lo + m)
        for x in own[:-1]:
            root = _find(parent, of[own])
            if (root == root[0]).all():
                break
            y = own[(own > x) & (root != root[x - lo])]
            for z in y[near(np.full(len(y), x), y)]:
                pair = (min(of[x], of[z]), max(of[x], of[z]))
                if pair not in tried and apart(*pair):
                    tried.add(pair)
                    unite(*pair)
    root = _find(parent, np.arange(len(names)))
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _links_by_bits(rows: DataFrame) -> DataFrame:
    """(fp, g) rows -> (src, dst) edges of sets: of equal fingerprints, and of those that differ in ``LIMIT`` or fewer bits."""
    both = cut(rows.select("fp", "g").distinct())
    least = cut(both.groupBy("fp").agg(F.min("g").alias("least")))
    equal = both.join(least, "fp").where("g <> least").select(F.col("g").alias("src"), F.col("least").alias("dst"))
    near = link_fingerprints(least.select("fp"))
    near = near.join(least.select(F.col("fp").alias("src"), F.col("least").alias("a")), "src").join(least.select(F.col("fp").alias("dst"), F.col("least").alias("b")), "dst")
    return equal.unionByName(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def keep_one(docs: DataFrame, shingle: int = WIDE_SHINGLE, like: float = LIKE) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document of the smallest id stays.

    Components are over the links of fingerprints (``LIMIT`` bits, as in ``components``) and over pairs of texts
    whose sets of ``shingle``-word runs have a Jaccard of ``like`` or more, each verified. Texts without words are alike. Rows that share that id are told apart by their
    text, and one of equal rows stays. A row of null id stays only where its component has no other.
    Columns pass through unchanged.
    """
    path = shared_path(docs.sparkSession, "shingle-sets")
    slim = cut(_with_sets(docs.select("doc_id", "text"), shingle, path))
    nodes = cut(slim.groupBy("g").agg(F.min(F.struct("file", "at", "n")).alias("s")).select("g", "s.*"))
    linked = connected_components(_links_by_bits(slim).unionByName(link_sets(nodes, path, like)))
    comp = nodes.join(linked, nodes.g == linked.node, "left").select("g", F.coalesce("component", "g").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g")
    # the winner of a set first: a set that many documents share is one row by then
    each = slim.groupBy("doc_id", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("g").agg(F.min(order).alias("b"), F.min_by("n", order).alias("n")).select("b.doc_id", "b.h", "g", "n")
    win = each.join(comp, "g").groupBy("root").agg(F.min(order).alias("b"), F.min_by("n", order).alias("n"))
    win = win.select(F.col("b.doc_id").alias("i"), F.col("b.h").alias("g"), "n")
    rows = docs.select(F.struct("*").alias("own"), "doc_id", F.xxhash64("text").alias("h"))
    got = rows.join(win, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(F.lit(0)))
    several = got.where("n > 1").withColumn("nth", nth).where("nth = 1")
    return got.where("n = 1").select("own.*").unionByName(several.select("own.*"))
