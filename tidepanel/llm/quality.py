"""Document quality by a byte-level convolutional network in numpy (operator 9).

A document's UTF-8 bytes are cut into overlapping chunks that cover it whole. Each byte enters as a
learned embedding and a few channels that say whether the last bytes repeat what stood shortly before.
Learned filters slide over every chunk and are max-pooled; the document's representation joins, per
filter, the mean and the maximum over its chunks, and a logistic unit makes one probability of it.

Training takes at most ``SAMPLE`` labelled rows of the learning folds (those of lowest hash), each with
its whole text up to ``SAMPLE_BYTES`` bytes in all, by Adam on mini-batches of documents; max pooling
sends gradients to the winning positions only. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

HELD_MODULUS, HELD = 3, 1
THRESHOLD = 0.5
#: Labelled rows that are learned from at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2_400, 12_000_000
CHUNK, OVERLAP = 512, 16
DIM, ECHO, WIDTH, FILTERS, STRIDE = 6, 2, 6, 20, 2
BLOCK = 256  # chunks that are worked on at once


@dataclass
class Net:
    embed: np.ndarray  # 256 x DIM, and a row for padding
    conv: np.ndarray  # WIDTH * (DIM + ECHO) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    last: float

    @classmethod
    def new(cls, seed: int = 11) -> Net:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.7, (257, DIM)).astype(np.float32)
        embed[256] = 0
        conv = rng.normal(0, (WIDTH * (DIM + ECHO)) ** -0.5, (WIDTH * (DIM + ECHO), FILTERS)).astype(np.float32)
        return cls(embed, conv, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)


def encode(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of byte values (256: padding) and echo channels; at least one chunk."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    flat = np.full(OVERLAP + n * step, 256, np.int16)
    flat[: len(raw)] = raw
    echo = np.zeros((len(flat), ECHO), np.float32)
    if len(raw) > 8:
        code = raw[:-3].astype(np.uint32) | raw[1:-2].astype(np.uint32) << 8 | raw[2:-1].astype(np.uint32) << 16 | raw[3:].astype(np.uint32) << 24
        for lag in range(1, 17):
            if len(code) > lag:
                echo[lag : len(code), 0] = np.maximum(echo[lag : len(code), 0], code[lag:] == code[:-lag])
        wide = np.minimum(np.cumsum(np.r_[0.0, echo[: len(flat), 0]])[16:] - np.cumsum(np.r_[0.0, echo[: len(flat), 0]])[:-16], 16) / 16
        echo[: len(wide), 1] = wide[: len(flat)]
    at = np.arange(n)[:, None] * step + np.arange(CHUNK)
    return flat[at], echo[at]


def _windows(net: Net, chunks: np.ndarray, echo: np.ndarray) -> np.ndarray:
    """Input of every filter position: chunks x positions x (WIDTH * channels)."""
    x = np.concatenate([net.embed[chunks], echo], axis=2, dtype=np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]  # chunks, positions, channels, WIDTH
    return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), view.shape[1], -1)


def pooled(net: Net, chunks: np.ndarray, echo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled filter outputs per chunk and the positions they come from."""
    tops, ats = [], []
    for a in range(0, len(chunks), BLOCK):
        w = _windows(net, chunks[a : a + BLOCK], echo[a : a + BLOCK])
        y = w.reshape(-1, w.shape[2]) @ net.conv
        y = y.reshape(w.shape[0], w.shape[1], FILTERS)
        at = y.argmax(axis=1)
        tops.append(np.take_along_axis(y, at[:, None], 1)[:, 0] + net.bias)
        ats.append(at)
    return np.concatenate(tops), np.concatenate(ats)


def probability(net: Net, top: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One probability per document from its chunks' pooled outputs; ``starts`` are first chunks."""
    r = np.tanh(top)
    n = np.diff(np.r_[starts, len(r)])[:, None]
    z = np.concatenate([np.add.reduceat(r, starts) / n, np.maximum.reduceat(r, starts)], axis=1) @ net.out + net.last
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], target: np.ndarray, rounds: int = 10, batch: int = 32, seed: int = 11) -> Net:
    net = Net.new(seed)
    rng = np.random.default_rng(seed)
    if not len(texts) or target.min() == target.max():
        return net
    data = [encode(t) for t in texts]
    share = target.mean()
    weight = np.where(target > 0, 1.0, min(3.0, (share / (1 - share)) ** 0.5))
    parts = ["embed", "conv", "bias", "out", "last"]
    m = {p: np.zeros_like(getattr(net, p)) for p in parts}
    v = {p: np.zeros_like(getattr(net, p)) for p in parts}
    t, steps = 0, rounds * -(-len(texts) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            chunks, echo = (np.concatenate([data[i][j] for i in own]) for j in (0, 1))
            n = np.array([len(data[i][0]) for i in own])
            starts = np.cumsum(n) - n
            top, at = pooled(net, chunks, echo)
            r = np.tanh(top)
            mean, best = np.add.reduceat(r, starts) / n[:, None], np.maximum.reduceat(r, starts)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([mean, best], 1) @ net.out + net.last, -30, 30)))
            g = (p - target[own]) * weight[own] / len(own)
            grad = {"out": np.concatenate([mean, best], 1).T @ g, "last": g.sum()}
            doc = np.repeat(np.arange(len(own)), n)
            gr = g[doc, None] * net.out[:FILTERS] / n[doc, None]
            gr = gr + np.where(r == best[doc], g[doc, None] * net.out[FILTERS:], 0)
            gt = (gr * (1 - r * r)).astype(np.float32)
            grad["bias"] = gt.sum(0)
            rows = np.arange(len(chunks))[:, None]
            place = at[:, :, None] * STRIDE + np.arange(WIDTH)  # chunks, filters, WIDTH
            byte = chunks[rows[:, :, None], place]
            x = np.concatenate([net.embed[byte], echo[rows[:, :, None], place]], axis=3).reshape(len(chunks), FILTERS, -1)
            grad["conv"] = np.einsum("cf,cfi->if", gt, x, optimize=True)
            back = (gt[:, :, None] * net.conv.T[None]).reshape(len(chunks), FILTERS, WIDTH, DIM + ECHO)[..., :DIM]
            grad["embed"] = np.stack([np.bincount(byte.ravel(), back[..., d].ravel(), 257) for d in range(DIM)], 1)
            grad["embed"][256] = 0
            t += 1
            rate = 0.02 * (1 - 0.9 * t / steps)
            for q in parts:
                m[q] = 0.9 * m[q] + 0.1 * grad[q]
                v[q] = 0.99 * v[q] + 0.01 * grad[q] ** 2
                new = getattr(net, q) - rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.99**t)) + 1e-7)
                setattr(net, q, new.astype(np.float32) if isinstance(new, np.ndarray) else float(new))
    return net


def learn(texts: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> Net:
    """Net from (doc_id, text, quality) rows, or from (doc_id, text) rows and ``labels`` of (doc_id, quality), unique by id.

    Null labels and texts are left out, rows of equal id and text are one, whose largest label counts. At most
    ``sample`` rows, those of lowest hash, and ``SAMPLE_BYTES`` reach the driver. Labels are joined with ids, hashes
    and sizes; of the texts only those of the chosen rows are moved.
    """
    rows = texts.where("text is not null").withColumn("h", F.xxhash64("doc_id", "text", F.lit(9)))
    slim = rows.select("doc_id", "h", F.octet_length("text").alias("n"), *([] if labels is not None else ["quality"]))
    known = slim.join(labels, "doc_id") if labels is not None else slim
    known = known.where("quality is not null").groupBy("h").agg(F.min("n").alias("n"), F.max(F.col("quality").cast("int")).alias("y"))
    sizes = known.orderBy("h").limit(sample).collect()
    chosen, used = [], 0
    for h, n, y in sizes:
        if used + n <= SAMPLE_BYTES:  # a text that does not fit is passed over
            used += n
            chosen.append((h, y))
    if sizes and not chosen:
        one = min(sizes, key=lambda r: (r["n"], r["h"]))
        chosen = [(one["h"], one["y"])]
    if not chosen:
        return train([], np.zeros(0))
    some = F.broadcast(texts.sparkSession.createDataFrame(chosen, "h long, y int"))
    found = rows.select("h", "text").join(some, "h").select("h", "text", "y").dropDuplicates(["h"]).orderBy("h").collect()
    return train([r["text"] for r in found], np.array([r["y"] for r in found], float))


def with_score(docs: DataFrame, net: Net, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a double column ``name`` appended, which must be new; null and empty texts are one chunk of padding."""
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, lo, texts = [], 0, b.column(at)
            while lo < len(texts):
                data, n = [], 0
                while lo + len(data) < len(texts) and n < 4 * BLOCK:
                    data.append(encode(texts[lo + len(data)].as_py()))
                    n += len(data[-1][0])
                size = np.array([len(c) for c, _ in data])
                top, _ = pooled(held.value, *(np.concatenate([d[j] for d in data]) for j in (0, 1)))
                scores.append(probability(held.value, top, np.cumsum(size) - size).astype(float))
                lo += len(data)
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("double").alias(name)).schema)


def learning(rows: DataFrame) -> DataFrame:
    """Rows of the learning folds, by doc_id."""
    return rows.where(fold(F.col("doc_id"), HELD_MODULUS) != HELD)


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the learning folds; of several labels of an id the largest counts."""
    return learning(labels).where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document row (a null id is not held out)."""
    net = learn(learning(docs.select("doc_id", "text")), labels=labels_of(labels))
    held = F.coalesce(fold(F.col("doc_id"), HELD_MODULUS) == HELD, F.lit(False))
    out = with_score(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"))
