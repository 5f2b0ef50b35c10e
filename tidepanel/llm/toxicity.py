"""Toxicity by weak supervision (operator 4).

Voters look at a text's words: fixed lexicons of insults, lexicons of words and word beginnings that
labelled rows associate with toxicity or its absence (dealt over several voters), and patterns (shouting,
second-person address, repeated punctuation). A generative label model takes their votes, estimates per
class how each votes and how votes correlate beyond the class, discounts correlated voters and gives a
posterior for every row; the sample's labels are one voter among them and may be outvoted. A linear classifier over the lexicon entries is trained on those posteriors and
scores whole texts anywhere in one narrow pass.

Learning uses at most ``SAMPLE`` labelled rows of the learning folds (those of lowest hash); counting the
sample's words is a Spark aggregation, and only chosen entries, votes and sparse features of the sample
reach the driver. Scores never see labels, lang, source or doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, fresh

HELD_MODULUS, HELD = 4, 2
THRESHOLD = 0.3
#: Labelled rows that are learned from at most.
SAMPLE = 12_000
#: Entries of the sample's features that the classifier's training works on at once, which bounds the driver's memory.
PART = 1 << 18
#: Entries of the learned lexicon at most, and voters that share it.
ENTRIES, DEALT = 4_000, 6
#: Log ratio of a lexicon entry between the classes at most.
BOUND = 3.0
#: A short list of English insults, for a first opinion where labels are few.
INSULTS = (
    "airhead bastard bitch bonehead bozo buffoon chump clown coward crap creep cretin crook degenerate dimwit "
    "dirtbag disgusting dolt dope dork dumb dumbass dunce fool freak garbage hate hypocrite idiot idiots imbecile "
    "jackass jerk kill lame liar loser losers lowlife lunatic maggot moron morons nasty numbskull parasite pathetic "
    "pig psycho puke rat rotten rubbish scum scumbag shameful sick simpleton slob stupid sucker thug trash twit "
    "ugly useless vermin vile weasel weirdo wimp worm worthless wretch"
).split()
_FIXED = frozenset(INSULTS)
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»¿¡"
_SECOND = frozenset("you your yours yourself u ur".split())


def words(text: str | None) -> Counter:
    """Lower-cased words without outer punctuation, with their counts."""
    raw = Counter(text.lower().split()) if text else Counter()
    out: Counter = Counter()
    for w, n in raw.items():
        if w := w.strip(_EDGES):
            out[w] += n
    return out


def entries(word: str) -> list[str]:
    """Lexicon entries that a word belongs to: itself, its beginnings and its end."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6, 7) if len(word) > k), *([f"*{word[-5:]}"] if len(word) > 5 else [])]


def _patterns(text: str, found: Counter) -> list[int]:
    """Votes of the fixed and pattern voters: 1 toxic, -1 not, 0 none."""
    n = sum(found.values()) or 1
    insults = [w for w in found if w in _FIXED]
    letters = sum(map(str.isalpha, text)) or 1
    shout = sum(map(str.isupper, text)) / letters
    return [
        1 if insults else 0,
        1 if len(insults) > 1 else 0,
        1 if shout > 0.6 and "!" in text else 0,
        1 if insults and any(w in _SECOND for w in found) else 0,
        1 if re.search(r"[!?]{3,}", text) and insults else 0,
        -1 if n < 5 and not insults else 0,
    ]


@dataclass
class Model:
    lexicon: dict[str, int]  # entry -> column
    sign: np.ndarray  # of each entry: 1 toxic, -1 not
    weights: np.ndarray  # presence and log density of each entry, log length, bias
    voters: list[str]
    accuracy: np.ndarray  # P(vote toxic | toxic), P(vote toxic | not), per voter
    correlation: np.ndarray
    prior: float


def features(text: str | None, lexicon: dict[str, int], memo: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, int, Counter]:
    """Columns of the entries a text has, how many of its words have each, its word count, its words."""
    found = words(text)
    hits: Counter = Counter()
    if len(memo) > 500_000:
        memo.clear()
    for w, n in found.items():
        own = memo.get(w)
        if own is None:
            own = memo[w] = tuple(lexicon[e] for e in entries(w) if e in lexicon)
        for k in own:
            hits[k] += n
    at = np.fromiter(hits.keys(), np.int64, len(hits))
    return at, np.fromiter(hits.values(), np.float64, len(hits)), sum(found.values()), found


def _values(count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(count)), np.log1p(200 * count / max(n, 20))


def score_text(text: str | None, model: Model, memo: dict) -> float:
    at, count, n, _ = features(text, model.lexicon, memo)
    k = len(model.lexicon)
    one, dense = _values(count, n)
    z = float(model.weights[at] @ one + model.weights[k + at] @ dense + model.weights[2 * k] * math.log1p(n) / 10 + model.weights[2 * k + 1])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _centred(z: np.ndarray, share: float) -> np.ndarray:
    """Log odds moved by a constant, so that their probabilities have the mean ``share``."""
    low, high = -40.0, 40.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if _sigmoid(z + mid).mean() > share else (mid, high)
    return z + low


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of each row, P(vote toxic | toxic) and P(vote toxic | not) of each voter, residual correlations and prior.

    ``votes`` are 1, 0 or -1. The sample's own labels are the last voter; they start the model and so name the
    classes, but weigh by their rates like any voter. In the first half of the rounds these are estimated
    against the posterior of the other voters alone, so that others may outvote the labels that started them,
    and the prior is the one that the labels' share and rates imply; then by plain expectation maximisation. A voter's log ratio is divided
    by one plus the absolute correlations it has with other voters within the classes.
    """
    labels = known.astype(int)
    share, own = labels.mean(), np.array([0.05, 0.95])
    post = np.clip(known.astype(float), 0.05, 0.95)
    kinds = votes[:, :, None] == np.array([1, 0, -1])
    rates, prior = np.zeros((2, votes.shape[1], 3)), share
    for turn in range(rounds):
        alone = turn < rounds // 2  # by then the other voters have had their say on the labels
        if not alone:
            prior = min(max(post.mean(), 0.01), 0.99)
        elif turn and own[1] - own[0] >= 0.2:
            prior = min(max((share - own[0]) / (own[1] - own[0]), 0.01), share)
        for c, w in enumerate((1 - post, post)):
            rates[c] = (np.einsum("n,nms->ms", w, kinds) + 0.5) / (w.sum() + 1.5)
        mean = np.stack([r[:, 0] - r[:, 2] for r in rates])
        rest = votes - ((1 - post)[:, None] * mean[0] + post[:, None] * mean[1])
        spread = rest.std(0) + 1e-9
        corr = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        discount = 1 / (1 + np.maximum(np.abs(corr) - 0.05, 0).sum(1) - np.abs(np.diag(corr)).clip(0, 0.95))
        ratio = (np.log(rates[1]) - np.log(rates[0])) * discount[:, None]
        z = np.einsum("nms,ms->n", kinds, ratio)
        seen = _sigmoid(_centred(z, prior)) if alone else post
        own = np.array([((w * labels).sum() + 1) / (w.sum() + 2) for w in (1 - seen, seen)])
        said = np.where(labels == 1, math.log(own[1] / own[0]), math.log((1 - own[1]) / (1 - own[0])))
        z = _centred(z + said, prior) if alone else z + said + math.log(prior / (1 - prior))
        post = 0.5 * post + 0.5 * _sigmoid(z)
    return post, np.vstack([rates[::-1, :, 0].T, own[::-1]]), corr, prior


def _linear(rows: list[tuple[np.ndarray, np.ndarray, int]], target: np.ndarray, k: int, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft targets: full-batch Adam with a little ridge."""
    lengths = np.array([len(at) for at, _, _ in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    col = np.concatenate([at for at, _, _ in rows]).astype(np.int32) if len(row) else np.zeros(0, np.int32)
    n = np.array([n for _, _, n in rows], float)
    count = np.concatenate([c for _, c, _ in rows]) if len(row) else np.zeros(0)
    dense = np.log1p(200 * count / np.maximum(n[row], 20))
    size = np.log1p(n) / 10
    parts = [(row[s : s + PART], col[s : s + PART], dense[s : s + PART]) for s in range(0, len(row), PART)]
    w, m, s = np.zeros(2 * k + 2), np.zeros(2 * k + 2), np.zeros(2 * k + 2)
    for t in range(1, rounds + 1):
        z = w[2 * k] * size + w[2 * k + 1]
        for r, c, d in parts:
            z += np.bincount(r, w[c] + w[k + c] * d, len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad = np.zeros(2 * k + 2)
        for r, c, d in parts:
            own = g[r]
            grad[:k] += np.bincount(c, own, k)
            grad[k : 2 * k] += np.bincount(c, own * d, k)
        grad[2 * k :] = g @ size, g.sum()
        grad += 2e-6 * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def learn(texts: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> Model:
    """Model from (doc_id, text, toxic) rows, or from (doc_id, text) rows and ``labels`` of (doc_id, toxic), unique by id.

    Null labels and texts are left out, rows of equal id and text are one, whose largest label counts. Long texts count
    like others, by the words they have. Labels are joined with ids and hashes; of the texts only the sample's are moved.
    """
    rows = texts.where("text is not null").withColumn("h", F.xxhash64("doc_id", "text", F.lit(5)))
    slim = rows.select("doc_id", "h", *([] if labels is not None else ["toxic"]))
    known = slim.join(labels, "doc_id") if labels is not None else slim
    known = known.where("toxic is not null").groupBy("h").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    some = F.broadcast(cut(known.orderBy("h").limit(sample)))  # of bounded size
    known = cut(rows.select("h", "text").join(some, "h").dropDuplicates(["h"]).select("text", "y").repartition(24))  # of bounded size

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update({e for w in words(t) for e in entries(w)})
        every = [e for e in {*toxic, *clean} if toxic[e] or clean[e] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[e] for e in every], pa.int64()), pa.array([clean[e] for e in every], pa.int64())], names=["e", "a", "b"])

    y1, y0 = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    chosen: list = []
    if y1 and y0:
        by = known.mapInArrow(counts, "e string, a long, b long").groupBy("e").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        p, q = (F.col("a") + 0.5) / (y1 + 1), (F.col("b") + 0.5) / (y0 + 1)
        z = (F.log(p) - F.log(q)) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
        by = by.withColumn("z", z).where((F.col("a") + F.col("b") >= 4) & (F.abs("z") > 2.5))
        # the lexicon is a top list of fixed length
        chosen = by.orderBy(F.desc(F.abs("z") + F.when(F.col("z") > 0, 2).otherwise(0)), "e").limit(ENTRIES).collect()
    lexicon = {r["e"]: k for k, r in enumerate(chosen)}
    for w in INSULTS:
        lexicon.setdefault(w, len(lexicon))
    sign = np.ones(len(lexicon))
    for r in chosen:
        sign[lexicon[r["e"]]] = 1 if r["z"] > 0 else -1
    ratio = np.zeros(len(lexicon))
    for r in chosen:
        ratio[lexicon[r["e"]]] = np.clip(math.log((r["a"] + 0.5) / (y1 + 1)) - math.log((r["b"] + 0.5) / (y0 + 1)), -BOUND, BOUND)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                at, count, n, found = features(t, lexicon, memo)
                out.append({"at": at.astype("<i4").tobytes(), "c": count.astype("<f4").tobytes(), "n": n, "v": _patterns(t, found)})
            yield pa.RecordBatch.from_arrays([pa.array(out, _SPARSE), b.column(1)], names=["x", "y"])

    # arrays travel as bytes, so that the driver makes no object of every number; counts are exact to 2^24
    got = known.mapInArrow(sparse, "x struct<at:binary,c:binary,n:bigint,v:array<bigint>>, y int").collect()
    rows = [(np.frombuffer(r["x"]["at"], "<i4"), np.frombuffer(r["x"]["c"], "<f4"), r["x"]["n"]) for r in got]
    truth = np.array([r["y"] for r in got], float)
    names = [f"lexicon-{k}" for k in range(DEALT)] + ["density", "balance", "insult", "insults", "shouting", "address", "punctuation", "tiny", "label"]
    if not rows or not y1 or not y0:  # nothing to learn from: the fixed list speaks
        k = len(lexicon)
        w = np.concatenate([np.where(ratio >= 0, 2.0, 0.0), np.zeros(k + 1), [-1.5]])
        return Model(lexicon, sign, w, names, np.zeros((len(names), 2)), np.eye(len(names)), 0.1)
    votes = np.column_stack([_lexicon_votes(rows, ratio, truth.mean()), np.array([r["x"]["v"] for r in got])])
    post, rates, corr, prior = label_model(votes, truth)
    return Model(lexicon, sign, _linear(rows, post, len(lexicon)), names, rates, corr, prior)


_SPARSE = pa.struct([("at", pa.binary()), ("c", pa.binary()), ("n", pa.int64()), ("v", pa.list_(pa.int64()))])


def _lexicon_votes(rows: list[tuple[np.ndarray, np.ndarray, int]], ratio: np.ndarray, share: float) -> np.ndarray:
    """Votes of the learned lexicons (entries dealt by number), of toxic density and of the balance of evidence.

    A voter says toxic of the part of texts, as large as ``share``, that has most evidence, and not of most of the others.
    """
    n = len(rows)
    row = np.repeat(np.arange(n), [len(at) for at, _, _ in rows])
    col = np.concatenate([at for at, _, _ in rows])
    count = np.concatenate([c for _, c, _ in rows])
    size = np.array([max(m, 1) for _, _, m in rows])
    evidence = [np.bincount(row, np.where(col % DEALT == k, ratio[col], 0), n) for k in range(DEALT)]
    evidence.append(np.bincount(row, count * (ratio[col] > 1), n) / size)
    evidence.append(np.bincount(row, ratio[col], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)))
    high = [max(np.quantile(e, 1 - share), 1e-9) for e in evidence]
    low = [np.quantile(e, 0.7 * (1 - share)) for e in evidence]
    return np.column_stack([np.where(e >= h, 1, np.where(e <= b, -1, 0)) for e, h, b in zip(evidence, high, low, strict=True)])


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``name`` appended; null and empty texts are scored as texts of no words."""
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            scores = pa.array([score_text(t.as_py(), held.value, memo) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("double").alias(name)).schema)


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the learning folds; of several labels of an id the largest counts."""
    return _learning(labels).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _learning(rows: DataFrame) -> DataFrame:
    return rows.where(fold(F.col("doc_id"), HELD_MODULUS) != HELD)


def learn_from(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the documents and labels of the learning folds."""
    return learn(_learning(docs.select("doc_id", "text")), labels=labels_of(labels))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document row (a null id is not held out)."""
    model = learn_from(docs, labels)
    held = F.coalesce(fold(F.col("doc_id"), HELD_MODULUS) == HELD, F.lit(False))
    out = with_score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; learned from the rows of ``docs`` that ``labels`` names."""
    name = fresh(docs.columns, "toxicity")
    return with_score(docs, learn_from(docs, labels), name=name).where(F.col(name) < threshold).drop(name)
