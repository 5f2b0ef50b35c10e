"""Embedding near-duplicates with navigable small-world graphs per shard (operator 8).

Vectors of a label (and length) are dealt into shards of bounded size by a hash. A task builds one
hierarchical navigable small-world graph per shard, which is stored as one row; every two shards of a
label then query each other in blocks. Beams start narrow and widen while a brute-force audit of part
of the block finds recall below ``AUDIT``, and for single queries while everything in their beam is
still linked; queries that outgrow the widest beam, blocks whose audit fails at it and blocks with too
few links to audit scan the shard exactly. A pair that either end finds counts at both. Cosines are verified in
double precision. Equal vectors are one node with a weight, and a task emits a spanning forest of its
links rather than the links, so a large group of copies stays linear in what leaves the task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_by_hot_key

LINK = 0.93
#: Vectors of a shard, and of a block that queries it.
SHARD = 16_384
BLOCK = 8_192
AUDIT, AUDITED = 0.97, 128
#: Links that an audit sees at least.
TRUE_LINKS = 256
BEAM, WIDEST = 32, 256
DEGREE = 12


class Graph:
    """Hierarchical navigable small world over unit vectors; built and searched in vectorised batches."""

    def __init__(self, x: np.ndarray, level: np.ndarray, links: list[np.ndarray]):
        self.x, self.level, self.links = x, level, links
        self.entry = int(np.argmax(level)) if len(level) else -1

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, batch: int = 512) -> Graph:
        n = len(x)
        u = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / (1 << 53)
        level = np.minimum((-np.log(1 - u) / np.log(degree)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # upper layers first: each layer is entered through a finished one
        x, level = x[order], level[order]
        g = cls(x, level, [np.full((n if k == 0 else int((level >= k).sum()), degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)])
        g.order = order
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(batch, max(1, done))))
            sims_in = x[new] @ x[new].T
            np.fill_diagonal(sims_in, -2)
            near_in = np.argsort(-sims_in, axis=1)[:, : degree]
            for k in range(len(g.links)):
                member = level[new] >= k
                if not member.any():
                    continue
                own = new[member]
                ids, sims = g.search(x[own], beam, k, done)
                peers = new[near_in[member]]
                psims = np.take_along_axis(sims_in[member], near_in[member], axis=1)
                peers = np.where((level[peers] >= k) & (psims > -2), peers, -1)
                ids, sims = np.hstack([ids, peers]), np.hstack([sims, np.where(peers < 0, -2, psims)])
                width = g.links[k].shape[1]
                picked = g._spread(ids, sims, min(width, degree))
                g.links[k][own, : picked.shape[1]] = picked
                g._back(k, own, picked)
            done = int(new[-1]) + 1
        return g

    def _spread(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` neighbours per row, nearest first, none nearer to a picked one than to the row; the rest by nearness."""
        o = np.argsort(-np.where(ids < 0, -2, sims), axis=1)[:, : max(3 * width, 24)]
        ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", v, v, optimize=True)
        picked = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            clash = (picked & (between[:, j, :] > sims[:, j, None])).any(1)
            picked[:, j] = (ids[:, j] >= 0) & ~clash & (picked.sum(1) < width)
        score = np.where(picked, 4.0, 0) + np.where(ids < 0, -9, sims)
        o = np.argsort(-score, axis=1)[:, :width]
        return np.where(np.take_along_axis(score, o, 1) > -5, np.take_along_axis(ids, o, 1), -1)

    def _back(self, k: int, own: np.ndarray, picked: np.ndarray) -> None:
        src, dst = np.repeat(own, picked.shape[1]), picked.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        if not len(dst):
            return
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(min(count.max(), 64))
        place = np.arange(len(dst)) - np.repeat(first, count)
        extra = np.full((len(to), most), -1, np.int64)
        fit = place < most
        extra[np.repeat(np.arange(len(to)), count)[fit], place[fit]] = src[fit]
        for s in range(0, len(to), 512):
            t = to[s : s + 512]
            ids = np.hstack([self.links[k][t], extra[s : s + 512]])
            sims = np.where(ids < 0, -2, np.einsum("bd,bjd->bj", self.x[t], self.x[np.maximum(ids, 0)], optimize=True))
            self.links[k][t] = self._spread(ids, sims, self.links[k].shape[1])

    def search(self, q: np.ndarray, beam: int, floor: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best found nodes of layer ``floor`` for each query: ids (-1: none) and cosines."""
        limit = len(self.x) if limit is None else limit
        if not len(q) or not limit:
            return np.full((len(q), beam), -1), np.full((len(q), beam), -2.0)
        start = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.links) - 1, floor, -1):
            start = self._layer(q, start, 4, k)[0][:, :1]
        return self._layer(q, start, beam, floor)

    def _layer(self, q: np.ndarray, start: np.ndarray, beam: int, k: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        links, rows = self.links[k], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(links) + 1), bool)
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -2.0, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("bd,bjd->bj", q, self.x[start], optimize=True)
        seen[rows, start] = True
        open_ = ids >= 0
        alive = np.arange(len(q))
        while len(alive):
            s = np.where(open_[alive], sims[alive], -3)
            pick = np.argpartition(-s, min(wide, beam) - 1, axis=1)[:, : min(wide, beam)]
            ok = np.take_along_axis(s, pick, 1) > -3
            go = ok.any(1)
            alive, pick, ok = alive[go], pick[go], ok[go]
            if not len(alive):
                break
            r = alive[:, None]
            open_[r, pick] = False
            near = np.where(ok[:, :, None], links[ids[r, pick]], -1).reshape(len(alive), -1)
            fresh_ = ~seen[r, near] & (near >= 0)
            near = np.where(fresh_, near, -1)
            o = np.sort(near, axis=1)  # one of equal neighbours
            near = np.where(np.hstack([np.ones((len(o), 1), bool), o[:, 1:] != o[:, :-1]]), o, -1)
            seen[r, near] = True
            got = np.where(near < 0, -2, np.einsum("bd,bjd->bj", q[alive], self.x[np.maximum(near, 0)], optimize=True))
            all_ids, all_sims = np.hstack([ids[alive], near]), np.hstack([sims[alive], got])
            all_open = np.hstack([open_[alive], near >= 0])
            o = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[alive], sims[alive], open_[alive] = (np.take_along_axis(a, o, 1) for a in (all_ids, all_sims, all_open))
        return ids, sims


def neighbours(
    g: Graph, q: np.ndarray, link: float = LINK, audit: float = AUDIT, own: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, node, cosine) of pairs at ``link`` or more, in blocks; ``q`` are float64 unit vectors, ``g.y`` the nodes' in order.

    ``own`` is the node that a query is itself (-1: none); it is no link. Queries are audited until
    ``TRUE_LINKS`` links are seen. Where there are fewer, or the widest beam fails the audit, the block
    scans the shard exactly.
    """
    small = q.astype(np.float32)
    own = np.full(len(q), -1) if own is None else own
    order = np.random.default_rng(len(q)).permutation(len(q))
    sample, truth, seen = [], [], 0
    for s in range(0, len(q), AUDITED):
        part = order[s : s + AUDITED]
        true = small[part] @ g.x.T >= link
        mine = np.flatnonzero(own[part] >= 0)
        true[mine, own[part[mine]]] = False
        linked = true.any(1)
        sample.append(part[linked])
        truth += [np.flatnonzero(t) for t in true[linked]]
        seen += int(true.sum())
        if seen >= TRUE_LINKS:
            break
    sample = np.concatenate(sample) if sample else order
    beam = BEAM if seen >= TRUE_LINKS else 2 * WIDEST
    while beam <= WIDEST:
        ids, _ = g.search(small[sample], beam)
        # those with as many links as the beam is wide, itself included, widen by themselves
        counted = [(len(t), len(np.intersect1d(t, i))) for t, i in zip(truth, ids, strict=True) if len(t) + 1 < beam]
        if sum(c for _, c in counted) >= audit * sum(n for n, _ in counted):
            break
        beam *= 2
    left = np.arange(len(q))
    while len(left):
        exact = beam > WIDEST
        later = []
        for s in range(0, len(left), 256):
            part = left[s : s + 256]
            if exact:
                a, ids = np.nonzero(small[part] @ g.x.T >= link - 1e-4)
                rows = part[a]
            else:
                ids, sims = g.search(small[part], beam)
                full = (sims >= link).all(1) & (ids >= 0).all(1)
                later.append(part[full])
                a, b = np.nonzero((sims >= link - 1e-4) & (ids >= 0) & ~full[:, None])
                rows, ids = part[a], ids[a, b]
            cos = np.einsum("ij,ij->i", q[rows], g.y[ids])
            ok = (cos >= link) & (own[rows] != ids)
            yield rows[ok], ids[ok], cos[ok]
        left = np.concatenate(later) if later else left[:0]
        beam *= 2


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    g = Graph.build(_unit(pdf["embedding"]).astype(np.float32))
    buf = io.BytesIO()
    np.savez(buf, order=g.order, level=g.level, **{f"l{k}": v for k, v in enumerate(g.links)})
    ids, n = pdf["vec_id"].to_numpy()[g.order], pdf["n"].to_numpy()[g.order]
    y = io.BytesIO()
    np.savez(y, ids=ids, n=n, y=_unit(pdf["embedding"])[g.order])
    one = pdf.iloc[0]
    return pd.DataFrame({"label": [one["label"]], "dim": [one["dim"]], "shard": [one["shard"]], "graph": [buf.getvalue()], "nodes": [y.getvalue()]})


def _graph(rows: pd.DataFrame) -> tuple[Graph, np.ndarray, np.ndarray]:
    """Graph, ids and weights of one stored shard."""
    z, node = np.load(io.BytesIO(rows["graph"].iloc[0])), np.load(io.BytesIO(rows["nodes"].iloc[0]))
    g = Graph(node["y"].astype(np.float32), z["level"], [z[f"l{k}"] for k in range(len([f for f in z.files if f[0] == "l" and f != "level"]))])
    g.y = node["y"]
    return g, node["ids"], node["n"]


def _query(pair: pd.DataFrame, block: int) -> pd.DataFrame:
    """One or two shards' graphs -> (vec_id, links, root): links between the two (or within the one), root of their own forest.

    Both shards query each other in blocks. A pair counts at both ends, whichever end found it.
    """
    pair = pair.sort_values("shard", kind="stable")
    sides = [_graph(pair.iloc[k : k + 1]) for k in range(len(pair))]
    (g, ids, n), (h, jds, m) = sides[0], sides[-1]
    alone = len(sides) == 1
    found = np.zeros((len(ids), len(jds)), bool)
    for s in range(0, len(jds), block):
        for rows, at, _ in neighbours(g, h.y[s : s + block], own=np.arange(s, min(s + block, len(jds))) if alone else None):
            found[at, rows + s] = True
    if not alone:
        for s in range(0, len(ids), block):
            for rows, at, _ in neighbours(h, g.y[s : s + block]):
                found[rows + s, at] = True
    links_a, links_b = np.zeros(len(ids), np.int64), np.zeros(len(jds), np.int64)
    nodes = np.unique(np.concatenate([ids, jds]))  # rows of equal id share a node
    qa, na = np.searchsorted(nodes, ids), np.searchsorted(nodes, jds)
    parent = np.arange(len(nodes))

    def root(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while not np.array_equal(up := parent[r], r):
            r = up
        return r

    for s in range(0, len(ids), 256):
        here = found[s : s + 256]
        x, y = np.nonzero(here | found[:, s : s + 256].T if alone else here)
        x = x + s
        other = ids[x] != jds[y]
        x, y = x[other], y[other]
        np.add.at(links_a, x, m[y])
        if not alone:
            np.add.at(links_b, y, n[x])
        a, b = qa[x], na[y]
        while len(a):
            ra, rb = root(a), root(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    top = root(np.arange(len(nodes)))
    out = pd.DataFrame({"vec_id": ids, "links": links_a, "root": nodes[top[qa]]})
    return out if alone else pd.concat([out, pd.DataFrame({"vec_id": jds, "links": links_b, "root": nodes[top[na]]})])


def near_duplicates(vectors: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per row.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    kept. Vectors of different lengths are not comparable. A row is told apart by its label and vector, not by its id:
    rows of one vec_id with different vectors have links of their own, rows of equal vectors are links of each other, and
    a row of null id links like any other. A component's id is its smallest vec_id, null where it has none.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", x.alias("x"), F.xxhash64("label", x).alias("h"))
    good = F.coalesce(usable, F.lit(False))
    slim = cut(rows.select("vec_id", "h", good.alias("good")))
    # below, a distinct vector's number stands in the column vec_id
    reps = rows.where(good).groupBy("label", "h", "x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    reps = cut(reps.select("label", F.size("x").alias("dim"), "h", F.monotonically_increasing_id().alias("vec_id"), "least", "n", F.col("x").alias("embedding")))
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).alias("shards"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod("h", "shards"))
    graphs = cut(
        dealt.select("label", "dim", "shard", "vec_id", "n", "embedding").groupBy("label", "dim", "shard")
        .applyInPandas(_build, "label int, dim int, shard long, graph binary, nodes binary")
    )
    # a task has two shards of a label, or one with itself
    pairs = graphs.join(sizes.select("label", "dim", "shards"), ["label", "dim"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    pairs = pairs.withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other"))
    found = cut(
        pairs.select("label", "dim", "low", "high", "shard", "graph", "nodes").groupBy("label", "dim", "low", "high")
        .applyInPandas(lambda pdf: _query(pdf, block), "vec_id long, links long, root long")
    )
    comp = connected_components(found.where("vec_id <> root").select(F.col("vec_id").alias("src"), F.col("root").alias("dst")))
    of = reps.select("h", F.col("vec_id").alias("rep"), "least", "n").join(found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left")
    of = cut(of.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("node")))
    low = of.groupBy("node").agg(F.min("least").alias("root"), F.count(F.lit(1)).alias("members"))
    of = join_by_hot_key(of, low, "node", "members").select("h", "n", "links", "root")
    out = slim.where("good").select("vec_id", "h")
    out = join_by_hot_key(out, of, "h", "n").unionByName(slim.where("not good").select("vec_id", "h", *(F.lit(None).cast("long").alias(c) for c in ("n", "links", "root"))))
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
