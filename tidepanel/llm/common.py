"""Shared helpers: lineage cuts, shared scratch folder, connected components, label splits."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, as a path that Python workers can open and memory-map.

    Memory maps need a mounted file system, so a ``spark.checkpoint.dir`` in a store without a mount
    is refused with a clear message.
    """
    uri = urlparse(shared_dir(spark))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped tables need a mounted shared folder, not {uri.scheme}://")
    path = os.path.join(uri.path, f"{kind}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def save_array(path: str, array: np.ndarray) -> None:
    """Write under a temporary name and rename: a task that runs again replaces its output with the same bytes."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        np.save(f, array)
    os.replace(draft, path)


class Maps:
    """Memory-mapped arrays of a folder, of which at most ``most`` are open at once. One that is missing is an error."""

    def __init__(self, path: str, most: int = 96):
        self.path, self.most = path, most
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()

    def __call__(self, name: str) -> np.ndarray:
        if name in self.held:
            self.held.move_to_end(name)
        else:
            while len(self.held) >= self.most:
                self.held.popitem(last=False)
            self.held[name] = np.load(f"{self.path}/{name}.npy", mmap_mode="r")
        return self.held[name]


def join_by_hot_key(rows: DataFrame, of: DataFrame, key: str, count: str, most: int = 1_000) -> DataFrame:
    """Left join of ``rows`` with ``of`` on ``key``, unique in ``of``, whose column ``count`` says how many rows have it.

    Keys of a ``most``th of the rows or more are at most ``most`` and are broadcast; no task gets all rows of one.
    """
    total = of.agg(F.sum(count)).first()[0] or 0
    hot = of.where(F.col(count) * most >= total).select(F.col(key).alias("hot_key"), F.struct(*(c for c in of.columns if c != key)).alias("hot"))
    cold = of.where(F.col(count) * most < total).select(F.col(key).alias("cold_key"), F.struct(*(c for c in of.columns if c != key)).alias("cold"))
    here = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    spread = F.when(F.col("hot_key").isNull(), F.col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    got = here.withColumn("spread", spread).join(cold, (F.col("spread") == F.col("cold_key")) & F.col("hot_key").isNull(), "left")
    return got.select(*rows.columns, *(F.coalesce(f"hot.{c}", f"cold.{c}").alias(c) for c in of.columns if c != key))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def fresh(columns: list[str], name: str) -> str:
    """``name``, prefixed until it clashes with none of ``columns`` (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long pairs -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds. Each round only aggregates minima and joins them
    back, so a hub's edges can be split over tasks; every round is cut into the shared folder.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    seen = state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.where("u <> v").distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
