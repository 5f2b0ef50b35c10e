"""Files of any store that Spark reaches: lists, small texts, swaps; frames written aside and put in place at once.

The driver only handles names and small texts. A frame is written to a draft folder beside its place; when the job has
ended well, renames put it there. A job that fails or is stopped leaves what was there before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _at(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store, store.makeQualified(path)


def qualified(spark: SparkSession, uri: str) -> str:
    """The path with its scheme and without a slash at its end."""
    return _at(spark, uri)[1].toString().rstrip("/")


def exists(spark: SparkSession, uri: str) -> bool:
    store, path = _at(spark, uri)
    return store.exists(path)


def is_file(spark: SparkSession, uri: str) -> bool:
    store, path = _at(spark, uri)
    return store.exists(path) and store.getFileStatus(path).isFile()


def files(spark: SparkSession, uri: str) -> list[tuple[str, int]]:
    """(name below the folder, bytes) of all files, sorted; a file itself has the empty name. Nothing there: an error."""
    store, path = _at(spark, uri)
    root, listed, out = path.toString().rstrip("/"), store.listFiles(path, True), []
    while listed.hasNext():
        f = listed.next()
        out.append((f.getPath().toString()[len(root) + 1 :], f.getLen()))
    return sorted(out)


def folders(spark: SparkSession, uri: str, glob: str) -> list[str]:
    """Last names of the folders right below one whose names match the glob, sorted."""
    store, path = _at(spark, f"{uri.rstrip('/')}/{glob}")
    return sorted(f.getPath().getName() for f in store.globStatus(path) or [] if f.isDirectory())


def read_text(spark: SparkSession, uri: str) -> str:
    """A small text, whole."""
    store, path = _at(spark, uri)
    stream = store.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """A small text, written aside and put in place."""
    draft = f"{uri}.{uuid.uuid4().hex}"
    store, path = _at(spark, draft)
    stream = store.create(path)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    swap(spark, draft, uri)


def delete(spark: SparkSession, uri: str) -> None:
    store, path = _at(spark, uri)
    store.delete(path, True)


def swap(spark: SparkSession, draft: str, final: str) -> None:
    """Puts a draft, file or folder, in the place of what is there. If that fails, what was there comes back."""
    store, new = _at(spark, draft)
    _, place = _at(spark, final)
    aside = None
    store.mkdirs(place.getParent())
    if store.exists(place):
        _, aside = _at(spark, f"{place.toString()}.{uuid.uuid4().hex}")
        if not store.rename(place, aside):
            raise OSError(f"{final} can't be moved aside")
    if not store.rename(new, place):
        if aside is not None:
            store.rename(aside, place)
        raise OSError(f"{draft} can't be moved to {final}")
    if aside is not None:
        store.delete(aside, True)


def write_frame(df: DataFrame, path: str, **measures: Column) -> dict:
    """Writes Parquet aside and puts it in place; gives back the rows and any further aggregates, observed by the same job."""
    seen, draft = Observation(), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in measures.items())).write.parquet(draft)
    except BaseException:
        delete(df.sparkSession, draft)
        raise
    swap(df.sparkSession, draft, path)
    return seen.get


def write_parts(df: DataFrame, targets: dict[str, str], time: str | None = None) -> dict[str, dict]:
    """Writes each part's rows, without the column ``_part``, to its own folder, all in one job.

    ``_part`` holds a name or an array of names (a row may belong to several parts); rows of other parts, or of none, go
    nowhere. Gives back rows and, with ``time``, the first and last time of each part, observed by the same job. A part
    without rows is an error, before anything is put in place.
    """
    spark, names = df.sparkSession, list(targets)
    rows = df
    if not isinstance(rows.schema["_part"].dataType, StringType):
        rows = rows.withColumn("_part", F.explode("_part"))
    seen, draft = Observation(), f"{targets[names[0]].rstrip('/')}.{uuid.uuid4().hex}"
    mine = lambda n, c: F.when(F.col("_part") == n, c)
    measures = [F.count(mine(n, F.lit(1))).alias(f"rows_{k}") for k, n in enumerate(names)]
    if time:
        measures += [f(mine(n, F.col(time))).alias(f"{f.__name__}_{k}") for k, n in enumerate(names) for f in (F.min, F.max)]
    try:
        rows.where(F.col("_part").isin(names)).observe(seen, *measures).write.partitionBy("_part").parquet(draft)
        got = seen.get
        if empty := [n for k, n in enumerate(names) if not got[f"rows_{k}"]]:
            raise ValueError(f"no rows for {', '.join(empty)}")
        for name in names:
            swap(spark, f"{draft}/_part={name}", targets[name])
    finally:
        delete(spark, draft)
    return {n: {"rows": got[f"rows_{k}"]} | ({"start": got[f"min_{k}"], "end": got[f"max_{k}"]} if time else {}) for k, n in enumerate(names)}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a fresh temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named
