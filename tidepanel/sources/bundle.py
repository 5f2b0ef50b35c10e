"""Bundles of files: staged with checksums and a manifest, verified, restored. Tasks copy and hash file by file, in blocks.

The driver lists names and deals them to tasks; contents never pass through it. A file of any size is read a block at a
time, so there is no limit of 2 GB. Tasks open the local file system (which must be a shared mount on a cluster) and the
stores that pyarrow opens; other stores are hashed through Spark's own reader (files of up to 2 GB) and not staged.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from fnmatch import fnmatch
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

BLOCK, TEXT_LIMIT = 1 << 20, 10 << 20
#: What a staged text must not hold: cloud key ids, private keys, home folders.
SECRETS = (r"AKIA[0-9A-Z]{16}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"/Users/[A-Za-z0-9._-]+/")
#: Paths, or last names of paths, that are never staged from a folder.
EXCLUDED = (".git/*", ".env", ".env.*", "*.pem", "*.key", "id_rsa", "id_ed25519", "*/.ssh/*", "*/.venv/*", "*/__pycache__/*", "*/.DS_Store", "*/worker.log")
_HOME = re.compile(r"/(?:Users|home)/[A-Za-z0-9._-]+/[^\"'\s,}]+")
STAGED = "source string, relative_path string, size_bytes long, sha256 string, findings array<string>"


def _fs(uri: str):
    """(file system, path) of a URI for use in tasks."""
    from pyarrow import fs

    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), at.path if at.scheme else uri
    return fs.FileSystem.from_uri(uri)


def _opens(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def _blocks(uri: str) -> Iterator[bytes]:
    system, path = _fs(uri)
    with system.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            yield block


def digest(uri: str) -> tuple[int, str]:
    """(bytes, SHA-256) of a file, read in blocks."""
    size, made = 0, hashlib.sha256()
    for block in _blocks(uri):
        size += len(block)
        made.update(block)
    return size, made.hexdigest()


def scrub(text: str, root: str) -> str:
    """Paths below the root become relative, other paths of home folders unreadable."""
    root = root.rstrip("/")
    return _HOME.sub("<local-path>", text.replace(root + "/", "").replace(root, "."))


def copy(source: str, target: str, root: str | None = None, secrets: tuple[str, ...] = ()) -> tuple[int, str, list[str]]:
    """Copies a file and gives (bytes, SHA-256, findings) of the copy, which appears at once under its name.

    With ``root`` a text of up to ``TEXT_LIMIT`` bytes is scrubbed; anything that is no UTF-8 is copied as it is. A task
    that runs again writes the same bytes again.
    """
    system, path = _fs(target)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    size, made, kept, findings = 0, hashlib.sha256(), [], []
    blocks = _blocks(source)
    if root is not None:
        for block in blocks:
            kept.append(block)
            size += len(block)
            if size > TEXT_LIMIT:
                break
        if size <= TEXT_LIMIT:
            whole = b"".join(kept)
            try:
                kept = [scrub(whole.decode(), root).encode()]
            except UnicodeDecodeError:
                kept = [whole]
            text = kept[0].decode(errors="ignore")
            findings = [p for p in secrets if re.search(p, text)]
        size = 0
    with system.open_output_stream(draft) as out:
        for part in (kept, blocks):
            for block in part:
                size += len(block)
                made.update(block)
                out.write(block)
    system.move(draft, path)
    return size, made.hexdigest(), findings


def _deal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One row a file, dealt one by one over tasks (a file's contents are one task's)."""
    n = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, schema).repartition(n)


def hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """name (path below the folder), size and SHA-256 of each file whose last name matches the glob; no files give no rows."""
    root = store.qualified(spark, folder)
    names = [(n, f"{root}/{n}" if n else root) for n, _ in store.files(spark, folder) if fnmatch((n or root).rsplit("/", 1)[-1], glob)]
    if not _opens(root):
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        hashed = found.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
        empty = [(n, 0, hashlib.sha256().hexdigest()) for n, size in store.files(spark, folder) if not size and fnmatch(n.rsplit("/", 1)[-1], glob)]
        return hashed.unionByName(spark.createDataFrame(empty, "name string, size long, sha256 string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                size, made = digest(r["uri"])
                yield pa.RecordBatch.from_pydict({"name": [r["name"]], "size": [size], "sha256": [made]})

    return _deal(spark, names, "name string, uri string").mapInArrow(run, "name string, size long, sha256 string")


def planned(spark: SparkSession, root: str, includes: list[tuple[str, str | None]], excluded: tuple[str, ...] = EXCLUDED) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(source, target below the payload, URI) of the files to stage, and the sources that are missing.

    A source is a file or folder below the root; with a target it goes there. Globs exclude by path or last name, but not
    a file that is a source itself.
    """
    rows, missing = [], []
    for source, target in includes:
        at = f"{store.qualified(spark, root)}/{source}"
        if not store.exists(spark, at):
            missing.append(source)
            continue
        if store.is_file(spark, at):
            rows.append((source, target or source, at))
            continue
        for name, _ in store.files(spark, at):
            path = f"{source}/{name}"
            if not any(fnmatch(path, p) or fnmatch(name.rsplit("/", 1)[-1], p) for p in excluded):
                rows.append((source, f"{target or source}/{name}", f"{at}/{name}"))
    return rows, missing


def stage(
    spark: SparkSession, root: str, bundle: str, includes: list[tuple[str, str | None]], name: str = "bundle", force: bool = False,
    excluded: tuple[str, ...] = EXCLUDED, secrets: tuple[str, ...] = SECRETS, readme: str | None = None,
) -> dict:
    """Copies the included files to ``bundle``/payload, scrubbed and audited, with bundle_manifest.json and SHA256SUMS.

    The bundle is built aside and put in place whole. A finding of the audit, or two files for one place, is an error and
    leaves no bundle; so is a bundle that is already there, unless ``force``. The manifest is returned; missing sources
    are listed in it.
    """
    if store.exists(spark, bundle) and not force:
        raise FileExistsError(f"{bundle} is there; force replaces it")
    rows, missing = planned(spark, root, includes, excluded)
    if len({r[1] for r in rows}) < len(rows):
        raise ValueError("two files have one place in the bundle")
    base, draft = store.qualified(spark, root), f"{store.qualified(spark, bundle)}.{uuid.uuid4().hex}"
    local = urlparse(base).path if base.startswith("file:") else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                size, made, findings = copy(r["uri"], f"{draft}/payload/{r['relative_path']}", local, secrets)
                yield pa.RecordBatch.from_pydict(
                    {"source": [r["source"]], "relative_path": [r["relative_path"]], "size_bytes": [size], "sha256": [made], "findings": pa.array([findings], pa.list_(pa.string()))}
                )

    try:
        made = _deal(spark, rows, "source string, relative_path string, uri string").mapInArrow(run, STAGED).collect()  # a row a file
        if found := [f"{r['relative_path']}: {p}" for r in made for p in r["findings"]]:
            raise ValueError("the audit found " + "; ".join(sorted(found)))
        listed = sorted(({c: r[c] for c in ("source", "relative_path", "size_bytes", "sha256")} for r in made), key=lambda r: r["relative_path"])
        manifest = {
            "bundle_name": name, "created_at": datetime.now(UTC).isoformat(), "includes": [s for s, _ in includes], "missing": missing, "file_count": len(listed),
            "total_size_bytes": sum(r["size_bytes"] for r in listed), "files": listed,
        }
        store.write_text(spark, f"{draft}/bundle_manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n")
        store.write_text(spark, f"{draft}/SHA256SUMS", "".join(f"{r['sha256']}  payload/{r['relative_path']}\n" for r in listed))
        if readme is not None:
            store.write_text(spark, f"{draft}/README.md", readme)
        store.swap(spark, draft, bundle)
    except BaseException:
        store.delete(spark, draft)
        raise
    return manifest


def copy_tree(spark: SparkSession, source: str, target: str, excluded: tuple[str, ...] = ()) -> int:
    """Copies a folder without the excluded names or paths, in place of what is at the target; gives the number of files."""
    base, draft = store.qualified(spark, source), f"{store.qualified(spark, target)}.{uuid.uuid4().hex}"
    names = [(n,) for n, _ in store.files(spark, source) if not any(fnmatch(n, p) or fnmatch(n.rsplit("/", 1)[-1], p) for p in excluded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                copy(f"{base}/{r['name']}", f"{draft}/{r['name']}")
                yield pa.RecordBatch.from_pydict({"name": [r["name"]]})

    try:
        n = _deal(spark, names, "name string").mapInArrow(run, "name string").count() if names else 0
        if n:
            store.swap(spark, draft, target)
    finally:
        store.delete(spark, draft)
    return n


def verify(spark: SparkSession, bundle: str) -> DataFrame:
    """(name, problem) of the files of SHA256SUMS that are missing or differ; a bundle without that file is an error."""
    root = store.qualified(spark, bundle)
    if not store.exists(spark, f"{root}/SHA256SUMS"):
        raise FileNotFoundError(f"{bundle} has no SHA256SUMS")
    lines = spark.read.text(f"{root}/SHA256SUMS").where(F.trim("value") != "")
    parsed = lines.select(F.split("value", r"\s+", 2).alias("x")).select(F.get("x", F.lit(0)).alias("sha256"), F.trim(F.get("x", F.lit(1))).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    problem = None if digest(f"{root}/{r['name']}")[1] == r["sha256"] else "mismatch"
                except FileNotFoundError:
                    problem = "missing"
                if problem:
                    yield pa.RecordBatch.from_pydict({"name": [r["name"]], "problem": [problem]})

    return parsed.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "name string, problem string")


def restore(spark: SparkSession, bundle: str, root: str, force: bool = False) -> int:
    """Copies the payload to ``root`` and gives the number of files.

    Nothing is copied where the bundle does not verify, or where a file is there already and ``force`` is not given.
    """
    if bad := verify(spark, bundle).orderBy("name").limit(20).collect():
        raise ValueError("the bundle is damaged: " + "; ".join(f"{r['problem']} {r['name']}" for r in bad))
    payload, target = f"{store.qualified(spark, bundle)}/payload", store.qualified(spark, root)
    names = [n for n, _ in store.files(spark, payload)]
    if not force and (there := [n for n in names if store.exists(spark, f"{target}/{n}")]):
        raise FileExistsError(f"{there[0]} and {len(there) - 1} more are there; force replaces them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                copy(f"{payload}/{r['name']}", f"{target}/{r['name']}")
                yield pa.RecordBatch.from_pydict({"name": [r["name"]]})

    return _deal(spark, [(n,) for n in names], "name string").mapInArrow(run, "name string").count()
