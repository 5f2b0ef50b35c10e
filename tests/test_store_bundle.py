"""Bundles: round trip, damage, audit, scrubbing, blocks; frames written aside: interrupted writes leave the old ones."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import bundle, panel, store

START = datetime(2024, 1, 1)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "source"
    texts = {
        "README.md": f"see {root}/docs/a.txt and {root}", "docs/a.txt": "plain", "docs/deep/b.txt": "home /home/me/secret/file.txt here", "docs/empty.txt": "",
        "docs/__pycache__/x.pyc": "no", "docs/key.pem": "no", ".env": "no", "other.txt": "not included", "space in name.txt": "1",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "data").mkdir()
    (root / "data/raw.bin").write_bytes(bytes(range(256)) * 5)
    (root / "data/large.bin").write_bytes(b"/home/me/x/y\n" * 1_000_000)
    return root


INCLUDES = [("README.md", None), ("docs", None), ("data", "tables"), ("space in name.txt", "one/t.txt"), ("absent", None)]


def test_round_trip(spark, tree, tmp_path):
    made = bundle.stage(spark, str(tree), str(tmp_path / "b"), INCLUDES, readme="# Read me\n")
    names = {r["relative_path"]: r for r in made["files"]}
    assert set(names) == {"README.md", "docs/a.txt", "docs/deep/b.txt", "docs/empty.txt", "tables/raw.bin", "tables/large.bin", "one/t.txt"}
    assert made["missing"] == ["absent"] and made["file_count"] == 7 and json.loads((tmp_path / "b/bundle_manifest.json").read_text()) == made
    for name, r in names.items():
        data = (tmp_path / "b/payload" / name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["size_bytes"], r["sha256"])
    assert (tmp_path / "b/payload/README.md").read_text() == "see docs/a.txt and ."
    assert (tmp_path / "b/payload/docs/deep/b.txt").read_text() == "home <local-path> here"
    assert (tmp_path / "b/payload/tables/large.bin").read_bytes() == (tree / "data/large.bin").read_bytes()  # beyond the text limit
    assert bundle.verify(spark, str(tmp_path / "b")).count() == 0
    assert bundle.restore(spark, str(tmp_path / "b"), str(tmp_path / "out")) == 7
    assert (tmp_path / "out/tables/raw.bin").read_bytes() == (tree / "data/raw.bin").read_bytes()
    with pytest.raises(FileExistsError):
        bundle.restore(spark, str(tmp_path / "b"), str(tmp_path / "out"))
    assert bundle.restore(spark, str(tmp_path / "b"), str(tmp_path / "out"), force=True) == 7
    with pytest.raises(FileExistsError):
        bundle.stage(spark, str(tree), str(tmp_path / "b"), INCLUDES)
    assert bundle.stage(spark, str(tree), str(tmp_path / "b"), INCLUDES[:1], force=True)["file_count"] == 1
    assert not (tmp_path / "b/payload/docs").exists() and [p.name for p in tmp_path.iterdir() if "b." in p.name] == []


def test_damage_is_named_and_stops_a_restore(spark, tree, tmp_path):
    bundle.stage(spark, str(tree), str(tmp_path / "b"), INCLUDES)
    (tmp_path / "b/payload/docs/a.txt").write_text("changed")
    (tmp_path / "b/payload/one/t.txt").unlink()
    assert {tuple(r) for r in bundle.verify(spark, str(tmp_path / "b")).collect()} == {("payload/docs/a.txt", "mismatch"), ("payload/one/t.txt", "missing")}
    with pytest.raises(ValueError, match="damaged"):
        bundle.restore(spark, str(tmp_path / "b"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    with pytest.raises(FileNotFoundError):
        bundle.verify(spark, str(tmp_path / "out"))


def test_audit_leaves_no_bundle(spark, tree, tmp_path):
    (tree / "docs/a.txt").write_text("id AKIA" + "A" * 16)
    with pytest.raises(ValueError, match="docs/a.txt"):
        bundle.stage(spark, str(tree), str(tmp_path / "b"), INCLUDES)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["source"]
    with pytest.raises(ValueError, match="one place"):
        bundle.stage(spark, str(tree), str(tmp_path / "b"), [("other.txt", "x"), ("README.md", "x")])


def test_hashes_of_a_folder(spark, tree):
    got = {r["name"]: (r["size"], r["sha256"]) for r in panel.checksums(spark, str(tree), "*.txt").collect()}
    want = {str(p.relative_to(tree)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tree.rglob("*.txt")}
    assert got == want and panel.checksums(spark, str(tree), "*.none").count() == 0
    expected = spark.createDataFrame([("docs/a.txt", "0"), ("gone", "1")], "name string, sha256 string")
    assert {tuple(r) for r in panel.compare_checksums(panel.checksums(spark, str(tree)), expected).collect()} == {("docs/a.txt", "mismatch"), ("gone", "missing")}


def test_an_interrupted_write_leaves_the_old_frame(spark, tmp_path):
    path = str(tmp_path / "frame")
    assert store.write_frame(spark.range(10), path, top=F.max("id")) == {"rows": 10, "top": 9}
    with pytest.raises(Exception, match="stop"):
        store.write_frame(spark.range(10).select(F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id")), path)
    assert spark.read.parquet(path).count() == 10
    store.write_frame(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["frame"]


def test_parts_are_written_by_one_job(spark, tmp_path):
    df = spark.createDataFrame([(START + timedelta(days=k), k) for k in range(10)], "timestamp_agg timestamp, x int")
    side = F.when(F.col("x") < 3, "a").when(F.col("x") < 9, "b")
    targets = {"a": str(tmp_path / "one/a.parquet"), "b": str(tmp_path / "two/b.parquet")}
    got = store.write_parts(df.withColumn("_part", side), targets, "timestamp_agg")
    assert got == {"a": {"rows": 3, "start": START, "end": START + timedelta(days=2)}, "b": {"rows": 6, "start": START + timedelta(days=3), "end": START + timedelta(days=8)}}
    assert spark.read.parquet(targets["a"]).columns == df.columns and sorted(r["x"] for r in spark.read.parquet(targets["b"]).collect()) == list(range(3, 9))
    with pytest.raises(ValueError, match="no rows for b"):
        store.write_parts(df.where("x < 2").withColumn("_part", side), targets)
    assert spark.read.parquet(targets["a"]).count() == 3  # as before


def test_texts(spark, tmp_path):
    path = str(tmp_path / "deep/t.txt")
    store.write_text(spark, path, "äb\n")
    store.write_text(spark, path, "c")
    assert store.read_text(spark, path) == "c" and store.files(spark, str(tmp_path)) == [("deep/t.txt", 1)] and store.is_file(spark, path)
