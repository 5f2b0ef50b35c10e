"""Training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from tidepanel.llm import decontamination, lines, mixing, simhash, toxicity
from tidepanel.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rows that score 0.3 or more go. Learned from the labelled rows of ``docs`` itself."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later similar lines are cut from the texts; rows stay, n_chars follows the text."""
    from pyspark.sql import functions as F

    out = lines.remove_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of texts linked by SimHash bits, or by a Jaccard of 0.8 or more over five-word shingles, the document of the smallest id stays."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: rows that hold ten words in a row of a benchmark item go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents that the mix takes, with how often (mix_copies)."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix),
]
#: Training, similarity joins and suffix arrays are beyond SQL; the operators are tested against plain Python one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{home}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
