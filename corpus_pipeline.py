"""Five stages from raw documents to a training mixture; each stage's rows are written and read again as the next's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import decontaminate, mixing, near, secrets, toxicity
from meshloom.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score as toxic; the scorer learns from the labelled ones that are not held out, and where
    these surely tell nothing, all documents stay."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not machine.told:
        return docs
    return toxicity.scored(docs, machine).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that five-word shingles with Jaccard 0.8 or more connect: the one with the
    smallest id, of repeated rows any one."""
    return near.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item, whole or edited."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and puts [SECRET] in place of each secret."""
    return secrets.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target marginals of source, language and topic."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Learnt scores and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage keeps of documents.parquet."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = set(scratch.written)
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        scratch.drop(*before)  # the next stage reads the last one's rows only
    return docs
