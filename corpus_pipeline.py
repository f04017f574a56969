"""From raw documents to packed training sequences, in stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm import fm_index, nbsvm, packing, partenum, pii
from alertmill.llm.tokens import byte_bpe_path
from alertmill.session import prepare
from alertmill.storage import materialize

QUALITY_THRESHOLD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels to learn from it rejects none."""
    model = nbsvm.train(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights.any():
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return nbsvm.score(rows, model, keep=("_row",), inside="_row").where(F.col("score") >= QUALITY_THRESHOLD).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest id; repeated rows go as well."""
    prepare(spark)
    return partenum.one_of_each_component(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return fm_index.without_contamination(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), length=13, share=20)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, byte_bpe_path(), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
