"""From raw documents to token ids, in five stages, each by one operator for training data.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; the results
of all but the last have the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkgraph.llm import _shared, bpe, contamination, near_duplicates, quality, secrets

#: Words of a shingle in the near-duplicate stage; its least similarity is the operator's.
SHINGLE_WORDS = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without junk and abusive documents."""
    return quality.kept_documents(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group."""
    return near_duplicates.kept_documents(docs, SHINGLE_WORDS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of a benchmark item."""
    return contamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the texts replaced."""
    return secrets.redacted_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the token ids, and the digest of the decoded text."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("contamination", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: SQL can't express the first and the last stage; tests hold the pipeline against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
