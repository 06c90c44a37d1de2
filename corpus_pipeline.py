"""A corpus from raw documents to packed training sequences, in five stages.

Each stage reads what the one before kept as a Parquet table and takes (spark, docs,
sf_dir). All but the last return the columns of documents; further columns of the input
go. An empty table gives an empty one at every stage. Without text (null, empty or blank)
a document has too few words for the first stage. Rows without doc_id go through: they
are never near duplicates, and are mixed by their texts. Repeated rows of one doc_id are
one document from the second stage on. Very long texts are worked on whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from covenant.llm import jaccard, mixing, packing, quality, queries, secrets
from covenant.llm._common import shared_dir

#: Texts are long, so few of them go to a Python worker at a time: rows and bytes of a batch at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, in batches that a worker holds easily."""
    for name, value in BATCHES.items():
        docs.sparkSession.conf.set(name, value)
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too short, repeat themselves or score below the threshold go; the kept rows stay as they are."""
    return quality.keep(_columns(docs), queries.trusted_ids(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    return jaccard.deduplicate(_columns(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows."""
    docs = _columns(docs)
    return secrets.redact(docs, secrets.train(secrets.samples(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get equal weights: documents are left out or repeated, and shuffled."""
    return mixing.replicate(_columns(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(_columns(docs), queries.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages fit models and search for packings, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
