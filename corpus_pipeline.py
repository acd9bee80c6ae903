"""The training-data pipeline over ``documents``: quality, near duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir); between stages the rows are written as
Parquet to the shared work folder and read again.  All stages but the last return
the columns of ``documents``.  Nulls, empty and long texts, repeated rows and
empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wellspark.llm.jaccard import keep_first
from wellspark.llm.mixing import mixed
from wellspark.llm.packing import packed_documents
from wellspark.llm.pii import mask_documents
from wellspark.llm.quality import keep_good
from wellspark.session import apply_settings, settle


#: Rows handed to Python at once: long texts make large batches, and two tasks share an executor's memory.
BATCH_ROWS = "500"


def _ready(spark: SparkSession) -> None:
    apply_settings(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after the text has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _ready(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts that share 0.8 or more of their runs of five words.

    SimHash fingerprints bring close texts together, MinHash bands the texts that are
    alike beyond a few bits; whole sets decide in both cases.
    """
    _ready(spark)
    return keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    _ready(spark)
    return _counted(mask_documents(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, once for each pass over their source."""
    _ready(spark)
    return _counted(mixed(docs, sort=False))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 2,048 tokens."""
    _ready(spark)
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("best-fit packing", packing)]

#: Trained models, message passing and tokenizing have no SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
