"""The corpus pipeline: whole documents in, packed training sequences out.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its predecessor kept; all but the last return
rows of ``documents`` unchanged.  ``run`` writes each stage as Parquet to the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeflow.llm import decontaminate, exact_dedup, order_minhash, pattern_packing, toxicity
from recipeflow.session import ship_package, stage
from recipeflow.sources.tables import load

#: Documents that score this or more are rejected.
TOXIC_FROM = 0.5
SEQUENCE_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text does not score as toxic; the model learns from the labelled rows of the ``documents`` table."""
    ship_package(spark)
    model = toxicity.learn(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_texts(docs, model).where(F.col("score") < TOXIC_FROM).select("_doc.*")


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    ship_package(spark)
    return order_minhash.drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of ``benchmark``."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence."""
    ship_package(spark)
    packed = pattern_packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), SEQUENCE_TOKENS)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: The near-dedup, toxicity and packing stages are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name)
    return docs
