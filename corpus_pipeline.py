"""The training-data pipeline: five operators applied to ``documents`` in turn.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept and returns a DataFrame with the columns of ``documents`` (the last one adds
``shard`` and ``slot``). :func:`run` writes each stage's result as Parquet into
the shared folder of ``spark.checkpoint.dir`` and reads it again as the next
stage's input, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandcast.llm.common import table
from demandcast.llm.decontaminate import drop_contaminated
from demandcast.llm.language import fit_languages, fitting_languages, with_least_fit
from demandcast.llm.mixing import training_order
from demandcast.llm.sharding import shard_documents
from demandcast.llm.simhash import drop_near_copies
from demandcast.session import shared_path


#: Share of a document's letters that must be in a learned script. The words in those
#: must fit the languages they are labelled with better than random letters do; how
#: many languages share the text does not matter: a short text with a foreign license
#: line or address is a clean document.
KNOWN_LETTERS = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit a learned language stay; ``lang`` is kept as it is given."""
    model = with_least_fit(fit_languages(docs), docs)
    marked = fitting_languages(docs, model, F.struct("*").alias("__row"))
    return marked.filter((F.col("known") >= KNOWN_LETTERS) & (F.col("fit") > 0)) \
        .select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (3-word shingles, 3 bits)."""
    return drop_near_copies(docs, shingle=3, distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order."""
    return training_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard (0 to 7) and slot."""
    return shard_documents(docs, shards=8)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_path(spark, f"pipeline/{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
