"""A training-corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.llm.common import prepare, read_documents, write_table  # noqa: E402
from quarry.llm.decontaminate import drop_leaks  # noqa: E402
from quarry.llm.mixing import mix  # noqa: E402
from quarry.llm.quality import keep_good  # noqa: E402
from quarry.llm.secrets import find_secrets, redact  # noqa: E402
from quarry.llm.simhash import keep_one  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (low quality or toxic ones go)."""
    prepare(spark)
    return keep_good(docs, read_documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each SimHash component."""
    prepare(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return drop_leaks(docs, read_documents(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    prepare(spark)
    done = redact(find_secrets(docs))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in done.columns else done


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources in its global order, with copy, taken and virtual_finish."""
    prepare(spark)
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("mixing", mixing)]

#: The classifier, the fingerprints and the latent space are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
