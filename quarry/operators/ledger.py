"""F8 with memory: every completion is asked for once and written before it is used.

A ledger is a table of completions under one path, keyed by the SHA-256 of model, prompt,
context and query. ``complete`` settles its input, leaves out the prompts that the ledger has
(anti join), calls the completer once for each of the others, however many rows share it, and
appends what it said; the result joins the rows with the ledger. So a plan that is evaluated
again, a second plan with the same prompts, or a run after a crash asks for nothing that is
written already. Prompts are called and committed in slices of about ``SLICE`` prompts (by
digest), as a failed job keeps nothing of its own: what a failure costs is one slice. The
prompts are written by slice first, so that they are read once, however many slices there are.

Failed prompts are reported with their error but not kept: the next run asks for them again.
The model's name stands for the completer: a changed completer needs another name or path.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.generate import USAGE_FIELDS, complete, make_extractive_completer
from quarry.session import path_exists, settle, shared_path

SLICE = 10_000
#: Files of a slice's prompts, about.
SPREAD = 8
LEDGER_SCHEMA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("response", T.StringType()),
                              T.StructField("error", T.StringType()), T.StructField("model", T.StringType()), *USAGE_FIELDS])


@dataclass(frozen=True)
class Ledger:
    """The completions under ``path`` (a folder of the shared file system)."""

    path: str
    slice: int = SLICE

    @classmethod
    def shared(cls, spark: SparkSession, name: str = "completions") -> "Ledger":
        return cls(shared_path(spark, "quarry-ledger", name))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The kept completions, one for each digest (two plans at once may have asked for the same)."""
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], LEDGER_SCHEMA)
        return spark.read.schema(LEDGER_SCHEMA).parquet(self.path).dropDuplicates(["digest"])

    def complete(self, df: DataFrame, make_completer: Callable = make_extractive_completer, prompt: str = "prompt",
                 context: Optional[str] = "context", query: Optional[str] = "query_text",
                 model: str = "extractive-stub") -> DataFrame:
        """As ``generate.complete``: df with response, error, model and usage columns."""
        spark = df.sparkSession
        said = [c for c in dict.fromkeys((prompt, context, query)) if c is not None and c in df.columns]
        key = F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), *said), {"ignoreNullFields": "false"}), 256)
        asked = settle(df.withColumn("_digest", key), "asked")
        kept = self.rows(spark).select(F.col("digest").alias("_digest"))
        missing = asked.select("_digest").distinct().join(kept, "_digest", "left_anti").count()
        slices = -(-missing // self.slice)
        open_ = asked.select("_digest", *said).dropDuplicates(["_digest"]).join(kept, "_digest", "left_anti") \
            .withColumn("_slice", F.pmod(F.xxhash64("_digest"), F.lit(max(slices, 1))).cast("int"))
        # a folder for each slice, of several files: a slice reads its own prompts alone
        open_ = open_.withColumn("_salt", F.pmod(F.xxhash64("_digest", F.lit(1)), F.lit(SPREAD)))
        open_ = settle(open_.hint("rebalance", "_slice", "_salt").drop("_salt"), "open", "_slice")
        failed = None
        for i in range(slices):
            mine = open_.filter(F.col("_slice") == i).drop("_slice")
            done = complete(mine.repartition("_digest"), make_completer, prompt, context, query, model) \
                .select(F.col("_digest").alias("digest"), *[f.name for f in LEDGER_SCHEMA.fields[1:]])
            # one evaluation: errors are told apart after the answers are written
            fresh = settle(done, "completed")
            fresh.filter("error IS NULL").write.mode("append").parquet(self.path)
            errors = fresh.filter("error IS NOT NULL")
            if not errors.isEmpty():
                failed = errors if failed is None else failed.unionByName(errors)
        known = self.rows(spark) if failed is None else self.rows(spark).unionByName(failed)
        # settled: a plan that reads the ledger before and after it grew would take both reads for one
        return settle(asked.join(known.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")
                      .select(*df.columns, *[f.name for f in LEDGER_SCHEMA.fields[1:]]), "answered")
