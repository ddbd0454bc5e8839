"""Registered queries of the corpus operators, with DuckDB SQL where SQL can say it.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe
from quarry.llm import oracle as O
from quarry.llm.ann import nearest
from quarry.llm.common import read_documents
from quarry.llm.decontaminate import leaks
from quarry.llm.fill_in_middle import fill_in_middle, restore
from quarry.llm.license_scan import license_scan
from quarry.llm.lm import lm_scores
from quarry.llm.mixing import schedule
from quarry.llm.quality import classify
from quarry.llm.secrets import find_secrets, span_list
from quarry.llm.simhash import simhash_dedup
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.suffix_dedup import suffix_dedup
from quarry.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: Optional[str] = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_substring_dedup", O.SUBSTRING_DEDUP)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_documents(spark, sf_dir)).drop("kept_text")


@register("op4_suffix_dedup", O.SUFFIX_DEDUP)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_documents(spark, sf_dir)).drop("kept")


@register("op2_mixing", O.MIXING)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@register("op7_secrets", O.SECRETS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)

    def count(kind: int, name: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(name)

    counts = [count(0, "n_assign"), count(1, "n_access"), count(2, "n_hex")]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col("secret_spans")).alias("spans"))


@register("op10_license")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_documents(spark, sf_dir))


@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_dedup(read_documents(spark, sf_dir))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op9_ann")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_documents(spark, sf_dir, "embeddings"))


@register("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"),
                    columns=["doc_id"])
    return done.select("row.doc_id", "host", "path", "evidence", "host_rate", "path_rate", "p_bad", "keep")


@register("op5_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_documents(spark, sf_dir))


@register("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


@register("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_documents(spark, sf_dir, "embeddings"))


@register("op12_fill_in_middle", O.FILL_IN_MIDDLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(read_documents(spark, sf_dir)))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       *(F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256") for c in ("output", "restored")))


@register("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ranks = public.path("byte_bpe_50k.tiktoken")
    done = byte_bpe.decode(byte_bpe.encode(read_documents(spark, sf_dir), ranks, public.PATTERN), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
