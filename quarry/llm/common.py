"""Helpers shared by the corpus operators: documents, keys, shared tables, Arrow text access."""

from __future__ import annotations

import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, ship_package, shared_path

#: Arrow batches hold whole documents, so their row count is kept low.
ARROW_ROWS = 1000
#: Fixed value: words are runs of anything but these ASCII white-space bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Shared folder, package on the workers, and small Arrow batches for text."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A whole table of the data folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_digest(text):
    """Half of the text's SHA-256: 128 bits, as any number of texts may share an id (or have none)."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, text): th tells rows apart that share a doc_id, so that (id, th)
    names one text. Null texts become empty; a null id becomes the smallest long
    inside the operators and null again in results (see ``real_id``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text.alias("text")) \
        .select("id", text_digest(F.col("text")).alias("th"), "text")


NULL_ID = -(2 ** 63)


def real_id(col: str = "id"):
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col)).alias("doc_id")


def stage_by_key(keyed: DataFrame, tag: str) -> DataFrame:
    """Write (id, th, text) once, bucketed by the key, so that every later join
    of the texts with per-document rows leaves the texts where they are."""
    spark = keyed.sparkSession
    n = partitions(spark)
    name = f"llm_{tag}_{uuid.uuid4().hex}"
    path = shared_path(spark, "llm", name)
    keyed.repartition(n, "id", "th").write.format("parquet").option("path", path) \
        .option("compression", "zstd").bucketBy(n, "id", "th").saveAsTable(name)
    return spark.table(name)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf, off.astype(np.int64)


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text; a longer text is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def sum_pieces(rows: DataFrame) -> DataFrame:
    """(piece int, weight double, data binary of float32) -> the sums by piece, data as
    float64. A task streams its rows through one accumulator for each piece."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, weight, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "weight", "data"))):
                part = np.frombuffer(data, dtype=np.float32)
                have = sums.setdefault(piece, [0.0, np.zeros(len(part))])
                have[0] += weight
                have[1] += part
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([sums[k][0] for k in keys], pa.float64()),
                 pa.array([sums[k][1].tobytes() for k in keys], pa.binary())], names=["piece", "weight", "data"])

    return rows.repartition("piece").mapInArrow(run, "piece int, weight double, data binary")


def piece_rows(array: np.ndarray, pieces: int, weight: float) -> pa.RecordBatch:
    """An array cut into pieces, as rows for ``sum_pieces``."""
    parts = np.array_split(array.astype(np.float32), pieces)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(pieces), pa.int32()), pa.array([float(weight)] * pieces, pa.float64()),
         pa.array([p.tobytes() for p in parts], pa.binary())], names=["piece", "weight", "data"])
