"""Substring dedup on words by level-wise doubling.

Windows of ``window`` words are judged through the runs they contain. The first
level counts short runs (``first`` words) over the whole corpus; windows whose
run repeats there are extended to runs of twice that length, and so on until the
runs are the windows themselves or no candidate survives. At each level a range
of windows is settled as a whole where its full text repeats (see ``windows``).

All counts are grouped aggregations with map-side combine, so a passage that a
third of all documents share is one row per task; the joins back to the rows
have one row per key on the other side, so the planner may split a hot key. Texts are bucketed once by
document; later levels join them without moving them.

Defined cases: a null text has no words; repeated rows are documents of their
own and match each other; a null doc_id is kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as X
from quarry.llm.common import chunks, prepare, real_id, stage_by_key, text_buffer, with_key, write_table

WINDOW, FIRST = 35, 9
CHUNK = 1 << 20
ROWS = "id long, th binary, lo int, hi int, core long, span long"
_ROWS = pa.schema([("id", pa.int64()), ("th", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()),
                   ("core", pa.int64()), ("span", pa.int64())])


def doubling(first: int, window: int) -> list[int]:
    """first, twice that, ... and at last the window."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def limits(batch: pa.RecordBatch, i: int, j: int):
    """The (text, lo, hi) limits of rows i..j, from the list column ``ranges``."""
    if "ranges" not in batch.schema.names:
        return None
    column = batch.column("ranges").slice(i, j - i)
    counts = np.asarray([0 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
    flat = column.flatten()
    return (np.repeat(np.arange(j - i), counts), flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64),
            flat.field("hi").to_numpy(zero_copy_only=False).astype(np.int64))


def scan(words: bool, window: int, core: int):
    """mapInArrow function: the ranges of each text's windows."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            ids, ths = batch.column("id").to_numpy(zero_copy_only=False), batch.column("th")
            for i, j in chunks(off, CHUNK if words else CHUNK // 2):
                part, offsets = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                if words:
                    starts, ends, offsets = X.word_spans(part, offsets)
                    symbols = X.word_symbols(part, starts, ends)
                else:
                    symbols = X.byte_symbols(part)
                t, lo, hi, c, s = X.ranges(symbols, offsets, window, core, limits(batch, i, j))
                if len(t):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i:j][t]), ths.take(pa.array(i + t)), pa.array(lo.astype(np.int32)),
                         pa.array(hi.astype(np.int32)), pa.array(c.view(np.int64)), pa.array(s.view(np.int64))],
                        schema=_ROWS)

    return run


def with_ranges(staged: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Texts with the list of their (lo, hi) rows; a document has at most as many as words."""
    lists = rows.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    return staged.join(lists, ["id", "th"], how)


def repeated_windows(staged: DataFrame, window: int, first: int) -> DataFrame:
    """(id, th, lo, hi): all ranges of window starts whose windows repeat."""
    found, texts = [], staged
    for core in doubling(first, window):
        rows = texts.mapInArrow(scan(True, window, core), ROWS)
        cores = rows.groupBy("core").agg(F.count("*").alias("n"), (F.min("span") != F.max("span")).alias("open"))
        hits = write_table(rows.join(cores.filter("n > 1").drop("n"), "core"), f"hits{core}")
        found.append(hits.filter("not open").select("id", "th", "lo", "hi"))
        if core == window:
            break
        spans = write_table(hits.filter("open").groupBy("core", "span").agg(
            F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "th", "lo", "hi")]), f"spans{core}")
        found.append(hits.filter("open").join(spans.filter("n > 1"), ["core", "span"], "left_semi")
                     .select("id", "th", "lo", "hi"))
        if spans.isEmpty():
            break
        texts = with_ranges(staged, spans, "inner")  # one occurrence of each text that is still open
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _remove(window: int):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            raw = buf.tobytes()
            out = []
            lists = batch.column("ranges")
            for k, id_ in enumerate(batch.column("id").to_pylist()):
                words = raw[off[k]:off[k + 1]].split()
                n = len(words)
                if lists[k].is_valid and len(lists[k]):
                    spans = lists[k].values
                    gone = X.covered(n, spans.field("lo").to_numpy(), spans.field("hi").to_numpy(), window)
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                out.append((id_, n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)],
                                                 schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256: each text without the
    words under a window that also starts elsewhere."""
    prepare(docs.sparkSession)
    staged = stage_by_key(with_key(docs), "words")
    found = repeated_windows(staged, window, first)
    done = with_ranges(staged, found, "left").mapInArrow(
        _remove(window), "id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return done.select(real_id(), "n_words", "n_removed", "kept_text", "kept_sha256")
