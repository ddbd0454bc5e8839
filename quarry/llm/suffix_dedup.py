"""Suffix-array dedup on bytes.

A full suffix array of 100 TB cannot be moved, so the array is sparse: suffixes
start where a range of ``window``-byte windows starts (content-defined places, see
``windows``), and a suffix's leading tokens are the digests of the stretch that
all its windows share and of the stretch that they cover. The suffixes are
range-partitioned on these tokens by sampled splitters; each bucket sorts its own
by multikey quicksort and compares neighbours; runs that a bucket boundary cuts
are settled by comparing each bucket's last suffix with the next bucket's first.
The document is the splitters' last tie-breaker, so a text that a third of all
documents share spreads over many buckets.

Neighbours alike in both tokens repeat as a whole. Those alike only in the first
go on, one for each text, with a longer first token, up to the window itself.

Defined cases: a null text is empty; repeated rows are documents of their own and
match each other; a null doc_id is kept; an empty table gives no rows; other
columns are ignored. The remaining bytes may cut a character, so they are binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import windows as X
from quarry.llm.common import partitions, prepare, real_id, stage_by_key, text_buffer, with_key, write_table
from quarry.llm.substring_dedup import ROWS, scan, with_ranges

WINDOW = 200
#: Lengths of the first token, in bytes, before the window itself.
CORES = (100, 175)
#: Suffixes of a bucket, at most about.
BUCKET_ROWS = 1_000_000
SMALL = 512

_SORTED = pa.schema([("id", pa.int64()), ("th", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()),
                     ("core", pa.int64()), ("span", pa.int64()), ("bucket", pa.int32()),
                     ("repeats", pa.bool_()), ("lead", pa.bool_()), ("open", pa.bool_()),
                     ("run1", pa.bool_()), ("run9", pa.bool_()), ("core1", pa.bool_()), ("core9", pa.bool_()),
                     ("first", pa.bool_()), ("last", pa.bool_())])
_SORTED_DDL = ("id long, th binary, lo int, hi int, core long, span long, bucket int, repeats boolean, lead boolean, "
               "open boolean, run1 boolean, run9 boolean, core1 boolean, core9 boolean, first boolean, last boolean")


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of ``tokens`` (n x m, unsigned): three-way partition on one
    token at a time; only rows equal in it go on to the next token."""
    n, m = tokens.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == m:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort(tokens[part, d:].T[::-1])]
            continue
        key = tokens[part, d]
        a, b, c = key[0], key[(hi - lo) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        less, more = key < pivot, key > pivot
        i = lo + int(less.sum())
        j = hi - int(more.sum())
        order[lo:hi] = np.concatenate((part[less], part[~(less | more)], part[more]))
        todo += [(lo, i, d), (i, j, d + 1), (j, hi, d)]
    return order


def _sort_bucket(batches):
    from pyspark import TaskContext

    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    core = table["core"].to_numpy().view(np.uint64)
    span = table["span"].to_numpy().view(np.uint64)
    order = multikey_quicksort(np.stack((core, span), axis=1))
    core, span = core[order], span[order]
    n = len(order)
    new_core = np.ones(n, dtype=bool)
    new_core[1:] = core[1:] != core[:-1]
    lead = new_core.copy()
    lead[1:] |= span[1:] != span[:-1]
    run, group = np.cumsum(lead) - 1, np.cumsum(new_core) - 1
    repeats = np.bincount(run)[run] > 1
    opened = np.bincount(group[lead])[group] > 1
    at = np.arange(n)
    flags = [repeats, lead, opened, run == 0, run == run[-1], group == 0, group == group[-1], at == 0, at == n - 1]
    keep = np.flatnonzero(repeats | opened | flags[5] | flags[6])
    rows = table.take(pa.array(order[keep])).select(["id", "th", "lo", "hi", "core", "span"])
    out = pa.Table.from_arrays(
        [c.combine_chunks() for c in rows.columns]
        + [pa.array(np.full(len(keep), TaskContext.get().partitionId(), np.int32))]
        + [pa.array(f[keep]) for f in flags], schema=_SORTED)
    yield from out.to_batches(max_chunksize=20_000)


def compare_suffixes(rows: DataFrame, tag: str, buckets: int) -> DataFrame:
    """rows with ``repeats`` (same tokens as another suffix) and ``goes_on`` (first of
    its kind among suffixes alike in the first token alone)."""
    ordered = rows.withColumn("u", F.col("core").bitwiseXOR(F.lit(-2 ** 63)))
    ordered = ordered.withColumn("v", F.col("span").bitwiseXOR(F.lit(-2 ** 63))) \
        .repartitionByRange(buckets, "u", "v", "id", "th", "lo").drop("u", "v")
    seen = write_table(ordered.mapInArrow(_sort_bucket, _SORTED_DDL), tag)
    ends = seen.filter("first or last").groupBy("bucket").agg(
        *[F.max(F.when(F.col(e), F.col(c))).alias(f"{e}_{c}") for e in ("first", "last") for c in ("core", "span")])
    by = Window.orderBy("bucket")  # one row for each bucket

    def same(c, end, other, step):
        return F.coalesce(F.col(f"{end}_{c}") == step(f"{other}_{c}").over(by), F.lit(False))

    cuts = ends.select(
        "bucket", same("core", "first", "last", F.lag).alias("core_back"),
        same("span", "first", "last", F.lag).alias("span_back"),
        same("core", "last", "first", F.lead).alias("core_on"), same("span", "last", "first", F.lead).alias("span_on"))
    # cuts has a row for each bucket, and there are as many buckets as tasks
    return seen.join(F.broadcast(cuts), "bucket").select(
        "id", "th", "lo", "hi",
        (F.col("repeats") | (F.col("run1") & F.col("core_back") & F.col("span_back"))
         | (F.col("run9") & F.col("core_on") & F.col("span_on"))).alias("repeats"),
        (F.col("lead") & (F.col("open") | (F.col("core1") & F.col("core_back"))
                          | (F.col("core9") & F.col("core_on")))).alias("goes_on"))


def repeated_windows(staged: DataFrame, window: int, cores: tuple[int, ...]) -> DataFrame:
    """(id, th, lo, hi): all ranges of window starts whose windows repeat."""
    spark = staged.sparkSession
    size = staged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found, texts = None, staged
    for core in [*(c for c in cores if c < window), window]:
        expected = 2 * size // (window - core + 2)
        rows = texts.mapInArrow(scan(False, window, core), ROWS)
        seen = compare_suffixes(rows, f"suffixes{core}", max(partitions(spark), expected // BUCKET_ROWS))
        more = seen.filter("repeats").select("id", "th", "lo", "hi")
        found = more if found is None else found.unionByName(more)
        rest = seen.filter("goes_on")
        if core == window or rest.isEmpty():
            break
        texts = with_ranges(staged, rest, "inner")
    return found


def _remove(window: int):
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            out = []
            lists = batch.column("ranges")
            for k, id_ in enumerate(batch.column("id").to_pylist()):
                text = buf[off[k]:off[k + 1]]
                n, gone, runs = len(text), 0, 0
                if lists[k].is_valid and len(lists[k]):
                    spans = lists[k].values
                    mask = X.covered(n, spans.field("lo").to_numpy(), spans.field("hi").to_numpy(), window)
                    gone = int(mask.sum())
                    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    text = text[~mask]
                kept = text.tobytes()
                out.append((id_, n, gone, runs, kept, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)],
                                                 schema=schema)

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, cores: tuple[int, ...] = CORES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256: each text's
    bytes without those under a window that also starts elsewhere."""
    prepare(docs.sparkSession)
    staged = stage_by_key(with_key(docs), "bytes")
    found = repeated_windows(staged, window, cores)
    done = with_ranges(staged, found, "left").mapInArrow(
        _remove(window),
        "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return done.select(real_id(), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
