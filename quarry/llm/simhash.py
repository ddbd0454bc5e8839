"""SimHash near-dedup with meet-in-the-middle ball hashing.

Fingerprints at most three bits apart meet at a point between them. An odd number
of differing bits changes the parity of a fingerprint's bit count, so for three
bits one side is even and one odd: the odd side emits its ball of radius one, the
even side also the points two flips away. Of any three places two lie in the same
half of the 64 bits, so the two flips need only be in the same half. Then

* 1 bit apart: the even one is in the odd one's ball;
* 2 bits apart: both emit the points in the middle, one flip from each;
* 3 bits apart: the even one flips two bits of a half, the odd one the third.

Distinct fingerprints alone are hashed. Points are shuffled as packed arrays by
hash bucket; in a bucket equal points are found by sorting, each point's group is
verified by its bit distances and linked as a star around a member with fewest
flips (one or none, so every link is within the radius); links that a star leaves
out are between nodes that it connects. A point has at most 2,081 fingerprints
within two flips, so no group grows with the data. Components come from
alternating star steps; copies share the node of their fingerprint.

Defined cases: a null text and one without words have fingerprint zero and are
linked like any other; repeated rows share a component; a null doc_id never names
a component unless there is no other id in it; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, partitions, prepare, real_id, text_buffer, text_digest, with_key, write_table
from quarry.llm.graph import components
from quarry.llm.windows import mix

SHINGLE, MAX_BITS = 3, 3
SEED = 42
U = np.uint64


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """64-bit majority of the XXH64 of all shingles."""
    if not words:
        return 0
    h, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= size:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    values = np.array([h(joined[s:e - 1], seed) for s, e in zip(starts, ends[size - 1:])], dtype=U)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(U)[0])


def _fingerprints(size: int):
    schema = pa.schema([("id", pa.int64()), ("th", pa.binary()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            raw = buf.tobytes()
            out = [fingerprint(raw[s:e].lower().split(), size) for s, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(np.array(out, dtype=U).view(np.int64))], schema=schema)

    return run


def _balls() -> tuple[np.ndarray, np.ndarray]:
    """Flip masks of the odd and of the even side."""
    one = U(1) << np.arange(64, dtype=U)
    near = np.concatenate((np.zeros(1, U), one))
    half = [one[i] | one[j] for k in (0, 32) for i in range(k, k + 32) for j in range(i + 1, k + 32)]
    return near, np.concatenate((near, np.array(half, dtype=U)))


_POINTS = pa.schema([("bucket", pa.int32()), ("points", pa.binary()), ("owners", pa.binary())])


def _emit(buckets: int):
    """Points around each fingerprint, packed by bucket: a point and its owner's flip number."""

    def run(batches):
        odd, even = _balls()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(U)
            for i in range(0, len(fps), 1000):
                part = fps[i:i + 1000]
                parity = np.bitwise_count(part) & 1
                points, flips = [], []
                for side, masks in ((1, odd), (0, even)):
                    own = part[parity == side]
                    points.append((own[:, None] ^ masks[None, :]).ravel())
                    flips.append(np.tile(np.arange(len(masks), dtype=np.uint16), len(own)))
                point, flip = np.concatenate(points), np.concatenate(flips)
                bucket = (mix(point) % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                point, flip, bucket = point[order], flip[order], bucket[order]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cut[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), pa.array([point[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                     pa.array([flip[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], schema=_POINTS)

    return run


def _meet(max_bits: int):
    """Links of one bucket: stars around the fewest-flip member of each point."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        _, masks = _balls()  # the odd side's masks come first in it
        point = np.frombuffer(b"".join(table["points"].to_pylist()), dtype=U)
        flip = np.frombuffer(b"".join(table["owners"].to_pylist()), dtype=np.uint16)
        order = np.argsort(point, kind="stable")
        point = point[order]
        same = np.zeros(len(point) + 1, dtype=bool)
        same[1:-1] = point[1:] == point[:-1]
        keep = np.flatnonzero(same[1:] | same[:-1])
        point, flip = point[keep], flip[order[keep]]
        if not len(point):
            return schema.empty_table()
        owner = point ^ masks[flip]
        rank = (flip > 0).astype(np.int64) + (flip > 64)
        order = np.lexsort((owner, rank, point))
        point, owner, rank = point[order], owner[order], rank[order]
        group = np.flatnonzero(np.append(True, point[1:] != point[:-1]))
        center = np.repeat(owner[group], np.diff(np.append(group, len(point))))
        near = (center != owner) & (np.bitwise_count(center ^ owner) <= max_bits)
        pairs = np.unique(np.stack((np.minimum(center, owner)[near], np.maximum(center, owner)[near])), axis=1)
        return pa.Table.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], schema=schema)

    return run


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within three bits."""
    spark = fps.sparkSession
    buckets = max(partitions(spark), int(fps.count() * 561 // 2_000_000) + 1)
    points = fps.select("fp").mapInArrow(_emit(buckets), "bucket int, points binary, owners binary")
    return points.groupBy("bucket").applyInArrow(_meet(MAX_BITS), "a long, b long").distinct()


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) of all documents and (fp, root) of all fingerprints."""
    prepare(docs.sparkSession)
    rows = write_table(with_key(docs).mapInArrow(_fingerprints(size), "id long, th binary, fp long"), "fingerprints")
    fps = rows.select("fp").distinct()
    parts = components(near_links(fps))
    named = fps.join(parts, fps.fp == parts.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows, write_table(named, "classes")


def simhash_dedup(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed), component_id (smallest doc_id reachable)."""
    rows, named = _classes(docs, size)
    least = rows.groupBy("fp").agg(F.min(real_id()).alias("least")).join(named, "fp")
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(roots, "root").select("fp", "component_id")
    return rows.join(names, "fp").select(real_id(), "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with its own columns."""
    rows, named = _classes(docs, size)
    first = F.min(F.struct((F.col("id") == NULL_ID).alias("unknown"), "id", "th")).alias("first")
    firsts = rows.groupBy("fp").agg(first).join(named, "fp").groupBy("root").agg(F.min("first").alias("first"))
    names = firsts.select(F.col("first.id").alias("id"), F.col("first.th").alias("th"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    keyed = docs.select(key.alias("id"), text_digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), row)
    return keyed.join(names, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).select("row.*")
