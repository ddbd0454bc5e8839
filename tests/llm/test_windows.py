import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import windows as X
from quarry.llm.simhash import keep_one
from quarry.llm.substring_dedup import doubling, substring_dedup
from quarry.llm.suffix_dedup import multikey_quicksort, suffix_dedup

from . import frames


def repeated(seqs, window):
    keys = lambda s: [s[i:i + window] if isinstance(s, bytes) else tuple(s[i:i + window])
                      for i in range(len(s) - window + 1)]
    count = Counter(k for s in seqs for k in keys(s))
    masks = []
    for s in seqs:
        mask = [False] * len(s)
        for i, k in enumerate(keys(s)):
            if count[k] > 1:
                mask[i:i + window] = [True] * window
        masks.append(mask)
    return masks


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=4), st.integers(2, 9))
def test_ranges_cover_every_window_once_and_cores_are_shared(texts, window):
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    for core in {max(1, window // 2), window}:
        t, lo, hi, c, s = X.ranges(X.byte_symbols(buf), off, window, core)
        seen = [(int(k), p) for k, a, b in zip(t, lo, hi) for p in range(a, b + 1)]
        assert sorted(seen) == [(k, p) for k, x in enumerate(texts) for p in range(len(x) - window + 1)]
        by_window = {}
        for k, a, b, digest in zip(t, lo, hi, c):
            for p in range(a, b + 1):
                by_window.setdefault(texts[k][p:p + window], set()).add(int(digest))
        assert all(len(v) == 1 for v in by_window.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2 ** 64 - 1), st.integers(0, 1)), max_size=1500))
def test_multikey_quicksort_sorts(rows):
    tokens = np.array(rows, dtype=np.uint64).reshape(len(rows), 3)
    assert [tuple(map(int, tokens[i])) for i in multikey_quicksort(tokens)] == sorted(rows)


def test_multikey_quicksort_many_equal():
    tokens = np.random.default_rng(0).integers(0, 3, (5000, 2)).astype(np.uint64)
    got = tokens[multikey_quicksort(tokens)]
    assert (got == np.array(sorted(map(tuple, tokens.tolist())), dtype=np.uint64)).all()


def test_doubling():
    assert doubling(9, 35) == [9, 18, 35] and doubling(40, 35) == [35]


def test_substring_dedup_brute_force(spark):
    docs = frames.awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    seqs = [(r.text or "").encode().split() for r in rows]
    want = []
    for r, s, mask in zip(rows, seqs, repeated(seqs, 35)):
        kept = b" ".join(w for w, m in zip(s, mask) if not m)
        want.append((r.doc_id, len(s), sum(mask), kept.decode(), hashlib.sha256(kept).hexdigest()))
    assert any(w[2] for w in want)
    frames.same(substring_dedup(docs).collect(), want)
    assert substring_dedup(frames.empty(spark)).count() == 0


def test_suffix_dedup_brute_force(spark):
    docs = frames.awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    seqs = [(r.text or "").encode() for r in rows]
    want = []
    for r, s, mask in zip(rows, seqs, repeated(seqs, 200)):
        kept = bytes(b for b, m in zip(s, mask) if not m)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        want.append((r.doc_id, len(s), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    assert any(w[2] for w in want)
    frames.same(suffix_dedup(docs).drop("kept").collect(), want)
    assert suffix_dedup(frames.empty(spark)).count() == 0


def test_texts_of_one_id_with_equal_short_hashes(spark):
    """A null id and an equal 32-bit hash do not make two texts one."""
    shared = frames.words(30, 60)
    longer = F.concat(F.lit("a"), F.col("id"), F.lit(" " + shared))
    shorter = F.concat(F.lit("b"), F.col("id"), F.lit(" alone"))
    ids = spark.range(300_000)
    pair = ids.select(longer.alias("x"), F.hash(longer).alias("h")).join(
        ids.select(shorter.alias("y"), F.hash(shorter).alias("h")), "h").orderBy("x").first()
    docs = spark.createDataFrame([(None, pair.x), (None, pair.y), (3, shared + " end")], "doc_id long, text string")
    for run, size, sep in ((substring_dedup, 35, b" "), (suffix_dedup, 200, None)):
        seqs = [r.text.encode().split() if sep else r.text.encode() for r in docs.collect()]
        kept = [sep.join(w for w, m in zip(s, mask) if not m) if sep else bytes(b for b, m in zip(s, mask) if not m)
                for s, mask in zip(seqs, repeated(seqs, size))]
        want = sorted(hashlib.sha256(k).hexdigest() for k in kept)
        assert sorted(r.kept_sha256 for r in run(docs).collect()) == want
    assert sorted(r.text for r in keep_one(docs.filter("doc_id is null")).collect()) == sorted([pair.x, pair.y])


def test_suffix_runs_cut_by_bucket_boundaries(spark):
    """Many copies over many buckets: equal suffixes straddle the boundaries."""
    text = frames.words(20, 120)
    docs = spark.createDataFrame([(i, text if i % 2 else frames.words(100 + i, 60)) for i in range(40)],
                                 "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all((removed == size) == bool(i % 2) for i, (size, removed) in got.items())
    assert all(removed == 0 for i, (_, removed) in got.items() if i % 2 == 0)
