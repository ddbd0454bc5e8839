"""Language model, quality classifier and decontamination."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D
from quarry.llm import lm
from quarry.llm.quality import classify, keep_good

from . import frames

SF = "/root/testdata/sf0.001"


def base_scores(rows):
    token = lambda r: [*(r.text or "").encode().lower().split(), None]
    held = lambda r: zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 1
    c = Counter(t for r in rows if not held(r) for t in token(r))
    n, v = sum(c.values()), len(c)
    return [(r.doc_id, held(r), len(token(r)), sum(c[t] > 0 for t in token(r)), n,
             sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in token(r))) for r in rows]


def test_lm_counts_by_brute_force_and_held_out_gain(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), frames.awkward(spark)):
        rows = docs.select("doc_id", "text").collect()
        got = lm.lm_scores(docs).collect()
        want = base_scores(rows)
        rounded = lambda x: (*x[:5], round(x[5], 6))
        frames.same([rounded(r) for r in got], [rounded(w) for w in want])
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        if len(rows) > 50:
            held = [r for r in got if r.held_out]
            assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.lm_scores(frames.empty(spark)).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    model = lm.Model(np.full(300, 1 / 300))
    model.bias = rng.standard_normal(300).astype(np.float32)
    norm = model.normalisers()
    p = np.exp(model.context @ model.target.T + model.bias - norm[:, None])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    done = classify(docs, labels.filter("doc_id % 4 != 1"), columns=["doc_id"]) \
        .select("row.doc_id", "keep", "host_rate", "path_rate")
    assert done.count() == docs.count()
    held = done.join(labels.filter("doc_id % 4 = 1"), "doc_id").collect()
    clean = [r.keep for r in held if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in held if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.3 * len(junk)


def test_quality_awkward(spark):
    docs = frames.awkward(spark)
    none = spark.createDataFrame([(1, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = keep_good(docs, none)  # without labels of both classes all is kept
    assert kept.columns == docs.columns and kept.count() == docs.count()
    both = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert classify(docs, both).count() == docs.count()
    assert classify(frames.empty(spark), both).count() == 0


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)).tolist(), rng.integers(0, 6, rng.integers(0, 120)).tolist()
        assert D.lcs(a, b) == slow(a, b)


def test_singular_vectors_span_the_leading_space():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((D.FEATURES, 10)))[0]
    a = rng.standard_normal((400, 10)) * np.linspace(50, 10, 10) @ basis.T
    random = np.random.default_rng(D.SEED).standard_normal((D.FEATURES, D.RANK)).astype(np.float32)
    vectors, sigma = D.singular_vectors(a.T @ (a @ random))
    exact = np.linalg.svd(a, compute_uv=False)[:10]
    assert np.allclose(sigma[:10], exact, rtol=1e-3)
    assert np.allclose(np.linalg.norm(basis.T @ vectors[:, :10], axis=0), 1, atol=1e-3)


def test_leaks_by_brute_force_and_paraphrase(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy(F.length("text").desc()).first()
    words = item.text.split()
    changed = [("swapped" if i % 6 == 3 and i < len(words) - 6 else w) for i, w in enumerate(words)]
    odd = docs.orderBy("doc_id").first().text
    more = spark.createDataFrame([(9001, odd + " " + " ".join(changed) + " " + odd), (9002, None), (9003, ""),
                                  (None, item.text), (9004, " ".join(sorted(words)))], "doc_id long, text string")
    all_docs = docs.unionByName(more)
    plain = lambda s: b" " + b" ".join(D._TABLE[np.frombuffer((s or "").encode(), np.uint8)].tobytes().split()) + b" "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in all_docs.collect() for t in [plain(r.text)] for i, s in items if s in t}
    got = {(r.doc_id, r.item_id) for r in D.leaks(all_docs, bench).collect()}
    assert want <= got and (9001, item.item_id) in got and (None, item.item_id) in got
    assert not [x for x in got - want if x[0] != 9001]
    kept = D.drop_leaks(all_docs, bench)
    dirty = {d for d, _ in got}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in all_docs.collect()} - dirty


def test_paraphrases_pass_the_gate(spark):
    """Items of which 0.55 or 0.6 of the words are left with the answer, or 0.7 without it, at any window offset."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng = np.random.default_rng(3)
    pool = " ".join(r.text or "" for r in docs.orderBy("doc_id").limit(40).collect()).split()
    items = [(r.item_id, r.text.split()) for r in bench.orderBy("item_id").collect() if len((r.text or "").split()) >= 20]
    rows, want = [], set()
    for k, (item, words) in enumerate(items[:20]):
        for share, answer in ((0.55, True), (0.6, True), (0.7, False)):
            n = len(words)
            lost = n - math.ceil(share * n - 1e-9)
            body, tail = rng.permutation(n - D.ANSWER_WORDS), n - D.ANSWER_WORDS + rng.permutation(D.ANSWER_WORDS)
            gone = set(body[:lost]) if answer else {*tail[:3], *body[:lost - 3]}
            text = [f"zz{k}x{i}" if i in gone else w for i, w in enumerate(words)]
            id_ = 20_000 + len(rows)
            around = rng.choice(pool, 80).tolist()
            cut = int(rng.integers(0, 60))
            rows.append((id_, " ".join(around[:cut] + text + around[cut:])))
            want.add((id_, item))
    assert len(want) == 60
    more = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in D.leaks(more, bench).collect()}
    assert not want - got
    assert not {d for d, _ in want} & {r.doc_id for r in D.drop_leaks(more, bench).collect()}


def test_leaks_awkward(spark):
    docs = frames.awkward(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, frames.words(1, 60)), (4, frames.words(1, 60)),
                                   (None, frames.words(5, 50))], "item_id long, text string")
    got = D.leaks(docs, bench).select("doc_id", "item_id").collect()
    frames.same(got, [(1, 4), (2, 4), (9, 4), (6, None)])
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert D.leaks(frames.empty(spark), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0


def test_unions_and_sums_by_brute_force():
    rng = np.random.default_rng(3)
    feature = rng.integers(0, D.FEATURES, 3000).astype(np.uint16)
    start = rng.integers(0, 2900, 400)
    end = start + rng.integers(1, 101, 400)
    got = D.Unions(feature).of(start, end)
    assert all((g == np.bitwise_or.reduce(D._BITS[feature[a:b]], axis=0)).all() for g, a, b in zip(got, start, end))
    table, first = rng.standard_normal((D.FEATURES, D.RANK)).astype(np.float32), np.arange(0, 3000, 37)
    assert np.array_equal(D._sums(table, feature, first), np.add.reduceat(table[feature], first, axis=0))
    sums = D._running_sums(table, feature, np.empty((3001, D.RANK), np.float32))
    assert not sums[0].any() and np.array_equal(sums[1:], np.cumsum(table[feature], axis=0))


def test_frequencies_count_a_passage_once():
    import pyarrow as pa

    texts = [" ".join(f"w{i % 7}" for i in range(90)), "", "w1 W1 w1", " \n", "w1 w2"]
    batch = next(D._frequencies([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    df = np.frombuffer(batch.column("data")[0].as_py(), dtype=np.float32)
    assert batch.column("weight")[0].as_py() == 5  # three passages, and one each
    one = lambda w: int(D.word_features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    assert [df[one(b"w%d" % i)] for i in range(4)] == [3, 5, 4, 3]


def test_common_words_make_no_candidates():
    """Of the windows of words that an item shares in part, few come to the checks; one that holds it does."""
    rng = np.random.default_rng(4)
    word = lambda i: "v" + "".join(chr(97 + int(i) // 26 ** k % 26) for k in range(3))
    item = " ".join(word(i) for i in rng.permutation(300)[:53])
    text = " ".join(word(i) for i in rng.integers(0, 300, 20_000))
    latent = np.abs(rng.standard_normal((D.FEATURES, D.RANK))).astype(np.float32)  # everything is alike
    items = D.Items([(1, item)], latent)

    def found(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        feature, words, _, _ = D.word_features(buf, np.array([0, len(buf)]))
        return items.candidates(feature, words)

    windows = 20_000 // (D.width_of(53) // D.STEPS)
    assert len(found(text)) <= 0.01 * windows
    assert found(f"{text} {item} {text}")
