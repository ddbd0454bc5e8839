import numpy as np
import xxhash

from quarry.llm.graph import components
from quarry.llm.simhash import fingerprint, keep_one, near_links, simhash_dedup

from . import frames


def roots(values):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def slow(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_ball_hashing_finds_all_links(spark):
    rng = np.random.default_rng(3)
    values = [0]
    for _ in range(40):
        v = int(rng.integers(0, 2 ** 63)) * 2 + int(rng.integers(0, 2))
        values.append(v)
        for _ in range(int(rng.integers(0, 6))):  # chains of 1 to 4 flips
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                v ^= 1 << int(bit)
            values.append(v)
    signed = [v - 2 ** 64 if v >= 2 ** 63 else v for v in set(values)]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    for r in links.collect():
        assert ((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= 3
    got = {r.node: r.root for r in components(links).collect()}
    want = roots(signed)
    assert {v: got.get(v, v) for v in signed} == want
    assert 10 < len(set(want.values())) < len(want)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 50))


def test_documents_by_brute_force(spark):
    docs = frames.awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = [slow(r.text) for r in rows]
    assert all(fingerprint((r.text or "").encode().lower().split()) == f for r, f in zip(rows, fps))
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    root = roots(signed)
    least = {}
    for r, f in zip(rows, signed):
        if r.doc_id is not None:
            least[root[f]] = min(least.get(root[f], r.doc_id), r.doc_id)
    frames.same(simhash_dedup(docs).collect(), [(r.doc_id, f, least.get(root[f])) for r, f in zip(rows, signed)])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root.values()))
    assert simhash_dedup(frames.empty(spark)).count() == 0 and keep_one(frames.empty(spark)).count() == 0
