"""A4-A7 on disk: snapshots, crashes, layers, streamed updates, selective search, pruned fetch."""

import uuid

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quarry.config import RagConfig
from quarry.operators import sparse
from quarry.operators.chunk import chunk
from quarry.operators.fetch import around, fetch_places, hit_nodes, node_places, with_windows
from quarry.operators.sparse import Selection, bm25_top_k, expected_pairs, keyword_top_k, query_term_idf, selective_bm25_top_k
from quarry.session import list_path
from quarry.sources import index_store
from quarry.sources.index_store import Layer, Manifest, load_index, read_manifest, upsert_index

SF = "/root/testdata/sf0.001"
CFG = RagConfig().but(layout={"partitions": 8})


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def state(idx):
    """All tables of an index, as sorted rows."""
    tables = (idx.nodes.select("node_id", "doc_id", "pos", "text"), idx.postings.select("term", "node_id", "doc_id", "tf", "dl"),
              idx.vectors.select("node_id", F.col("vector").cast("string")), idx.df.select("term", "df"),
              idx.stats.select("n", "avgdl", "total"), idx.forward.select("node_id", F.col("terms").cast("string"), "dl"))
    return [sorted(map(tuple, t.collect()), key=repr) for t in tables]


def built(spark, scratch, rows, cfg=CFG):
    path = f"{scratch}/{uuid.uuid4().hex[:8]}"
    upsert_index(spark, frame(spark, rows), path, cfg)
    return path


ROWS = [(i, f"Alpha {i} runs. Beta {i % 3} sleeps now. Gamma word{i}.") for i in range(24)]
NEXT = [(i, "Delta came anew. Alpha left." if i == 5 else "" if i == 6 else t) for i, t in ROWS if i != 9] + [(100, "A new one.")]


def test_reader_keeps_its_snapshot(spark, scratch):
    path = built(spark, scratch, ROWS)
    reader = load_index(spark, path, CFG)
    before = state(reader)
    upsert_index(spark, frame(spark, NEXT), path, CFG)
    assert state(reader) == before
    assert state(load_index(spark, path, CFG)) == state(load_index(spark, built(spark, scratch, NEXT), CFG))


def test_a_crash_at_any_write_leaves_a_readable_index(spark, scratch, monkeypatch):
    path = built(spark, scratch, ROWS[:8])
    want = state(load_index(spark, built(spark, scratch, NEXT[:8]), CFG))
    before = state(load_index(spark, path, CFG))
    write, replace = DataFrameWriter.parquet, index_store.replace_file
    left = [0]

    def count(fn):
        def run(*args, **kwargs):
            if left[0] == 0:
                raise OSError("the disk is gone")
            left[0] -= 1
            return fn(*args, **kwargs)

        return run

    monkeypatch.setattr(DataFrameWriter, "parquet", count(write))
    monkeypatch.setattr(index_store, "replace_file", count(replace))
    crashes, n = 0, 0
    while True:
        left[0] = n
        try:
            upsert_index(spark, frame(spark, NEXT[:8]), path, CFG)
            break
        except OSError:
            crashes += 1
            n += 1 if n < 3 else 3  # each of the first writes, then every third and the manifest
            assert state(load_index(spark, path, CFG)) == before
    left[0] = -1
    assert crashes >= 5 and state(load_index(spark, path, CFG)) == want
    assert not any(upsert_index(spark, frame(spark, NEXT[:8]), path, CFG).values())


def test_versions_no_longer_named_are_deleted(spark, scratch):
    path = built(spark, scratch, ROWS[:4])
    for i in range(3):
        upsert_index(spark, frame(spark, [(0, f"Version {i}."), *ROWS[1:4]]), path, CFG)
    manifest = read_manifest(spark, path)
    named = {f"v={v}" for v in (*manifest.named(), *manifest.before)}
    for table in ("docs", "nodes", "postings", "df"):
        assert {n for n in list_path(spark, f"{path}/{table}") if n.startswith("v=")} <= named
    assert "window" not in load_index(spark, path, CFG).nodes.columns


def test_repeated_ids_and_nulls(spark, scratch):
    rows = [(1, "One here."), (1, "Other there."), (None, "No id."), (2, None), (3, "Three.")]
    path = built(spark, scratch, rows)
    assert upsert_index(spark, frame(spark, rows), path, CFG) == {"changed": 0, "removed": 0, "touched_parts": 0}
    less = [(1, "One here."), (None, "No id now."), (2, "Two."), (3, "Three.")]
    upsert_index(spark, frame(spark, less), path, CFG)
    assert state(load_index(spark, path, CFG)) == state(load_index(spark, built(spark, scratch, less), CFG))


def test_layers_stay_few(spark, scratch):
    path, rows = built(spark, scratch, ROWS), list(ROWS)
    for i in range(3):
        rows += [(200 + i, f"Added {i}. Alpha again.")]
        upsert_index(spark, frame(spark, rows), path, CFG)
    layers = read_manifest(spark, path).layers
    assert layers[0].v == 1 and layers[0].docs == len(ROWS) and len(layers) <= 3  # the first was never written again
    assert state(load_index(spark, path, CFG)) == state(load_index(spark, built(spark, scratch, rows), CFG))


def test_manifest_merges_by_size():
    m = Manifest(3, 4, 64, [Layer(1, 100, [0, 1, 2, 3]), Layer(2, 3, [1]), Layer(3, 2, [2])])
    assert m.mergeable(1) == [] and m.mergeable(2) == [3, 2] and m.mergeable(60) == [3, 2, 1]
    after = m.after(Layer(4, 2, [1, 2]), [1, 2], [3])
    assert [(x.v, x.dead) for x in after.layers] == [(1, [1, 2]), (4, [])] and after.before == [1, 2, 3]
    assert Manifest.of(after.text()) == after


def test_stream_takes_the_last_delivery(spark, scratch):
    from quarry.streaming.ingest import DOC_SCHEMA, stream_index, upsert_batch

    def arrive(rows):
        spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(f"{scratch}/in")

    run = lambda: stream_index(spark, f"{scratch}/in", f"{scratch}/idx", f"{scratch}/ckpt", CFG)
    arrive(ROWS[:6])
    arrive([(0, "Replaced in the same batch."), (7, "Seven.")])  # two files, one micro-batch
    run()
    arrive([(1, "Changed later."), ROWS[2], (50, "New.")])
    idx = run()
    last = dict(ROWS[:6]) | {0: "Replaced in the same batch.", 7: "Seven.", 1: "Changed later.", 50: "New."}
    want = state(load_index(spark, built(spark, scratch, sorted(last.items())), CFG))
    assert state(idx) == want
    batch = read_manifest(spark, f"{scratch}/idx").batches["documents"]
    again = spark.createDataFrame([(1, "Not this.", None, "f")], "doc_id long, text string, file_modification_time timestamp, file_path string")
    assert upsert_batch(spark, again, batch, f"{scratch}/idx", CFG, "documents") is None  # replayed
    assert state(load_index(spark, f"{scratch}/idx", CFG)) == want
    upsert_batch(spark, again, batch + 1, f"{scratch}/idx", CFG, "documents")
    assert load_index(spark, f"{scratch}/idx", CFG).nodes.filter("doc_id = 1").first().text == "Not this."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """An index of several layers, some of whose postings were replaced."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path_factory.mktemp("corpus") / "idx")
    upsert_index(spark, docs.filter("doc_id % 10 > 0"), path, CFG)
    upsert_index(spark, docs.withColumn("text", F.when(F.col("doc_id").isin(1, 11), F.concat("text", F.lit(" Zzyzx once more.")))
                                        .otherwise(F.col("text"))), path, CFG)
    assert any(x.dead for x in read_manifest(spark, path).layers)
    return load_index(spark, path, CFG)


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "node_id", "score", "rank").collect()))


def test_selective_search_equals_the_scan(spark, corpus):
    common = [r.term for r in corpus.df.orderBy(F.desc("df"), "term").limit(8).collect()]
    rare = [r.term for r in corpus.df.filter("df <= 3").orderBy("term").limit(8).collect()]
    texts = [" ".join(common[:2]), common[0], " ".join(rare[:3]), f"{common[1]} {rare[4]} {rare[5]}", "notthere", "",
             " ".join(common), "zzyzx", f"{rare[0]} {rare[0]} notthere"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    for queries, k in ((q, 1), (q, 7), (bench, 5)):
        want = rows_of(bm25_top_k(queries, corpus, k))
        assert rows_of(selective_bm25_top_k(queries, corpus, k)) == want
        assert rows_of(keyword_top_k(queries, corpus, k)) == want


def test_rare_terms_read_few_postings(spark, corpus):
    rare = [r.term for r in corpus.df.filter("df <= 2").orderBy(F.desc("term")).limit(2).collect()]
    q = spark.createDataFrame([(1, " ".join(rare))], "query_id long, text string")
    found = query_term_idf(q, corpus)
    chosen = Selection(found, corpus, 5, "query_id", 1.5, 0.75)
    whole = corpus.blocks.agg(F.sum("n")).first()[0]
    bucket_rows = corpus.blocks.filter(F.col("bucket").isin([r[0] for r in found.select(
        sparse.bucket_of("term", corpus.buckets)).collect()])).agg(F.sum("n")).first()[0]
    assert bucket_rows < 0.05 * whole and chosen.pairs <= 4
    plan = chosen.blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan  # buckets are pruned, terms are pushed down
    assert expected_pairs(found, 5, "query_id") <= 4


def test_stopwords_alone_skip_blocks(spark, corpus):
    top = corpus.df.orderBy(F.desc("df")).first()
    q = spark.createDataFrame([(1, top.term)], "query_id long, text string")
    chosen = Selection(query_term_idf(q, corpus), corpus, 3, "query_id", 1.5, 0.75)
    assert chosen.pairs < top.df
    assert rows_of(chosen.search()) == rows_of(bm25_top_k(q, corpus, 3))


def test_scan_packs_are_cut_by_terms(spark, corpus, monkeypatch):
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    want = rows_of(bm25_top_k(q, corpus, 5))
    monkeypatch.setattr(sparse, "PACK_TERMS", 50)
    assert rows_of(bm25_top_k(q, corpus, 5)) == want


def test_fetch_reads_the_nodes_once_and_prunes(spark, corpus):
    hits = corpus.nodes.filter("doc_id IN (3, 10, 11)").select("node_id")
    spans = node_places(hits, corpus)
    spans.write.parquet(f"{index_store.shared_path(spark, uuid.uuid4().hex)}")
    plan = fetch_places(around(spans, 3), corpus)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    got = {r.node_id: (r.text, r.window) for r in hit_nodes(hits, corpus).collect()}
    whole = with_windows(corpus.nodes, CFG).filter("doc_id IN (3, 10, 11)").collect()
    assert got == {r.node_id: (r.text, r.window) for r in whole} and len(got) > 3


def test_windows_equal_the_chunkers(spark, scratch):
    rows = [(-4, "One. Two. Three. Four. Five. Six. Seven. Eight. Nine."), (7, "Alone."), (12, "")]
    idx = load_index(spark, built(spark, scratch, rows), CFG)
    want = {r.node_id: r.window for r in chunk(frame(spark, rows), CFG).collect()}
    assert {r.node_id: r.window for r in hit_nodes(idx.nodes, idx).collect()} == want
    for name in ("document", "token"):
        cfg = CFG.but(chunking={"kind": name})
        idx = load_index(spark, built(spark, scratch, rows, cfg), cfg)
        nodes = hit_nodes(idx.nodes, idx).collect()
        assert {r.node_id: r.text for r in nodes} == {r.node_id: r.text for r in chunk(frame(spark, rows), cfg).collect()}
        assert all(r.window is None for r in nodes)
