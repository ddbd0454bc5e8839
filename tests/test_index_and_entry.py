import uuid

from pyspark.sql import functions as F

from quarry.config import RagConfig
from quarry.sources.index_store import load_index, upsert_index

SF = "/root/testdata/sf0.001"


def test_incremental_index_second_run_adds_nothing(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = f"{scratch}/idx-{uuid.uuid4().hex[:6]}"
    cfg = RagConfig().but(layout={"partitions": 4})
    first = upsert_index(spark, docs, path, cfg)
    before = load_index(spark, path, cfg).postings.count()
    again = upsert_index(spark, docs, path, cfg)
    assert again["touched_parts"] == 0 and load_index(spark, path, cfg).postings.count() == before
    # change one document: only its rows are replaced
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.lit("Brand new text. Second one."))
                              .otherwise(F.col("text")))
    r = upsert_index(spark, changed, path, cfg)
    assert r["changed"] == 1
    idx = load_index(spark, path, cfg)
    assert sorted(x.text for x in idx.nodes.filter("doc_id = 0").collect()) == ["Brand new text.", "Second one."]
    assert idx.nodes.count() == idx.nodes.select("node_id").distinct().count()
    assert first["changed"] == docs.count()


def test_removed_and_emptied_documents_leave_the_index(spark, scratch):
    cfg = RagConfig().but(layout={"partitions": 16})
    path = f"{scratch}/idx-{uuid.uuid4().hex[:6]}"
    rows = [(i, f"First of {i}. Second of {i}.") for i in range(5)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    upsert_index(spark, make(rows), path, cfg)
    less = [(i, "" if i == 3 else t) for i, t in rows if i != 2]
    r = upsert_index(spark, make(less), path, cfg)
    assert (r["changed"], r["removed"]) == (1, 1)
    idx = load_index(spark, path, cfg)
    assert {x.doc_id for x in idx.nodes.collect()} == {x.doc_id for x in idx.postings.collect()} == {0, 1, 4}
    assert idx.stats.first().n == 6
    assert upsert_index(spark, make(less), path, cfg) == {"changed": 0, "removed": 0, "touched_parts": 0}
    gone = upsert_index(spark, make(rows[:0]), path, cfg)
    assert gone["removed"] == 4 and load_index(spark, path, cfg).nodes.count() == 0


def test_index_without_its_tables_or_mark(spark, scratch):
    import os

    import pytest

    from quarry.session import delete_path
    from quarry.sources.index_store import committed, ensure_index

    cfg = RagConfig().but(layout={"partitions": 2})
    path = f"{scratch}/idx-{uuid.uuid4().hex[:6]}"
    docs = spark.createDataFrame([(1, "One sentence."), (2, "Another one.")], "doc_id long, text string")
    ensure_index(spark, docs, "t", cfg, path=path)
    os.remove(f"{path}/manifest.json")  # as a crashed build leaves it
    assert not committed(spark, path)
    changed = docs.union(spark.createDataFrame([(3, "A third.")], docs.schema))
    assert ensure_index(spark, changed, "t", cfg, path=path).nodes.count() == 3
    more = changed.union(spark.createDataFrame([(4, "A fourth.")], docs.schema))
    assert ensure_index(spark, more, "t", cfg, path=path).nodes.count() == 4  # updates by default
    delete_path(spark, f"{path}/postings")
    with pytest.raises(FileNotFoundError):
        load_index(spark, path, cfg)


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_routed_answer_each_query_once(spark):
    from quarry.operators.route import classify_by_keyword_score
    from quarry.plans.answer import routed_answer
    from quarry.plans.registry import DEFAULT_CFG, corpus_index
    from quarry.sources.tables import benchmark_queries

    idx = corpus_index(spark, SF)
    q = benchmark_queries(spark, SF)
    routes = {r.query_id: r.route for r in classify_by_keyword_score(q, idx, DEFAULT_CFG.synthesis.route_at).collect()}
    out = routed_answer(q, idx, DEFAULT_CFG).collect()
    assert sorted(r.query_id for r in out) == sorted(routes)  # every query exactly once
    for r in out:
        assert r.route == routes[r.query_id]
        assert (r.source_node_id is None) == (r.route == 1)  # sources only on the RAG route
