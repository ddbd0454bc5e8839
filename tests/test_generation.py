from pyspark.sql import functions as F

from quarry.operators.generate import QA_TEMPLATE, best_sentence, complete, fill_template, tree_levels
from quarry.operators.messages import message_records, running_text
from quarry.operators.pack import budget_context, repack


def test_fill_template_never_substitutes_twice(spark):
    df = spark.createDataFrame([("doc with {query_str} inside", "q?")], "context string, q string")
    out = df.select(fill_template(QA_TEMPLATE, F.col("context"), F.col("q")).alias("p")).first().p
    assert "doc with {query_str} inside" in out and out.count("q?") == 1


def test_failing_completer_row_isolated(spark):
    def make():
        def fn(prompt, context, query):
            if "boom" in prompt:
                raise RuntimeError("model down")
            return "ok"
        return fn

    df = spark.createDataFrame([("fine",), ("boom",)], "prompt string")
    rows = {r.prompt: r for r in complete(df, make, context=None, query=None).collect()}
    assert rows["fine"].response == "ok" and rows["fine"].error is None
    assert rows["boom"].response is None and "model down" in rows["boom"].error
    assert rows["boom"].prompt_tokens == 0 and rows["boom"].total_tokens == 0


def test_stub_first_best_sentence_wins():
    assert best_sentence("Cats nap. Dogs run fast. Dogs run.", "do dogs run") == "Dogs run fast."
    assert best_sentence("", "x") == ""


def test_tree_levels():
    assert [tree_levels(k, 2) for k in (1, 2, 3, 4, 5)] == [1, 1, 2, 2, 3]


def test_repack_orders(spark):
    h = spark.createDataFrame([(1, str(r), r) for r in range(1, 6)], "query_id long, node_id string, rank int")
    sides = [r.rank for r in repack(h, "sides").orderBy("ord").collect()]
    assert sides == [1, 3, 5, 4, 2]
    rev = [r.rank for r in repack(h, "reverse").orderBy("ord").collect()]
    assert rev == [5, 4, 3, 2, 1]


def test_budget_truncates_first_node(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    packed = spark.createDataFrame([(1, "n1", 1, " ".join(["w"] * 50)), (1, "n2", 2, "x y")],
                                   "query_id long, node_id string, ord int, text string")
    from quarry.operators.pack import template_token_count
    cw = 20 + template_token_count(QA_TEMPLATE) + 2  # budget 20 tokens
    rows = budget_context(packed, q, cw, 0, QA_TEMPLATE).collect()
    assert len(rows) == 1 and len(rows[0].text.split()) == 20


def test_running_text_blocks_equal_plain(spark):
    rows = [(1, i, f"d{i} ") for i in range(23)] + [(2, 0, "x"), (2, 5, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.text_so_far for r in running_text(df, block=4).collect()}
    for (c, t), v in got.items():
        want = "".join(x[2] for x in sorted(rows) if x[0] == c and x[1] <= t)
        assert v == want
    assert len(got) == len(rows)


def test_message_records_drop_nulls(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, None, "x"), (1, 2, "assistant", None)],
                               "conv_id long, turn long, role string, text string")
    assert [r.turn for r in message_records(df).collect()] == [0]


def test_tree_carries_errors_and_usage(spark):
    from quarry.operators.generate import tree_summarize

    packed = spark.createDataFrame([(q, o, f"text {o}.") for q in (1, 2) for o in (1, 2, 3)],
                                   "query_id long, ord int, text string")
    queries = spark.createDataFrame([(1, "text"), (2, "bad text")], "query_id long, text string")

    def make():
        def complete(prompt, context, query):
            if query.startswith("bad"):
                raise ValueError("no model")
            return "fine answer", {"prompt_tokens": 10, "completion_tokens": 2}

        return complete

    got = {r.query_id: r for r in tree_summarize(packed, queries, 3, 2, make).collect()}
    assert got[1].response == "fine answer" and got[1].error is None
    assert (got[1].prompt_tokens, got[1].completion_tokens, got[1].total_tokens) == (30, 6, 36)
    assert got[2].response is None and got[2].error == "ValueError: no model"


def test_running_text_of_nulls_ties_and_hot_streams(spark):
    rows = [(1, None, "x"), (1, 0, "a"), (None, 0, "b"), (None, 3, "c"), (2, 0, None), (2, 1, ""), (2, 1, "é"), (2, 1, "é")]
    rows += [(7, i, f"d{i}—") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    by = lambda x: (x is not None, x or 0)
    want = []
    for stream in {r[0] for r in rows}:
        so_far = ""
        for r in sorted((r for r in rows if r[0] == stream), key=lambda r: (by(r[1]), r[2] or "")):
            so_far += r[2] or ""
            want.append((r[0], r[1], so_far))
    for parts, block in ((20, 64), (1, 4096), (20, 1)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [tuple(r) for r in running_text(df if block > 1 else df.filter("conv_id IS NULL OR conv_id < 7"), block=block).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        key = lambda r: (by(r[0]), by(r[1]), len(r[2]), r[2])
        assert sorted(got, key=key) == sorted((w for w in want if block > 1 or w[0] != 7), key=key)


def test_one_stream_spreads_over_partitions(spark):
    from quarry.operators.messages import running_offsets, text_blocks

    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("t"), "id").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        offsets = running_offsets(df)
        plan = offsets._jdf.queryExecution().executedPlan().toString()
        whole = "".join(r.text for r in text_blocks(offsets, 100).orderBy("block").collect())
        cuts = offsets.agg(F.count("*"), F.max("end")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert whole == "".join(f"t{i}" for i in range(3000)) and tuple(cuts) == (3000, len(whole))
    assert "Window" in plan


def counting_completer(folder, fail=()):
    def make():
        def fn(prompt, context, query):
            import os
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt or "")
            for bad in fail:
                if bad in (prompt or "") and not os.path.exists(f"{folder}/../mended"):
                    raise RuntimeError("model down")
            return f"said {prompt}", {"prompt_tokens": 3, "completion_tokens": 2}

        return fn

    return make


def test_ledger_asks_once(spark, scratch):
    import os

    from quarry.operators.ledger import Ledger

    calls = f"{scratch}/calls"
    os.mkdir(calls)
    ledger = Ledger(f"{scratch}/ledger", slice=2)
    df = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p1"), (4, "p3 bad"), (5, None)], "id long, prompt string")
    make = counting_completer(calls, fail=("bad",))
    got = {r.id: r for r in ledger.complete(df, make, context=None, query=None).collect()}
    assert got[1].response == got[3].response == "said p1" and got[1].total_tokens == 5
    assert got[4].response is None and got[4].error == "RuntimeError: model down"
    assert len(os.listdir(calls)) == 4  # p1 once
    open(f"{scratch}/mended", "w").close()
    out = ledger.complete(df, make, context=None, query=None)
    assert {r.id: r.response for r in out.collect()}[4] == "said p3 bad" and out.count() == 5
    assert len(os.listdir(calls)) == 5  # only the failed one again
    again = ledger.complete(df, make, context=None, query=None, model="another")
    assert again.count() == 5 and len(os.listdir(calls)) == 9


def test_ledger_resumes_after_a_failed_job(spark, scratch, monkeypatch):
    import os

    import pytest

    from quarry.operators import ledger as L

    calls = f"{scratch}/calls"
    os.mkdir(calls)
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(40)], "id long, prompt string")
    book, settle, left = L.Ledger(f"{scratch}/ledger", slice=10), L.settle, [4]  # two inputs, then two slices

    def failing(*args):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("lost")
        return settle(*args)

    monkeypatch.setattr(L, "settle", failing)
    with pytest.raises(OSError):
        book.complete(df, counting_completer(calls), context=None, query=None)
    done = len(os.listdir(calls))
    monkeypatch.setattr(L, "settle", settle)
    assert book.complete(df, counting_completer(calls), context=None, query=None).filter("response IS NOT NULL").count() == 40
    assert 0 < done < 40 and len(os.listdir(calls)) == 40


def test_plans_call_the_plug_ins(spark, scratch):
    import os

    from quarry.config import RagConfig
    from quarry.operators.ledger import Ledger
    from quarry.plans.answer import routed_answer
    from quarry.sources.index_store import ensure_index

    docs = spark.createDataFrame([(i, f"Alpha beta {i}. Gamma delta {i}.") for i in range(6)], "doc_id long, text string")
    idx = ensure_index(spark, docs, "t", RagConfig().but(layout={"partitions": 2}), path=f"{scratch}/idx")
    q = spark.createDataFrame([(1, "gamma 3"), (2, "alpha 1"), (3, "hello there")], "query_id long, text string")
    calls = f"{scratch}/calls"
    os.mkdir(calls)

    def classifier():
        return lambda texts: [int("hello" in t) for t in texts]

    def run():
        return {r.query_id: r for r in routed_answer(
            q, idx, RagConfig().but(search={"pseudo_documents": True}), counting_completer(calls), make_classifier=classifier,
            make_writer=counting_completer(calls), ledger=Ledger(f"{scratch}/ledger")).collect()}

    got = run()
    assert {i: r.route for i, r in got.items()} == {1: 0, 2: 0, 3: 1}
    assert all((r.response or "").startswith("said ") for r in got.values()), got
    n = len(os.listdir(calls))
    written = sum("reference work" in open(f"{calls}/{f}").read() for f in os.listdir(calls))
    assert n == 5 and written == 2  # two documents, two answers, one direct answer
    assert run() == got and len(os.listdir(calls)) == n  # evaluated again: nothing is asked
