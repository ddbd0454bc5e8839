from pyspark.sql import functions as F

from quarry.operators import chunk as C


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_sentence_split_edges(spark):
    d = docs(spark, ["One.", "", "A. B. C. D. E. F. G.", "A. B. C. D. E. F. G. H.", "  ...  ", "x\ny! z?"])
    rows = {(r.doc_id, r.pos): r.sentence for r in C.split_sentences(d).collect()}
    assert rows[(0, 0)] == "One."
    assert not any(k[0] == 1 for k in rows)  # empty doc: no sentence
    assert len([k for k in rows if k[0] == 2]) == 7
    assert len([k for k in rows if k[0] == 3]) == 8
    assert [rows[(5, i)] for i in range(3)] == ["x", "y!", "z?"]


def test_sentence_window_three_each_side(spark):
    d = docs(spark, ["A. B. C. D. E. F. G. H."])
    nodes = {r.pos: r for r in C.sentence_window_nodes(d, 3).collect()}
    assert len(nodes) == 8
    assert nodes[0].window == "A. B. C. D."
    assert nodes[3].window == "A. B. C. D. E. F. G."  # seven sentences inside
    assert nodes[7].window == "E. F. G. H."
    assert nodes[3].text == "D." and nodes[3].node_id == "0-3"


def test_window_never_crosses_documents(spark):
    d = docs(spark, ["A. B.", "C. D."])
    for r in C.sentence_window_nodes(d, 3).collect():
        assert ("C." in r.window) == (r.doc_id == 1)


def test_token_chunks(spark):
    text = " ".join(f"t{i}" for i in range(600))
    rows = C.token_chunk_nodes(docs(spark, [text, "", "a b c"]), 512, 128).orderBy("doc_id", "pos").collect()
    starts = [r.text.split()[0] for r in rows if r.doc_id == 0]
    assert starts == ["t0", "t384"]
    assert len(rows[1].text.split()) == 600 - 384
    assert [r.text for r in rows if r.doc_id == 2] == ["a b c"]
    assert not [r for r in rows if r.doc_id == 1]


def loop_spans(counts, size, overlap):
    return C.pack_spans(counts, size, overlap)


def test_sentence_pack_matches_loop_and_properties(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for size, overlap in ((64, 16), (40, 0)):
        nodes = C.sentence_pack_nodes(d, size, overlap).orderBy("doc_id", "pos").collect()
        sents = {r.doc_id: r.s for r in d.select("doc_id", C.sentences("text").alias("s")).collect()}
        by_doc = {}
        for r in nodes:
            by_doc.setdefault(r.doc_id, []).append(r.text)
        for doc_id, ss in sents.items():
            counts = [len(s.split()) for s in ss]
            spans = loop_spans(counts, size, overlap)
            want = [" ".join(ss[a:b + 1]) for a, b in spans]
            assert by_doc.get(doc_id, []) == want
            ends = [b for _, b in spans]
            assert ends == sorted(set(ends))  # every chunk ends later
            for a, b in spans:
                assert b == a or sum(counts[a:b + 1]) <= size
            if overlap == 0:
                assert [i for a, b in spans for i in range(a, b + 1)] == list(range(len(ss)))


def test_chunker_choice_rejects_bad_overlap():
    import pytest

    from quarry.config import RagConfig

    with pytest.raises(ValueError):
        RagConfig().but(chunking={"size": 10, "overlap": 10})
