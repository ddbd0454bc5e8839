import hashlib
import re

from quarry.llm import fill_in_middle as fim
from quarry.llm.fill_in_middle import fill_in_middle, restore

from . import frames


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    spm = h[3] % 100 < 20
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(units), "spm" if spm else "psm", len(pre), len(mid), out, text


def test_by_brute_force(spark):
    more = spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(
            ["<P> x", "a <S", "<", "S>", "a<M>b", "<P", "P>x <", "<<P", "\x00\x01é\u0000日本語 \U0001f600\r\n", "aB" * 5000, " " * 300,
             "né1 2_3—" * 200])] +
        [(i, frames.words(i, 30) + "\n") for i in range(200, 320)], "doc_id long, text string")
    docs = frames.awkward(spark).select("doc_id", "text").unionByName(more)
    want = [brute(*r) for r in docs.collect()]
    got = restore(fill_in_middle(frames.awkward(spark))).unionByName(restore(fill_in_middle(more))).collect()
    frames.same(got, want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert restore(fill_in_middle(frames.empty(spark))).count() == 0


def test_small_chunks_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [frames.words(i, 40) for i in range(20)] + [""] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(23)), "text": texts} |
                                       {f"h{k}": np.arange(23, dtype=np.int64) * 977 * k + 5 for k in (1, 2, 3, 4)})
    whole = pa.Table.from_batches(list(fim._forward([batch])))
    monkeypatch.setattr(fim, "CHUNK", 100)
    cut = pa.Table.from_batches(list(fim._forward([batch])))
    assert whole.to_pylist() == cut.to_pylist() and len(cut) == 23
