"""The pipeline's stages against what can be told without the operators."""

import numpy as np

import corpus_pipeline as P
from quarry.llm.common import write_table
from quarry.llm.decontaminate import _TABLE

from . import frames
from .test_mixing import check
from .test_secrets import base
from .test_simhash import roots, slow

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in P.STAGES:
        tables.append(write_table(stage(spark, tables[-1], SF), f"test-{name}"))
    whole, good, single, clean, safe, mixed = tables
    assert [t.columns for t in tables[:5]] == [columns] * 5
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    fine = [d for d, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(d in kept for d in fine) >= 0.97 * len(fine)
    signed = {r.doc_id: (f := slow(r.text)) - (2 ** 64 if f >= 2 ** 63 else 0) for r in good.collect()}
    root, first = roots(signed.values()), {}
    for d in sorted(signed):
        first.setdefault(root[signed[d]], d)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())
    plain = lambda s: b" " + b" ".join(_TABLE[np.frombuffer(s.encode(), np.uint8)].tobytes().split()) + b" "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rest = {r.doc_id for r in clean.collect()}
    for r in single.collect():
        assert (r.doc_id in rest) != any(s in plain(r.text) for s in items)
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert not base(r.text) and r.n_chars == len(r.text)
        assert base(before[r.doc_id]) or r.text == before[r.doc_id] or "[secret]" in r.text
    assert safe.count() == clean.count()
    assert sum(r.taken for r in mixed.collect()) > 0
    from quarry.llm.mixing import schedule

    assert check(schedule(safe).collect(), safe.collect()) == sum(r.taken for r in mixed.collect())


def test_awkward_and_empty(spark):
    for docs, n in ((frames.awkward(spark), 17), (frames.empty(spark), 0)):
        for name, stage in P.STAGES:
            out = write_table(stage(spark, docs, SF), f"test-{name}")
            if name != "mixing":
                assert out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == (n > 0)
