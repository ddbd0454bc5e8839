import re

from quarry.llm.common import write_table
from quarry.llm.mixing import _placed, _plan, _rows, mix, queue, schedule

from . import frames


def fill(size, weight):
    done, free, total = {}, set(size), float(sum(size.values()))
    while free:
        level = (total - sum(done.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            return {**done, **{s: level * weight[s] for s in free}}
        done.update({s: 3.0 * size[s] for s in over})
        free -= set(over)
    return done


def check(rows, docs):
    size = {}
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        size[r.source] = size.get(r.source, 0) + n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = fill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = {}
    for r in rows:
        assert abs(r.target - (want[r.source] if size[r.source] else 0)) < 1e-6 and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) < 1
    return sum(taken.values())


def test_targets_and_words_by_brute_force(spark):
    for docs in (frames.awkward(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = schedule(docs).collect()
        assert len(rows) == docs.count()
        total = check(rows, docs.select("text", "source").collect())
        served = mix(docs).collect()
        assert sum(r.taken for r in served) == total
        assert all(len((r.text or "").encode().split()) == r.taken for r in served)
        assert [r.virtual_finish for r in served] == sorted(r.virtual_finish for r in served)
        again = schedule(docs.repartition(5)).collect()
        frames.same([(r.doc_id, r.size, r.taken) for r in rows], [(r.doc_id, r.size, r.taken) for r in again])


def test_empty(spark):
    assert schedule(frames.empty(spark)).count() == 0 and mix(frames.empty(spark)).count() == 0


def test_the_schedule_is_the_queue_cut_at_the_budget(spark):
    docs = frames.awkward(spark).unionByName(frames.awkward(spark))
    rows = write_table(_rows(docs, "mix-1", "text", "source", ("doc_id",)), "test-rows")
    goals, plan = _plan(rows, (5, 2, 1), 1.0, 3)
    served = queue(_placed(rows, plan), goals).collect()
    assert max(r.total for r in served) == sum(int(r.target) for r in goals.collect()) == sum(r.words for r in served)
    served.sort(key=lambda r: r.total)
    assert [r.virtual_finish for r in served] == sorted(r.virtual_finish for r in served)
    running = 0
    for r in served:
        running += r.words
        assert r.total == running and r.words > 0 and r.virtual_finish <= 1
    of = {}
    for r in served:
        of[r.source, r.before] = of.get((r.source, r.before), 0) + r.words
    want = [(r.source, r.before, r.size, of.get((r.source, r.before), 0) if r.size else 0) for r in schedule(docs).collect()]
    frames.same([(r.source, r.before, r.size, r.taken) for r in schedule(docs).collect()], want)
    assert sum(x[3] for x in want) == running
