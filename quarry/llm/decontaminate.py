"""Benchmark decontamination by latent semantic retrieval.

1. TF-IDF. Texts are cut into passages of ``PASSAGE`` words; words are hashed to
   ``FEATURES`` features; document frequencies count all passages.
2. Randomised SVD. With A the normalised TF-IDF passages and W a random matrix, every
   task adds up its part of A'(A W); the sum is all that the driver needs to get the
   leading singular vectors and values of A (single-pass Nystroem form). Its size is
   fixed by FEATURES and RANK.
3. Retrieval. Benchmark items and windows of about their length, at every quarter of
   it, are projected on the whitened latent space (running sums of word vectors give
   any window at the cost of a subtraction); pairs of a cosine of at least
   ``LEAST_COSINE`` are candidates.
4. Checks. A candidate is a leak if the longest common subsequence of item and window
   (with a margin) holds ``LEAST_LCS`` of the item's words, or ``PARAPHRASE_LCS`` of
   them and the item's answer: its last words, in order and close together.

Items visit the documents in blocks of at most ``ITEM_BLOCK``, so what is sent to the
tasks is bounded. Documents are not shuffled.

Defined cases: null and empty texts have no words and no leaks; items of fewer than
``LEAST_WORDS`` words take no part; repeated rows give equal rows; a null doc_id is
kept; empty tables give no rows; other columns are ignored by ``leaks`` and kept by
``drop_leaks``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as X
from quarry.llm.common import chunks, piece_rows, prepare, sum_pieces, text_buffer

FEATURES, RANK, PASSAGE, SEED, PIECES = 8192, 64, 40, 5, 16
#: The gate before the checks, far below what they accept: a text at PARAPHRASE_LCS comes to
#: about 0.87 * 0.55 = 0.48 at the worst window offset, and the projection to RANK scatters that.
LEAST_COSINE = 0.3
LEAST_LCS, PARAPHRASE_LCS, LEAST_ANSWER = 0.7, 0.55, 0.8
LEAST_WORDS, ANSWER_WORDS, GROWTH = 5, 6, 1.4
STEPS, ITEM_BLOCK, CHUNK, PART = 4, 10_000, 1 << 18, 1024

_TABLE = np.array([(b | 32 if 65 <= b <= 90 else b) if (b > 127 or chr(b).isalnum()) else 32 for b in range(256)],
                  dtype=np.uint8)


def word_features(buf: np.ndarray, offsets: np.ndarray):
    """(feature of each word, word offsets by text, word starts, word ends)."""
    plain = _TABLE[buf]
    starts, ends, words = X.word_spans(plain, offsets)
    return (X.word_symbols(plain, starts, ends) % np.uint64(FEATURES)).astype(np.uint16), words, starts, ends


def _passages(offsets: np.ndarray) -> np.ndarray:
    """First words of all passages (texts' words cut every PASSAGE words)."""
    n = np.diff(offsets)
    count = -(-n // PASSAGE)
    return X._aranges(np.zeros(len(n), np.int64), count) * PASSAGE + np.repeat(offsets[:-1], count)


def _sums(table: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the table's rows ``which`` from each place of ``first`` to the next, added up in
    parts that fit the processor's cache."""
    out, offsets = np.empty((len(first), RANK), dtype=np.float32), np.append(first, len(which))
    for i, j in chunks(offsets, PART):
        rows = table[which[offsets[i]:offsets[j]]]
        np.add.reduceat(rows, first[i:j] - offsets[i], axis=0, out=out[i:j])
    return out


def _running_sums(table: np.ndarray, which: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out[i]: the sum of the first i of the table's rows ``which``. Two columns are added up at
    once, as the parts of a complex number."""
    out[0] = 0
    for i in range(0, len(which), PART):
        rows = table[which[i:i + PART]]
        if i:
            rows[0] += out[i]
        np.cumsum(rows.view(np.complex64), axis=0, out=out[i + 1:i + 1 + len(rows)].view(np.complex64))
    return out


def _frequencies(batches):
    df, passages = np.zeros(FEATURES), 0
    for batch in batches:
        buf, off = text_buffer(batch.column("text"))
        for i, j in chunks(off, CHUNK):
            feature, words, _, _ = word_features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
            first = _passages(words)
            if len(first):
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(feature))))
                order = np.argsort(feature, kind="stable")  # so a feature's passages ascend
                by, at = feature[order], owner[order]
                once = np.append(True, (by[1:] != by[:-1]) | (at[1:] != at[:-1]))
                df += np.bincount(by[once], minlength=FEATURES)
                passages += len(first)
    yield piece_rows(df, 1, passages)


def _sketch(idf: np.ndarray):
    def run(batches):
        random = np.random.default_rng(SEED).standard_normal((FEATURES, RANK)).astype(np.float32)
        sketch = idf[:, None] * random
        total = np.zeros((FEATURES, RANK), dtype=np.float32)
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            for i, j in chunks(off, CHUNK):
                feature, words, _, _ = word_features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                first = _passages(words)
                if not len(first):
                    continue
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(feature))))
                norm = np.add.reduceat(idf[feature] ** 2, first)
                y = _sums(sketch, feature, first) / np.maximum(norm, 1e-12)[:, None]
                order = np.argsort(feature, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(feature[order]) != 0))
                at = feature[order][cut]
                total[at] += idf[at][:, None] * _sums(y, owner[order], cut)
        yield piece_rows(total, PIECES, 1.0)

    return run


def singular_vectors(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of A from A'(A W)."""
    random = np.random.default_rng(SEED).standard_normal((FEATURES, RANK)).astype(np.float32).astype(float)
    shift = 1e-9 * (np.abs(total).max() + 1e-300)
    sketch = total + shift * random
    core = random.T @ sketch
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    half = vector / np.sqrt(np.maximum(value, 1e-9 * max(value.max(), 1e-300)))
    left, sigma, _ = np.linalg.svd(sketch @ half, full_matrices=False)
    return left, sigma


def latent_words(docs: DataFrame) -> np.ndarray:
    """FEATURES x RANK: the whitened latent vector of each feature, idf included."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = "piece int, weight double, data binary"
    got = sum_pieces(texts.mapInArrow(_frequencies, kind)).first()
    df, passages = (np.frombuffer(got.data), got.weight) if got else (np.zeros(FEATURES), 0)
    idf = np.log((passages + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
    rows = sum_pieces(texts.mapInArrow(_sketch(idf), kind)).orderBy("piece").collect()  # of fixed size
    if not rows:
        return np.zeros((FEATURES, RANK), dtype=np.float32)
    total = np.concatenate([np.frombuffer(r.data).reshape(-1, RANK) for r in rows])
    vectors, sigma = singular_vectors(total)
    keep = sigma > 1e-6 * max(sigma.max(), 1e-300)
    return (idf[:, None] * (vectors * np.where(keep, 1.0 / np.where(keep, sigma, 1.0), 0.0))).astype(np.float32)


#: A word's feature as one of 64 * MASKS bits: enough that a region of common words leaves most of an item's bits out.
MASKS = 8
_BITS = np.zeros((FEATURES, MASKS), dtype=np.uint64)
_BITS[np.arange(FEATURES), np.arange(FEATURES) // 64 % MASKS] = np.uint64(1) << (np.arange(FEATURES) % 64).astype(np.uint64)


class Unions:
    """Union of the bits of any stretch of words: that of two overlapping runs of 2^k words,
    whose unions are kept by their first words."""

    def __init__(self, feature: np.ndarray):
        self.runs = [_BITS[feature]]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        power = np.frexp(end - start)[1] - 1
        out = np.empty((len(start), MASKS), dtype=np.uint64)
        for k in np.unique(power).tolist():
            while len(self.runs) <= k:
                last, half = self.runs[-1], 1 << len(self.runs) - 1
                self.runs.append(last[:-half] | last[half:])
            mine = np.flatnonzero(power == k)
            out[mine] = self.runs[k][start[mine]] | self.runs[k][end[mine] - (1 << k)]
        return out


class Rows:
    """Rows taken from a table into memory that is used again for each chunk."""

    def __init__(self):
        self.rows = np.empty((0, RANK), dtype=np.float32)

    def take(self, table: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.take(table, which, axis=0, out=self.empty(len(which)), mode="clip")

    def empty(self, n: int) -> np.ndarray:
        if len(self.rows) < n:
            self.rows = np.empty((n * 5 // 4, RANK), dtype=np.float32)
        return self.rows[:n]


def margin_of(n):
    """Words that are looked at on either side of a window for an item of n words."""
    return np.maximum(2, n // 3)


def width_of(n: int) -> int:
    """Window length for an item of n words: one of a few lengths."""
    return max(LEAST_WORDS, round(LEAST_WORDS * GROWTH ** round(np.log(n / LEAST_WORDS) / np.log(GROWTH))))


class Items:
    """A block of benchmark items, ready to be met."""

    def __init__(self, rows: list[tuple[int, str]], latent: np.ndarray):
        self.latent = latent
        self.sums, self.starts, self.ends = Rows(), Rows(), Rows()
        self.items, bits, by_width = [], [], {}
        for id_, text in rows:
            buf = np.frombuffer((text or "").encode(), dtype=np.uint8)
            feature, _, _, _ = word_features(buf, np.array([0, len(buf)]))
            if len(feature) < LEAST_WORDS:
                continue
            vector = latent[feature].sum(axis=0)
            norm = np.linalg.norm(vector)
            if norm > 0:
                by_width.setdefault(width_of(len(feature)), []).append((len(self.items), vector / norm))
                self.items.append((id_, _TABLE[buf].tobytes().split()))
                bits.append(np.bitwise_or.reduce(_BITS[feature], axis=0))
        self.bits = np.array(bits, dtype=np.uint64).reshape(-1, MASKS)
        self.lengths = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.margins = margin_of(self.lengths)
        self.widths = {w: (np.array([i for i, _ in v]), np.array([x for _, x in v], dtype=np.float32).T)
                       for w, v in sorted(by_width.items())}

    def _may_hold(self, unions: Unions, words: np.ndarray, text, at, end, hit, item) -> np.ndarray:
        """Whether so few of an item's bits are missing around a window ``at`` to ``end`` (the
        ``hit``-th, ascending) that enough of its words may be there: a missing bit is at least
        one missing word. Around a window are the words within the largest margin of the items."""
        new = np.append(True, hit[1:] != hit[:-1])
        window = hit[new]
        margin = self.margins[item].max()
        there = unions.of(np.maximum(words[text[window]], at[window] - margin),
                          np.minimum(end[window] + margin, words[text[window] + 1]))
        bits = np.take(~there, np.cumsum(new) - 1, axis=0)
        bits &= np.take(self.bits, item, axis=0)
        missing = np.einsum("ij->i", np.bitwise_count(bits).astype(np.uint16))
        return self.lengths[item] - missing >= PARAPHRASE_LCS * self.lengths[item]

    def candidates(self, feature: np.ndarray, words: np.ndarray):
        """(text, window start, width, item, cosine) of all texts of a chunk, whose words
        are features ``feature[words[i]:words[i + 1]]``, by text."""
        n = np.diff(words)
        unions = Unions(feature)
        sums = _running_sums(self.latent, feature, self.sums.empty(len(feature) + 1))
        out = []
        for width, (which, vectors) in self.widths.items():
            long = np.flatnonzero(n >= LEAST_LCS * width / GROWTH)
            last, step = np.maximum(0, n[long] - width), max(1, width // STEPS)
            count = -(-last // step) + 1  # every step, and the last window
            start = np.minimum(X._aranges(np.zeros(len(long), np.int64), count) * step, np.repeat(last, count))
            text = np.repeat(long, count)
            at = words[text] + start
            window = self.ends.take(sums, np.minimum(at + width, words[text + 1]))
            window -= self.starts.take(sums, at)
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            cosine = window @ vectors
            flat = np.flatnonzero(cosine >= (LEAST_COSINE * np.maximum(norm, 1e-12))[:, None])
            hit = flat // len(which)
            item = flat - hit * len(which)
            if len(hit):
                may = self._may_hold(unions, words, text, at, at + width, hit, which[item])
                hit, item = hit[may], item[may]
                out.append((text[hit], start[hit], np.full(len(hit), width), which[item], cosine[hit, item] / norm[hit]))
        if not out:
            return []
        columns = [np.concatenate(c) for c in zip(*out)]
        order = np.argsort(columns[0], kind="stable")
        return list(zip(*(c[order].tolist() for c in columns)))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel in the words of a."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _answer(item: list[bytes], region: list[bytes]) -> bool:
    """The item's last words in order within a stretch of the region of one and a half their number."""
    tail = item[-ANSWER_WORDS:]
    width = len(tail) + len(tail) // 2
    return any(lcs(tail, region[i:i + width]) >= LEAST_ANSWER * len(tail)
               for i in range(max(1, len(region) - width + 1)))


def _leaks_of(plain: np.ndarray, offsets: np.ndarray, feature: np.ndarray, words: np.ndarray,
              items: Items) -> dict[int, dict[int, tuple]]:
    """text -> item index -> (start, cosine, lcs share, answer) of its best verified window."""
    found: dict[int, dict[int, tuple]] = {}
    region: list[bytes] = []
    text, split, where, near = -1, [], None, set()
    for k, start, width, m, cosine in items.candidates(feature, words):
        if k != text:
            text, split = k, plain[offsets[k]:offsets[k + 1]].tobytes().split()
        item = items.items[m][1]
        margin = int(items.margins[m])
        if where != (k, start, width, margin):
            where, region = (k, start, width, margin), split[max(0, start - margin):start + width + margin]
            near = set(region)
        if sum(map(near.__contains__, item)) < PARAPHRASE_LCS * len(item):
            continue  # a common subsequence has no more words than are in the region at all
        share = lcs(item, region) / len(item)
        best = found.get(k, {}).get(m)
        if share < PARAPHRASE_LCS or (best and best[2] >= share):
            continue
        answer = _answer(item, region)
        if share >= LEAST_LCS or answer:
            found.setdefault(k, {})[m] = (start, cosine, share, answer)
    return found


def _all_leaks(buf: np.ndarray, off: np.ndarray, items: Items):
    """(row, item index, leak) of a batch of texts, a chunk at a time."""
    for i, j in chunks(off, CHUNK):
        part, offsets = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        feature, words, _, _ = word_features(part, offsets)
        for k, leaks in _leaks_of(_TABLE[part], offsets, feature, words, items).items():
            for m, leak in leaks.items():
                yield i + k, m, leak


def _scan(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()),
                        ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())])

    def run(batches):
        items = Items(*shared.value)
        for batch in batches:
            ids = batch.column("doc_id")
            buf, off = text_buffer(batch.column("text"))
            out = [(ids[k].as_py(), items.items[m][0], *leak) for k, m, leak in _all_leaks(buf, off, items)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)],
                                                 schema=schema)

    return run


def _item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text) of at most about ITEM_BLOCK items each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .filter("text is not null").distinct()
    blocks = -(-rows.count() // (ITEM_BLOCK // 2))
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
               .orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, cosine, lcs, answer: every document that holds an item."""
    spark = docs.sparkSession
    prepare(spark)
    latent = latent_words(docs)
    kind = "doc_id long, item_id long, first_word long, cosine double, lcs double, answer boolean"
    out = spark.createDataFrame([], kind)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for rows in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((rows, latent))  # at most ITEM_BLOCK items
        out = out.unionByName(texts.mapInArrow(_scan(shared), kind))
    return out


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        items = Items(*shared.value)
        buf, off = text_buffer(pa.array(text.fillna(""), pa.string()))
        dirty = {k for k, _, _ in _all_leaks(buf, off, items)}
        return pd.Series([k not in dirty for k in range(len(text))], dtype=bool)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with their own columns; nothing is shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    latent = latent_words(docs)
    for rows in _item_blocks(benchmark):
        docs = docs.filter(_clean(spark.sparkContext.broadcast((rows, latent)))(F.col("text").cast("string")))
    return docs
