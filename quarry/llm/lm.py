"""LM scoring with a log-bilinear neural model, trained by noise-contrastive estimation.

The model gives a word after a word the score ``context[h] . target[w] + bias[w]``
over the ``VOCABULARY`` most frequent training tokens; all other words share one
entry, whose probability their smoothed frequencies divide. It is trained in numpy
on every training document: each task starts from the same weights, runs mini-batches
with shared noise words, and returns its weights, which are averaged by the number of
tokens seen. The normalisers of all contexts are then computed exactly by batched
matrix products, so the log-probabilities are normalised.

Corpus counts cover all training tokens, whatever the vocabulary: texts are packed
into blocks of about ``BLOCK`` bytes, each block gets the counts of its own words by a
join, and no table of all words is ever broadcast or held by one task. Words are
told apart by 64-bit digests.

Defined cases: a null or empty text is one end token; a null doc_id trains; without
training documents the counts are 0 and the model is uniform over its entries;
repeated rows count as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as X
from quarry.llm.common import piece_rows, prepare, sum_pieces, text_buffer, write_table

VOCABULARY, WIDTH = 8192, 32
BLOCK = 4 << 20
BATCH, NOISE, RATE, SEED = 1024, 64, 0.1, 11
#: Tokens that a training task sees, at least about: its weights are worth moving then.
TASK_TOKENS = 6_000_000
FOLDS, HELD_OUT = 5, 1
END, OTHER = 0, 1
END_HASH = 0  # a digest of its own: no word hashes to it but by accident

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCKS = pa.schema([("payload", pa.binary())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])


def _pack(batches):
    """Documents as compressed blocks of about BLOCK bytes of text."""
    held, size = [], 0

    def block():
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, _TEXTS, options=options) as out:
            for b in held:
                out.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_BLOCKS)

    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in _TEXTS], schema=_TEXTS)
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def _open(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """ids, held_out, digests of all words, offsets of the documents' words."""
    table = pa.ipc.open_stream(payload).read_all()
    column = table["text"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    buf, off = text_buffer(column)
    digests, offsets = [], [np.zeros(1, np.int64)]
    total = 0
    for i in range(0, len(off) - 1, 200):  # some documents at a time
        o = off[i:i + 201]
        part = _LOWER[buf[o[0]:o[-1]]]
        starts, ends, words = X.word_spans(part, o - o[0])
        digests.append(X.word_symbols(part, starts, ends).view(np.int64))
        offsets.append(words[1:] + total)
        total += int(words[-1])
    flat = np.concatenate(digests) if digests else np.empty(0, np.int64)
    held = np.asarray(table["held_out"].to_pylist(), dtype=bool)
    return table["doc_id"].to_pylist(), held, flat, np.concatenate(offsets)


def _incidence(batches):
    """(block, word, n): the words of each block and how often they train."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for id_, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
            _, held, words, off = _open(payload)
            train = np.repeat(~held, np.diff(off))
            word, at = np.unique(words, return_inverse=True)
            n = np.bincount(at, weights=train, minlength=len(word)).astype(np.int64)
            word, n = np.append(word, END_HASH), np.append(n, int((~held).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), id_)), pa.array(word), pa.array(n)],
                                             schema=schema)


def _sequence(words: np.ndarray, off: np.ndarray, vocabulary: np.ndarray, place: np.ndarray):
    """Entries of all tokens, an end after each document, and of the tokens before them."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1) if len(vocabulary) else None
    entry = np.where(vocabulary[at] == words, place[at], OTHER) if at is not None else np.full(len(words), OTHER)
    docs = len(off) - 1
    token = np.full(len(words) + docs, END, dtype=np.int64)
    token[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(off))] = entry
    before = np.concatenate(([END], token[:-1]))
    return token, before  # an end is also what stands before a first word


class Model:
    def __init__(self, unigram: np.ndarray):
        rng = np.random.default_rng(SEED)
        v = len(unigram)
        self.bias = np.log(unigram).astype(np.float32)
        self.context = (rng.standard_normal((v, WIDTH)) * 0.1).astype(np.float32)
        self.target = (rng.standard_normal((v, WIDTH)) * 0.1).astype(np.float32)

    def weights(self) -> np.ndarray:
        return np.column_stack((self.context, self.target, self.bias))

    def load(self, weights: np.ndarray) -> "Model":
        self.context, self.target = weights[:, :WIDTH].copy(), weights[:, WIDTH:2 * WIDTH].copy()
        self.bias = weights[:, -1].copy()
        return self

    def normalisers(self) -> np.ndarray:
        """log of the sum over all entries, for every context."""
        out = np.empty(len(self.bias), dtype=np.float64)
        for i in range(0, len(out), 256):
            s = self.context[i:i + 256] @ self.target.T + self.bias
            top = s.max(axis=1, keepdims=True)
            out[i:i + 256] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1, dtype=np.float64))
        return out


def _add(into: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """AdaGrad step on rows that may repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    total, rows = np.add.reduceat(grad[order], cut, axis=0), rows[cut]
    seen[rows] += total * total
    into[rows] -= RATE * total / np.sqrt(seen[rows])


class Trainer:
    """Noise-contrastive estimation: a token against NOISE words shared by its mini-batch."""

    def __init__(self, model: Model, unigram: np.ndarray):
        self.model, self.log_noise = model, np.log(unigram * NOISE).astype(np.float32)
        self.draw = np.cumsum(unigram)
        self.rng = np.random.default_rng(SEED)
        self.seen = [np.full_like(x, 1.0) for x in (model.context, model.target, model.bias)]

    def step(self, before: np.ndarray, token: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.draw, self.rng.random(NOISE)), len(self.draw) - 1)
        h, t, q = m.context[before], m.target[token], m.target[noise]
        real = (h * t).sum(axis=1) + m.bias[token] - self.log_noise[token]
        fake = h @ q.T + (m.bias[noise] - self.log_noise[noise])
        up = -1.0 / (1.0 + np.exp(np.clip(real, -30, 30)))
        down = 1.0 / (1.0 + np.exp(-np.clip(fake, -30, 30)))
        grad_h = up[:, None] * t + down @ q
        rows = np.concatenate((token, noise))
        grad_t = np.concatenate((up[:, None] * h, down.T @ h))
        grad_b = np.concatenate((up, down.sum(axis=0)))
        _add(m.context, self.seen[0], before, grad_h.astype(np.float32))
        _add(m.target, self.seen[1], rows, grad_t.astype(np.float32))
        _add(m.bias, self.seen[2], rows, grad_b.astype(np.float32))


def _train(vocabulary: np.ndarray, place: np.ndarray, unigram: np.ndarray, pieces: int):
    def run(batches):
        model = Model(unigram)
        trainer, tokens = Trainer(model, unigram), 0
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                _, held, words, off = _open(payload)
                token, before = _sequence(words, off, vocabulary, place)
                keep = np.repeat(~held, np.diff(off) + 1)
                token, before = token[keep], before[keep]
                before[:1] = END
                order = trainer.rng.permutation(len(token))
                for i in range(0, len(order), BATCH):
                    part = order[i:i + BATCH]
                    trainer.step(before[part], token[part])
                tokens += len(token)
        if tokens:
            yield piece_rows(model.weights() * np.float32(tokens), pieces, tokens)

    return run


def train_model(blocks: DataFrame, vocabulary, place, unigram, tasks: int, pieces: int = 16) -> Model:
    rows = blocks.select("payload").coalesce(tasks).mapInArrow(
        _train(vocabulary, place, unigram, pieces), "piece int, weight double, data binary")
    parts = [np.frombuffer(r.data).reshape(-1, 2 * WIDTH + 1) / r.weight
             for r in sum_pieces(rows).orderBy("piece").collect()]  # the model: its size is fixed
    return Model(unigram).load(np.concatenate(parts).astype(np.float32)) if parts else Model(unigram)


def _score(shared, total: int, kinds: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        context, target, bias, norm, vocabulary, place, rest, rest_kinds, ends = shared.value
        known = counts["word"].to_numpy()
        order = np.argsort(known)
        known, count = known[order], counts["c"].to_numpy()[order]
        out = []
        for payload in texts["payload"].to_pylist():
            ids, held, words, off = _open(payload)
            token, before = _sequence(words, off, vocabulary, place)
            n = np.diff(off) + 1
            owner = np.repeat(np.arange(len(ids)), n)
            c = np.full(len(token), ends, dtype=np.int64)
            inner = np.ones(len(token), dtype=bool)
            inner[np.cumsum(n) - 1] = False
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                c[inner] = np.where(known[at] == words, count[at], 0)
            else:
                c[inner] = 0
            base = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
            logp = np.empty(len(token))
            for i in range(0, len(token), 1 << 16):
                b, t = before[i:i + (1 << 16)], token[i:i + (1 << 16)]
                logp[i:i + (1 << 16)] = np.einsum("ij,ij->i", context[b], target[t]) + bias[t] - norm[b]
            logp /= math.log(10)
            other = token == OTHER
            logp[other] += np.log10((c[other] + 0.5) / (rest + 0.5 * (rest_kinds + 1)))
            docs = len(ids)
            out.append(pa.table([
                pa.array(ids, pa.int64()), pa.array(held), pa.array(n),
                pa.array(np.bincount(owner, weights=c > 0, minlength=docs).astype(np.int64)),
                pa.array(np.bincount(owner, weights=base, minlength=docs)),
                pa.array(np.bincount(owner, weights=logp, minlength=docs))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def lm_scores(docs: DataFrame, vocabulary_size: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    fold = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % FOLDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT).alias("held_out"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = write_table(texts.mapInArrow(_pack, "payload binary")
                         .withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    words = write_table(blocks.mapInArrow(_incidence, "block long, word long, n long"), "lm-words")
    counts = write_table(words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    size = counts.agg(F.sum("c").alias("total"), F.count("*").alias("kinds"),
                      F.sum(F.when(F.col("word") == END_HASH, F.col("c"))).alias("ends")).first()
    total, kinds, ends = size.total or 0, size.kinds, size.ends or 0
    top = counts.filter(F.col("word") != END_HASH).orderBy(F.desc("c"), "word").limit(vocabulary_size - 2).collect()
    rest, rest_kinds = total - ends - sum(r.c for r in top), kinds - len(top) - (1 if ends else 0)
    unigram = np.array([ends, rest] + [r.c for r in top], dtype=np.float64) + 0.5
    unigram /= unigram.sum()
    ranked = sorted((r.word, i + 2) for i, r in enumerate(top))
    vocabulary = np.array([w for w, _ in ranked], dtype=np.int64)
    place = np.array([i for _, i in ranked], dtype=np.int64)
    model = train_model(blocks, vocabulary, place, unigram, total // TASK_TOKENS + 1)
    shared = spark.sparkContext.broadcast(  # VOCABULARY rows: a fixed size
        (model.context, model.target, model.bias, model.normalisers(), vocabulary, place, rest, rest_kinds, ends))
    own = words.select("block", "word").join(counts, "word")
    done = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        _score(shared, total, kinds),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                       "base_score", "score")
