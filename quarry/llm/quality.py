"""Quality classifier with hierarchical empirical Bayes over sites.

1. Evidence. A logistic regression gives each document its log-odds of being bad
   (low quality or toxic) from words, their beginnings, and binned measures of its shape. It is
   fitted on at most ``SAMPLE`` labelled documents (the smallest keyed hashes of their
   ids) in one bounded task, over at most ``MOST_FEATURES`` features that tell the
   classes apart beyond chance in that sample.
2. Sites. The evidence of all documents is summed by path and host (grouped
   aggregation with map-side combine). A host's rate of bad documents is shrunk
   towards the global rate, a path's towards its host's, by pseudo-counts that the
   spread of the rates yields (method of moments): sparse sites follow their parent.
3. Posterior. A document's log-odds are its evidence plus what its path's rate adds to
   the global rate's log-odds. It is kept if that makes it more likely good than bad.

Defined cases: a null or empty text has the evidence of no words; a null host or path
is a site of its own; labels that are null or of unknown documents are ignored, and
without labels of both classes the evidence is 0 and all is kept; repeated rows get
equal results; an empty table gives no rows; ``keep_good`` returns the columns of its
input, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from quarry.llm.common import prepare, write_table

SAMPLE, SEED = 10_000, "quality-1"
#: A feature needs so many documents, so much gain (twice the log-likelihood ratio); at most so many features.
LEAST_DOCS, LEAST_GAIN, MOST_FEATURES = 3, 20.0, 20_000
PREFIXES, STEM = (4, 5, 6, 8), 5
STEPS, RATE, PRIOR_VARIANCE = 300, 0.3, 4.0
LEAST_PSEUDO, MOST_PSEUDO = 20.0, 1e6
LIMIT = 0.5

_WORDS = bytes((b | 32 if 65 <= b <= 90 else b) if (b > 127 or chr(b).isalnum()) else 32 for b in range(256))
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")


def _bin(name: str, value: float, steps: int = 12) -> bytes:
    return f"{name}={int(min(max(value, 0.0), 1.0) * steps)}".encode()


def features(text: bytes) -> set[bytes]:
    """Words, their beginnings, stems of two and more words, runs of marks, and binned measures of shape."""
    raw = text.split()
    words = text.translate(_WORDS).split()
    n = max(1, len(raw))
    lines = text.split(b"\n")
    marks = _MARKS.findall(text)
    shape = [
        _bin("unique", len(set(words)) / max(1, len(words))),
        _bin("lines", len(set(lines)) / max(1, len(lines))),
        _bin("marks", len(marks) / n), _bin("long marks", sum(len(m) > 1 for m in marks) / n),
        _bin("bars", text.count(b"|") / n), _bin("calls", text.count(b"!") / n),
        _bin("upper", sum(w.isupper() for w in raw) / n), _bin("digits", sum(w.isdigit() for w in raw) / n),
        _bin("width", len(text) / n / 20.0), _bin("size", float(np.log2(n + 1)) / 16.0),
    ]
    distinct = set(words)
    stems = Counter([w[:STEM] for w in distinct if len(w) > STEM])
    return {*distinct, *[w[:n] + b"-" for n in PREFIXES for w in distinct if len(w) > n],
            *[s + b"+" for s, n in stems.items() if n > 1], *(b"mark " + m for m in marks),
            *(b"shape " + x for x in shape)}


def digests(text: bytes) -> np.ndarray:
    """64-bit digests of the features, sorted."""
    return np.array(sorted(map(xxh64_intdigest, features(text))), dtype=np.uint64)


def fit(rows: list[np.ndarray], bad: np.ndarray) -> dict[int, float]:
    """Weights of the feature digests that tell the classes apart beyond chance (0 is
    the intercept), by AdaGrad on the penalised likelihood."""
    if not 0 < bad.sum() < len(bad):
        return {}
    size = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    found, flat = np.unique(np.concatenate(rows), return_inverse=True)
    n = np.bincount(flat)
    k = np.bincount(flat, weights=bad[owner])
    rate, gain = bad.mean(), np.zeros(len(n))
    for x, e in ((k, n * rate), (n - k, n * (1 - rate))):
        gain += 2 * x * np.log(np.maximum(x, 1e-300) / e) * (x > 0)
    chosen = np.flatnonzero((n >= LEAST_DOCS) & (gain >= LEAST_GAIN))
    chosen = np.sort(chosen[np.lexsort((chosen, -gain[chosen]))][:MOST_FEATURES])
    place = np.full(len(n), -1)
    place[chosen] = np.arange(len(chosen))
    flat = place[flat]
    flat, owner = flat[flat >= 0], owner[flat >= 0]
    flat = np.concatenate((flat, np.full(len(rows), len(chosen))))
    owner = np.concatenate((owner, np.arange(len(rows))))
    weights, seen = np.zeros(len(chosen) + 1), np.full(len(chosen) + 1, 1e-8)
    penalty = np.full(len(weights), 1.0 / PRIOR_VARIANCE)
    penalty[-1] = 0.0
    for _ in range(STEPS):
        z = np.bincount(owner, weights=weights[flat], minlength=len(rows))
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - bad
        grad = np.bincount(flat, weights=error[owner], minlength=len(weights)) + penalty * weights
        seen += grad * grad
        weights -= RATE * grad / np.sqrt(seen)
    return dict(zip([*found[chosen].tolist(), 0], weights.tolist()))


def score(text: bytes, weights: dict[int, float]) -> float:
    hits = sorted(weights.keys() & set(map(xxh64_intdigest, features(text))))
    total = weights.get(0, 0.0) + math.fsum(weights[h] for h in hits)
    return min(max(total, -15.0), 15.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """Weights from the labelled sample. The sample is bounded, so one task holds its
    digests and its ids may be broadcast."""
    key = F.md5(F.concat(F.lit(f"{SEED}|"), F.col("label_id").cast("string")))
    picked = labels.filter("doc_id is not null and quality is not null and toxic is not null") \
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.when(
            (F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    picked = picked.orderBy(key, "label_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        F.col("text").cast("string"), F.lit("")).alias("text")) \
        .join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")) \
        .select("doc_id", "bad", _digests("text").alias("digests")).dropDuplicates(["doc_id"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        found = [np.frombuffer(b, dtype=np.uint64) for chunk in table["digests"].chunks for b in chunk.to_pylist()]
        weights = fit(found, table["bad"].to_numpy().astype(float))
        return pa.table({"weights": pa.array([pickle.dumps(weights)], pa.binary())})

    done = rows.withColumn("fit", F.lit(0)).groupBy("fit").applyInArrow(run, "weights binary").first()
    return pickle.loads(done.weights) if done else {}


@F.pandas_udf(T.BinaryType())
def _digests(text: pd.Series) -> pd.Series:
    return pd.Series([digests(t.encode()).tobytes() for t in text])


def _evidence(weights: dict[int, float]):
    @F.pandas_udf("double")
    def evidence(text: pd.Series) -> pd.Series:
        return pd.Series([score((t or "").encode(), weights) for t in text], dtype=float)

    return evidence


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _pseudo(rates: DataFrame, parent: str) -> float:
    """Pseudo-count of a Beta prior around the parent's rate, from the spread of the
    children's rates beyond chance."""
    p = F.col(parent)
    got = rates.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)).alias("spread"),
        F.sum(p * (1 - p)).alias("chance"), F.sum(F.col("n") * p * (1 - p)).alias("scale"),
        F.sum("n").alias("n")).first()
    if not got.n or not got.scale or got.spread is None or got.spread <= got.chance:
        return MOST_PSEUDO
    return float(np.clip(got.scale / (got.spread - got.chance), LEAST_PSEUDO, MOST_PSEUDO))


def site_rates(scored: DataFrame) -> DataFrame:
    """(host, path) -> n, host_rate, path_rate, global_rate, from (host, path, evidence)."""
    bad = 1 / (1 + F.exp(-F.col("evidence")))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = min(max((total.bad or 0.0) / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) \
        .withColumn("global_rate", F.lit(rate))
    m = _pseudo(hosts, "global_rate")
    hosts = hosts.select(F.col("host").alias("h"), "global_rate",
                         ((F.col("bad") + m * F.col("global_rate")) / (F.col("n") + m)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    m = _pseudo(paths, "host_rate")
    return paths.withColumn("path_rate", (F.col("bad") + m * F.col("host_rate")) / (F.col("n") + m)).drop("bad")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             sample: int = SAMPLE, columns: list[str] | None = None) -> DataFrame:
    """(row: the named columns of docs, all if None, host, path, evidence, host_rate,
    path_rate, log_odds, p_bad, keep). Texts are scored once: the evidence is a table."""
    spark = docs.sparkSession
    prepare(spark)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    weights = train(docs, labels, sample)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    scored = write_table(docs.select(
        row.alias("row"), host.cast("string").alias("host"), path.cast("string").alias("path"),
        _evidence(weights)(F.col("text").cast("string")).alias("evidence")), "evidence")
    rates = site_rates(scored.select("host", "path", "evidence")).select(
        F.col("host").alias("h"), F.col("path").alias("p"), "global_rate", "host_rate", "path_rate")
    out = scored.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).drop("h", "p")
    out = out.withColumn("log_odds", F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.col("global_rate")))
    out = out.withColumn("p_bad", 1 / (1 + F.exp(-F.col("log_odds"))))
    return out.withColumn("keep", F.col("p_bad") <= LIMIT)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    return classify(docs, labels, **options).filter("keep").select("row.*")
