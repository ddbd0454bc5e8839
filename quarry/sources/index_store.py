"""Persist, load and incrementally update an index as versioned parquet tables.

Layout under one directory (the path carries the config fingerprint, so a dense-only run
never meets a hybrid index built with other settings):

    manifest.json               the one file that says which versions are the index
    docs/v=<n>/part=<p>/        doc_id, fingerprint             one row per indexed document
    nodes/v=<n>/part=<p>/       node_id, doc_id, pos, text      (windows are built for hits)
    forward/v=<n>/part=<p>/     node_id, doc_id, pos, terms, tfs, dl
    vectors/v=<n>/part=<p>/     node_id, doc_id, vector
    postings/v=<n>/bucket=<b>/  blocks of a term's postings     (``operators/postings.py``)
    df/v=<n>/, stats/v=<n>/     term, df; n, avgdl, total       whole, of the newest version

``part = pmod(xxhash64(doc_id), P)``. An update (A6) works per document: documents whose
(doc_id, fingerprint) is not in ``docs`` are chunked and embedded, and all old rows of a
changed, emptied or removed document go. It writes one layer, as the next version: new
documents as they are, and anew each partition that loses old rows; the manifest then names,
for each older layer, the partitions that were replaced. So documents that are only added
cost what they add. Newer layers of less than twice the documents of the update are merged
into it, so that there are never more layers than doublings of the corpus. ``df`` and
``stats`` follow from the old ones and the rows rewritten.

Snapshots: no file that a manifest names is ever changed. The manifest is written beside the
old one and renamed over it in one step, so an update that dies anywhere leaves the index as
it was, and a reader that opened the index before an update keeps reading the version it
opened. Versions that neither the manifest nor the one before it names are deleted after each
update (a reader may be one update behind). One writer at a time. Running an update twice
changes nothing. When the corpus has outgrown the partitions four times over, the next full
update writes everything as one layer of more of them.

A stream's updates (A7, ``streaming/ingest.py``) name their batch in the manifest, so that a
replayed batch is recognised.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import RagConfig
from quarry.operators.chunk import chunk, fingerprint
from quarry.operators.embed import Embedder
from quarry.operators.index import TextIndex, build_forward, build_vectors, corpus_stats, doc_freq
from quarry.operators.postings import BLOCK_FIELDS, BUCKETS, build_blocks, expand_blocks
from quarry.session import delete_path, list_path, open_files, path_exists, read_file, replace_file, settle, shared_path


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()
_PART = (("v", _INT), ("part", _INT))
DOCS_SCHEMA = _schema(("doc_id", _LONG), ("fingerprint", _STR), *_PART)
NODES_SCHEMA = _schema(("node_id", _STR), ("doc_id", _LONG), ("pos", _INT), ("text", _STR), *_PART)
VECTORS_SCHEMA = _schema(("node_id", _STR), ("doc_id", _LONG), ("vector", T.ArrayType(T.DoubleType())), *_PART)
FORWARD_SCHEMA = _schema(("node_id", _STR), ("doc_id", _LONG), ("pos", _INT), ("terms", T.ArrayType(_STR)),
                         ("tfs", T.ArrayType(_INT)), ("dl", _INT), *_PART)
POSTINGS_SCHEMA = _schema(*BLOCK_FIELDS, ("v", _INT), ("bucket", _INT))
DF_SCHEMA = _schema(("term", _STR), ("df", _LONG))
STATS_SCHEMA = _schema(("n", _LONG), ("avgdl", T.DoubleType()), ("total", _LONG))

#: Tables kept by document partition.
TABLES = {"docs": DOCS_SCHEMA, "nodes": NODES_SCHEMA, "forward": FORWARD_SCHEMA, "vectors": VECTORS_SCHEMA}
MANIFEST = "manifest.json"


@dataclass
class Layer:
    """What one version wrote: its documents, the partitions that hold them, those replaced since."""

    v: int
    docs: int
    parts: list[int]
    dead: list[int] = field(default_factory=list)


@dataclass
class Manifest:
    version: int
    parts: int
    buckets: int
    layers: list[Layer]
    before: list[int] = field(default_factory=list)    # versions that the manifest before this one named
    batches: dict[str, int] = field(default_factory=dict)  # last batch taken in from each stream

    def named(self) -> list[int]:
        return sorted({self.version, *(x.v for x in self.layers)})

    def text(self) -> str:
        return json.dumps(self, default=lambda x: x.__dict__)

    @classmethod
    def of(cls, text: str) -> "Manifest":
        raw = json.loads(text)
        return cls(**{**raw, "layers": [Layer(**x) for x in raw["layers"]]})

    def live(self) -> Column:
        """Rows of tables with (v, part) that belong to this snapshot."""
        return self.live_where(F.col("v"), F.col("part"))

    def live_where(self, v: Column, part: Column) -> Column:
        keep = F.lit(False)
        for layer in self.layers:
            mine = v == layer.v
            keep = keep | (mine & ~part.isin(layer.dead) if layer.dead else mine)
        return keep

    def mergeable(self, docs: int) -> list[int]:
        """The newest layers that an update of so many documents takes in."""
        taken = []
        for layer in reversed(self.layers):
            if layer.docs >= 2 * docs:
                break
            taken.append(layer.v)
            docs += layer.docs
        return taken

    def after(self, layer: Layer, replaced: list[int], merged: list[int]) -> "Manifest":
        """The manifest once a layer has been written that replaces partitions and whole layers."""
        older = [Layer(x.v, x.docs, x.parts, sorted({*x.dead, *replaced} & set(x.parts)))
                 for x in self.layers if x.v not in merged]
        return Manifest(layer.v, self.parts, self.buckets, [*(x for x in older if len(x.dead) < len(x.parts)), layer], self.named(),
                        dict(self.batches))


def default_index_path(spark: SparkSession, name: str, cfg: RagConfig, embedder: Embedder | None = None) -> str:
    emb = (embedder.name if embedder else "hashed-bow").replace("/", "_")
    return shared_path(spark, "quarry-index", f"{name}-{emb}-{cfg.index_fingerprint()}")


def part_of(doc_id, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id) if isinstance(doc_id, str) else doc_id), F.lit(parts)).cast("int")


TARGET_PART_BYTES = 256 * 1024 * 1024
REGROW = 4


def choose_parts(docs: DataFrame) -> int:
    """Partitions for an index: about 256 MB of source text each, a power of two.
    From the planner's size estimate (no job)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << max(0, -(-size // TARGET_PART_BYTES) - 1).bit_length()


def committed(spark: SparkSession, path: str) -> bool:
    """Whether there is an index: every build and update ends with its manifest."""
    return path_exists(spark, f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest.of(read_file(spark, f"{path}/{MANIFEST}"))


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    replace_file(spark, f"{path}/{MANIFEST}", manifest.text())


def clean(spark: SparkSession, path: str) -> list[int]:
    """Delete the versions that neither the manifest nor the one before it names."""
    manifest = read_manifest(spark, path)
    keep = {*manifest.named(), *manifest.before}
    gone = set()
    for table in (*TABLES, "postings", "df", "stats"):
        for name in list_path(spark, f"{path}/{table}"):
            if name.startswith("v=") and int(name[2:]) not in keep:
                delete_path(spark, f"{path}/{table}/{name}")
                gone.add(int(name[2:]))
    return sorted(gone)


def _read(spark: SparkSession, path: str, name: str, schema: T.StructType, versions) -> DataFrame:
    """The named versions of a table. Partition columns come from the folders' names; df and stats have none."""
    paths = [f"{path}/{name}/v={v}" for v in versions]
    for full in paths:
        if not path_exists(spark, full):
            raise FileNotFoundError(f"the index at {path} has no table {name}")
    base = f"{path}/{name}" if "v" in schema.fieldNames() else paths[0]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


def _live(spark: SparkSession, path: str, name: str, manifest: Manifest) -> DataFrame:
    return _read(spark, path, name, TABLES[name], [x.v for x in manifest.layers]).filter(manifest.live())


def load_index(spark: SparkSession, path: str, cfg: RagConfig, embedder: Embedder | None = None) -> TextIndex:
    """A5: the index that the manifest names now, with explicit schemas (no inference)."""
    manifest = read_manifest(spark, path)
    tables = {n: _live(spark, path, n, manifest) for n in ("nodes", "forward", "vectors")}
    blocks = _read(spark, path, "postings", POSTINGS_SCHEMA, [x.v for x in manifest.layers])
    dead = any(x.dead for x in manifest.layers)

    def live_posting(v: Column, doc_id: Column) -> Column:
        return manifest.live_where(v, part_of(doc_id, manifest.parts)) if dead else F.lit(True)

    return TextIndex(
        nodes=tables["nodes"].drop("v"), forward=tables["forward"].drop("v"), vectors=tables["vectors"].drop("v", "part"),
        postings=expand_blocks(blocks, cfg, live_posting).drop("v"), blocks=blocks, live_posting=live_posting,
        df=_read(spark, path, "df", DF_SCHEMA, [manifest.version]),
        stats=_read(spark, path, "stats", STATS_SCHEMA, [manifest.version]),
        cfg=cfg, embedder=embedder or Embedder(dim=cfg.layout.dim), parts=manifest.parts, buckets=manifest.buckets)


def indexed_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, fingerprint of the documents that the index holds."""
    return _live(spark, path, "docs", read_manifest(spark, path)).select("doc_id", "fingerprint")


WRITE_SALT = 64


def _write_parts(df: DataFrame, full: str, spread: bool) -> None:
    # what is derived from a table that lies by part already is written where it is read, unsorted:
    # a sort by part would hold, and spill, a task's vectors
    if not spread:
        with open_files(df.sparkSession):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(full)
        return
    # REBALANCE on (part, salt): AQE merges small shuffle partitions and splits
    # big ones, so files stay task-sized at any scale. The salt (a hash of the
    # node, else the document) spreads one partition value -- or one huge
    # document -- over many files, so even a small table is read by several
    # tasks and a hot partition is never one writer.
    key = "node_id" if "node_id" in df.columns else "doc_id"
    df.withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(WRITE_SALT))) \
        .hint("rebalance", "part", "_salt").drop("_salt") \
        .write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(full)


def _write_layer(spark: SparkSession, path: str, v: int, docs: DataFrame, kept: dict[str, DataFrame], cfg: RagConfig,
                 embedder: Embedder, parts: int, buckets: int) -> DataFrame:
    """All tables of a layer: ``docs`` (doc_id, text, fingerprint) chunked, tokenised and embedded,
    and the kept rows of the tables as they are. Returns the forward table as written."""
    def write(name: str, df: DataFrame) -> DataFrame:
        columns = [c for c in TABLES[name].fieldNames() if c not in ("v", "part")]
        rows = df.withColumn("part", part_of("doc_id", parts)).select(*columns, "part")
        if name in kept:
            rows = rows.unionByName(kept[name].select(*columns, "part"))
        _write_parts(rows, f"{path}/{name}/v={v}", spread=bool(kept) or name in ("nodes", "docs"))
        return _read(spark, path, name, TABLES[name], [v])

    # new nodes and their terms are written once; the layer's tables, kept rows included, follow from them
    nodes = settle(chunk(docs, cfg, windows=False).drop("window"), "new-nodes") if kept else None
    if nodes is None:
        nodes = write("nodes", chunk(docs, cfg, windows=False))
        forward = write("forward", build_forward(nodes, cfg))
        fresh = forward
    else:
        write("nodes", nodes)
        fresh = settle(build_forward(nodes, cfg), "new-forward")
        forward = write("forward", fresh)
    write("vectors", build_vectors(nodes, fresh, cfg, embedder))
    with open_files(spark):  # a task's blocks come bucket by bucket
        build_blocks(forward, buckets).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/v={v}")
    write("docs", docs)
    return forward


def _write_aggregates(spark: SparkSession, path: str, v: int, forward: DataFrame, old: tuple | None) -> None:
    """df and stats of version v: of a whole layer, or the old ones plus what the touched
    partitions hold now and minus what they held (``old``: df, stats, their rows before).
    A layer's blocks count the postings of its terms, so its df is summed over them."""
    now = corpus_stats(forward)
    blocks = _read(spark, path, "postings", POSTINGS_SCHEMA, [v])
    dfs = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    if old is not None:
        old_df, old_stats, before = old
        change = dfs.select("term", "df").unionByName(doc_freq(before).select("term", (-F.col("df")).alias("df")))
        dfs = old_df.unionByName(change).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        was = corpus_stats(before)
        sums = old_stats.select("n", "total").unionByName(now.select("n", "total")) \
            .unionByName(was.select((-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
        now = sums.agg(F.sum("n").alias("n"), F.sum("total").alias("total")) \
            .select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avgdl"), "total")
    dfs.select("term", "df").write.mode("overwrite").parquet(f"{path}/df/v={v}")
    now.select("n", "avgdl", "total").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/v={v}")


def _parts_wanted(docs: DataFrame, cfg: RagConfig) -> int:
    return cfg.layout.partitions if cfg.layout.partitions > 0 else choose_parts(docs)


def _same(*columns: str) -> Column:
    """Equality of (column, column of the other side under the name _column); nulls are equal."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def _without(left: DataFrame, right: DataFrame, *columns: str, how: str = "left_anti") -> DataFrame:
    return left.join(right.select(*(F.col(c).alias(f"_{c}") for c in columns)), _same(*columns), how)


def upsert_index(spark: SparkSession, docs: DataFrame, path: str, cfg: RagConfig,
                 embedder: Embedder | None = None, whole: bool = True, batch: tuple[str, int] | None = None) -> dict:
    """Bring the index at ``path`` in line with ``docs``.

    ``whole``: docs is the full corpus, and documents that are not in it leave the index;
    otherwise (A7) they stay, and docs are only added or replaced. ``batch``: (stream, number)
    to note in the manifest. Returns counts: {"changed": documents (re)indexed, "removed":
    documents dropped, "touched_parts": partitions written}.
    """
    embedder = embedder or Embedder(dim=cfg.layout.dim)
    have = read_manifest(spark, path) if committed(spark, path) else None
    want = cfg.layout.partitions if cfg.layout.partitions > 0 else choose_parts(docs)
    if have is None or (whole and cfg.layout.partitions <= 0 and want >= REGROW * have.parts):
        return _build(spark, docs, path, cfg, embedder, want, have, batch)
    p, v = have.parts, have.version + 1
    current = docs.select("doc_id", "text").withColumn("fingerprint", fingerprint("text"))
    known = indexed_documents(spark, path)
    differ = _without(current, known, "doc_id", "fingerprint").select("doc_id")
    if whole:
        differ = differ.unionByName(_without(known, current, "doc_id", "fingerprint").select("doc_id"))
    # the difference is written once; everything below reads it
    differ = settle(differ.distinct().withColumn("part", part_of("doc_id", p)), "differ")
    changed = settle(_without(current, differ, "doc_id", how="left_semi"), "changed")
    old_ids = settle(_without(differ, known, "doc_id", how="left_semi"), "old-ids")
    changed_n, removed_n = changed.count(), _without(differ, changed, "doc_id").count()
    # bounded: at most P distinct partition numbers
    written = sorted(r["part"] for r in differ.select("part").distinct().collect())
    manifest = have
    if written:
        replaced = sorted(r["part"] for r in old_ids.select("part").distinct().collect())
        merged = have.mergeable(changed_n)
        again = F.col("part").isin(replaced) | F.col("v").isin(merged)
        kept = {n: _without(_live(spark, path, n, have).filter(again), old_ids, "doc_id") for n in TABLES}
        forward = _write_layer(spark, path, v, changed, kept, cfg, embedder, p, have.buckets)
        before = (_read(spark, path, "df", DF_SCHEMA, [have.version]), _read(spark, path, "stats", STATS_SCHEMA, [have.version]),
                  _live(spark, path, "forward", have).filter(again))
        _write_aggregates(spark, path, v, forward, before)
        manifest = have.after(_layer(spark, path, v), replaced, merged)
    if written or batch is not None:
        if batch is not None:
            manifest.batches[batch[0]] = batch[1]
        _commit(spark, path, manifest)
        clean(spark, path)
    return {"changed": changed_n, "removed": removed_n, "touched_parts": len(written)}


def _layer(spark: SparkSession, path: str, v: int) -> Layer:
    """What a written version holds: at most P rows come to the driver."""
    rows = _read(spark, path, "docs", DOCS_SCHEMA, [v]).groupBy("part").count().collect()
    return Layer(v, sum(r["count"] for r in rows), sorted(r["part"] for r in rows))


def _build(spark: SparkSession, docs: DataFrame, path: str, cfg: RagConfig, embedder: Embedder, parts: int,
           have: Manifest | None, batch: tuple[str, int] | None) -> dict:
    """The whole index as one layer; an index that is there stays readable until the manifest is replaced."""
    v = have.version + 1 if have else 1
    current = docs.select("doc_id", "text").withColumn("fingerprint", fingerprint("text"))
    buckets = max(BUCKETS, parts)
    forward = _write_layer(spark, path, v, current, {}, cfg, embedder, parts, buckets)
    _write_aggregates(spark, path, v, forward, None)
    layer = _layer(spark, path, v)
    manifest = Manifest(v, parts, buckets, [layer], have.named() if have else [], dict(have.batches) if have else {})
    if batch is not None:
        manifest.batches[batch[0]] = batch[1]
    _commit(spark, path, manifest)
    clean(spark, path)
    return {"changed": layer.docs, "removed": 0, "touched_parts": parts}


def ensure_index(spark: SparkSession, docs: DataFrame, name: str, cfg: RagConfig,
                 embedder: Embedder | None = None, path: str | None = None,
                 refresh: bool = True) -> TextIndex:
    """Build or update (A6), then load (A5).

    ``refresh=False`` loads a committed index without looking at the documents,
    so it may be out of date: the update fingerprints the whole corpus.
    """
    path = path or default_index_path(spark, name, cfg, embedder)
    if refresh or not committed(spark, path):
        upsert_index(spark, docs, path, cfg, embedder)
    return load_index(spark, path, cfg, embedder)
