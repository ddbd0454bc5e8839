"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

Texts are split by the tokenizer's pattern and dictionary-encoded in blocks of about
``BLOCK`` bytes: a block's row holds its documents' lengths, a code for each occurrence, and
its distinct words once, packed by hash bucket. Only these packs are shuffled. A bucket brings
the blocks' words together and each distinct word of the table is encoded once, by Spark's
higher-order functions: its bytes are an array of one-byte tokens, and a fold merges, step by
step, the leftmost adjacent pair of the lowest rank; the ranks are a literal map. The ids go
back to the blocks that hold the word, where they are put in the places of the codes. Decoding
maps ids to their binary pieces and concatenates them. The number of buckets follows the
table's size; a common word is one entry of each block, however often it occurs.

The literal map is keyed by pairs of tokens: every cut of a token into two tokens, so that a
pair is found exactly if its bytes are a token. It is an array of short lists, chosen by the
key's remainder, as Spark searches a map from its first key to its last. A fold copies its
arrays in every step, so words of more than ``LONGEST_FOLD`` bytes (runs without a space, as
in encoded data) take the same merges through a heap instead. The character classes of the
pattern are those of the installed tiktoken library (they depend on its Unicode version),
read from it once on the driver.

Defined cases: a null text is empty and has no ids; a null id stays null; rows that share
an id or a text are rows of their own; a text longer than a block is a block alone; an empty
table gives no rows; other columns are ignored (only id and text are read).
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import partitions, prepare
from quarry.session import shared_path

#: Bytes of text in a block, bytes of input for each bucket, words put together at a time, bytes of a word that the fold
#: takes, lists that the rank map is cut into (a prime).
BLOCK, BUCKET, PIECE, LONGEST_FOLD, SHARDS = 16 << 20, 4 << 20, 1 << 19, 1024, 16381

_BLOCKS = ("block long, ids array<long>, lengths array<int>, codes binary, homes binary, "
           "packs array<struct<bucket:int,words:binary>>")
_BUCKETS = "words array<string>, uses array<struct<block:long,bucket:int,ids:binary>>"
_TOKENS = "home long, bucket int, counts binary, flat binary"
_DONE = "doc_id long, n_tokens long, ids array<int>, packed binary"


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@functools.cache
def class_differences() -> dict[str, tuple[set[str], set[str]]]:
    """For the classes L and N: characters that only the ``regex`` module has in it, and only tiktoken."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    out = {}
    for name in ("L", "N"):
        exact = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
        theirs = set(exact.decode_bytes(exact.encode_ordinary(every)).decode())
        ours = set(regex.findall(rf"\p{{{name}}}", every))
        out[name] = ours - theirs, theirs - ours
    return out


def splitter(pattern: str):
    """(regex, characters, regex): the pattern as it stands, for texts without any of the characters
    that the two libraries class apart, and with tiktoken's classes written out, for the others."""
    differing, exact = set(), pattern
    for name, (less, more) in class_differences().items():
        differing |= less | more
        written = rf"[\p{{{name}}}{_class(more)}--[{_class(less)}]]" if less else rf"[\p{{{name}}}{_class(more)}]"
        exact = exact.replace(rf"\p{{{name}}}", written)
    return pattern, differing, f"(?V1){exact}"


def ascii_splitter(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII characters alone, where the classes are plain lists, for the standard
    library's matcher, which is faster; None if the pattern has anything else that the two may read apart."""
    if not set(re.findall(r"\\[pP]\{\w+\}|\\.|\(\?.|&&|\|\||--|~~|\[\[|[+*?}]\+|\[:", pattern)) <= {r"\p{L}", r"\p{N}", r"\s", r"\S", "(?!"}:
        return None
    inside = lambda s: s.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    written = re.sub(r"\[[^\]]*\]", lambda m: inside(m[0]), pattern)
    written = re.sub(r"\\p\{[LN]\}", lambda m: f"[{inside(m[0])}]", written)
    return re.compile(written, re.ASCII)


def _class(chars: set[str]) -> str:
    points, out, i = sorted(map(ord, chars)), [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


def _pack(pattern: str, buckets: int):
    """Blocks of dictionary-encoded words, the words packed by bucket."""
    usual, differing, exact = splitter(pattern)
    plain = ascii_splitter(pattern)

    def run(batches):
        import regex

        fast, slow = regex.compile(usual).findall, regex.compile(exact).findall
        ascii_only = plain.findall if plain else fast
        part, seq = TaskContext.get().partitionId(), 0
        ids, codes, lengths, size, known = [], [], [], 0, defaultdict()
        known.default_factory = known.__len__  # a new word's code is the number of those before

        def block():
            flat = np.concatenate(codes)
            often = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")  # small codes for common words
            code = np.empty(len(known), np.uint32)
            code[often] = np.arange(len(known))
            words = np.array([*known, None], dtype=object)[often]
            homes = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint32, len(known)) % np.uint32(buckets)
            order = np.argsort(homes, kind="stable")
            used, starts = np.unique(homes[order], return_index=True)
            packs = [{"bucket": int(b), "words": _crush(json.dumps(w.tolist()))}
                     for b, w in zip(used, np.split(words[order], starts[1:]))]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
                 pa.array([_squeeze(code[flat])], pa.binary()), pa.array([_squeeze(homes)], pa.binary()),
                 pa.array([packs], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))],
                names=["block", "ids", "lengths", "codes", "homes", "packs"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if size and size + len(text) > BLOCK:
                    yield block()
                    ids, codes, lengths, size, seq = [], [], [], 0, seq + 1
                    known.clear()
                words = ascii_only(text) if text.isascii() else fast(text) if differing.isdisjoint(text) else slow(text)
                codes.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                lengths.append(len(words))
                size += len(text) + 1
        if ids:
            yield block()
        known.default_factory = None  # which refers to the dictionary itself

    return run


def _crush(text: str) -> bytes:
    data = text.encode()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _uncrush(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    return pa.Codec("zstd", 3).compress(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed, as they are written and shuffled: a byte for each (255: 255
    or more), then the byte planes of what is left of the large ones."""
    first = np.minimum(numbers, 255).astype(np.uint8)
    large = numbers[first == 255].astype(np.uint32) - np.uint32(255)
    head = pa.Codec("zstd", 3).compress(first.tobytes(), asbytes=True)
    return b"".join([*(x.to_bytes(8, "little") for x in (len(first), len(head), len(large))), head, _planes(large)])


def _spread(data: bytes) -> np.ndarray:
    n, size, m = (int.from_bytes(data[i:i + 8], "little") for i in (0, 8, 16))
    codec = pa.Codec("zstd")
    first = np.frombuffer(codec.decompress(data[24:24 + size], n, asbytes=True), np.uint8)
    planes = np.frombuffer(codec.decompress(data[24 + size:], 4 * m, asbytes=True), np.uint8)
    numbers = first.astype(np.uint32)
    numbers[first == 255] += np.ascontiguousarray(planes.reshape(4, m).T).view(np.uint32).ravel()
    return numbers


def _gather(table: pa.Table) -> pa.Table:
    """A bucket's distinct words, and for each block's pack the places of its words among them."""
    known = defaultdict()
    known.default_factory = known.__len__
    uses = []
    for row in table.to_pylist():
        words = json.loads(_uncrush(row["words"]))
        places = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        uses.append({"block": row["block"], "bucket": row["bucket"], "ids": _squeeze(places)})
    use = pa.struct([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])
    known.default_factory = None  # which refers to the dictionary itself
    return pa.table([pa.array([list(known)], pa.list_(pa.string())), pa.array([uses], pa.list_(use))], names=["words", "uses"])


def _return(ranks: dict[bytes, int]):
    """Each pack's tokens, for its block: how many for each word, and the ids one after the other."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lists = batch.column("tokens")[row].values
                long_words = batch.column("long_words")[row].as_py()
                if long_words:  # in the places that the fold left out
                    ids = lists.to_pylist()
                    for place, word in zip(np.flatnonzero(lists.is_null()), long_words):
                        ids[place] = merge_by_heap(word.encode(), ranks)
                    lists = pa.array(ids, pa.list_(pa.int32()))
                for use in batch.column("uses")[row].as_py():
                    mine = lists.take(pa.array(_spread(use["ids"])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([use["block"]]), pa.array([use["bucket"]], pa.int32()),
                         pa.array([_squeeze(mine.value_lengths().to_numpy())], pa.binary()),
                         pa.array([_squeeze(mine.flatten().to_numpy())], pa.binary())], names=["home", "bucket", "counts", "flat"])

    return run


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of every pair of tokens whose bytes together are a token."""
    return {(ranks[piece[:cut]], ranks[piece[cut:]]): rank for piece, rank in ranks.items()
            for cut in range(1, len(piece)) if piece[:cut] in ranks and piece[cut:] in ranks}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal: pairs and their ranks, sharded by the pair's key; the ids of the 256 bytes and the ranks of
    two bytes (at 256 * first + second)."""
    shards: list[tuple[list, list]] = [([], []) for _ in range(SHARDS)]
    for (left, right), rank in pair_ranks(ranks).items():
        key = (left << 32) + right
        shards[key % SHARDS][0].append(key)
        shards[key % SHARDS][1].append(rank)
    literal = {"pairs": [s[0] for s in shards], "ranks": [s[1] for s in shards], "bytes": [ranks[bytes([b])] for b in range(256)],
               "two": [ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]}
    return F.from_json(F.lit(json.dumps(literal, separators=(",", ":"))),
                       "pairs array<array<bigint>>, ranks array<array<int>>, bytes array<int>, two array<int>")


def pair_rank(table: Column, left: Column, right: Column) -> Column:
    """Null where the pair's bytes are no token, or one of the two is null."""
    key = F.shiftleft(left.cast("long"), 32) + right
    shard = F.pmod(key, F.lit(SHARDS)).cast("int")
    return F.get(F.get(table["ranks"], shard), (F.array_position(F.get(table["pairs"], shard), key) - 1).cast("int"))


def encode_word(word: Column, table: Column) -> Column:
    """array<int>: the fold of ranked merges over the word's bytes.

    The state holds the tokens and, for each, the rank of the pair it starts; both begin with
    a place that pairs with nothing, so that every merge has a neighbour to its left."""
    none, rest = F.lit(-1), F.lit(2 ** 30)

    def step(state: Column, _turn: Column) -> Column:
        tokens, ranks = state["tokens"], state["ranks"]
        least = F.array_min(ranks)

        def merged(at: Column) -> Column:
            beside = F.array(pair_rank(table, F.get(tokens, at - 2), least), pair_rank(table, least, F.get(tokens, at + 1)))
            return F.struct(F.concat(F.slice(tokens, 1, at - 1), F.array(least), F.slice(tokens, at + 2, rest)).alias("tokens"),
                            F.concat(F.slice(ranks, 1, at - 2), beside, F.slice(ranks, at + 2, rest)).alias("ranks"))

        return F.when(least.isNull(), state).otherwise(_let(F.array_position(ranks, least).cast("int"), merged))

    def fold(data: Column) -> Column:
        tokens = F.concat(F.array(none), F.transform(data, lambda b: F.get(table["bytes"], b)))
        ranks = F.concat(F.array(F.lit(None).cast("int")),
                         F.transform(data, lambda b, i: F.get(table["two"], b * 256 + F.get(data, i + 1))))
        turns = F.slice(data, 2, rest)  # as many merges as there can be
        return F.aggregate(turns, F.struct(tokens.alias("tokens"), ranks.alias("ranks")), step,
                           lambda s: F.slice(s["tokens"], 2, rest))

    return _let(bytes_of(F.encode(word, "UTF-8")), fold)


def bytes_of(data: Column) -> Column:
    """array<int>: the bytes of a binary, read through the character set that has one for each."""
    return F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), F.ascii)


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: neighbours as a linked list, pairs in a heap by (rank, place)."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # piece i is word[i:end[i]]; its neighbours
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    live = bytearray([1]) * n
    while heap:
        _rank, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two has changed since
        live[end[i]] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    return [ranks[word[i:end[i]]] for i in range(n) if live[i]]


def _assemble(block: pa.Table, packs: pa.Table) -> pa.Table:
    """Ids of a block's documents, from its codes and the ids of its words."""
    homes = _spread(block["homes"][0].as_py())
    packs = packs.sort_by("bucket")
    none = np.empty(0, np.uint32)
    counts_by_bucket = np.concatenate([none, *map(_spread, packs["counts"].to_pylist())]).astype(np.int64)
    tokens = np.concatenate([none, *map(_spread, packs["flat"].to_pylist())])
    order = np.argsort(homes, kind="stable")  # a bucket's words stand in the order of their codes
    counts, starts = np.empty(len(homes), np.int64), np.empty(len(homes), np.int64)
    counts[order] = counts_by_bucket
    starts[order] = np.cumsum(counts_by_bucket) - counts_by_bucket
    codes = _spread(block["codes"][0].as_py())
    lengths = block["lengths"][0].values.to_numpy()
    words = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))  # before each document
    ids, done, i = block["ids"][0].values, [], 0
    while i < len(lengths):  # some documents at a time, a longer one alone
        j = max(i + 1, int(np.searchsorted(words, words[i] + PIECE, side="right")) - 1)
        part = codes[words[i]:words[j]]
        each = counts[part]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.arange(ends[-1]) + np.repeat(starts[part] - ends[:-1], each)
        flat = tokens[at].astype("<i4")
        offsets = ends[words[i:j + 1] - words[i]]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets * 4), pa.py_buffer(flat)])
        done.append(pa.RecordBatch.from_arrays(
            [ids[i:j], pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
             raw.cast(pa.binary())], schema=_DONE_SCHEMA))
        i = j
    return pa.Table.from_batches(done, schema=_DONE_SCHEMA)


_DONE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                          ("packed", pa.binary())])


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and the ids as little-endian unsigned 32-bit integers (``packed``)."""
    spark = docs.sparkSession
    prepare(spark)
    ranks = read_ranks(rank_file)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tasks, size = partitions(spark), int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # the planner's estimate, which for rows that come from no file is no number of bytes
    buckets = max(4 * tasks, size // BUCKET if known else 0)
    # written in buckets of the block number by the tasks that made them: the blocks are not moved again
    name = f"llm_bpe_{uuid.uuid4().hex}"
    rows.mapInArrow(_pack(pattern, buckets), _BLOCKS).write.format("parquet").option("path", shared_path(spark, "llm", name)) \
        .bucketBy(max(tasks, size // BLOCK if known else 0), "block").saveAsTable(name)
    blocks = spark.table(name)
    packs = blocks.select("block", F.explode("packs").alias("p")).select("block", "p.bucket", "p.words")
    # folding costs far more than its bytes: a number of tasks that is not made smaller for them
    gathered = packs.repartition(max(tasks, buckets // 4), "bucket").groupBy("bucket").applyInArrow(_gather, _BUCKETS)
    short = lambda w: F.octet_length(w) <= LONGEST_FOLD
    tokens = _let(rank_map(ranks), lambda table: F.transform("words", lambda w: F.when(short(w), encode_word(w, table))))
    folded = gathered.select("uses", tokens.alias("tokens"), F.filter("words", lambda w: ~short(w)).alias("long_words"))
    back = folded.mapInArrow(_return(ranks), _TOKENS)
    return blocks.drop("packs").groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_assemble, _DONE)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """The rows with the concatenated binary pieces of ``ids`` as ``decoded``."""
    prepare(encoded.sparkSession)
    ranks = read_ranks(rank_file)
    pieces = {rank: piece for piece, rank in ranks.items()}
    listed = json.dumps([base64.b64encode(pieces.get(i, b"")).decode() for i in range(max(pieces) + 1)])
    # strings are bytes to array_join; nothing reads them as characters
    table = F.from_json(F.lit(listed), "array<binary>").cast("array<string>")
    joined = _let(table, lambda t: F.array_join(F.transform("ids", lambda i: t[i]), ""))
    return encoded.withColumn("decoded", joined.cast("binary"))
