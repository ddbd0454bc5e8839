"""Fill-in-the-middle transformation as a pyarrow.compute pipeline.

A text is cut into units (a run of A-Z a-z, or one other code point). Two draws from the
document's id cut the units into prefix, middle and suffix, a third says whether the text is
transformed at all and a fourth in which order the pieces stand. Per batch: a mark that no
UTF-8 text holds is put behind every unit and the texts are split there into list arrays;
the lists are flattened with their parent indices, each unit gets its ordinal, the units are
filtered by role, the filtered units become lists again and are joined to pieces, and the
pieces are joined to outputs. ``restore`` undoes it from output and form alone.

Nothing is shuffled. Batches are cut into chunks of ``CHUNK`` bytes (a longer text is a
chunk of its own), with 64-bit offsets.

Defined cases: a null text is empty, and empty texts are plain; a null id draws as the
empty string does; rows that share an id draw alike, each row on its own text; texts that
hold a marker are plain; other columns are ignored (their names cannot clash: only id and
text are read); an empty table gives no rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, prepare, text_buffer

#: The markers, and the shares (of 100) of transformed texts and of the spm order among them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SPM = 90, 20
SEED = "1"
CHUNK = 1 << 20
#: The units in UTF-8 bytes (the binary kernels match bytes), and a byte that no UTF-8 text holds.
UNIT = r"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*"
MARK = b"\xff"

_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_OUT_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def draws(id_col: str = "doc_id"):
    """h1 to h4: the first four 8-digit groups of the hex SHA-256 of ``1:`` and the id."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _lists(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), flat)


def _join(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    return pc.binary_join(_lists(flat, counts), pa.scalar(b"", pa.large_binary()))


def _text(data: pa.Array) -> pa.Array:
    return data.cast(pa.large_string())


def transform(text: pa.Array, h: list[np.ndarray]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a chunk of texts (large_binary)."""
    marked = pc.replace_substring_regex(text, pattern=UNIT, replacement=b"\\0" + MARK)
    lists = pc.split_pattern(marked, pattern=MARK)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(units), 0)  # each text ends with a mark, so with an empty piece
    units, parents = units.filter(real), parents.filter(real)
    n = np.bincount(parents.to_numpy(), minlength=len(text)).astype(np.int64)
    first = pa.array(np.cumsum(n) - n)
    ordinal = pc.subtract(pa.array(np.arange(len(units), dtype=np.int64)), first.take(parents))

    cut1, cut2 = h[0] % (n + 1), h[1] % (n + 1)
    start, end = np.minimum(cut1, cut2), np.maximum(cut1, cut2)
    before = pc.less(ordinal, pa.array(start).take(parents))
    after = pc.greater_equal(ordinal, pa.array(end).take(parents))
    inside = pc.invert(pc.or_(before, after))
    prefix, middle, suffix = (_join(units.filter(role), counts) for role, counts in
                              ((before, start), (inside, end - start), (after, n - end)))

    marker = pc.or_(pc.or_(pc.match_substring(text, PREFIX), pc.match_substring(text, SUFFIX)),
                    pc.match_substring(text, MIDDLE))
    plain = pc.or_(pc.or_(pc.equal(pc.binary_length(text), 0), marker), pa.array(h[2] % 100 >= TRANSFORMED))
    spm = pa.array(h[3] % 100 < SPM)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    p, s, m, none = (pa.scalar(x, pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE, b""))
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text))
    absent = pa.scalar(None, pa.int64())
    lengths = [pc.if_else(plain, absent, pc.utf8_length(_text(x)).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n), form, *lengths, _text(output)]


def _pieces(text: pa.Array, markers: tuple) -> list[pa.Array]:
    """What follows each marker; the pieces hold none, so the first one found is the real one."""
    pieces = []
    for marker in markers:
        halves = pc.split_pattern(text, pattern=marker, max_splits=1)
        pieces.append(pc.list_element(halves, 0))
        text = pc.list_element(halves, 1)
    return [*pieces[1:], text]


def undo(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts (large_binary) that ``transform`` was given."""
    none = pa.scalar(b"", pa.large_binary())
    order, parts = [], []
    for kind in ("plain", "psm", "spm"):
        chosen = pc.equal(form, kind)
        at, some = pc.indices_nonzero(chosen), output.filter(chosen)
        if not len(some):
            continue
        if kind == "psm":
            prefix, suffix, middle = _pieces(some, (PREFIX, SUFFIX, MIDDLE))
        elif kind == "spm":
            suffix, prefix, middle = _pieces(some, (SUFFIX, PREFIX, MIDDLE))
        order.append(at)
        parts.append(some if kind == "plain" else pc.binary_join_element_wise(prefix, middle, suffix, none))
    if not parts:
        return output
    return pa.concat_arrays(parts).take(pc.sort_indices(pa.concat_arrays(order)))


def _binary(column: pa.Array) -> pa.Array:
    wide = column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())
    return pc.fill_null(wide, "").cast(pa.large_binary())


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = text_buffer(batch.column("text"))
        for i, j in chunks(offsets, CHUNK):
            part = batch.slice(i, j - i)
            h = [part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            done = transform(_binary(part.column("text")), h)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *done], names=_OUT_NAMES)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = undo(_binary(batch.column("output")), batch.column("form"))
        yield pa.RecordBatch.from_arrays([*batch.columns, _text(text)], names=[*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text as ``output``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws(id_col))
    return rows.mapInArrow(_forward, _OUT)


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the text rebuilt from output and form as ``restored``."""
    prepare(transformed.sparkSession)
    return transformed.select(*_OUT_NAMES).mapInArrow(_backward, f"{_OUT}, restored string")
