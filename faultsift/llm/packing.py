"""Token-id output: documents packed into rows of equal length by best-fit-decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import bounded_batches, raw_bytes, text_slices
from faultsift.llm.bpe import Encoder, gather, vocabulary as loaded

END_OF_TEXT = 256        # after the 256 byte ids
HELD_TOKENS = 16 << 20   # packed together by a task; a longer document is packed by itself
ROWS_AT_ONCE = 256


class Capacities:
    """Rows by the room they have left: a segment tree over 0..length that finds the least room that suffices."""

    def __init__(self, length: int):
        self.base = 1 << (length + 1).bit_length()
        self.tree = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        at = self.base + room
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of a row with the least room of `need` or more, removed; None if there is none."""
        at = self.base + need
        while not self.tree[at]:
            while at & 1:      # a right child: nothing beyond it under its parent
                at >>= 1
            if not at:
                return None
            at += 1            # the right neighbour
        while at < self.base:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.tree[at] = 0
            at >>= 1
            while at and not (self.tree[2 * at] or self.tree[2 * at + 1]):
                self.tree[at] = 0
                at >>= 1
        return row, room


def best_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """The row of each piece: longest pieces first, each into the fullest row that still holds it."""
    free, out, rows = Capacities(length), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = free.take(size)
        if found is None:
            found, rows = (rows, length), rows + 1
        out[i] = found[0]
        if found[1] > size:
            free.put(found[0], found[1] - size)
    return out


def _packed(ids: np.ndarray, sizes: np.ndarray, docs: pa.Array, length: int, pad: int, wide: type, first: int,
            names: list[str]) -> Iterator[pa.RecordBatch]:
    count = np.maximum(-(-sizes // length), 1)
    owner = np.repeat(np.arange(len(sizes)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = turn * length
    size = np.minimum(sizes[owner] - begin, length)
    some = size > 0
    owner, begin, size = owner[some], begin[some], size[some]
    source = (np.cumsum(sizes) - sizes)[owner] + begin
    row = best_fit_decreasing(size, length)
    order = np.argsort(row, kind="stable")
    row, owner, begin, size, source = row[order], owner[order], begin[order], size[order], source[order]
    rows = int(row[-1]) + 1 if len(row) else 0
    for at in range(0, rows, ROWS_AT_ONCE):
        some = slice(np.searchsorted(row, at), np.searchsorted(row, min(at + ROWS_AT_ONCE, rows)))
        n = min(ROWS_AT_ONCE, rows - at)
        own, s = row[some] - at, size[some]
        upto = np.cumsum(s)
        pieces = np.searchsorted(own, np.arange(n + 1))
        start = upto - s
        inside = start - start[pieces[:-1]][own]
        matrix, place = np.full((n, length), pad, wide), np.zeros((n, length), np.dtype("<u2") if length <= 1 << 16 else "<u4")
        to = gather(own * length + inside, s)
        matrix.ravel()[to] = ids[gather(source[some], s)]
        place.ravel()[to] = gather(np.zeros(len(s), np.int64), s)
        ends = (inside + s).astype(np.int32)
        marks = np.insert(ends, pieces[:-1], 0)
        blob = lambda m: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(
            (np.arange(n + 1) * m.itemsize * length).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m))])
        lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([
            pa.array(first + at + np.arange(n)), blob(matrix), blob(place),
            lists(pieces + np.arange(n + 1), pa.array(marks)),
            lists(pieces, docs.take(pa.array(owner[some]))), lists(pieces, pa.array(begin[some]))], names=names)


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("pack_id", T.LongType(), False), T.StructField("ids", T.BinaryType(), False),
        T.StructField("positions", T.BinaryType(), False),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("doc_ids", T.ArrayType(id_type), False),
        T.StructField("starts", T.ArrayType(T.LongType(), False), False)])


def pack(docs: DataFrame, *, length: int = 8192, id_column: str = "doc_id", text_column: str | None = None,
         ids_column: str | None = None, tokenizer: tuple[str, str] | None = None, end_id: int = END_OF_TEXT,
         pad_id: int = 0, vocabulary: int = 257) -> DataFrame:
    """Rows of `length` token ids: pack_id, ids, positions, cu_seqlens, doc_ids and starts.

    Tokens are the ids of `ids_column`, or those that `tokenizer` (path and pattern, as for `bpe.encode`) gives
    `text_column`, or without one its UTF-8 bytes; either way `end_id` follows. A document
    of more than `length` tokens is cut into pieces of `length` and a rest; none is lost. `ids` is a
    matrix row of little-endian 16-bit numbers (32-bit if `vocabulary` needs it), filled up with `pad_id`; `positions`, of 16
    bits up to a length of 65,536, counts from 0 again at every segment; `cu_seqlens` has 0 and the end of every
    segment; `doc_ids` and `starts` say, segment by segment, from which document and which of its tokens on.

    Each task packs its documents in lots of 16 million tokens, by best fit in decreasing order with a
    segment tree over free capacities, so nothing is shuffled and memory is bounded; a pack holds documents of
    one task. Null texts or ids count as empty: the end alone. Repeated rows are packed as often as they come; an empty
    table gives no rows; other columns are not read.
    """
    if (text_column is None) == (ids_column is None):
        raise ValueError("give either text_column or ids_column")
    if tokenizer is not None and text_column is None:
        raise ValueError("a tokenizer needs text_column")
    bounded_batches(docs.sparkSession)
    made = _schema(docs.schema[id_column].dataType)
    wide = np.dtype("<u2") if max(vocabulary, end_id + 1, pad_id + 1) <= 1 << 16 else np.dtype("<u4")

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(tokens with ends, sizes, documents) of some rows."""
        encoder = Encoder(loaded(*tokenizer)) if tokenizer is not None else None
        for batch in batches:
            if text_column is not None:
                for rows, texts in text_slices(batch, "__tokens"):
                    if encoder is not None:
                        flat, sizes = encoder.encode_rows(*raw_bytes(texts))
                        yield _ended(flat, sizes, end_id, wide), sizes + 1, rows.column(0)
                        continue
                    data, offsets = raw_bytes(texts)
                    yield _ended(data, np.diff(offsets), end_id, wide), np.diff(offsets) + 1, rows.column(0)
            else:
                for at in range(0, batch.num_rows, 1000):
                    rows = batch.slice(at, 1000)
                    sizes = rows.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
                    flat = rows.column(1).flatten().to_numpy(zero_copy_only=False)
                    yield _ended(flat, sizes, end_id, wide), sizes + 1, rows.column(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, tokens = TaskContext.get().partitionId() << 40, [], 0
        for lot in lots(batches):
            if held and tokens + len(lot[0]) > HELD_TOKENS:
                for out in _lot(held, length, pad_id, wide, first, made.names):
                    first += out.num_rows
                    yield out
                held, tokens = [], 0
            held.append(lot)
            tokens += len(lot[0])
        if held:
            yield from _lot(held, length, pad_id, wide, first, made.names)

    source = F.col(text_column) if text_column is not None else F.col(ids_column).cast("array<int>")
    return docs.select(F.col(id_column).alias("__id"), source.alias("__tokens")).mapInArrow(run, made)


def _lot(held: list, length: int, pad: int, wide: np.dtype, first: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    ids, sizes = (np.concatenate([lot[i] for lot in held]) for i in (0, 1))
    docs = pa.concat_arrays([lot[2] for lot in held])
    held.clear()
    yield from _packed(ids, sizes, docs, length, pad, wide, first, names)


def _ended(flat: np.ndarray, sizes: np.ndarray, end_id: int, wide: np.dtype) -> np.ndarray:
    return np.insert(flat.astype(wide), np.cumsum(sizes), end_id)


def unpack(packed: DataFrame, *, length: int = 8192, vocabulary: int = 257) -> DataFrame:
    """(doc_id, start, tokens): the segments of packed rows, as arrays; those of a document, in order of
    `start`, are its tokens and the end."""
    wide = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    made = T.StructType([T.StructField("doc_id", packed.schema["doc_ids"].dataType.elementType),
                         T.StructField("start", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[row].as_py(), wide)
                marks = batch.column(1)[row].values.to_numpy()
                yield pa.RecordBatch.from_arrays([
                    batch.column(2)[row].values, batch.column(3)[row].values,
                    pa.ListArray.from_arrays(pa.array(marks), pa.array(ids[:marks[-1]].astype(np.int32)))],
                    names=made.names)

    return packed.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, made)
