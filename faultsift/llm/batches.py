"""Arrow batches as byte arrays, and words as vectorised 64-bit hashes."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of 4 MB at most (or one row), so long texts do not pile up
    in a task. A session that already asks for less keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"[^0-9]", "", spark.conf.get(name)) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def carried(df: DataFrame, carry: tuple[str, ...], made: T.StructType) -> list[T.StructField]:
    """The input columns to keep beside the made ones; a made column wins a clash of names."""
    taken = {f.name.lower() for f in made}
    return [df.schema[name] for name in carry if name.lower() not in taken]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on for other stages, and two or more share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def text_slices(batch: pa.RecordBatch, column: str,
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts a batch into runs of rows of about `limit` text bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop
    del texts
    give_back()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array, offsets from zero."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def lookup(word: str, lower: bool = True) -> np.ndarray:
    """256 bytes: what a byte counts as inside a word (A-Z lower-cased), 0 for a separator."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    if word == "alnum":  # letters, digits and everything beyond ASCII
        keep = np.zeros(256, bool)
        keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    else:  # all but blanks
        keep = np.ones(256, bool)
        keep[9:14] = keep[32] = False
    table[~keep] = 0
    if word != "alnum":
        table[0] = 0xF8  # NUL is a word byte there; no UTF-8 text holds this one
    return table


ALNUM, NONBLANK = lookup("alnum"), lookup("nonblank")
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
                for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from running sums over all bytes."""
    power, inverse = _tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * power[:len(data)], out=sums[1:], dtype=np.uint64)
        own = (sums[end] - sums[start]) * inverse[start]
        return mix(own + (end - start).astype(np.uint64) * ODD)


class Words:
    """Words of the texts of one slice: byte spans, owner rows and 64-bit hashes.

    `first[d]:first[d + 1]` are the words of row d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM):
        rows = len(offsets) - 1
        self.bytes = table[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = self.bytes > 0
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        cuts = offsets[:-1]
        at_start = before.copy()
        at_start[cuts] = False
        self.start = np.flatnonzero(inside & ~at_start)
        ends = before & ~inside
        ends[offsets[1:]] |= before[offsets[1:]]
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i]:self.end[i]].tobytes()


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, owner row) of every `size` consecutive words of a row."""
    full = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(full)), full)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + first[:-1][owner]
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * ODD + hashes[at + k]
    return mix(total), at, owner


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner row) of every `size` words; a row of fewer words, but not none, is one shingle."""
    total, _, owner = grams(hashes, first, size)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return total, owner
    extra = np.zeros(len(short), np.uint64)
    with np.errstate(over="ignore"):
        for i, row in enumerate(short):
            for h in hashes[first[row]:first[row + 1]]:
                extra[i] = extra[i] * ODD + h + np.uint64(1)
    total, owner = np.concatenate([total, mix(extra)]), np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    return total[order], owner[order]


def made_batch(kept: pa.RecordBatch, names: list[str], arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    """The carried columns of a slice beside the made ones."""
    columns = [kept.column(kept.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(columns + list(arrays.values()), names + list(arrays))
