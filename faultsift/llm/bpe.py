"""Byte-level BPE: distinct pieces in length-bucketed matrices, one merge per row and round."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultsift.llm.batches import bounded_batches, carried, free_name, made_batch, raw_bytes, span_hashes, text_slices

NO_RANK = np.int32(2**31 - 1)
LONGEST_ROW = 256      # bytes of a piece in a matrix; longer ones merge by a heap
ROWS_AT_ONCE = 1 << 15
IDS_AT_ONCE = 1 << 20
KEPT_PIECES = 300_000  # remembered by a task at most, and their ids
KEPT_IDS = 4 << 20


class PairTable:
    """(left id, right id) to merged id: open addressing, probed for whole matrices at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot, self.probes = self._slot(keys), 1
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several, the last one stays
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.int64) << 32) | right[todo]
        slot = self._slot(keys)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class TokenBytes:
    """What ids stand for; all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, row offsets) for ids of all rows and how many each has."""
        unknown = (ids < 0) | (ids >= len(self.at) - 1)
        if unknown.any():
            raise ValueError(f"not an id of the vocabulary: {ids[unknown][0]}")
        size = self.at[ids + 1] - self.at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[gather(self.at[ids], size)], ends[np.concatenate([[0], np.cumsum(counts)])]


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.single = np.full(256, -1, np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, merged)))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has)."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > LONGEST_ROW:
                out[i] = self._merge_long(piece)
            else:
                by_length.setdefault(len(piece), []).append(i)
        for length, rows in by_length.items():
            step = max(1, ROWS_AT_ONCE * 16 // length)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                matrix = self.single[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                self._merge_matrix(matrix.reshape(len(part), length), np.array(part), out)
        counts = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int32, int(counts.sum()))
        return flat, counts

    def _merge_matrix(self, ids: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Every row merges its leftmost pair of least rank; finished rows leave the matrix."""
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(rows):
            least = ranks.argmin(axis=1)  # the first of equals: the leftmost
            line = np.arange(len(rows))
            merged = ranks[line, least]
            done = merged == NO_RANK
            if done.any():
                for i, tokens in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = tokens
                on = ~done
                rows, ids, ranks, least, merged = rows[on], ids[on], ranks[on], least[on], merged[on]
                line = np.arange(len(rows))
                if not len(rows):
                    return
            width = ids.shape[1]
            ids[line, least] = merged
            gone = np.ones(ids.shape, bool)
            gone[line, least + 1] = False
            ids = ids[gone].reshape(len(rows), width - 1)
            gone = np.ones(ranks.shape, bool)
            gone[line, least] = False
            ranks = ranks[gone].reshape(len(rows), width - 2)
            if width == 2:
                for i, tokens in zip(rows.tolist(), ids.tolist(), strict=True):
                    out[i] = tokens
                return
            for shift in (-1, 0):  # the pairs that end and begin at the merged token
                at = least + shift
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                ranks[ok, at[ok]] = self.pairs.find(ids[ok, at[ok]], ids[ok, at[ok] + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece: a heap of (rank, place) over a linked list."""
        end = len(piece)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))  # of the token that begins here
        alive = bytearray(b"\1" * end)

        def merged(a: int, b: int) -> int | None:
            return self.ranks.get(piece[a:after[b]])

        heap = [(r, i, i + 1) for i in range(end - 1) if (r := merged(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if not alive[i] or after[i] != j or merged(i, j) != rank:
                continue  # one of the two has been merged since
            alive[j] = 0
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (r := merged(a, b)) is not None:
                    heapq.heappush(heap, (r, a, b))
        starts = [i for i in range(end) if alive[i]]
        return [self.ranks[piece[a:after[a]]] for a in starts]


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[0], start[0] + 1, ... for runs of the given sizes."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(_ranks(path), pattern)


@cache
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(_ranks(path))


LETTER, NUMBER, BLANK, OTHER = range(4)


@cache
def _classes() -> np.ndarray:
    """Which class of the pattern below every code point is in."""
    table = np.full(0x110000, OTHER, np.uint8)
    letters = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for hit in regex.finditer(name, letters):
            a, b = (i + 0x800 * (i >= 0xD800) for i in hit.span())
            table[a:b] = kind
    return table


# Fixed value: the pattern that `class_pieces` splits by.
BY_CLASS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def class_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the matches of BY_CLASS in all rows; they tile the rows.

    A match is a stretch of one class. A space before it joins it; other blanks keep to themselves, the last one
    of a stretch apart when something follows. A lone apostrophe with no space before it takes what makes it a
    short form from the letters behind it.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    rows = np.searchsorted(lead, offsets[:-1])
    rows = rows[rows < len(cp)]
    if not len(cp):
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    edge = np.ones(len(cp), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[rows] = True
    opens = np.zeros(len(cp), bool)
    opens[rows] = True
    start = np.flatnonzero(edge)
    end, kind, opens = np.append(start[1:], len(cp)), kind[start], opens[start]
    blank = kind == BLANK
    followed = np.append(~opens[1:], False)
    lends = blank & followed & (cp[end - 1] == 32)  # its last space goes to what follows
    joined = np.append(False, lends[:-1])
    cut = np.zeros(len(cp), bool)
    cut[start[~blank] - joined[~blank]] = True
    cut[start[blank & ~(lends & (end - start == 1))]] = True
    cut[end[blank & followed & ~lends] - 1] = True
    lone = np.flatnonzero((kind == OTHER) & (end - start == 1) & (cp[start] == 39) & ~joined & followed)
    lone = lone[kind[lone + 1] == LETTER] if len(lone) else lone
    at, stop = start[lone + 1], end[lone + 1]
    first, second = cp[at], np.where(at + 1 < stop, cp[np.minimum(at + 1, len(cp) - 1)], 0)
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = np.isin(first * 256 + second, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (second < 256)
    size = np.where(one, 1, np.where(two, 2, 0))
    cut[at[size > 0]] = False
    rest = at + size
    cut[rest[(size > 0) & (rest < stop)]] = True
    return lead[np.flatnonzero(cut)]


class Encoder:
    """Encodes rows of bytes; remembers pieces by hash, and of too many the later used half."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.turn = vocab, 0
        self.known: dict[int, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hashes, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used > np.median(self.used))
        self.flat = self.flat[gather(self.start[keep], self.count[keep])]
        self.count, self.hashes, self.used = self.count[keep], self.hashes[keep], self.used[keep]
        self.start = np.cumsum(self.count) - self.count
        self.known = dict(zip(self.hashes.tolist(), range(len(keep)), strict=True))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.vocab.pattern.pattern == BY_CLASS:
            return class_pieces(data, offsets)
        text = data.tobytes()
        size = [len(p.encode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                for p in self.vocab.pattern.findall(text[a:b].decode())]
        ends = np.cumsum(np.array(size, np.int64))
        if (ends[-1] if size else 0) != len(data):
            raise ValueError("the pattern leaves out a part of a text")
        return ends - size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has)."""
        rows = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return self.encode_rows(np.frombuffer(b"".join(rows), np.uint8), offsets)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the UTF-8 rows data[offsets[i]:offsets[i + 1]]."""
        if len(self.known) > KEPT_PIECES or len(self.flat) > KEPT_IDS:
            self._forget()
        self.turn += 1
        start = self._pieces(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        size = end - start
        hashes, first, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        same = first[which]
        if not (np.array_equal(size, size[same]) and np.array_equal(data, data[gather(start[same], size)])):
            raise RuntimeError("two pieces share a hash")  # 1 in 2^64 a pair
        slot = np.fromiter((self.known.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(slot < 0)
        text = data.tobytes()
        flat, counts = self.vocab.encode_pieces([text[a:b] for a, b in zip(
            start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        slot[new] = len(self.start) + np.arange(len(new))
        self.known.update(zip(hashes[new].tolist(), slot[new].tolist(), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat])
        self.hashes = np.concatenate([self.hashes, hashes[new]])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[slot] = self.turn
        at = slot[which]
        many = self.count[at]
        ids = self.flat[gather(self.start[at], many)]
        upto = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(start, offsets)]
        return ids, np.diff(upto)


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def encode(docs: DataFrame, path: str, pattern: str, *, text_column: str = "text",
           carry: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The carried columns and `ids`, the token ids of the whole text, as a row-local map; with `decoded` also
    the bytes that the ids stand for, as `decode` makes them, without a second worker a task.

    Each match of `pattern` is encoded separately: a piece that is a token is that token, any other
    starts as bytes and merges the leftmost pair of least rank until none is left. Null texts count as
    empty and have no ids. Repeated rows stay; an empty table gives no rows; a carried column
    named `ids` is left out. `path` is read by every worker, so it must be installed on all.
    """
    bounded_batches(docs.sparkSession)
    made = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
                        + [T.StructField("decoded", T.BinaryType(), False)] * decoded)
    kept = carried(docs, carry, made)
    names = [f.name for f in kept]
    source = free_name(docs, "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path, pattern))
        for batch in batches:
            for rows, texts in text_slices(batch, source):
                ids, counts = encoder.encode_rows(*raw_bytes(texts))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                own = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))}
                if decoded:
                    own["decoded"] = _binary(*token_bytes(path).decode(ids, counts))
                yield made_batch(rows, names, own)

    text = docs[text_column].alias(source)
    return docs.select(*[docs[n] for n in names], text).mapInArrow(run, T.StructType(kept + made.fields))


def decode(tokens: DataFrame, path: str, *, ids_column: str = "ids",
           carry: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The carried columns and `decoded`, the bytes that the ids stand for. Null ids decode to
    nothing; an id outside the vocabulary is an error."""
    bounded_batches(tokens.sparkSession)
    made = T.StructType([T.StructField("decoded", T.BinaryType(), False)])
    kept = carried(tokens, carry, made)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = token_bytes(path)
        for batch in batches:
            sizes = pc.fill_null(batch.column(batch.num_columns - 1).value_lengths(), 0).to_numpy()
            upto, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(
                    upto, (upto[at - 1] if at else 0) + IDS_AT_ONCE, side="right")))
                rows, counts, at = batch.slice(at, stop - at), sizes[at:stop], stop
                lists = rows.column(rows.num_columns - 1)
                flat, ends = vocab.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
                yield made_batch(rows, names, {"decoded": _binary(flat, ends)})

    return tokens.select(*[tokens[n] for n in names], tokens[ids_column].alias(free_name(tokens, "source"))).mapInArrow(
        run, T.StructType(kept + made.fields))
