"""Periodic runs of words: suffix automaton, with link-cut access over its suffix links."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultsift.llm.batches import ODD, Words, bounded_batches, carried, free_name, lookup, made_batch, mix, raw_bytes, text_slices

WORD = lookup("nonblank", lower=False)


class Automaton:
    """Suffix automaton of a list of numbers: `length` and `link` of each state, and the state of each prefix.

    Most states have one transition, which lies in two arrays; the others are in a dictionary each.
    """

    def __init__(self, sequence: list[int]):
        length, link, word, target = array("q", [0]), array("q", [-1]), array("q", [-1]), array("q", [-1])
        more: dict[int, dict[int, int]] = {}
        self.length, self.link, self.prefix = length, link, array("q")
        last = 0
        for x in sequence:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            word.append(-1)
            target.append(-1)
            p = last
            while p >= 0:
                if word[p] == x:
                    q = target[p]
                elif p in more and x in more[p]:
                    q = more[p][x]
                else:
                    if word[p] < 0:
                        word[p], target[p] = x, new
                    else:
                        more.setdefault(p, {})[x] = new
                    p = link[p]
                    continue
                if length[q] == length[p] + 1:
                    link[new] = q
                    break
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                target.append(target[q])
                if q in more:
                    more[copy] = dict(more[q])
                link[q] = link[new] = copy
                while p >= 0:
                    if word[p] == x:
                        if target[p] != q:
                            break
                        target[p] = copy
                    elif p in more and more[p].get(x) == q:
                        more[p][x] = copy
                    else:
                        break
                    p = link[p]
                break
            self.prefix.append(new)
            last = new


class LastEnds:
    """Link-cut tree over suffix links. A solid path is a splay tree by depth; its root keeps the path's colour:
    where its strings ended last, -1 for nowhere yet."""

    def __init__(self, link: array):
        self.up = array("q", link)
        self.left, self.right, self.colour = (array("q", [-1]) * len(link) for _ in range(3))

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0 and left[z] == y:
            left[z] = x
        elif z >= 0 and right[z] == y:
            right[z] = x
        else:
            self.colour[x] = self.colour[y]

    def _splay(self, x: int) -> None:
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        y = up[x]
        while y >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                rotate(y if (left[z] == y) == (left[y] == x) else x)
            rotate(x)
            y = up[x]

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Recolours the path from `state` to the root; (last end, deepest state) of each segment it was."""
        up, right, colour = self.up, self.right, self.colour
        below, x = -1, state
        while x >= 0:
            self._splay(x)
            deeper = right[x]
            if deeper >= 0:
                colour[deeper] = colour[x]
            right[x] = below
            if colour[x] >= 0:
                yield colour[x], x
            below, x = x, up[x]
        self._splay(state)
        colour[state] = end


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items agree; reads on in steps that double."""
    at, step, size = 0, 16, min(len(a), len(b))
    while at < size:
        stop = min(at + step, size)
        differ = np.flatnonzero(a[at:stop] != b[at:stop])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, 2 * step
    return size


def runs_of(sequence: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal stretches with least period q and length >= max(shortest, exponent * q).

    Where a string ends now and ended last d places before, and has (exponent - 1) * d items or more, the two make
    `exponent` times a block of d, and d is the least period there: a smaller one would have ended later. Every such
    run is met at the end of its first `exponent` periods. It is then extended both ways, once.
    """
    items = sequence.tolist()
    automaton = Automaton(items)
    ends, length = LastEnds(automaton.link), automaton.length
    reached: dict[int, int] = {}
    found = []
    for end, state in enumerate(automaton.prefix):
        for last, deepest in ends.access(state, end):
            d = end - last
            if (exponent - 1) * d > length[deepest] or reached.get(d, -1) >= end:
                continue
            start = last - length[deepest] + 1
            start -= _matching(sequence[:start][::-1], sequence[:start + d][::-1])
            stop = end + 1 + _matching(sequence[end + 1:], sequence[end + 1 - d:])
            reached[d] = stop - 1
            if stop - start >= max(shortest, exponent * d):
                found.append((start, stop - start, d))
    return found


def candidates(hashes: np.ndarray, first: np.ndarray, size: int, times: int, shortest: int) -> Iterator[np.ndarray]:
    """The stretches that runs can lie in, as positions: every word is in a `size`-gram that comes `times` times or
    more in the stretch. What a stretch loses splits it, and the parts are looked at again until nothing changes."""
    count = np.diff(first)
    at = np.flatnonzero(np.repeat(count >= shortest, count))
    owner = np.repeat(np.arange(len(count)), count)[at]
    while len(at):
        edge = np.ones(len(at), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
        stretch = np.cumsum(edge) - 1
        many = np.bincount(stretch)
        grams = len(at) - size + 1
        covered = np.zeros(len(at) + 1, np.int64)
        if grams > 0:
            key = stretch[:grams].astype(np.uint64)
            with np.errstate(over="ignore"):
                for k in range(size):
                    key = mix(key * ODD + hashes[at[k:k + grams]])
            whole = np.flatnonzero(stretch[:grams] == stretch[size - 1:])
            _, which, often = np.unique(key[whole], return_inverse=True, return_counts=True)
            good = whole[often[which] >= times]
            np.add.at(covered, good, 1)
            np.add.at(covered, good + size, -1)
        keep = (np.cumsum(covered)[:-1] > 0) & (many[stretch] >= shortest)
        if keep.all():
            starts = np.flatnonzero(edge)
            yield from np.split(at, starts[1:])
            return
        at, owner = at[keep], owner[keep]


def _slice_runs(words: Words, exponent: int, shortest: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each row, by start, then period."""
    hashes = words.hashes()
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.first) - 1)]
    size, times = (3, 3) if exponent >= 4 and shortest >= 6 else (1, 2)
    for stretch in candidates(hashes, words.first, size, times, shortest):
        row = int(words.row[stretch[0]])
        base = int(stretch[0] - words.first[row])
        sequence = np.unique(hashes[stretch], return_inverse=True)[1]
        found[row] += [(base + s, n, q) for s, n, q in runs_of(sequence, exponent, shortest)]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def _collapsed(data: np.ndarray, words: Words, runs: list[list[tuple[int, int, int]]]) -> list[bytes]:
    """The words of each row that no run drops, joined by a blank."""
    drop = np.zeros(len(words) + 1, np.int64)
    for row, own in enumerate(runs):
        for start, length, period in own:
            drop[words.first[row] + start + period] += 1
            drop[words.first[row] + start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
    size = words.end[kept] - words.start[kept] + 1
    ends = np.cumsum(size)
    source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.start[kept] - (ends - size), size)
    out = np.append(data, np.uint8(32))[source]
    out[ends - 1] = 32
    text, bounds = out.tobytes(), np.concatenate([[0], ends])[np.searchsorted(kept, words.first)]
    return [text[a:max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def find_runs(docs: DataFrame, *, exponent: int = 4, shortest: int = 6, text_column: str = "text",
              carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, `n_words`, `runs` (start, length, period of each, by start, then period) and `collapsed`.

    Words are what lies between blanks (space, tab to carriage return), numbered from 0. A run is a stretch of
    consecutive words with least period q and length >= max(shortest, exponent * q) that neither neighbour extends.
    `collapsed` joins by one blank the words that remain when each run keeps its first q words only.
    `exponent` is 2 or more. Null and empty texts have no words and the empty collapsed text; repeated rows stay;
    a carried column with a made name is left out; an empty table gives no rows.

    Row-local. Words count as equal by 64-bit hashes. Stretches in which no run can lie are set aside first, by
    counting grams of the words; the automaton of each other stretch takes about 150 bytes a word.
    """
    if exponent < 2:
        raise ValueError("exponent is 2 or more")
    bounded_batches(docs.sparkSession)
    run_type = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
    made = T.StructType([
        T.StructField("n_words", T.LongType(), False), T.StructField("runs", T.ArrayType(run_type, False), False),
        T.StructField("collapsed", T.StringType(), False)])
    kept = carried(docs, carry, made)
    names = [f.name for f in kept]
    source = free_name(docs, "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, source):
                data, offsets = raw_bytes(texts)
                words = Words(data, offsets, WORD)
                found = _slice_runs(words, exponent, shortest)
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                ends = np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], run_type.names)
                yield made_batch(rows, names, {
                    "n_words": pa.array(np.diff(words.first)),
                    "runs": pa.ListArray.from_arrays(pa.array(ends), structs),
                    "collapsed": pa.array(_collapsed(data, words, found), pa.binary()).cast(pa.string())})

    return docs.select(*[docs[n] for n in names], docs[text_column].alias(source)).mapInArrow(
        run, T.StructType(kept + made.fields))
