"""Language-model scoring: a hierarchical Pitman-Yor model whose seating is sampled by Gibbs moves."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import NONBLANK, ODD, Words, bounded_batches, carried, mix, raw_bytes, text_slices
from faultsift.session import scratch_path

END = np.uint64(0x1DEA5ED0C0FFEE11)  # stands for the end of a text among word hashes
ESCAPE = 65_535         # words of the book are numbered below it
BLOCK_TOKENS = 1_000_000
ROUNDS = 4
LOT_TOKENS = 800_000
SEATED_SINGLY = 48
BLOCKS = 32             # later customers come in blocks of this part of those seated
SPLIT = 20_000          # dishes of the parent that are seated together; a restaurant is split by ten times as many customers
HELD_WORDS = 1 << 21


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, owner row, first of a row) of every token; the last of each row is its end."""
    words = Words(*raw_bytes(texts), NONBLANK)
    rows = len(texts)
    first = words.first + np.arange(rows + 1)
    out = np.full(int(first[-1]), END, np.uint64)
    place = np.arange(len(words)) + words.row
    out[place] = words.hashes()
    return out, np.repeat(np.arange(rows), np.diff(first)), first


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * ODD + word)


def predecessors(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of each token: its predecessor; a text begins after an end."""
    last = np.empty(len(words), np.uint64)
    last[1:] = words[:-1]
    last[first[:-1]] = END
    return last


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens of the column `__text`, added up within each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            words, which = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(which, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

        def made() -> pa.RecordBatch:
            words, n = folded()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, part in text_slices(batch, "__text"):
                held.append(np.unique(tokens(part)[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD_WORDS:
                    held = [folded()]
                    size = len(held[0][0])
                    if size > HELD_WORDS // 2:
                        yield made()
                        held, size = [], 0
        if held:
            yield made()

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece; whole numbers take as few bytes as their largest needs."""
    small = [x.astype(np.min_scalar_type(int(x.max()))) if x.dtype.kind in "iu" and len(x) else x for x in arrays]
    data = pickle.dumps(small)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(piece: bytes) -> list[np.ndarray]:
    return pickle.loads(pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), codec="zstd", asbytes=True))


def deltas(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Steps from one number to the next in runs of the given lengths, each run from zero."""
    out, start = np.diff(x, prepend=0), (np.cumsum(length) - length)[length > 0]
    out[start] = x[start]
    return out


def summed(steps: np.ndarray, length: np.ndarray) -> np.ndarray:
    upto, length = np.cumsum(steps), length[length > 0]
    start = np.cumsum(length) - length
    return upto - np.repeat(upto[start] - steps[start], length)


@dataclass
class Deal:
    """How tokens are dealt: a restaurant goes to one lot, a large one by its dishes to several.

    `book` holds the commonest words, which are written by number; all others are written as they are.
    """
    lots: int
    book: np.ndarray         # sorted word hashes, fewer than ESCAPE
    salts: np.ndarray        # by word of the book

    def coded(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, known = Answers._find(self.book, words)
        return np.where(known, at, ESCAPE).astype(np.uint16), words[~known]

    def words(self, code: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.empty(len(code), np.uint64)
        known = code != ESCAPE
        out[known], out[~known] = self.book[code[known]], rest
        return out

    def split(self, contexts: np.ndarray) -> np.ndarray:
        at, known = Answers._find(self.book, contexts)
        out = np.ones(len(contexts), np.int64)
        out[known] = self.salts[at[known]]
        return out

    def lot(self, contexts: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(contexts + salt.astype(np.uint64) * ODD) % np.uint64(self.lots)).astype(np.int64)


def dealt(texts: DataFrame, names: list[str], deal: Deal) -> DataFrame:
    """(lot, block, data): the tokens of `__text` by lot, and of each block of documents their carried columns, under a
    negative lot. The lots need `__train` too. Blocks are numbered by task, so a task that runs again makes the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            number = (task << 24) + made
            hashes, context, train = (np.concatenate([h[k] for h in held]) for k in range(3))
            length = np.concatenate([h[3] for h in held])
            doc = np.repeat(np.arange(len(length)), length)
            sink = pa.BufferOutputStream()
            kept = pa.Table.from_batches([h[4] for h in held])
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_table(kept)
            lot = deal.lot(context, mix(hashes) % deal.split(context).astype(np.uint64))
            # Runs of a context in a lot; two that agree in these bits may take turns, which only makes more runs.
            order = np.argsort((lot.astype(np.uint64) << np.uint64(44)) | (context >> np.uint64(20)))
            lot, context, hashes, tag = lot[order], context[order], hashes[order], (2 * doc + train[doc])[order]
            cut = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]]))
            lots, pieces = [-1 - number % deal.lots], [pack(length, np.frombuffer(sink.getvalue(), np.uint8))]
            for low, high in zip(cut, [*cut[1:], len(lot)], strict=True):
                lead = low + np.flatnonzero(np.concatenate([[True], context[low + 1:high] != context[low:high - 1]]))
                lots.append(int(lot[low]))
                pieces.append(pack(*deal.coded(context[lead]), np.diff([*lead, high]), *deal.coded(hashes[low:high]), tag[low:high]))
            return pa.RecordBatch.from_arrays([pa.array(lots, pa.int64()), pa.array([number] * len(lots), pa.int64()),
                                               pa.array(pieces, pa.binary())], names=["lot", "block", "data"])

        for batch in batches:
            for rows, part in text_slices(batch, "__text"):
                hashes, _, first = tokens(part)
                train = rows.column(rows.schema.get_field_index("__train")).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((hashes, predecessors(hashes, first), train, np.diff(first), rows.select(names)))
                size += len(hashes)
                if size > BLOCK_TOKENS:
                    yield block()
                    made, held, size = made + 1, [], 0
        if held:
            yield block()

    return texts.mapInArrow(run, "lot long, block long, data binary")


def _part() -> Column:
    """The round in which a lot is scored; -1: carried columns."""
    return F.when(F.col("lot") < 0, -1).otherwise(F.pmod(F.xxhash64("lot"), F.lit(ROUNDS)).cast("int"))


def lots_of(tokens_dealt: DataFrame, deal: Deal, buckets: int) -> DataFrame:
    """One row a lot: its words by bucket; its pairs that are to be seated; all its pairs; its tokens. Carried columns pass."""
    def run(key: tuple, part: pa.Table) -> pa.Table:
        lot, blocks, pieces = key[0].as_py(), part["block"].to_numpy(), part["data"].to_pylist()
        if lot < 0:
            empty = pa.nulls(len(part), pa.binary())
            return pa.table({"lot": part["lot"], "block": part["block"], "words": part["data"],
                             "many": empty, "pairs": empty, "tokens": empty})
        read = [unpack(x) for x in pieces]
        context = np.concatenate([np.repeat(deal.words(a, b), run) for a, b, run, *_ in read])
        word = np.concatenate([deal.words(c, d) for *_, c, d, _ in read])
        tag = np.concatenate([x[-1].astype(np.int64) for x in read])
        length = np.array([len(x[-1]) for x in read])
        del read
        words = np.unique(np.concatenate([np.unique(context), np.unique(word)]))
        order = np.argsort(_bucket(words, buckets), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        of, at = rank[np.searchsorted(words, context)], rank[np.searchsorted(words, word)]
        words = words[order]
        cut = np.searchsorted(_bucket(words, buckets), np.arange(buckets + 1))
        pair, which = np.unique(of * len(words) + at, return_inverse=True)
        n = np.bincount(which, tag & 1, len(pair)).astype(np.int64)
        of, dish = np.divmod(pair, len(words))
        once, many = n == 1, n > 1
        count = np.bincount(at, tag & 1, len(words)).astype(np.int64)
        salts = deal.split(words)
        for i in np.flatnonzero(salts > 1):  # a lot may hold several salts of a restaurant
            here = (deal.lot(np.repeat(words[i], salts[i]), np.arange(salts[i])) == lot).sum()
            salts[i] = max(1, round(salts[i] / max(here, 1)))
        rooms = np.bincount(of, minlength=len(words))
        block = np.repeat(np.arange(len(length)), length)
        order = np.argsort(block * len(pair) + which)
        which, doc = which[order], (tag >> 1)[order]
        return pa.table({
            "lot": pa.array([lot], pa.int64()), "block": pa.array([0], pa.int64()),
            "words": pa.array([words.tobytes()], pa.binary()),
            "many": pa.array([pack(cut, of[many], dish[many], n[many], np.bincount(of[once], minlength=len(words)),
                                   np.bincount(dish[once], minlength=len(words)), count, salts)], pa.binary()),
            "pairs": pa.array([pack(cut, rooms, deltas(dish, rooms), n)], pa.binary()),
            "tokens": pa.array([pack(blocks, length, deltas(which, length), doc)], pa.binary())})

    return tokens_dealt.groupBy("lot").applyInArrow(
        run, "lot long, block long, words binary, many binary, pairs binary, tokens binary")


@dataclass
class Seating:
    """Tables of restaurants seated together: the row (a dish of a restaurant) each serves and its customers.

    A restaurant may have tables elsewhere: `ones` of them with one customer each for good, and where its
    dishes are dealt to several tasks by hash, `scale` tables in all for each one here.
    """
    discount: float
    strength: float
    random: np.random.Generator
    room: np.ndarray | None = None      # restaurant of each row; None: one for all
    ones: np.ndarray | None = None      # by restaurant
    scale: np.ndarray | None = None     # by restaurant
    dish: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0))
    aside: np.ndarray | float = 0.0     # tables by row that move no more

    def _rooms(self, rows: int) -> None:
        if self.room is None:
            self.room, self.ones, self.scale = np.zeros(rows, np.int64), np.zeros(1), np.ones(1)

    def _added(self, rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return self.scale * np.bincount(self.room[rows], tables, len(self.ones))

    def open(self, n: np.ndarray, above: np.ndarray) -> None:
        """Seats n[i] customers of row i; above[i] is what the parent restaurant gives its dish.

        The k-th customers of all dishes come in turn; beyond SEATED_SINGLY they come in blocks of a BLOCKS-th of those
        seated, each block with the chance of a new table at its middle (tables expected then), and are counted after it.
        """
        self._rooms(len(n))
        tables = (n > 0).astype(np.float64)
        total = self.ones + self._added(np.arange(len(n)), tables)
        k, on = 1, np.flatnonzero(n > 1)
        while len(on):
            block = 1 if k < SEATED_SINGLY else max(1, k // BLOCKS)
            come = np.minimum(n[on] - k, block).astype(np.int64)
            half = np.zeros(len(on))
            for _ in range(1 if block == 1 else 3):  # what half a block adds to the tables, then the chance at its middle
                middle = total + self._added(on, half) if block > 1 else total
                fresh = (self.strength + self.discount * middle[self.room[on]]) * above[on]
                chance = fresh / (fresh + k + (come - 1) / 2 - self.discount * (tables[on] + half))
                half = chance * (come - 1) / 2
            anew = self.random.random(len(on)) < chance if block == 1 else self.random.binomial(come, chance)
            tables[on] += anew
            total += self._added(on, anew)
            k += block
            on = on[n[on] > k]
        self.dish = np.repeat(np.arange(len(n)), tables.astype(np.int64))
        share = self.random.gamma(1 - self.discount, size=len(self.dish)) + 1e-12
        whole = np.bincount(self.dish, share, len(n))
        spare = (n - tables)[self.dish]
        self.size = 1 + np.floor(spare * share / whole[self.dish])
        left = n - np.bincount(self.dish, self.size, len(n))
        lead = np.searchsorted(self.dish, np.flatnonzero(n > 0))
        self.size[lead] += left[n > 0]

    def settle(self, n: np.ndarray, above: np.ndarray, moves: int) -> None:
        """`moves` Gibbs moves a dish, or as many as it has customers if these are fewer."""
        self.aside = np.zeros(len(n))
        for k in range(moves):
            on = n > max(k, 1)
            if not on.any():
                return
            stay = on[self.dish]
            if 2 * stay.sum() < len(stay):
                self.aside += np.bincount(self.dish[~stay], minlength=len(n))
                self.dish, self.size = self.dish[stay], self.size[stay]
            self.move(n, above, np.flatnonzero(on))

    def move(self, n: np.ndarray, above: np.ndarray, served: np.ndarray | None = None) -> None:
        """A Gibbs move per dish: one of its customers, any with equal chance, gets up and sits down again."""
        self._rooms(len(n))
        served = np.flatnonzero(n > 1) if served is None else served
        if not len(served):
            return
        pick = self._choose(self.size, served)
        self.size[pick] -= 1
        stay = self.size > 0
        self.dish, self.size = self.dish[stay], self.size[stay]
        total = self.ones + self._added(np.arange(len(n)), self.tables(len(n)))
        fresh = (self.strength + self.discount * total[self.room[served]]) * above[served]
        seats = np.maximum(self.size - self.discount, 0)
        old = np.bincount(self.dish, seats, len(n))[served]
        anew = self.random.random(len(served)) * (fresh + old) < fresh
        self.size[self._choose(seats, served[~anew])] += 1
        self.dish = np.concatenate([self.dish, served[anew]])
        self.size = np.concatenate([self.size, np.ones(int(anew.sum()))])
        order = np.argsort(self.dish, kind="stable")
        self.dish, self.size = self.dish[order], self.size[order]

    def _choose(self, weight: np.ndarray, dishes: np.ndarray) -> np.ndarray:
        """A table of each dish, with a chance in proportion to its weight."""
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        low = np.searchsorted(self.dish, dishes)
        high = np.searchsorted(self.dish, dishes, side="right")
        at = upto[low] + self.random.random(len(dishes)) * (upto[high] - upto[low])
        return np.clip(np.searchsorted(upto, at, side="right") - 1, low, high - 1)

    def tables(self, dishes: int) -> np.ndarray:
        return np.bincount(self.dish, minlength=dishes) + self.aside


@dataclass
class Scale:
    """The few numbers of a model that every task needs."""
    strength: float
    unseen: np.ndarray       # by sample: what the parent gives a word never seen
    train_tokens: int
    distinct: int


class Answers:
    """Rows of a model by key: discounted counts of pairs; counts and probabilities of words."""

    def __init__(self, rows: pa.Table, scale: Scale):
        self.scale, samples = scale, len(scale.unseen)
        payload = rows["payload"].combine_chunks()
        size = payload.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start = payload.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        pair, word = order[size[order] == 1], order[size[order] > 1]
        self.pair, self.kept, self.word = keys[pair], flat[start[pair]], keys[word]
        self.about = flat[start[word][:, None] + np.arange(2 + 2 * samples)]

    @staticmethod
    def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(among):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return at, among[at] == keys

    def read(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, log10 probability given its predecessor) of every token."""
        samples, size = len(self.scale.unseen), len(words)
        context = predecessors(words, first)
        at, known = self._find(self.word, words)
        count, above = np.zeros(size), np.tile(self.scale.unseen, (size, 1))
        count[known], above[known] = self.about[at[known], 0], self.about[at[known], 2:2 + samples]
        at, known = self._find(self.word, context)
        total, onward = np.zeros(size), np.ones((size, samples))
        total[known], onward[known] = self.about[at[known], 1], self.about[at[known], 2 + samples:]
        at, known = self._find(self.pair, pair_keys(context, words))
        kept = np.zeros(size)
        kept[known] = self.kept[at[known]]
        return count, np.log10(kept / (self.scale.strength + total) + (above * onward).mean(axis=1))


@dataclass
class Model:
    """A model as a table (key, payload): of a pair its count less its discounts; of a word its count, that of all
    pairs after it, and by sample its probability in the parent and what its restaurant passes on."""
    rows: DataFrame
    scale: Scale
    fetched: Answers | None = None

    def score(self, words: np.ndarray, first: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of every token in the driver, for models small enough to be fetched."""
        if self.fetched is None:
            self.fetched = Answers(self.rows.toArrow(), self.scale)
        return self.fetched.read(words, first)[1]


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words) % np.uint64(buckets)).astype(np.int64)


def _told(cut: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the buckets say of a lot's words: discounted customers, tables of the restaurant, count."""
    out = [np.zeros(int(cut[-1])) for _ in range(3)]
    for bucket, data in zip(told["bucket"].to_pylist(), told["data"].to_pylist(), strict=True):
        if bucket >= 0:
            for x, y in zip(out, unpack(data), strict=True):
                x[cut[bucket]:cut[bucket + 1]] = y
    return tuple(out)


@dataclass
class Sweeps:
    """The few numbers of the sweeps: `held` and `passed` are the parent's customers and what it passes on, by kept sweep."""
    samples: int
    discount: float
    strength: float
    held: list[float]
    passed: list[float]

    def read(self, left: pa.Table, right: pa.Table) -> tuple:
        """(count, above by sample, onward by sample of words; context, word, n and kept of pairs) of a lot."""
        cut, rooms, steps, n = (x.astype(np.int64) for x in unpack(left["pairs"][0].as_py()))
        above, onward, count = [], [], np.zeros(cut[-1])
        sweep = right["sweep"].to_numpy()
        for s in range(self.samples):
            customers, tables, count = _told(cut, right.filter(pa.array(sweep == s)))
            above.append(customers / self.held[s] + self.passed[s])
            onward.append((self.strength + self.discount * tables) / (self.strength + count))
        kept = np.where(n == 1, 1 - self.discount, 0.0)
        for bucket, data in zip(right["bucket"].to_pylist(), right["data"].to_pylist(), strict=True):
            if bucket == -1:
                kept[n > 1] = n[n > 1] - self.discount * unpack(data)[0] / self.samples
        return count, np.array(above).T, np.array(onward).T, np.repeat(np.arange(cut[-1]), rooms), summed(steps, rooms), n, kept


@dataclass
class Swept:
    """The lots of a corpus, and what its sweeps left: rows (lot, bucket, data, sweep) of the kept ones.

    Under bucket -1 are the tables of the lot's pairs, added up over the kept sweeps; the others say for the lot's words
    of a bucket how many customers, less discounts, they have in the parent, how many tables their restaurant has, how
    often they were seen.
    """
    lots: DataFrame
    told: DataFrame
    sweeps: Sweeps
    tables: list[DataFrame]     # the written ones that `told` reads

    def each(self, run, schema: str, columns: tuple[str, ...], part: int | None = None) -> DataFrame:
        lots, told = self.lots.where("part >= 0"), self.told
        if part is not None:
            lots, told = self.lots.where(F.col("part") == part), told.where(_part() == part)
        return lots.select("lot", *columns).groupBy("lot").cogroup(told.groupBy("lot")).applyInArrow(run, schema)

    def rows(self) -> DataFrame:
        """The model by key, for `Answers`."""
        sweeps = self.sweeps

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            words = np.frombuffer(left["words"][0].as_py(), np.uint64)
            count, above, onward, of, dish, n, kept = sweeps.read(left, right)
            seen, known = n > 0, count > 0
            about = np.column_stack([count, count, above, onward])[known]
            return pa.table({
                "key": pa.array(np.concatenate([pair_keys(words[of[seen]], words[dish[seen]]), words[known]]).view(np.int64)),
                "payload": pa.array([*([x] for x in kept[seen].tolist()), *about.tolist()], pa.list_(pa.float64()))})

        return self.each(run, "key long, payload array<double>", ("words", "pairs")).dropDuplicates(["key"])


def sweep(lots: DataFrame, buckets: int, distinct: int, *, discount: float, strength: float,
          burn_in: int, samples: int, moves: int, seed: int, written, dropped) -> Swept:
    """Seats all restaurants of all lots, then their parent by buckets of words, `burn_in` + `samples` times."""
    uniform = 1.0 / (distinct + 1)
    state = lots.where("part >= 0").select("lot", "words", "many")
    none = lots.sparkSession.createDataFrame([], "lot long, bucket long, data binary")
    asked = none.select("lot", "bucket", F.col("data").alias("ask"))
    told, held, passed, kept, behind = none, 1.0, 0.0, [], []
    all_held, all_passed, past = [], [], []
    for number in range(burn_in + samples):
        keeps = number >= burn_in

        def seat(left: pa.Table, right: pa.Table) -> pa.Table:  # it and parent() run within the round that makes them
            lot = left["lot"][0].as_py()
            cut, of, dish, n, ones, once, count, salts = (x.astype(np.int64) for x in unpack(left["many"][0].as_py()))
            above = _told(cut, right)[0] / held + passed if number else np.full(len(count), uniform)
            before = np.zeros(len(n), np.int64)
            for bucket, data in zip(right["bucket"].to_pylist(), right["data"].to_pylist(), strict=True):
                if bucket == -1:
                    before = unpack(data)[0].astype(np.int64)
            lead, room = np.unique(of, return_inverse=True)
            seating = Seating(discount, strength, np.random.default_rng([seed + number, lot]), room,
                              (ones * salts)[lead].astype(np.float64), salts[lead].astype(np.float64))
            seating.open(n.astype(np.float64), above[dish])
            seating.settle(n.astype(np.float64), above[dish], moves)
            t = seating.tables(len(n)).astype(np.int64)
            serving = once + np.bincount(dish, t, len(count)).astype(np.int64)
            inside = ones + np.bincount(of, t, len(count)).astype(np.int64)
            to, pieces = [-1], [pack(before + t * int(keeps))]
            own = [] if number else [np.frombuffer(left["words"][0].as_py(), np.uint64)]
            for b, (low, high) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if low < high:
                    to.append(b)
                    pieces.append(pack(*(x[low:high] for x in (serving, inside, count, *own))))
            return pa.table({"lot": pa.array([lot] * len(to), pa.int64()), "bucket": pa.array(to, pa.int64()),
                             "data": pa.array(pieces, pa.binary())})

        def parent(key: tuple, part: pa.Table, asked: pa.Table) -> pa.Table:
            read = [unpack(x) for x in part["data"].to_pylist()]
            stop = np.cumsum([len(x[0]) for x in read])
            if number:  # the places of a lot's words among the bucket's are known
                place = dict(zip(asked["lot"].to_pylist(), asked["ask"].to_pylist(), strict=True))
                own = [unpack(place[lot])[0].astype(np.int64) for lot in part["lot"].to_pylist()]
                which = np.concatenate(own)
            else:
                which = np.unique(np.concatenate([x[3] for x in read]), return_inverse=True)[1]
                own = [which[e - len(x[0]):e] for x, e in zip(read, stop, strict=True)]
            n, tables, count = (np.bincount(which, np.concatenate([x[k] for x in read])) for k in range(3))
            many = n > 1
            seating = Seating(discount, strength, np.random.default_rng([seed + number, key[0].as_py(), 1]), np.zeros(many.sum(), np.int64),
                              np.array([float((n == 1).sum() * buckets)]), np.array([float(buckets)]))
            above = np.full(many.sum(), uniform)
            seating.open(n[many], above)
            seating.settle(n[many], above, moves)
            t = (n == 1).astype(np.float64)
            t[many] = seating.tables(int(many.sum()))
            less, rows = n - discount * t, len(read)
            return pa.table({
                "lot": pa.array([*part["lot"].to_pylist(), -1], pa.int64()), "bucket": pa.array([key[0].as_py()] * (rows + 1), pa.int64()),
                "data": pa.array([*(pack(less[i], tables[i].astype(np.int64), count[i].astype(np.int64)) for i in own), None], pa.binary()),
                "ask": pa.array([*([None] * rows if number else map(pack, own)), None], pa.binary()),
                "here": pa.array([*([0.0] * rows), n.sum()]), "tables": pa.array([*([0.0] * rows), t.sum()])})

        seated = written((state if number == 0 else state.drop("words")).groupBy("lot").cogroup(told.groupBy("lot")).applyInArrow(
            seat, "lot long, bucket long, data binary"), "seated")
        for df in past:  # what this round has replaced
            dropped(df)
        answers = written(seated.where("bucket >= 0").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
            parent, "lot long, bucket long, data binary, ask binary, here double, tables double"), "parent")
        if number == 0:
            asked = written(answers.where("lot >= 0").select("lot", "bucket", "ask"), "asked")
        here, tables = answers.where("lot = -1").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("here", "tables")]).first()
        held, passed = strength + here, (strength + discount * tables) / (strength + here) * uniform
        said = answers.where("lot >= 0").select("lot", "bucket", "data")
        if keeps:
            kept.append(said.withColumn("sweep", F.lit(number - burn_in)))
            behind.append(answers)
            all_held.append(held)
            all_passed.append(passed)
            told, past = said.unionByName(seated.where("bucket = -1")), [seated]
        else:  # its tables are not added up
            dropped(seated)
            told, past = said, [answers]
    dropped(asked)
    kept.append(seated.where("bucket = -1").withColumn("sweep", F.lit(-1)))
    return Swept(lots, reduce(DataFrame.unionByName, kept), Sweeps(samples, discount, strength, all_held, all_passed),
                 [*behind, seated])


def _tables(spark: SparkSession) -> tuple:
    """Functions that write a table and delete one, or a part. The files of a written plan's shuffles are let go of."""
    paths: dict[int, tuple[DataFrame, str]] = {}

    def written(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.partitionBy(*by).parquet(path)
        read = spark.read.schema(df.schema).parquet(path)
        paths[id(read)] = read, path
        del df
        spark.range(1).collect()  # else the write's last event, still in the listeners' hands, holds its plan
        spark.sparkContext._jvm.System.gc()  # Spark removes a shuffle's files once its plan is collected
        return read

    def dropped(df: DataFrame, part: str = "") -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path((paths[id(df)] if part else paths.pop(id(df)))[1] + part)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return written, dropped


def _counted(texts: DataFrame, written) -> tuple[DataFrame, int, int, list[tuple[int, int]]]:
    """(word counts, tokens, distinct words, the commonest words with their counts) of the rows with `__train`."""
    words = written(word_counts(texts.where("__train").select("__text")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sorted((r["word"] % (1 << 64), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(ESCAPE - 1).collect())
    return words, int(total), int(distinct), top


def _learned(texts: DataFrame, names: list[str], distinct: int, top: list[tuple[int, int]], written, dropped, *,
             word_share: float = 0, context_share: float = 0, discount: float = 0.75, strength: float = 1.0,
             burn_in: int = 1, samples: int = 3, moves: int = 30, seed: int = 11) -> Swept:
    """The lots of `__text` after the sweeps, learned from the rows with `__train`."""
    spark = texts.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = texts.agg(F.coalesce(F.sum(F.length("__text")), F.lit(0))).first()[0]
    deal = Deal(max(shuffles, every // (6 * LOT_TOKENS)), np.array([w for w, _ in top], np.uint64),
                np.array([-(-n // (10 * SPLIT)) for _, n in top], np.int64))
    buckets = max(1, -(-distinct // SPLIT))
    lots = written(lots_of(dealt(texts, names, deal), deal, buckets).withColumn("part", _part()), "lots", ("part",))
    return sweep(lots, buckets, distinct, discount=discount, strength=strength, burn_in=burn_in, samples=samples,
                 moves=moves, seed=seed, written=written, dropped=dropped)


def fit(texts: DataFrame, **options) -> tuple[Model, DataFrame]:
    """(model, word counts) learned from all tokens of the column `__text`.

    Every word is a dish and has a restaurant for what follows it; the parent of all restaurants has every word as a dish
    and a uniform base. Restaurants are dealt to lots with the tokens that come to them, words to buckets; lots and buckets
    tell each other tables and probabilities, in pieces that grow with the corpus. The driver sees totals and the commonest
    words. `word_share` and `context_share`, once the least shares of a dish and a restaurant, change nothing.

    A sweep seats every restaurant given its parent's predictive probabilities (new seating, then Gibbs
    moves, `moves` a dish or its customers if these are fewer); its tables are the parent's customers, which is
    seated in turn. After `burn_in` sweeps the predictive probabilities of `samples` sweeps are averaged. Pairs seen once
    have one table, so only the others are seated.
    """
    table = texts.select(F.coalesce("__text", F.lit("")).alias("__text"), F.lit(True).alias("__train"))
    written, dropped = _tables(texts.sparkSession)
    words, total, distinct, top = _counted(table, written)
    swept = _learned(table, [], distinct, top, written, dropped, **options)
    return Model(swept.rows(), Scale(swept.sweeps.strength, np.array(swept.sweeps.passed), total, distinct)), words


def score(docs: DataFrame, train: Column, *, id_column: str = "doc_id", text_column: str = "text",
          carry: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The carried columns, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` of every document.

    Tokens are runs of non-blank characters, A-Z lower-cased, and one end; the model learns from the rows for
    which `train` holds and scores all. `base_score` is the add-one unigram log10 probability, `score` the
    model's. Null texts count as empty (one token, the end); repeated rows count as often as they come; with no training
    rows every word is unknown; an empty table gives no rows; carried columns with made names are left out.

    The model is as large as the corpus has pairs, so it is never sent: tokens go to the lots of their contexts once, are
    counted and scored there, and what a lot finds for the documents of a block goes back to the block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    made = T.StructType([T.StructField(n, t, False) for n, t in (
        ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()),
        ("base_score", T.DoubleType()), ("score", T.DoubleType()))])
    kept = carried(docs, carry, made)
    names = [f"__{i}" for i in range(len(kept))]
    texts = docs.select(*[docs[f.name].alias(n) for f, n in zip(kept, names, strict=True)],
                        F.coalesce(docs[text_column], F.lit("")).alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    written, dropped = _tables(spark)
    words, total, distinct, top = _counted(texts, written)
    dropped(words)
    swept = _learned(texts, names, distinct, top, written, dropped, **options)
    sweeps = swept.sweeps

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        count, above, onward, of, dish, _, less = sweeps.read(left, right)
        chance = np.log10(less / (sweeps.strength + count[of]) + (above[dish] * onward[of]).mean(axis=1))
        base = np.log10((count + 1) / (total + distinct + 1))
        blocks, length, which, doc = (x.astype(np.int64) for x in unpack(left["tokens"][0].as_py()))
        which = summed(which, length)
        stop, pieces = np.cumsum(length), []
        for low, high in zip(stop - length, stop, strict=True):
            docs_here, at = np.unique(doc[low:high], return_inverse=True)
            pair = which[low:high]
            add = lambda x: np.bincount(at, x, len(docs_here))  # noqa: E731, B023
            pieces.append(pack(docs_here, add(chance[pair]).astype(np.float32), add(base[dish[pair]]),
                               add(count[dish[pair]] > 0).astype(np.int64)))
        return pa.table({"block": pa.array(blocks), "own": pa.array(np.zeros(len(blocks), bool)), "data": pa.array(pieces, pa.binary())})

    def gathered(key: tuple, part: pa.Table) -> pa.Table:
        own = part["own"].to_pylist()
        pieces = part["data"].to_pylist()
        length, stream = unpack(pieces[own.index(True)])
        sums = np.zeros((3, len(length)))
        for mine, data in zip(own, pieces, strict=True):
            if not mine:
                at, *rest = unpack(data)
                for k in range(3):
                    sums[k][at] += rest[k]
        columns = pa.ipc.open_stream(stream.tobytes()).read_all()
        found = (length.astype(np.int64), sums[2].astype(np.int64), np.full(len(length), total, np.int64), sums[1], sums[0])
        return pa.table([*columns.columns, *map(pa.array, found)], names=[f.name for f in (*kept, *made)])

    found = []
    for part in range(ROUNDS):  # one after the other, and a lot goes when it is scored: less lies on disk at once
        found.append(written(swept.each(scored, "block long, own boolean, data binary", ("pairs", "tokens"), part), "scored"))
        dropped(swept.lots, f"/part={part}")
    for table in swept.tables:
        dropped(table)
    blocks = swept.lots.where("part = -1").select("block", F.lit(True).alias("own"), F.col("words").alias("data"))
    found = reduce(DataFrame.unionByName, found)
    return found.unionByName(blocks).groupBy("block").applyInArrow(gathered, T.StructType(kept + made.fields))
