"""Benchmark decontamination: windows of items joined to documents by their rarest shingle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import Words, bounded_batches, carried, grams, made_batch, raw_bytes, text_slices
from faultsift.llm.bpe import gather

SHINGLE = 3
FILTER_BITS = 22


def item_windows(items: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """(item, words): distinct runs of `window` consecutive words of each item, joined by blanks;
    an item of fewer words, but not none, is one run. Items without an id have no windows."""
    item_type = items.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "__text"):
                words = Words(*raw_bytes(texts))
                owners, found = [], []
                for row in range(len(rows)):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    own = [words.word(i) for i in range(a, b)]
                    for at in range(max(1, len(own) - window + 1) if own else 0):
                        owners.append(row)
                        found.append(b" ".join(own[at:at + window]).decode())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(owners, pa.int64())), pa.array(found, pa.string())],
                    names=["item", "words"])

    return (items.where(F.col(id_column).isNotNull())
            .select(F.col(id_column).alias("item"), F.col(text_column).alias("__text"))
            .mapInArrow(run, T.StructType([T.StructField("item", item_type),
                                           T.StructField("words", T.StringType())])).distinct())


class Windows:
    """One bounded set of windows: word hashes, items, and the shingles that can stand for each."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        texts, which = np.unique(rows["words"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        by = np.argsort(which, kind="stable")
        self.items = rows["item"].take(pa.array(by)).combine_chunks()
        self.item_at = np.searchsorted(which[by], np.arange(len(texts) + 1))
        self.texts = [t.encode() for t in texts]
        words = Words(np.frombuffer(b"".join(self.texts), np.uint8),
                      np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64))
        self.hashes, self.first = words.hashes(), words.first
        self.size = np.diff(words.first)
        self.sizes = sorted(set(np.minimum(self.size, SHINGLE).tolist()))
        parts = []
        for k in self.sizes:
            h, at, owner = grams(self.hashes, self.first, k)
            ok = np.minimum(self.size, SHINGLE)[owner] == k
            parts.append((h[ok], (at - self.first[:-1][owner])[ok], owner[ok]))
        self.gram, self.offset, self.owner = (np.concatenate(x) for x in zip(*parts, strict=True))

    def choose(self, counts: dict[str, np.ndarray]) -> None:
        """Keeps of each window the shingle that is rarest in the documents: a document that holds
        the window holds every one of its shingles, so one is a sufficient prefix."""
        known = np.argsort(counts["gram"])
        at = np.searchsorted(counts["gram"][known], self.gram)
        at = np.minimum(at, max(len(known) - 1, 0))
        seen = np.zeros(len(self.gram), np.int64)
        if len(known):
            same = counts["gram"][known[at]] == self.gram
            seen[same] = counts["n"][known[at[same]]]
        order = np.lexsort((self.gram, seen, self.owner))
        lead = order[np.searchsorted(self.owner[order], np.arange(len(self.size)))]
        lead = lead[seen[lead] > 0]  # a window with a shingle that no document has occurs nowhere
        lead = lead[np.argsort(self.gram[lead], kind="stable")]
        self.gram, self.offset, self.owner = self.gram[lead], self.offset[lead], self.owner[lead]


class Sieve:
    """Which hashes are in a sorted list: a bit table first, then a search among those that pass."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.sorted = sorted_hashes
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[sorted_hashes >> np.uint64(64 - FILTER_BITS)] = True

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(64 - FILTER_BITS)])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == hashes[maybe]]


def _shingle_counts(docs: DataFrame, text_column: str, windows: Windows) -> dict[str, np.ndarray]:
    """How often each shingle of the windows occurs in the documents, summed by each task first."""
    sent = docs.sparkSession.sparkContext.broadcast((np.unique(windows.gram), windows.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sizes = sent.value
        sieve, total = Sieve(wanted), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, "__text"):
                words = Words(*raw_bytes(texts))
                hashes = words.hashes()
                for k in sizes:
                    h = grams(hashes, words.first, k)[0]
                    at = np.searchsorted(wanted, h[sieve.passing(h)])
                    total += np.bincount(at, minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])],
                                         names=["gram", "n"])

    rows = (docs.select(F.col(text_column).alias("__text")).mapInArrow(run, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).toArrow())
    return {"gram": rows["gram"].to_numpy().view(np.uint64), "n": rows["n"].to_numpy()}


def _occurrences(windows: Windows, sieve: Sieve, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence, verified word by word."""
    hashes = words.hashes()
    starts, which = [], []
    for k in windows.sizes:
        h, at, owner = grams(hashes, words.first, k)
        hit = sieve.passing(h)
        low = np.searchsorted(windows.gram, h[hit], side="left")
        many = np.searchsorted(windows.gram, h[hit], side="right") - low
        entry, hit = gather(low, many), np.repeat(hit, many)
        window = windows.owner[entry]
        start = at[hit] - windows.offset[entry]
        row = owner[hit]
        fits = ((np.minimum(windows.size[window], SHINGLE) == k) & (start >= words.first[row])
                & (start + windows.size[window] <= words.first[row + 1]))
        starts.append(start[fits])
        which.append(window[fits])
    start, window = np.concatenate(starts), np.concatenate(which)
    for i in range(int(windows.size.max(initial=0))):
        short = windows.size[window] <= i
        place = np.minimum(start + i, max(len(hashes) - 1, 0))
        other = np.minimum(windows.first[:-1][window] + i, max(len(windows.hashes) - 1, 0))
        same = short | (hashes[place] == windows.hashes[other])
        start, window = start[same], window[same]
    exact = [b" ".join(words.word(j) for j in range(s, s + int(windows.size[w]))) == windows.texts[w]
             for s, w in zip(start.tolist(), window.tolist(), strict=True)]
    exact = np.array(exact, bool)
    return start[exact], window[exact]


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, text_column: str = "text",
                       item_column: str = "item_id", item_text: str = "text",
                       carry: tuple[str, ...] = ("doc_id",), windows_at_once: int = 200_000) -> DataFrame:
    """The carried columns, `n_words`, `n_hit`, `hit_spans` and `items` for every document.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is `window`
    consecutive words of an item, or all words of a shorter one. Words inside an occurrence of any window are
    hit; `hit_spans` lists them as first word, end word (exclusive), first, end, ...; `items` are the distinct
    ids of items with an occurring window. Null and empty texts have no words; repeated rows stay and are judged
    alike; items that are null, empty or without an id hit nothing; with no items nothing is hit. A carried
    column with a made name is left out.

    Windows go to the tasks in sets of `windows_at_once` (about; by hash), one set a pass over the
    documents, so what is broadcast is bounded however many items there are. Spark counts how often the
    shingles (three words) of a set occur in the documents; the rarest of each window is the prefix it is
    joined on. Matches whose window would begin before or end after the document are dropped
    by position; the others are compared word by word.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pairs = item_windows(items, window, item_column, item_text)
    total = pairs.count()
    sets = max(1, -(-total // windows_at_once))
    made = T.StructType([
        T.StructField("n_words", T.LongType(), False),
        T.StructField("hit_spans", T.ArrayType(T.LongType(), False), False),
        T.StructField("items", T.ArrayType(items.schema[item_column].dataType, False), False)])
    kept = carried(docs, carry, T.StructType(made.fields + [T.StructField("n_hit", T.LongType())]))
    names = [f.name for f in kept]
    out = docs.select(*[docs[n] for n in names], docs[text_column].alias("__text"))
    for part in range(sets):
        rows = (pairs.where(F.pmod(F.xxhash64("item", "words"), F.lit(sets)) == part)
                if sets > 1 else pairs).toArrow()
        chosen = None
        if rows.num_rows:
            chosen = Windows(rows)
            chosen.choose(_shingle_counts(docs, text_column, chosen))
        sent = spark.sparkContext.broadcast(chosen)
        last = part == sets - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=part == 0,
                last=last) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            sieve = Sieve(windows.gram) if windows is not None and len(windows.gram) else None
            for batch in batches:
                for rows, texts in text_slices(batch, "__text"):
                    words = Words(*raw_bytes(texts))
                    before = None if first else (rows.column("hit_spans"), rows.column("items"))
                    found = _hits(windows, sieve, words, before)
                    yield made_batch(rows, names if last else [*names, "__text"], dict(zip(
                        made.names, [pa.array(np.diff(words.first)), *(
                            x.cast(f.type) for x, f in zip(found, to_arrow.values(), strict=True))],
                        strict=True)))

        to_arrow = {"hit_spans": pa.field("x", pa.list_(pa.int64())),
                    "items": pa.field("x", pa.list_(_arrow_type(rows)))}
        fields = kept + ([] if last else [T.StructField("__text", T.StringType())]) + made.fields
        out = out.mapInArrow(run, T.StructType(fields))
    hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2)), F.lit(0).cast("long"),
                      lambda n, i: n + F.get("hit_spans", i + 1) - F.get("hit_spans", i))
    return out.withColumn("n_hit", F.when(F.size("hit_spans") > 0, hit).otherwise(F.lit(0).cast("long")))


def _arrow_type(rows: pa.Table) -> pa.DataType:
    return rows.schema.field("item").type


def _hits(windows: Windows | None, sieve: Sieve | None, words: Words,
          before: tuple[pa.Array, pa.Array] | None) -> tuple[pa.Array, pa.Array]:
    """(spans, items) per row, joined with what earlier sets have found."""
    rows = len(words.first) - 1
    cover = np.zeros(len(words) + 1, np.int64)
    item_type = before[1].type.value_type if before else windows.items.type if windows is not None else pa.int64()
    owners, items = np.zeros(0, np.int64), pa.array([], item_type)
    if sieve is not None:
        start, window = _occurrences(windows, sieve, words)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + windows.size[window], -1)
        many = np.diff(windows.item_at)[window]
        items = windows.items.take(pa.array(gather(windows.item_at[:-1][window], many)))
        owners = np.repeat(words.row[start] if len(start) else owners, many)
    if before:
        spans = np.array(before[0].flatten().to_numpy()).reshape(-1, 2)
        base = np.repeat(words.first[:-1], before[0].value_lengths().to_numpy() // 2)
        np.add.at(cover, spans[:, 0] + base, 1)
        np.add.at(cover, spans[:, 1] + base, -1)
        owners = np.concatenate([owners, np.repeat(np.arange(rows), before[1].value_lengths().to_numpy())])
        items = pa.concat_arrays([items, before[1].flatten()])
    pairs = pa.table({"row": owners, "item": items}).group_by(["row", "item"]).aggregate([]).sort_by(
        [("row", "ascending"), ("item", "ascending")])
    item_ends = np.searchsorted(pairs["row"].to_numpy(), np.arange(rows + 1)).astype(np.int32)
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.ones(len(hit) + 1, bool)
    edge[1:-1] = (hit[1:] != hit[:-1]) | (words.row[1:] != words.row[:-1])
    begin = np.flatnonzero(edge[:-1]) if len(hit) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(hit))
    begin, end = begin[hit[begin]], end[hit[begin]]
    owner = words.row[begin] if len(begin) else begin
    flat = np.stack([begin, end], axis=1) - words.first[:-1][owner][:, None]
    span_ends = (2 * np.searchsorted(owner, np.arange(rows + 1))).astype(np.int32)
    return (pa.ListArray.from_arrays(pa.array(span_ends), pa.array(flat.ravel().astype(np.int64))),
            pa.ListArray.from_arrays(pa.array(item_ends), pairs["item"].combine_chunks()))
