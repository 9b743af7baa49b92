"""Ranked lexical search: no-random-access reads of impact-sorted postings, exact scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import Words, bounded_batches, raw_bytes, text_slices
from faultsift.llm.decontaminate import Sieve

GROUP_BYTES = 16 << 20  # text whose postings a task holds at a time
FIRST_READ = 16  # postings of a list in the first round; each round reads twice as many


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, terms): the distinct terms of each item with an id, as hashes; items without terms are left out."""
    item, text = F.col(id_column).alias("item"), F.col(text_column).alias("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                words = Words(*raw_bytes(texts))
                hashes = words.hashes().view(np.int64)
                terms = [np.unique(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    made = T.StructType([T.StructField("item", items.schema[id_column].dataType),
                         T.StructField("terms", T.ArrayType(T.LongType()))])
    return items.where(F.col(id_column).isNotNull()).select(item, text).mapInArrow(run, made).where("size(terms) > 0")


def _postings(words: Words, sieve: Sieve) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, frequency) of the asked terms in the rows of a slice."""
    hashes = words.hashes()
    hit = sieve.passing(hashes)
    term = np.searchsorted(sieve.sorted, hashes[hit])
    pair, often = np.unique(words.row[hit] * len(sieve.sorted) + term, return_counts=True)
    return pair // max(len(sieve.sorted), 1), pair % max(len(sieve.sorted), 1), often


def _statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents holding each asked term), summed by each task first."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, total, many, held = Sieve(sent.value), 0, 0, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                words = Words(*raw_bytes(texts))
                total += len(words)
                many += int((np.diff(words.first) > 0).sum())
                held += np.bincount(_postings(words, sieve)[1], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[many, total], held[some]]))],
            names=["term", "n"])

    rows = (docs.select("text").mapInArrow(run, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True))
    many, total = found.pop(-2, 0), found.pop(-1, 0)
    held = np.zeros(len(terms), np.int64)
    held[list(found)] = list(found.values())
    return many, total, held


def weights(many: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)


def length_norms(sizes: np.ndarray, many: int, total: int) -> np.ndarray:
    """m of documents of these numbers of terms; wide numbers, as the product can pass 64 bits at a large size."""
    if total and 90 * int(sizes.max(initial=0)) * many >= 1 << 63:
        return np.array([10 + 90 * n * many // total for n in sizes.tolist()], np.int64)
    return 10 + 90 * sizes * many // max(total, 1)


class Index:
    """Impact-sorted postings of a group of documents, numbered by ascending id."""

    def __init__(self, documents: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, -impact, term))
        self.documents, self.doc, self.impact = documents, doc[order], impact[order]
        self.terms, start = np.unique(term[order], return_index=True)
        self.bounds = np.append(start, len(order))
        self.read = 0  # postings read, of all searches

    def lists(self, terms: np.ndarray) -> list[tuple[int, int]]:
        at = np.flatnonzero(np.isin(self.terms, terms))
        return [(int(self.bounds[i]), int(self.bounds[i + 1])) for i in at]

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of at least the k best whose score is `floor` or more and above 0.

        Every list is read from its highest impact down. A document's lower bound is the sum of what was read of it,
        its upper bound adds the next impact of each list it was not met in. Reading ends when no unmet document can
        reach the k-th lower bound (or `floor`) and every document that can has been met in all lists that still
        matter, so that its bounds are equal.
        """
        lists = self.lists(terms)
        heads = np.array([self.impact[a] for a, _ in lists], np.int64)
        place = np.full(self.documents, -1)  # of the documents that were met and can be among the best
        docs, lower, unseen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones((len(lists), 0), bool)
        depth, step, kth, resolved = 0, FIRST_READ, max(floor, 1), True
        while heads.sum() >= kth or not resolved:
            parts = [slice(min(a + depth, b), min(a + depth + step, b)) for a, b in lists]
            if heads.sum() >= kth:
                fresh = np.unique(np.concatenate([self.doc[p] for p in parts]))
                fresh = fresh[place[fresh] == -1]
                place[fresh] = len(docs) + np.arange(len(fresh))
                docs = np.concatenate([docs, fresh])
                lower = np.concatenate([lower, np.zeros(len(fresh), np.int64)])
                unseen = np.concatenate([unseen, np.ones((len(lists), len(fresh)), bool)], axis=1)
            for i, part in enumerate(parts):
                at = place[self.doc[part]]
                met = at >= 0
                lower[at[met]] += self.impact[part][met]
                unseen[i, at[met]] = False
                self.read += part.stop - part.start
            depth, step = depth + step, 2 * step
            heads = np.array([self.impact[a + depth] if a + depth < b else 0 for a, b in lists], np.int64)
            if len(docs) >= k:
                kth = max(kth, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            upper = lower + np.where(unseen, heads[:, None], 0).sum(axis=0)
            able = upper >= kth
            place[docs[~able]] = -2  # given up for good: kth only rises
            docs, lower, unseen = docs[able], lower[able], unseen[:, able]
            place[docs] = np.arange(len(docs))
            resolved = bool((upper[able] == lower).all())
        return docs, lower


class _Searcher:
    """The best k documents of each item over the groups one task has seen."""

    def __init__(self, items: list[np.ndarray], terms: np.ndarray, weight: np.ndarray, many: int, total: int, k: int):
        self.items, self.weight, self.many, self.total, self.k = items, weight, many, total, k
        self.sieve = Sieve(terms)
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]  # (-score, id), ascending
        self._clear()

    def _clear(self) -> None:
        self.ids, self.parts, self.rows, self.size = [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        data, offsets = raw_bytes(texts)
        words = Words(data, offsets)
        named = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        number = np.full(len(ids), -1)
        number[named] = self.rows + np.arange(len(named))
        row, term, often = _postings(words, self.sieve)
        ok = number[row] >= 0
        row, term, often = row[ok], term[ok], often[ok]
        norm = length_norms(np.diff(words.first), self.many, self.total)[row]
        impact = self.weight[term] * (1_000_000_000 * often // (1000 * often + 8 * norm))
        self.parts.append((term, number[row], impact))
        self.ids.append(ids.drop_null().to_numpy())
        self.rows += len(named)
        self.size += len(data)
        if self.size >= GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        ids = np.concatenate(self.ids)
        by = np.argsort(ids, kind="stable")
        term, doc, impact = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        some = impact > 0
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        index, ids = Index(len(ids), term[some], rank[doc[some]], impact[some]), ids[by]
        for number, terms in enumerate(self.items):
            best = self.best[number]
            docs, score = index.search(terms, self.k, -best[-1][0] if len(best) == self.k else 0)
            if len(docs):
                first = np.lexsort((docs, -score))[:self.k]
                best += zip((-score[first]).tolist(), ids[docs[first]].tolist(), strict=True)
                best.sort()
                del best[self.k:]
        self._clear()


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", item_text: str = "text", terms_at_once: int = 500_000) -> DataFrame:
    """(item, rank, document, score), named as the two id columns: the k best documents of every item.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A document's score is the sum, over
    the item's distinct terms, of w * (10^9 * tf div (1000 * tf + 8 * m)): w falls with the number of documents that
    hold the term, m grows with the document's number of terms; all whole numbers. Equal scores go to the smaller id;
    documents with score 0 are not listed; fewer than k with a score are all listed.

    Null and empty texts have no terms. Every row is a document: repeated rows are ranked one by one. Documents without
    an id (a whole number) count in the statistics and are not ranked; items without an id or terms have no rows; an
    item id that comes twice is answered twice. Empty tables give no rows. Other columns are not read.

    Items go to the tasks in sets of about `terms_at_once` terms (by hash; an item is never split), so what is
    broadcast is bounded however many items there are; each set takes two passes, one for its statistics. A
    task keeps postings of the asked terms only, of 16 MB of text at a time, reads them by NRA (`Index.search`), and
    carries each item's k-th score from group to group; k rows an item and task come back to a rank filter.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = item_terms(items, item_column, item_text)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    sets = -(-total // terms_at_once)
    item_type = items.schema[item_column].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()),
                           T.StructField("item", item_type), T.StructField("id", T.LongType()),
                           T.StructField("score", T.LongType())])
    table = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    out = None
    for part in range(sets):
        rows = (asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(sets)) == part) if sets > 1 else asked).toArrow()
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        own = [np.sort(np.asarray(t, np.int64).view(np.uint64)) for t in rows["terms"].to_pylist()]
        terms = np.unique(np.concatenate(own))
        many, count, held = _statistics(table, terms)
        sent = spark.sparkContext.broadcast((
            [np.searchsorted(terms, t) for t in own], terms, weights(many, held), many, count, rows["item"].combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, part=part) -> Iterator[pa.RecordBatch]:
            numbers, terms, weight, many, count, names = sent.value
            searcher = _Searcher(numbers, terms, weight, many, count, k)
            for batch in batches:
                for rows, texts in text_slices(batch, "text"):
                    searcher.add(rows.column(0), texts)
            searcher.flush()
            number = np.repeat(np.arange(len(numbers)), [len(b) for b in searcher.best])
            found = [x for b in searcher.best for x in b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), part, np.int32)), pa.array(number), names.take(pa.array(number)),
                 pa.array([i for _, i in found], pa.int64()), pa.array([-s for s, _ in found], pa.int64())],
                names=schema.names)

        found = table.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = Window.partitionBy("part", "number").orderBy(F.desc("score"), "id")
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score"))
