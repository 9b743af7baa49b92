"""Exact top-k by inner product: blocks of vectors, pruned by the sum of their term maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import bounded_batches

EXACT = float(1 << 53)
GROUP_VALUES = 1 << 23  # components of the rows a task holds at a time
ROWS_AT_ONCE = 512
OWN_ORDER = 4  # blocks that each query takes in its own order


def quantised(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, q): components floor(scale * x); vectors that are null, empty or hold a null, NaN or
    infinite component, and rows without an id, are left out."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
            .select(F.col(id_column).cast("long").alias("id"),
                    F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("q")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width: shorter vectors end in zeros, which add nothing to a product."""
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = column < width
    out[row[ok], column[ok]] = flat[ok]
    return out


def coherent_order(rows: np.ndarray, block: int) -> list[np.ndarray]:
    """Row numbers in blocks of `block` at most: rows are halved at the median of their most spread component
    until they fit, so a block's components lie close together and its maxima bound its rows tightly."""
    done, todo = [], [np.arange(len(rows))]
    while todo:
        some = todo.pop()
        if len(some) <= block:
            done.append(some)
            continue
        own = rows[some]
        widest = int(np.argmax(own.var(axis=0)))
        half = len(some) // 2
        order = np.argpartition(own[:, widest], half)
        todo += [some[order[half:]], some[order[:half]]]
    return done


class _Searcher:
    """The best k of each query over the blocks one task has seen."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, block_rows: int = 256):
        self.ids, self.queries, self.k, self.block_rows = ids, queries, k, block_rows
        self.real = queries.astype(np.float64)
        self.high, self.low = np.maximum(self.real, 0), np.minimum(self.real, 0)
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vector = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.many = np.zeros(len(ids), np.int64)
        self.kth = np.full(len(ids), -np.inf)
        self.largest = np.abs(self.real).max(initial=0)
        self.scored = self.pairs = 0  # (query, block) pairs that were scored, of all

    def rows(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Each query takes its few blocks of highest bound first, from the highest down, which brings its kth near
        its end; the other blocks then go once over all queries whose bound there is still not below their kth."""
        real = matrix.astype(np.float64)
        blocks = [(ids[some], matrix[some]) for some in coherent_order(real, self.block_rows)]
        bounds = (np.stack([m.max(axis=0) for _, m in blocks]).astype(np.float64) @ self.high.T
                  + np.stack([m.min(axis=0) for _, m in blocks]).astype(np.float64) @ self.low.T)
        bounds += np.abs(bounds) * 1e-9 + 1e-6  # the rounding of a bound must not lose a score
        self.pairs += bounds.size
        first = min(OWN_ORDER, len(blocks))
        order = np.argsort(-bounds, axis=0, kind="stable")
        for turn in range(first):
            self._visit(blocks, bounds, order[turn])
        bounds[order[:first], np.arange(len(self.ids))] = -np.inf
        for block in np.argsort(-bounds.max(axis=1), kind="stable"):
            self._visit(blocks, bounds, np.full(len(self.ids), block))

    def _visit(self, blocks: list, bounds: np.ndarray, mine: np.ndarray) -> None:
        """Scores block mine[q] for each query q whose bound there is not below its kth (-inf: was there)."""
        here = bounds[mine, np.arange(len(mine))]
        asked = np.flatnonzero((here >= self.kth) & (here > -np.inf))
        self.scored += len(asked)
        by = asked[np.argsort(mine[asked], kind="stable")]
        for some in np.split(by, np.flatnonzero(np.diff(mine[by])) + 1) if len(by) else []:
            self._score(*blocks[mine[some[0]]], some)

    def _score(self, ids: np.ndarray, block: np.ndarray, asked: np.ndarray) -> None:
        width = block.shape[1]
        if self.largest * np.abs(block.astype(np.float64)).max(initial=0) * width < EXACT:
            scores = (self.real[asked] @ block.T.astype(np.float64)).astype(np.int64)
        else:  # beyond 53 bits: 64-bit integers, which wrap as a long does
            scores = self.queries[asked] @ block.T
        keep = (ids[None, :] != self.ids[asked][:, None]) & (scores >= self.kth[asked][:, None])
        row, column = np.nonzero(keep)
        if not len(row):
            return
        hit = np.unique(row)  # queries whose best may change; the others are not looked at
        own = asked[hit]
        held = np.arange(self.k)[None, :] < self.many[own][:, None]
        number = np.concatenate([np.nonzero(held)[0], np.searchsorted(hit, row)])
        score = np.concatenate([self.score[own][held], scores[row, column]])
        vector = np.concatenate([self.vector[own][held], ids[column]])
        by = np.lexsort((vector, -score, number))
        number, score, vector = number[by], score[by], vector[by]
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        best = rank < self.k
        number, rank = number[best], rank[best]
        self.score[own[number], rank], self.vector[own[number], rank] = score[best], vector[best]
        self.many[own] = np.bincount(number, minlength=len(own))
        full = own[self.many[own] == self.k]
        self.kth[full] = self.score[full, self.k - 1]

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, score, vector id) of what is held."""
        number, rank = np.nonzero(np.arange(self.k)[None, :] < self.many[:, None])
        return number, self.score[number, rank], self.vector[number, rank]


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024,
           id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = 256,
           queries_at_once: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every query by integer inner product.

    Ties go to the smaller id; fewer than k candidates are all returned; rows that share the query's
    id count as its own and are not candidates. Vectors of other lengths are filled up with zeros.
    A query id that comes twice is answered for each of its distinct vectors under the same id.
    Empty tables give no rows. Scores are 64-bit integers.

    Tasks cut their vectors into blocks of rows that lie close together (`coherent_order`), keep each block's maximum
    and minimum per component, and go through the blocks of a query in the order of their bounds. Queries come in
    sets of about `queries_at_once` (by hash; each set is sent to the tasks once), so neither
    the driver nor a task holds all of them; every task returns k rows a query at most, from which a
    rank filter takes the best.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    table = quantised(vectors, scale, id_column, vector_column)
    asked = quantised(queries, scale, id_column, vector_column).distinct()
    total, width = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_part", "_number", "query_id", "score", "vec_id")])
    out = None
    sets = max(1, -(-total // queries_at_once))
    for part in range(sets if total else 0):
        rows = (asked.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == part) if sets > 1 else asked).toArrow()
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks().sort_by("id")
        sent = spark.sparkContext.broadcast(
            (rows["id"].to_numpy(), _matrix(rows["q"].combine_chunks(), width)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, part=part) -> Iterator[pa.RecordBatch]:
            searcher = _Searcher(*sent.value, k, block_rows)
            held, values = [], 0

            def group() -> None:
                searcher.rows(*(np.concatenate(x) for x in zip(*held, strict=True)))

            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    rows = batch.slice(at, ROWS_AT_ONCE)
                    held.append((rows.column(0).to_numpy(), _matrix(rows.column(1), width)))
                    values += len(rows) * width
                    if values >= GROUP_VALUES:
                        group()
                        held, values = [], 0
            if held:
                group()
            number, score, vector = searcher.top()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (np.full(len(number), part), number,
                                                   searcher.ids[number], score, vector)], names=schema.names)

        found = table.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = Window.partitionBy("_part", "_number").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
