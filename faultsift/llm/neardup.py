"""Near-duplicate classes: ProbMinHash signatures, banding around hubs, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import ODD, Words, bounded_batches, give_back, mix, raw_bytes, shingles, text_slices
from faultsift.session import scratch_path

LOW48 = np.uint64((1 << 48) - 1)
BLOCK = 128        # documents on either side of a comparison of blocks
COLUMNS = 4096     # shingles of it held as a dense matrix at a time


def distinct_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(owner row, 48-bit shingle, how often) for every distinct shingle of every text, by row."""
    words = Words(*raw_bytes(texts))
    total, owner = shingles(words.hashes(), words.first, size)
    keys = np.sort(owner.astype(np.uint64) << np.uint64(48) | total & LOW48)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    often = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    return (keys >> np.uint64(48)).astype(np.int64), keys & LOW48, often, words


def prob_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int,
                  registers: int) -> np.ndarray:
    """Signatures, rows x registers: two texts agree in a register with the probability Jaccard
    similarity of their weighted shingles.

    Every element is a Poisson process of rate `weight` whose arrivals fall on random registers; a
    register keeps the element that arrived first. An element stops as soon as its next arrival is
    later than the latest register of its row, when it can change nothing any more.
    """
    first = np.full(rows * registers, np.inf)
    winner = np.zeros(rows * registers, np.uint64)
    now = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        with np.errstate(over="ignore"):
            random = mix(element + np.uint64(turn) * ODD)
        now = now - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight
        with np.errstate(over="ignore"):
            register = (mix(random ^ ODD) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        at = owner * registers + register.astype(np.int64)
        np.minimum.at(first, at, now)
        won = now == first[at]
        winner[at[won]] = element[won]
        last = first.reshape(rows, registers).max(axis=1)
        on = now < last[owner]
        owner, element, weight, now = owner[on], element[on], weight[on], now[on]
    return winner.reshape(rows, registers)


def _signed(docs: DataFrame, id_column: str, text_column: str, size: int, bands: int, band_rows: int) -> DataFrame:
    """(id, h, node, bands): what a row is known by, its word sequence, and the values of its bands.

    `node` is a hash of the words, or of the text where it has none, so exact copies share it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "__text"):
                owner, element, _, words = distinct_shingles(texts, size)
                hashes, first = words.hashes(), words.first
                signs = prob_min_hash(owner, element, np.ones(len(element)), len(rows), bands * band_rows)
                values = np.zeros((len(rows), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(band_rows):
                        values = mix(values * ODD + signs[:, k::band_rows])
                    values += np.arange(bands, dtype=np.uint64)
                nodes = []
                for row in range(len(rows)):
                    a, b = first[row], first[row + 1]
                    nodes.append(b"w" + xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a
                                 else b"t" + xxhash.xxh3_128_digest(texts[row].as_py()))
                worded = np.diff(first) > 0
                ends = np.concatenate([[0], np.cumsum(worded * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(nodes, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(mix(values[worded].ravel()).view(np.int64)))],
                    names=["id", "h", "node", "bands"])

    return (docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h"),
                        F.col(text_column).alias("__text"))
            .mapInArrow(run, T.StructType([
                T.StructField("id", docs.schema[id_column].dataType), T.StructField("h", T.LongType()),
                T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])))


def _verified(pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b) of the rows (a, b, text_a, text_b) whose sets of shingles are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sides = [distinct_shingles(rows.column(c).cast(pa.large_binary()), size)[:2] for c in (2, 3)]
                keys = [owner.astype(np.uint64) << np.uint64(48) | element for owner, element in sides]
                both = np.intersect1d(*keys, assume_unique=True) >> np.uint64(48)
                common = np.bincount(both.astype(np.int64), minlength=len(rows))
                total = sum(np.bincount(owner, minlength=len(rows)) for owner, _ in sides) - common
                keep = common >= threshold * total - 1e-9
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["a", "b"])
            give_back()

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _compare_blocks(size: int, threshold: float):
    """Compares all of one block with all of another; returns a spanning forest of the links."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        outside = rows["outside"].to_numpy(zero_copy_only=False)
        node = rows["node"].combine_chunks()
        owner, element, _, _ = distinct_shingles(rows["text"].combine_chunks().cast(pa.large_binary()), size)
        count = np.bincount(owner, minlength=len(rows))
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        place = np.zeros(len(rows), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        shared = np.intersect1d(element[outside[owner]], element[~outside[owner]])
        column = np.searchsorted(shared, element)
        known = (column < len(shared)) & (shared[np.minimum(column, max(len(shared) - 1, 0))] == element
                                          if len(shared) else np.zeros(len(element), bool))
        owner, column = owner[known], column[known]
        common = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, len(shared), COLUMNS):
            part = (column >= low) & (column < low + COLUMNS)
            sides = []
            for side, members in ((True, left), (False, right)):
                own = part & (outside[owner] == side)
                held = np.zeros((len(members), COLUMNS), np.float32)
                held[place[owner[own]], column[own] - low] = 1
                sides.append(held)
            common += sides[0] @ sides[1].T
        total = count[left][:, None] + count[right][None, :] - common
        root = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        a, b, names = [], [], node.to_pylist()
        for i, j in zip(*np.nonzero(common >= threshold * total - 1e-6), strict=True):
            x, y = names[left[i]], names[right[j]]
            if find(x) != find(y):
                root[find(x)] = find(y)
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for the nodes of the links.

    Rounds of taking the least label among the neighbours, then the label's own label, each written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = _written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "theirs").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
        moved = _written(step.join(jump, "least").select(
            "node", F.least("least", "further").alias("label"),
            (F.least("least", "further") != F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"neardup-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_duplicate_classes(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = 5,
                           threshold: float = 0.8, bands: int = 25, band_rows: int = 5) -> DataFrame:
    """(id, h, class_key, class_id, class_size, leader) for every row of `docs`.

    Two documents are linked if the Jaccard similarity of their sets of `size`-word shingles is `threshold` or more
    (words: digits, letters, non-ASCII, A-Z lower-cased; fewer words are one shingle); a class is a connected
    component of links, copies included. `class_id` is its least id, `class_key` its name, `h` the 64-bit hash of the
    row's text, and `leader` marks the rows with the least (id, h) of the class, of which one should stay. Texts without
    words are in a class with equal texts only; null ids sort last and null texts are empty texts; repeated rows are all
    returned; an empty table gives no rows.

    Signatures are ProbMinHash over distinct shingles of weight one, so registers agree as often as the sets' Jaccard
    similarity says, however often a shingle repeats within a text; with 25 bands of 5 a pair of similarity 0.8 is
    missed in 1 of 20,000 cases. Copies are first reduced to one node. Within a band's bucket all nodes are compared
    with one hub (the one that meets most others), not with each other. What stays outside its hub's component is then
    compared with all members met around that hub, block by block, of which only a spanning forest returns; so no link
    between classes is lost and no group is ever expanded into pairs.
    """
    bounded_batches(docs.sparkSession)
    rows = _written(_signed(docs.withColumn(text_column, F.coalesce(text_column, F.lit(""))), id_column, text_column,
                            size, bands, band_rows), "rows")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    nodes = rows.groupBy("node").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    sketches = rows.where(F.size("bands") > 0).dropDuplicates(["node"])
    dealt = sketches.select("node", F.explode("bands").alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = _written(dealt.join(full, "bucket"), "shared")
    support = shared.groupBy("node").agg(F.sum("n").alias("support"))
    hubs = (shared.join(support, "node").groupBy("bucket")
            .agg(F.max(F.struct("support", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("b")))
    pairs = _written(shared.select(F.col("node").alias("a"), "bucket").join(hubs, "bucket").where("a <> b")
                     .select("a", "b").distinct(), "pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    wanted = met.select("node", F.col("first.id").alias("i"), F.col("first.h").alias("g"))
    texts = _written(texts.join(wanted, texts["id"].eqNullSafe(wanted["i"]) & (texts["h"] == wanted["g"]))
                     .select("node", "text").dropDuplicates(["node"]), "texts")
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    links = _written(_verified(pairs.join(side("a"), "a").join(side("b"), "b"), size, threshold), "links")
    labels = _components(links)
    more = _residual_links(pairs, labels, texts, size, threshold)
    if not more.isEmpty():
        labels = _components(links.unionByName(more))
    named = nodes.join(labels, "node", "left").select(
        "node", "first", "copies", F.coalesce("label", "node").alias("label"))
    classes = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    known = _written(named.select("node", "label").join(classes, "label"), "classes")
    return rows.join(known, "node").select(
        "id", "h", F.hex("label").alias("class_key"), F.col("first.id").alias("class_id"), "class_size",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))).alias("leader"))


def _residual_links(pairs: DataFrame, labels: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links of nodes that their hub's component does not hold with the other nodes met around that hub."""
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    hub = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    around = _written(pairs.join(own, "a", "left").join(hub, "b", "left").select(
        F.col("a").alias("node"), "b",
        (F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).alias("outside")), "around")
    sizes = (around.groupBy("b").agg(F.count("*").alias("n"), F.count_if("outside").alias("out"))
             .where("n > 1 AND out > 0"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    held = around.join(sizes.select("b", blocks("n").alias("across"), blocks("out").alias("down")), "b")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (held.where("outside").select("node", "b", F.lit(True).alias("outside"), mine("down").alias("i"), spread("across").alias("j"))
            .unionByName(held.select("node", "b", F.lit(False).alias("outside"), spread("down").alias("i"), mine("across").alias("j"))))
    return _written(rows.join(texts, "node").groupBy("b", "i", "j").applyInArrow(
        _compare_blocks(size, threshold), "a binary, b binary"), "more")
