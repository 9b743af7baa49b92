"""Faults with similar titles: for one title, and for all groups at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultsift.functions.trigram import codes, jaccard, trigrams
from faultsift.session import cut
from faultsift.sources.versions import VersionedTable

MIN_SIMILARITY = 0.3
TOP = 5
# Similarity levels tried in turn; the last one is the operator's own threshold.
LEVELS = (0.8, 0.6, 0.45, 0.36, MIN_SIMILARITY)
# Entries of one posting list that meet in one task; longer lists are cut into blocks.
BLOCK = 1000
# Longest over shortest list of a length band.
BAND = 1.3


# -- H9 -------------------------------------------------------------------------------------------
def similar_to(rows: DataFrame, title: str, key: str, text: str = "title",
               exclude: Column | None = None, limit: int = TOP) -> DataFrame:
    """Rows whose text resembles ``title``, best first: one scan, a top-k at the end."""
    score = jaccard(trigrams(F.col(text)), trigrams(F.lit(title)))
    others = rows if exclude is None else rows.filter(~exclude)
    return (others.withColumn("_s", score).filter(F.col("_s") > MIN_SIMILARITY)
            .orderBy(F.desc("_s"), key).limit(limit)
            .withColumn("score", F.round("_s", 2)).drop("_s"))


class TitleIndex:
    """Postings of trigrams (token, length of the title's set, key) in buckets of the trigram, in its order."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = VersionedTable(spark, path, "bucket", self._bucket(F.col("token"), buckets), sort="token", counted=False)
        self.spark, self.buckets = spark, buckets

    @staticmethod
    def _bucket(token: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")

    def add(self, rows: DataFrame, key: str, text: str) -> None:
        """Postings of new rows; keys are taken to be new."""
        sets = rows.select(F.col(key).alias("key"), codes(trigrams(F.col(text))).alias("_set"))
        self.table.merge(sets.select(F.explode("_set").alias("token"), F.size("_set").alias("size"), "key"),
                         DataFrame.unionByName)

    def similar(self, title: str, limit: int = TOP, exclude: Column | None = None) -> DataFrame:
        """(key, score), best first: what ``similar_to`` finds, from the postings of the title's own trigrams.

        Only their buckets are opened, and in these the row groups that can hold them; each posting of a title of
        fitting length is one shared trigram, so counting them gives the similarity.
        """
        asked = codes(trigrams(F.lit(title)))
        own = self.spark.range(1).select(F.explode(asked).alias("token")).select(
            "token", self._bucket(F.col("token"), self.buckets).alias("bucket")).collect()
        n, opened = len(own), {str(r["bucket"]) for r in own}
        fits = (F.col("size") > MIN_SIMILARITY * n - 1e-9) & (F.col("size") < n / MIN_SIMILARITY + 1e-9)
        hits = self.table.read(lambda b, _: b in opened).filter(
            F.col("token").isin([r["token"] for r in own]) & fits)
        if exclude is not None:
            hits = hits.filter(~exclude)
        shared = hits.groupBy("key").agg(F.count(F.lit(1)).alias("_shared"), F.max("size").alias("_size"))
        return (shared.withColumn("_s", F.col("_shared") / (F.col("_size") + n - F.col("_shared")))
                .filter(F.col("_s") > MIN_SIMILARITY).orderBy(F.desc("_s"), "key").limit(limit)
                .select("key", F.round("_s", 2).alias("score")))


# -- H10 -------------------------------------------------------------------------------------------
def similar_groups(groups: DataFrame, key: str = "group_id", text: str = "title") -> DataFrame:
    """The best five similar groups of every group: (key, similar_id, score, rank).

    Titles with equal trigram sets are one node, however many groups carry them: of those
    only the first six ids can show up in anyone's top five. Nodes meet through the rare
    end of their trigram lists (``meetings``) above a similarity level, from a high level downwards;
    a node that has its five matches at one level cannot gain from the next and leaves. Exact:
    every pair above the level meets once, and any pair not found yet scores lower.
    """
    # Texts without any trigram resemble nothing, as the similarity is then 0.
    own = cut(groups.select(F.col(key), F.array_sort(codes(trigrams(F.col(text)))).alias("_set"))
              .filter(F.size("_set") > 0))
    # A checkpoint fixes the numbers.
    distinct = cut(own.groupBy("_set").agg(F.count(F.lit(1)).alias("carriers"))
                   .withColumn("node", F.monotonically_increasing_id()))
    carriers = cut(own.join(distinct.select("_set", "node"), "_set").select(key, "node"))
    within = Window.partitionBy("node").orderBy(key)
    members = (carriers.withColumn("_rn", F.row_number().over(within))
               .filter(F.col("_rn") <= TOP + 1).drop("_rn"))
    nodes = cut(rare_first(distinct).withColumn("carriers", F.least("carriers", F.lit(TOP + 1))))

    open_nodes, above = nodes, 1.0
    found: list[DataFrame] = []
    for level in LEVELS:
        pairs = cut(pairs_above(open_nodes, nodes, level).filter(F.col("score") <= above))
        found.append(pairs)
        so_far = reduce(DataFrame.unionByName, found)
        reached = so_far.groupBy("node").agg(F.sum("carriers").alias("_others"))
        open_nodes = cut(open_nodes.join(reached, "node", "left")
                         .filter(F.coalesce("_others", F.lit(0)) + F.col("carriers") - 1 < TOP)
                         .drop("_others"))
        above = level
        if open_nodes.isEmpty():
            break
    same = nodes.select("node", F.col("node").alias("other"), F.lit(1.0).alias("score"))
    pairs = reduce(DataFrame.unionByName, found).select("node", "other", "score").unionByName(same)
    # Each node keeps only as many neighbours as can matter, before ids are attached.
    best = Window.partitionBy("node").orderBy(F.desc("score"), "similar_id")
    ranked = (pairs.join(members.select(F.col("node").alias("other"),
                                        F.col(key).alias("similar_id")), "other")
              .withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= TOP + 1)
              .select("node", "similar_id", "score"))
    mine = Window.partitionBy(key).orderBy(F.desc("score"), "similar_id")
    return (carriers.join(ranked, "node")
            .filter(F.col(key) != F.col("similar_id"))
            .withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= TOP)
            .select(key, "similar_id", F.round("score", 2).alias("score"), "rank"))


def rare_first(sets: DataFrame) -> DataFrame:
    """(node, carriers, _rare, _n): each node's trigrams, the rarest first, ties by code. One order for all."""
    exploded = sets.select("node", F.explode("_set").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    # At most a title's worth of trigrams is collected per node.
    ordered = (exploded.join(frequency, "token").groupBy("node")
               .agg(F.array_sort(F.collect_list(F.struct("_df", "token"))).alias("_ordered")))
    return sets.join(ordered, "node").select(
        "node", "carriers", F.transform("_ordered", lambda t: t["token"]).alias("_rare"), F.size("_set").alias("_n"))


def _band(size: Column) -> Column:
    """Lengths in bands whose ends differ by a fixed ratio."""
    return F.floor(F.log(size.cast("double")) / math.log(BAND) + 1e-9).cast("int")


def postings(nodes: DataFrame, level: float) -> DataFrame:
    """(token, _at, node, _n): the prefix of each list in which a set similar above ``level`` must share a
    trigram. A little too long a prefix is harmless, too short a one would lose pairs."""
    size = F.col("_n") - F.ceil(F.col("_n") * level - 1e-9).cast("int") + 1
    return nodes.select("node", "_n", F.posexplode(F.slice("_rare", 1, size)).alias("_at", "token"))


def meetings(probe: DataFrame, index: DataFrame, level: float) -> DataFrame:
    """(node, other): pairs that may be similar above ``level``, as often as they meet.

    Two such sets share a trigram in their prefixes, and the first one they share, at positions i and j,
    leaves at least the wanted overlap in the shorter tail. From position i of a list of n a
    partner of m is reached only while level / (1 + level) * (n + m) <= n - i: the common
    trigrams, which come last, lead to short partners only. So lists are joined by trigram and length band, and
    a probe row goes to the bands that its position can reach. Long lists are cut into blocks on
    both sides, so a trigram that all titles share is spread over many tasks.
    """
    share = level / (1 + level)
    shortest = F.ceil(F.col("_n") * level - 1e-9)
    longest = F.least(F.floor(F.col("_n") / level + 1e-9), F.floor((F.col("_n") - F.col("_at")) / share - F.col("_n") + 1e-6))
    left = (postings(probe, level).filter(longest >= shortest)
            .withColumn("_band", F.explode(F.sequence(_band(shortest), _band(longest)))))
    right = postings(index, level).withColumn("_band", _band(F.col("_n")))
    keys = ["token", "_band"]
    long_lists = [side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
                  for side, name in ((left, "_probe_blocks"), (right, "_index_blocks"))]
    blocks = (long_lists[0].join(long_lists[1], keys)
              .filter((F.col("_probe_blocks") > 1) | (F.col("_index_blocks") > 1)))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its own list, once for every block of the other list."""
        one = F.lit(1).cast("bigint")
        return (side.join(blocks, keys, "left")
                .withColumn(own, F.pmod(F.xxhash64("node"), F.coalesce(own, one)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, one) - 1))))

    a = dealt(left, "_probe_blocks", "_index_blocks")
    b = dealt(right, "_index_blocks", "_probe_blocks").select(
        *keys, "_probe_blocks", "_index_blocks", F.col("node").alias("other"),
        F.col("_n").alias("_other_n"), F.col("_at").alias("_other_at"))
    needed = (F.col("_n") + F.col("_other_n")) * share - 1e-9
    tail = F.least(F.col("_n") - F.col("_at"), F.col("_other_n") - F.col("_other_at"))
    return (a.join(b, [*keys, "_probe_blocks", "_index_blocks"])
            .filter((F.col("node") != F.col("other")) & (tail >= needed)
                    & F.col("_other_n").between(shortest, F.floor(F.col("_n") / level + 1e-9)))
            .select("node", "other"))


def pairs_above(probe: DataFrame, index: DataFrame, level: float) -> DataFrame:
    """(node, other, carriers of other, score) of all pairs above ``level``, each once."""
    a = probe.select("node", F.col("_rare").alias("_a"))
    b = index.select(F.col("node").alias("other"), F.col("_rare").alias("_b"), "carriers")
    return (meetings(probe, index, level).distinct().join(a, "node").join(b, "other")
            .select("node", "other", "carriers", F.size(F.array_intersect("_a", "_b")).alias("_shared"),
                    (F.size("_a") + F.size("_b")).alias("_all"))
            .withColumn("score", F.col("_shared") / (F.col("_all") - F.col("_shared")))
            .filter(F.col("score") > level)
            .select("node", "other", "carriers", "score"))
