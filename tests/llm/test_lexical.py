"""Ranked lexical search against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from tests.llm.fixtures import PROSE, no_docs, odd_docs, odd_rows, words

from faultsift.llm import lexical

ITEMS = "item_id long, text string, rank int, score string"


def brute(docs, items, k):
    own = [(i, collections.Counter(words(t))) for i, t in docs]
    full = [c for _, c in own if c]
    many, total = len(full), sum(sum(c.values()) for c in full)
    held = collections.Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            score = 0
            for t in set(words(text)):
                if c[t] and i is not None:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * held[t] + 1)))
                    m = 100 - 90 + 90 * sum(c.values()) * many // total
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i))
        if item is not None:
            out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("group,at_once,k", [(1 << 24, 500_000, 10), (300, 9, 3)])
def test_ranking_equals_brute_force(spark, monkeypatch, group, at_once, k):
    monkeypatch.setattr(lexical, "GROUP_BYTES", group)
    dice = random.Random(2)
    vocabulary = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(dice.choices(vocabulary, weights=[1 / (n + 1) for n in range(40)], k=dice.randint(0, 30))))
            for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(None, rows[1][1]), (7, rows[7][1]), (900, PROSE * 20_000)]
    items = [(i, " ".join(dice.sample(vocabulary, 6) + ["never"])) for i in range(20)]
    items += [(50, None), (51, ""), (None, "t1 t2"), (0, "t3 t3 T3"), (52, rows[0][1]), (53, "absent")]
    docs = spark.createDataFrame([(*r, 1, "e") for r in rows], "doc_id long, text string, rank int, item_id string").repartition(4)
    table = spark.createDataFrame([(*x, 1, "e") for x in items], ITEMS)
    got = lexical.search(docs, table, k=k, terms_at_once=at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, items, k)


def test_odd_and_no_tables(spark):
    items = [(1, PROSE), (2, "word test")]
    table = spark.createDataFrame([(*x, 1, "e") for x in items], ITEMS)
    want = brute([r[:2] for r in odd_rows()], items, 10)
    assert sorted(map(tuple, lexical.search(odd_docs(spark), table).collect())) == want
    assert lexical.search(no_docs(spark), table).count() == 0
    assert lexical.search(odd_docs(spark), table.where("false")).count() == 0


def test_reading_ends_early_where_few_documents_are_good():
    dice = np.random.default_rng(1)
    term = np.repeat(np.arange(3), 20_000)
    doc = np.concatenate([dice.permutation(20_000) for _ in range(3)])
    impact = 1 + (1000 * dice.random(60_000)).astype(np.int64)
    impact[doc < 12] += 5000  # these win by far
    index = lexical.Index(20_000, term, doc, impact)
    docs, score = index.search(np.arange(3), 10, 0)
    exact = np.bincount(doc, impact).astype(np.int64)
    assert set(np.argsort(-exact, kind="stable")[:10]) <= set(docs.tolist()) and (exact[docs] == score).all()
    assert index.read < 0.1 * len(term)
    assert len(index.search(np.arange(3), 10, 10**9)[0]) == 0


def test_numbers_beyond_64_bits():
    sizes = np.array([1, 10**9], np.int64)
    assert lexical.length_norms(sizes, 10**10, 10**12).tolist() == [10 + 90 * n * 10**10 // 10**12 for n in sizes.tolist()]
