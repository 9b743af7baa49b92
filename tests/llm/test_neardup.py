"""Near-duplicate classes against all pairs, and the signatures' agreement."""

import itertools
import random

import numpy as np
import pytest
from tests.llm.fixtures import LOWER, WORD, no_docs, odd_docs, odd_rows, words

from faultsift.llm import neardup


def shingle_set(own):
    return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))}


def brute_classes(rows):
    """Class of each (id, text): rows joined by equal words (or texts without words) or similar shingles."""
    keys = {}
    for i, t in rows:
        own = tuple(words(t))
        keys.setdefault(own or ("text", t or ""), []).append((i is None, i, t))
    names = list(keys)
    sets = [shingle_set(k) if k[0] != "text" or len(k) != 2 else set() for k in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(names)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = {}
    for n, k in enumerate(names):
        out.setdefault(find(n), []).extend(keys[k])
    return sorted(sorted((i is None, i or 0) for _, i, _ in rows_) for rows_ in out.values())


def got_classes(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["class_key"], []).append((r["id"] is None, r["id"] or 0))
        assert r["class_size"] >= 1
    return sorted(map(sorted, out.values()))


def edited(text, dice, n):
    own = text.split()
    for _ in range(n):
        own[dice.randrange(len(own))] = f"w{dice.randrange(10 ** 6)}"
    return " ".join(own)


@pytest.mark.parametrize("block", [128, 4])
def test_classes_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    dice = random.Random(5)
    base = " ".join(f"b{i}" for i in range(120))
    texts = [base] * 5 + [edited(base, dice, dice.randrange(0, 9)) for _ in range(60)]
    chain = base.split()
    for i in range(12):  # each close to the last, far from the first
        chain = edited(" ".join(chain), dice, 2).split()
        texts.append(" ".join(chain))
    texts += [edited(t, dice, 1) for t in texts[-12:]]
    texts += [" ".join(f"u{dice.randrange(10 ** 6)}" for _ in range(50)) for _ in range(20)]
    texts += [base + " tail end", "same five words are here", "same five words are here!", "one", "one", "", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_classes(neardup.near_duplicate_classes(docs)) == brute_classes(rows)


def test_odd_tables(spark):
    found = neardup.near_duplicate_classes(odd_docs(spark))
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert got_classes(found) == brute_classes(rows)
    for r in found.groupBy("class_key").agg({"leader": "max"}).collect():
        assert r[1]
    assert neardup.near_duplicate_classes(no_docs(spark)).count() == 0


def test_registers_agree_as_often_as_the_probability_jaccard_says():
    dice = np.random.default_rng(8)
    element = dice.integers(1, 1 << 47, 60).astype(np.uint64)
    a, b = dice.integers(0, 5, 60).astype(float), dice.integers(0, 5, 60).astype(float)
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    signs = neardup.prob_min_hash(owner, np.concatenate([element[a > 0], element[b > 0]]),
                                  np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    assert abs((signs[0] == signs[1]).mean() - want) < 0.03
    assert set(signs[0].tolist()) <= set(element[a > 0].tolist())


def test_shingles_are_those_of_the_words():
    import pyarrow as pa
    texts = ["A b c d e f", "", "x y", None, "a B c d e! f a b c d e f", "é ü ß ñ 漢 字"]
    owner, element, often, _ = neardup.distinct_shingles(pa.array([(t or "").encode() for t in texts], pa.large_binary()), 5)
    for row, t in enumerate(texts):
        own = WORD.findall((t or "").translate(LOWER))
        assert (owner == row).sum() == (len(shingle_set(own)) if own else 0)
    assert set(element[owner == 0]) < set(element[owner == 4]) and often[owner == 4].sum() == 8


def test_copies_that_repeat_lines_are_found(spark):
    dice = random.Random(9)
    rows = []
    for pair in range(40):  # 100 common words; one copy has a passage of its own 30 times over
        common = " ".join(f"c{pair}x{i}" for i in range(104))
        own = " ".join(f"o{pair}x{dice.randrange(10 ** 6)}" for _ in range(20))
        rows += [(2 * pair, common), (2 * pair + 1, common + (" " + own) * 30)]
    want = brute_classes(rows)
    assert len(want) == 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_classes(neardup.near_duplicate_classes(docs)) == want
