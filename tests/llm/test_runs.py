"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tests.llm.fixtures import no_docs, odd_docs, odd_rows

from faultsift.llm import periodic_runs
from faultsift.llm.queries import QUERIES

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(x, exponent=4, shortest=6):
    found = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, exponent * q):
                own = x[i:i + size]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences():
    dice = random.Random(5)
    for turn in range(300):
        x = [dice.randrange(dice.choice([1, 2, 3, 9])) for _ in range(dice.randint(0, 50))]
        if turn % 2:
            block = [dice.randrange(3) for _ in range(dice.randint(1, 6))]
            x = x[:12] + block * dice.randint(2, 8) + x[12:]
        yield x
    word = [0]
    for _ in range(8):  # Thue-Morse: squares, no overlaps
        word += [1 - b for b in word]
    yield word
    a, b = [0], [0, 1]
    while len(b) < 400:  # Fibonacci: runs of exponent above 3
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 7)])
def test_runs_of_sequences(exponent, shortest):
    for x in sequences():
        got = sorted(periodic_runs.runs_of(np.array(x, np.int64), exponent, shortest), key=lambda r: (r[0], r[2]))
        assert got == brute_runs(x, exponent, shortest), x


def test_automaton_has_every_substring_once():
    x = [1, 2, 1, 1, 2, 1, 2, 3]
    made = periodic_runs.Automaton(x)
    distinct = {tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    assert sum(made.length[s] - made.length[made.link[s]] for s in range(1, len(made.length))) == len(distinct)


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 3)])
def test_runs_of_texts(spark, exponent, shortest):
    texts = [" ".join(f"w{v}" for v in x) for x in sequences()]
    rows = [(i, t, "en", "s", 1, "k", "r", "c") for i, t in enumerate(texts)] + odd_rows()
    rows.append((900, "x " * 700_000, "en", "s", 1, "k", "r", "c"))  # over one slice
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                        "runs string, source_ string, collapsed string").repartition(3)
    got = periodic_runs.find_runs(table, exponent=exponent, shortest=shortest, carry=("doc_id", "text", "source_", "runs"))
    assert got.columns == ["doc_id", "text", "source_", "n_words", "runs", "collapsed"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        words = BLANK.findall(r["text"] or "")
        runs = [(0, 700_000, 1)] if r["doc_id"] == 900 else brute_runs(words, exponent, shortest)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs, r["doc_id"]
        assert r["collapsed"] == brute_collapsed(words, runs)


def test_no_documents(spark):
    assert periodic_runs.find_runs(no_docs(spark)).count() == 0
    assert periodic_runs.find_runs(odd_docs(spark)).count() == len(odd_rows())
    with pytest.raises(ValueError):
        periodic_runs.find_runs(no_docs(spark), exponent=1)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] > 0 for r in rows) > 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        words, h = BLANK.findall(texts[r["doc_id"]] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        x = [hash(w) for w in words]
        runs = [] if len(x) > 3000 and not r["n_runs"] else brute_runs(x)
        s, size, q = min(runs, key=lambda v: (-v[1], v[0], v[2]), default=(None,) * 3)
        assert tuple(r) == (r["doc_id"], len(runs), s, size, q, size and 1000 * size // q,
                            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(brute_collapsed(words, runs)))
