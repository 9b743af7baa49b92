"""Trained operators: held-out accuracy, exact parts against brute force, and odd tables."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import no_docs, odd_docs, odd_rows

from faultsift.llm import language_id, pitman_yor, quality
from faultsift.llm.queries import bucket

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, extra string"


def test_dual_descent_reaches_the_hinge_optimum():
    dice = np.random.default_rng(1)
    points = dice.normal(size=(40, 3)).astype(np.float32)
    sign = np.where(points @ np.array([1.0, -2.0, 0.5]) + 0.3 * dice.normal(size=40) > 0, 1.0, -1.0)
    rows = [(np.arange(3), p) for p in points]
    w, b = quality.dual_descent(rows, sign, 1.0, 3, 2000, 0)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - sign * (points @ w + b)).sum()

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + dice.normal(0, 0.01, 3), b + dice.normal(0, 0.01)) >= best - 1e-3


def test_indicators_are_the_runs_of_bytes_and_words():
    data = np.frombuffer(b"aab!aa aa", np.uint8)
    (_, upto, feature), = quality.indicators(data, np.array([0, 4, 4, 9]))
    own = [set(feature[a:b].tolist()) for a, b in zip(upto[:-1], upto[1:], strict=True)]
    assert own[1] == set() and {97, 98, 33} == {f for f in own[0] if f < 256}
    pairs = {f - 256 for f in own[0] if 256 <= f < 256 + 65536}
    assert pairs == {97 * 256 + 97, 97 * 256 + 98, 98 * 256 + 33}
    base = quality.SINGLES + quality.PAIRS + quality.TRIPLES
    assert base in own[2] and base not in own[0] and base + 1 not in own[2]  # a word twice, not three times


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels, bucket(3) != 1))
    assert scored.count() == docs.count()
    right, n = (scored.join(labels, "doc_id").where(bucket(3) == 1)
                .agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first())
    assert n > 80 and right > 0.97


def brute_features(text):
    """Runs of one to three bytes and the longest run of one word, by plain loops."""
    data = text.encode()
    out = set(data) | {256 + a * 256 + b for a, b in zip(data, data[1:], strict=False)}
    for i in range(len(data) - 2):
        code = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
        out.add(256 + 65536 + (code * 0x9E3779B97F4A7C15 % (1 << 64) >> 48))
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    longest, last, run = 0, None, 0
    for word in (w for w in re.split("[ \t\n\x0b\x0c\r]+", lowered) if w):
        run, last = (run + 1 if word == last else 1), word
        longest = max(longest, run)
    return out | {256 + 2 * 65536 + i for i, n in enumerate((2, 3, 4, 6, 8)) if longest >= n}


def test_quality_scores_match_brute_force(spark):
    """Ratios by plain counts over the training rows, margins and scores by plain sums."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.where(F.length("text") < 3000).limit(250).unionByName(docs.limit(1).withColumn("text", F.lit(""))).cache()
    model = quality.fit(docs, labels, bucket(3) != 1)
    known = docs.join(labels.select("doc_id", "quality"), "doc_id").where(bucket(3) != 1).collect()
    size, held = collections.Counter(r["quality"] for r in known), {0: collections.Counter(), 1: collections.Counter()}
    for r in known:
        held[r["quality"]].update(brute_features(r["text"]))
    ratio = {f: math.log((held[1][f] + 1) / (size[1] + 2) / ((held[0][f] + 1) / (size[0] + 2)))
             for f in held[0].keys() | held[1].keys()}
    at = np.array(sorted(ratio))
    assert np.allclose(model.squares[at], [ratio[f] ** 2 for f in at]) and model.squares.sum() == pytest.approx(
        sum(x * x for x in ratio.values()))
    for r in quality.score(docs, model, carry=("doc_id", "text")).collect():
        own = brute_features(r["text"])
        norm = math.sqrt(max(sum(ratio.get(f, 0.0) ** 2 for f in own), 1e-12))
        margin = sum(model.weights[f] for f in own) / norm + model.bias
        want = 1 / (1 + math.exp(-(model.slope * margin + model.shift)))
        assert math.isclose(r["score"], want, abs_tol=1e-6) and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_fit_is_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"fine text number {i}") for i in range(300)] + [(2, "poor poor poor")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x")], LABELS)
    rows, given = [], quality.dual_descent
    monkeypatch.setattr(quality, "dual_descent", lambda some, *rest: (rows.append(len(some)), given(some, *rest))[1])
    model = quality.fit(docs, labels, F.lit(True), max_train=40)
    assert rows and rows[0] <= 40
    assert quality.score(docs.withColumn("__text", F.lit("own")), model, carry=("doc_id", "__text")).where("__text = 'own'").count() == 301


def test_quality_of_odd_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, "x"), (6, 0, "x"), (2, 1, "x"), (None, 1, "x"), (7, None, "x"), (8, 5, "x"),
                                    (6, 0, "x"), (999, 0, "x")], LABELS)
    for some in (labels, labels.where("quality = 1"), labels.where("false")):
        got = quality.score(docs, quality.fit(docs, some, F.lit(True)), carry=("doc_id", "score", "lang")).collect()
        assert len(got) == len(odd_rows()) and got[0].asDict().keys() == {"doc_id", "lang", "score", "predicted"}
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    model = quality.fit(no_docs(spark), labels, F.lit(True))
    assert quality.score(no_docs(spark), model).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs, bucket(5) != 0), carry=("doc_id", "lang"))
    right, n = found.where(bucket(5) == 0).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97


def test_language_of_odd_tables(spark):
    docs = odd_docs(spark)
    model = language_id.fit(docs, F.lit(True), steps=5)
    got = language_id.identify(docs, model, carry=("text", "score")).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    assert language_id.fit(no_docs(spark), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(no_docs(spark), model).count() == 0


def test_backpropagation_matches_differences():
    random_ = np.random.default_rng(2)
    layer = language_id.Direction(random_)
    text = random_.integers(97, 105, (6, 3)).astype(np.uint8)
    weight = random_.normal(size=(6, language_id.UNITS, 3)).astype(np.float32)
    trace: list = []
    layer.forward(text, trace)
    given, kept = layer.backward(text, trace, weight)
    for slope, values in ((given, layer.given), (kept, layer.kept)):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        before, high, low = values[at], None, None
        values[at] = before + 1e-2
        high = float((layer.forward(text) * weight).sum())
        values[at] = before - 1e-2
        low = float((layer.forward(text) * weight).sum())
        values[at] = before
        assert math.isclose((high - low) / 2e-2, float(slope[at]), rel_tol=2e-2)


def scalar_states(layer, text):
    """States of one gated recurrent layer over the bytes of one window, by scalar loops."""
    u, out = layer.kept.shape[1], []
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    state = [0.0] * u
    for x in text:
        inner = [sum(float(layer.kept[g, j]) * state[j] for j in range(u)) for g in range(3 * u)]
        update = [sigmoid(float(layer.given[j, x]) + inner[j]) for j in range(u)]
        reset = [sigmoid(float(layer.given[u + j, x]) + inner[u + j]) for j in range(u)]
        new = [math.tanh(float(layer.given[2 * u + j, x]) + reset[j] * inner[2 * u + j]) for j in range(u)]
        state = [new[j] + update[j] * (state[j] - new[j]) for j in range(u)]
        out.append(state)
    return out


def test_language_scores_match_scalar_loops(spark):
    """A network of random weights: the operator's score is that of loops over bytes, windows and letters."""
    random_ = np.random.default_rng(8)
    ahead, back = language_id.Direction(random_), language_id.Direction(random_)
    out = random_.normal(0, 1, (3, 2 * language_id.UNITS + 1)).astype(np.float32)
    model = language_id.LanguageModel(["aa", "bb", "cc"], ahead, back, out)
    texts = ["A short one, 3 words", "Größe und Maß " * 12, "42 !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__worded", F.lit("own"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, carry=("doc_id", "__worded")).collect()}
    assert {r["__worded"] for r in got.values()} == {"own"}
    for i, text in enumerate(texts):
        data, total, seen = list(text.encode()), [0.0] * 3, 0.0
        for at in range(0, len(data), language_id.LENGTH):
            own = [int(language_id.BYTES[b]) for b in data[at:at + language_id.LENGTH]]
            own += [0] * (language_id.LENGTH - len(own))
            first, last = scalar_states(ahead, own), scalar_states(back, own[::-1])[::-1]
            for x, a, b in zip(own, first, last, strict=True):
                power = [math.exp(sum(float(w) * s for w, s in zip(row, [*a, *b, 1.0], strict=True))) for row in out]
                weight = float(language_id.LETTER[x])
                seen += weight
                total = [t + weight * p / sum(power) for t, p in zip(total, power, strict=True)]
        if i == 2:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            assert got[i]["lang_pred"] == model.languages[int(np.argmax(total))]
            assert math.isclose(got[i]["score"], max(total) / seen, abs_tol=1e-4)


def test_windows_hold_every_byte():
    data = np.arange(97, 97 + 200, dtype=np.int64).astype(np.uint8)
    text, owner = language_id.windows(data, np.array([0, 0, 130, 200]))
    assert owner.tolist() == [1, 1, 1, 2, 2]
    assert text[:, :3].T.ravel()[:130].tolist() == language_id.BYTES[data[:130]].tolist()
    assert text[:, 3:].T.ravel()[:70].tolist() == language_id.BYTES[data[130:]].tolist()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    out, word = [], ""
    for c in lower(text):
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word) + [None]


@pytest.mark.parametrize("share", [1e-4, 0.2])
def test_base_scores_match_brute_force_and_chances_add_up(spark, share):
    docs = odd_docs(spark)
    held = bucket(7) == 2
    got = pitman_yor.score(docs, ~held, carry=("doc_id", "text", "score"), word_share=share, context_share=share).collect()
    train = [r for r in odd_rows() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = collections.Counter(t for r in train for t in tokens(r[1]))
    total = sum(count.values())
    assert len(got) == len(odd_rows())
    for r in got:
        own = tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[t] > 0 for t in own), total)
        base = sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_probabilities_of_every_next_word_add_up_to_one(spark):
    dice = random.Random(3)
    texts = [" ".join(dice.choice("the of and a b c d e f g h i".split()) for _ in range(30)) for _ in range(50)]
    table = spark.createDataFrame([(t,) for t in texts], "__text string")
    model, words = pitman_yor.fit(table, word_share=0.09, context_share=0.05)
    counts = {r["word"]: r["n"] for r in words.collect()}
    hashes = np.array(sorted(counts), np.int64).view(np.uint64)
    n = np.array([counts[int(h)] for h in hashes.view(np.int64)])
    for before in [None, *hashes[:6]]:
        start = [pitman_yor.END if before is None else before]
        chance = 0.0
        for h, c in zip([*hashes, np.uint64(12345)], [*n, 0], strict=True):
            pair = np.array([*start, h], np.uint64)
            chance += 10 ** model.score(pair, np.array([0, 2]), np.array([1, c]))[1]
        assert math.isclose(chance, 1.0, abs_tol=0.02)


def test_the_model_beats_counts_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = pitman_yor.score(docs, bucket(7) != 2).where(bucket(7) == 2)
    model, base, n = scored.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert 10 ** (-model / n) < 0.9 * 10 ** (-base / n)
    assert pitman_yor.score(no_docs(spark), F.lit(True)).count() == 0
    alone = pitman_yor.score(odd_docs(spark), F.lit(False)).collect()
    assert {r["n_known"] for r in alone} == {0} and {r["train_tokens"] for r in alone} == {0}


def test_scores_of_lots_are_those_of_the_model_and_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SPLIT", 16)  # several buckets of words, large restaurants in several lots
    dice = random.Random(8)
    texts = [" ".join(f"w{int(dice.paretovariate(0.6)) % 400}" for _ in range(dice.randrange(60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(3)
    model, words = pitman_yor.fit(docs.select(F.col("text").alias("__text")))
    assert words.count() > 16 * 3
    for r in pitman_yor.score(docs, F.lit(True), carry=("text", "doc_id")).collect():
        hashes, _, first = pitman_yor.tokens(pa.array([(r["text"] or "").encode()], pa.large_binary()))
        assert math.isclose(r["score"], model.score(hashes, first).sum(), rel_tol=1e-5) and r["n_known"] == r["n_tokens"] == len(hashes)


def test_what_lies_on_disk_is_small_beside_the_tokens(spark):
    dice = random.Random(9)
    texts = [" ".join(f"word{int(dice.paretovariate(0.8)) % 5000}" for _ in range(3000)) for _ in range(40)]
    table = spark.createDataFrame([(t,) for t in texts], "__text string").repartition(2)
    deal = pitman_yor.Deal(4, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    made = pitman_yor.dealt(table.withColumn("__train", F.lit(True)), [], deal)
    lots = pitman_yor.lots_of(made, deal, 2).where("lot >= 0").collect()
    assert sum(len(x) for r in lots for x in r if isinstance(x, (bytes, bytearray))) < 8 * 3001 * 40
    read = [pitman_yor.unpack(bytes(r["pairs"])) for r in lots]
    assert sum(int(n.sum()) for *_, n in read) == 3001 * 40


def test_scoring_leaves_only_the_tables_its_result_reads(spark, monkeypatch, tmp_path):
    made = itertools.count()
    monkeypatch.setattr(pitman_yor, "scratch_path", lambda spark, label: f"{tmp_path}/{next(made)}-{label}")
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i}") for i in range(60)], "doc_id long, text string").repartition(3)
    scored = pitman_yor.score(docs, F.col("doc_id") % 2 == 0)
    left = {f.relative_to(tmp_path).parts[:-1] for f in tmp_path.rglob("*.parquet")}
    assert {x[0].split("-")[1] for x in left} == {"lots", "scored"} and {x[1] for x in left if len(x) > 1} == {"part=-1"}
    assert sorted(r["doc_id"] for r in scored.collect()) == list(range(60))


def test_gibbs_moves_keep_every_customer():
    seating = pitman_yor.Seating(0.75, 1.0, np.random.default_rng(0))
    n, above = np.array([1.0, 5, 40, 3000, 0]), np.array([0.1, 0.2, 0.3, 0.3, 0.1])
    seating.open(n, above)
    for _ in range(50):
        seating.move(n, above)
        assert np.bincount(seating.dish, seating.size, 5).tolist() == n.tolist() and (seating.size >= 1).all()
    t = seating.tables(5)
    assert (t[:4] >= 1).all() and t[4] == 0 and t[3] > t[1]


def test_tables_of_large_counts_follow_seating_one_by_one():
    n, above = np.full(200, 20_000.0), np.full(200, 1 / 200)
    got, want = [], []
    for seed in range(12):
        seating = pitman_yor.Seating(0.75, 1.0, np.random.default_rng([seed, 1]))
        seating.open(n, above)
        dice, tables = np.random.default_rng([seed, 2]), np.ones(200)
        for k in range(1, 20_000):
            fresh = (1 + 0.75 * tables.sum()) * above
            tables += dice.random(200) * (fresh + k - 0.75 * tables) < fresh
        for out, t in ((got, seating.tables(200)), (want, tables)):
            out.append((1 + 0.75 * t.sum()) / (1 + n.sum()))
    assert math.isclose(np.mean(got), np.mean(want), rel_tol=0.03)


def test_rare_words_are_dishes_and_contexts(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SPLIT", 64)  # the common word's restaurant is dealt to several lots
    dice = random.Random(4)
    filler = [" ".join(f"f{dice.randrange(10 ** 6)} the" for _ in range(2000)) for _ in range(20)]
    texts = ["rare pair " * 3, *filler]  # 3 in 80,000 tokens
    table = spark.createDataFrame([(t,) for t in texts], "__text string").repartition(4)
    model, words = pitman_yor.fit(table)
    assert words.count() == len({w for t in texts for w in t.split()}) + 1
    hashes = lambda t: pitman_yor.tokens(pa.array([t.encode()], pa.large_binary()))
    chance = lambda t: 10 ** model.score(*hashes(t)[::2])[1]
    assert chance("rare pair") > 0.3 and chance("pair rare") > 0.3
    assert chance("rare pair") > 100 * chance("other pair") > 0 and chance("rare other") > 0
