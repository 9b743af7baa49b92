"""The pipeline stage by stage against plain re-implementations, and on odd tables."""

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F
from tests.llm.fixtures import BPE, no_docs, odd_docs, words
from tests.llm.test_neardup import brute_classes
from tests.llm.test_scans import brute_hits, brute_spans

from faultsift.llm import bpe, quality
from faultsift.llm.queries import QUERIES, bucket

SF = "/root/testdata/sf0.001"


def plain(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_every_stage_on_its_own_input(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    seen = [plain(docs)]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == list(seen[0][0].asDict())
        seen.append(plain(docs))
    raw, good, single, clean, safe, coded = seen
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels, bucket(3) != 1)
    score = {r["doc_id"]: r["score"] for r in quality.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert good == {i: r for i, r in raw.items() if score[i] >= 0.5} and len(good) < len(raw)
    classes = brute_classes([(i, r["text"]) for i, r in good.items()])
    assert single == {c[0][1]: good[c[0][1]] for c in classes}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[a:a + 13]) for _, t in items for w in [words(t)] for a in range(max(1, len(w) - 12))}
    for i, r in single.items():
        own = words(r["text"])
        if any(tuple(own[a:a + 13]) in grams for a in range(len(own))) or any(len(g) < 13 for g in grams):
            total, hit, _ = brute_hits(r["text"], items, 13)
            assert (i in clean) == (hit == 0 or 20 * hit < total)
        else:
            assert clean[i] == r
    for i, r in clean.items():
        text, at = "", 0
        for start, _, end, _ in brute_spans(r["text"])[1]:
            if start > at or at == 0:
                text += r["text"][at:start] + corpus_pipeline.MARK
            at = max(at, end)
        text += r["text"][at:]
        assert safe[i]["text"] == text and safe[i]["n_chars"] == (len(text) if at else r["n_chars"])
    vocab = bpe.vocabulary(*BPE)
    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=vocab.ranks, special_tokens={})
    for i, r in safe.items():
        assert list(coded[i]["ids"]) == library.encode_ordinary(r["text"]) and coded[i]["exact"]
        assert coded[i]["n_tokens"] == len(coded[i]["ids"])
    assert len(coded) == len(safe)
    final = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: list(r["ids"]) for r in final.collect()} == {i: list(r["ids"]) for i, r in coded.items()}


@pytest.mark.parametrize("table", [odd_docs, no_docs])
def test_odd_tables_go_through_with_their_columns(spark, tmp_path, table):
    docs = table(spark).withColumnRenamed("lang", "predicted").withColumn("n_words", F.lit(1))
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.count(), stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.count() <= before
        if n < 4:
            assert docs.columns == columns
        if n == 1:  # one of each class, repeated rows once
            assert docs.count() == docs.dropDuplicates(["doc_id", "text"]).count()


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
