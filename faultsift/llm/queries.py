"""One registered query per operator, at production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.llm import (
    bpe, decontaminate, language_id, lexical, neardup, packing, periodic_runs, pitman_yor, quality, secrets, text_density,
    topk, url_filter)


END_ID = 50256  # the end of a text, after the 50,256 ranks of the vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(n: int) -> Column:
    """crc32 of the id as text, mod n; what holds documents out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket(3) != 1)
    return quality.score(docs, model).select("doc_id", (bucket(3) == 1).alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(table(spark, sf_dir, "documents"), *source)
    return bpe.decode(tokens, source[0]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.described(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.described(F.col("spans")).alias("spans"))


def with_verdict(found: DataFrame) -> DataFrame:
    """Contaminated: some word is hit, and a twentieth of all words or more."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return with_verdict(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicate_classes(table(spark, sf_dir, "documents"), size=5, threshold=0.8)
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size")


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.pack(table(spark, sf_dir, "documents"), length=8192, text_column="text", tokenizer=source,
                        end_id=END_ID, vocabulary=END_ID + 1)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pitman_yor.score(table(spark, sf_dir, "documents"), bucket(7) != 2)
    return scored.select("doc_id", (bucket(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, bucket(5) != 0)
    return language_id.identify(docs, model).select("doc_id", (bucket(5) == 0).alias("held_out"), "lang_pred", "score")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.extract_text(table(spark, sf_dir, "pages"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Texts whose id hashes to 0 mod 10 repeat, from word a on, the p words from there; a and p from the hash too.
    Other texts, texts without words and rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Words are a column of their own, so that they are cut once a text and not once a word.
    cut = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    words = F.col("words")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    periodic = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(
        F.flatten(F.array_repeat(block, times)), F.lit(1), (n - a).cast("int")))
    return cut.withColumn("text", F.when(words.isNotNull() & (n > 0), F.array_join(periodic, " "))
                          .otherwise(F.col("text"))).drop("words")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length DIV -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_quality, op2_byte_bpe, op3_top_k, op4_secrets, op5_decontamination, op6_url_filters, op7_near_duplicates, op8_packed_ids, op9_lm_scoring, op10_language_id,
                                  op11_main_text, op12_periodic_runs, op13_lexical_search)}
