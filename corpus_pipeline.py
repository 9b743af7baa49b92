"""From documents to token ids in five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.llm import bpe, decontaminate, neardup, quality, secrets
from faultsift.llm.batches import free_name
from faultsift.llm.queries import bucket, table, with_verdict
from faultsift.session import scratch_path

MARK = "[SECRET]"


def _through(docs: DataFrame, operator, keep=None) -> DataFrame:
    """Runs a row-local operator with every column of `docs` carried, whatever the columns are called,
    and returns these columns of the rows for which `keep`, an expression on the made columns, holds."""
    plain = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
    found = operator(plain, f"__{docs.columns.index('text')}", tuple(plain.columns))
    if keep is not None:
        found = found.where(keep)
    return found.select(*(F.col(f"__{i}").alias(n) for i, n in enumerate(docs.columns)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores 0.5 or more; learns as op1 does, from two thirds of the labelled documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket(3) != 1)
    return _through(docs, lambda d, text, carry: quality.score(d, model, text_column=text, carry=carry),
                    F.col("predicted") == 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class: the one of least id, null ids last; a row repeated
    as a whole stays once."""
    key = free_name(docs, "__key")
    row_key = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), h)
    leaders = (neardup.near_duplicate_classes(docs).where("leader")
               .select(row_key(F.col("id"), F.col("h").cast("string")).alias(key)).distinct())
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")
    return (docs.withColumn(key, row_key(F.col("doc_id"), text_hash))
            .join(leaders, key, "left_semi").dropDuplicates([key]).drop(key))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: a benchmark window hits some word, and a twentieth of all or more."""
    items = table(spark, sf_dir, "benchmark")

    def operator(d: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
        return with_verdict(decontaminate.find_contamination(d, items, text_column=text, carry=carry))

    return _through(docs, operator, ~F.col("contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret and linked part by a mark; n_chars, where there is one, follows. No document is dropped."""
    columns = list(docs.columns)
    text = f"__{columns.index('text')}"
    plain = docs.toDF(*(f"__{i}" for i in range(len(columns))))
    found = secrets.find_secrets(plain, text_column=text, carry=tuple(plain.columns))
    hit = F.size("spans") > 0
    found = found.withColumn(text, F.when(hit, secrets.redacted(F.col(text), F.col("spans"), MARK)).otherwise(F.col(text)))
    if "n_chars" in columns:
        size = f"__{columns.index('n_chars')}"
        found = found.withColumn(size, F.when(hit, F.length(text).cast(plain.schema[size].dataType)).otherwise(F.col(size)))
    return found.select(*(F.col(f"__{i}").alias(n) for i, n in enumerate(columns)))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether the ids decode to the text."""
    source = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = bpe.encode(plain.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), *source,
                        carry=("doc_id", "digest"), decoded=True)
    return tokens.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("digest")).alias("exact"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: No SQL for the trained stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{number}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
