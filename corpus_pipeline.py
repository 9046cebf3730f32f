"""Corpus preparation as stages over the documents table.

Quality rules drop what they reject, one document of each class of near copies stays, documents that
hold too much of a benchmark go and long passages of it are cut out of the others, sources are mixed to their target weights (a document taken k times
is k rows), and the token ids are written as wavelet-matrix shards and read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgrid.llm import decontaminate, jaccard_join, mixing, quality_rules, wavelet
from floodgrid.runtime import write_and_read as materialize, shared_dir

TOKENIZER, END_OF_DOCUMENT = "word_bpe_49k.json", 2
# Rows that are passed to Python at once: whole rows, text and all, wait in memory on both sides.
BATCH_ROWS = 1_000
# Near copies as op8 has them: words in a shingle, per cent of shingles in common.
NEAR_WORDS, NEAR_PERCENT = 4, 85


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    # 0 or less means no bound.
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The first stage sets the size for all.
    _small_batches(spark)
    return quality_rules.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_class(docs, k=NEAR_WORDS, t=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = decontaminate.benchmark_hits(docs, benchmark, keep_text=True).where(~decontaminate.contaminated())
    cut = decontaminate.remove_spans(kept)
    old = F.col("row.text").eqNullSafe(F.col("t"))
    new = {"text": F.col("t")}
    if "n_chars" in docs.columns:
        length = F.length("t").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(old, F.col("row.n_chars")).otherwise(length)
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs).where("takes > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("takes").cast("int")))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    wavelet.write_shards(docs, out, public_tokenizers.path(TOKENIZER), END_OF_DOCUMENT)
    return wavelet.read_documents(spark, out)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_shards", write_tokens),
]
# Shingle classes, posterior estimates and tokenizer files are beyond SQL; the tests hold the stages
# against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
