"""Token counts through a cache of digests.

A text's key is the SHA-256 of its UTF-8 bytes together with the SHA-256 of the tokenizer file.
Byte-level tokenizers see every byte, so the only normalisation that keeps counts is null to the
empty text. Texts whose key is in the cache are not encoded; of the others one copy each is encoded
and appended.

Copies collapse before the shuffle (one per map task) and after it, so a text that fills a third of
the rows moves once per task. Keys that hold over 1/1000 of all rows, at most 1000, are joined by
broadcast; the rest by shuffle.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows stay; an empty table gives an
empty result; extra columns are kept if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgrid.llm.encoding import encoder, groups
from floodgrid.runtime import write_and_read as materialize

_CACHE = "digest binary, n_tokens bigint, tokenizer string"
HOT_SHARE = 1000


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; empty without a cache."""
    try:
        stored = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    # Writers that ran at the same time may have stored a digest twice.
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column is new in this task."""
    seen: set[bytes] = set()
    for batch in batches:
        take = []
        for i, d in enumerate(batch.column(0)):
            d = d.as_py()
            if d not in seen:
                seen.add(d)
                take.append(i)
        yield batch.take(pa.array(take, pa.int32()))


def _keyed(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return documents.select(
        F.unhex(F.sha2(body, 256)).alias("digest"),
        body.alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
    )


def add_misses(documents: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Encode the distinct texts that the cache lacks and append their counts to it."""
    spark, version = documents.sparkSession, tokenizer_version(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, counts=True)
        for batch in _first_copies(batches):
            bodies = (b.as_py() for b in batch.column(1).cast(pa.binary()))
            counts = [n for some in groups(bodies) for n in enc.encode(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    texts = _keyed(documents, text, []).select("digest", "body")
    local = texts.mapInArrow(_first_copies, texts.schema).repartition("digest")
    new = local.join(read_cache(spark, cache, version), "digest", "left_anti")
    counted = new.mapInArrow(count, "digest binary, n_tokens bigint").withColumn("tokenizer", F.lit(version))
    counted.write.mode("append").partitionBy("tokenizer").parquet(cache)


def token_counts(documents: DataFrame, path: str, cache: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``n_bytes`` and ``n_tokens`` of every document."""
    spark, version = documents.sparkSession, tokenizer_version(path)
    add_misses(documents, path, cache, text)
    rows = _keyed(documents, text, documents.columns if keep is None else keep)
    rows = rows.select("digest", "row", F.octet_length("body").cast("long").alias("n_bytes"))
    if keep is not None:
        rows = materialize(rows)  # Without the texts, so that they are not read for each use below.
    known = read_cache(spark, cache, version)
    copies = rows.groupBy("digest").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*")).first()[0]
    hot = copies.where(F.col("n") * HOT_SHARE > total).join(known, "digest").select("digest", F.col("n_tokens").alias("hot_tokens"))
    split = rows.join(F.broadcast(hot), "digest", "left")
    rest = split.where("hot_tokens IS NULL").drop("hot_tokens").join(known, "digest")
    done = split.where("hot_tokens IS NOT NULL").withColumnRenamed("hot_tokens", "n_tokens")
    return rest.unionByName(done).select("row", "n_bytes", "n_tokens")
