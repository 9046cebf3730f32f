"""Ranked lexical search as dense blocked matrix products.

Items are queries of distinct terms; a document's score for an item is the sum, over the item's
terms, of a term weight times an impact, both integers. Scores are made tile by tile:

* The terms of a block of items form a vocabulary. One pass over the whole texts writes a slim table:
  per document its length and its counts of vocabulary terms. Document frequencies and lengths are
  aggregates of it.
* A tile of items has a compact vocabulary of its own, cut into slices of ``TILE_TERMS`` terms. The
  slice's weights (terms x items) and a document tile's impacts (documents x terms) are dense float64
  matrices and meet in one BLAS product. All partial sums of a product are integers below
  ``TILE_TERMS`` x 10^6 x (largest weight) < 2^53, so the product is exact in any order of addition;
  slices are added up as 64-bit integers.
* A task keeps the ``k`` best of every item by (score, smaller doc_id): ties at the edge of a tile are
  decided by the id, never by the order of arrival. The tasks' lists, at most ``k`` rows an item each,
  meet in one window.

Items are cut into blocks of at most ``block_bytes`` of text (a longer item is a block of its own).
One block at a time is held by the driver and broadcast, so neither grows with the benchmark; every
block is one pass over the documents.

Cases: null and empty texts have no terms, are not counted and not found; an item without terms finds
nothing; repeated items are ranked each; repeated documents stand beside each other; documents
without an id come after those with one at equal scores; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from floodgrid.llm.texts import alnum_words
from floodgrid.runtime import write_and_read as materialize

TOP = 10
BLOCK_BYTES = 8 << 20
TILE_ITEMS, TILE_DOCS, TILE_TERMS = 64, 512, 2048
# Fixed values of the score: impacts stay below IMPACT / 1000, lengths count LENGTH_SHARE per cent.
IMPACT, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE, WEIGHT = 1_000_000_000, 1000, 8, 90, 1000
_EXACT = 1 << 53


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)


def _item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Blocks of (id, distinct terms), read partition by partition."""
    block, size = [], 0
    for row in items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        raw = (row.t or "").encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.i, sorted(set(alnum_words(raw)))))
        size += len(raw)
    if block:
        yield block


def _term_counts(documents: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the numbers and counts of vocabulary terms, for documents with a term."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        known = number.keys()
        for batch in batches:
            at, n, ids, tfs, ends = [], [], [], [], [0]
            for row, t in enumerate(batch.column(1).cast(pa.binary())):
                words = alnum_words(t.as_py() or b"")
                if not words:
                    continue
                counts = Counter(words)
                found = counts.keys() & known
                at.append(row)
                n.append(len(words))
                ids.extend(number[w] for w in found)
                tfs.extend(counts[w] for w in found)
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return materialize(rows.mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>"))


class ItemTile:
    """Some items over their compact vocabulary: the weights of their terms, slice by slice."""

    def __init__(self, items: list[list[int]], weight: np.ndarray):
        self.n = len(items)
        item = np.repeat(np.arange(self.n), [len(t) for t in items])
        term = np.array([t for terms in items for t in terms], np.int64)
        # Terms of weight 0 (those of nearly all documents) add nothing.
        item, term = item[weight[term] > 0], term[weight[term] > 0]
        self.terms, column = np.unique(term, return_inverse=True)
        self.slices = []
        for lo in range(0, len(self.terms), TILE_TERMS):
            mine = (column >= lo) & (column < lo + TILE_TERMS)
            width = min(TILE_TERMS, len(self.terms) - lo)
            if width * (IMPACT // TF_SCALE) * int(weight[self.terms[lo : lo + width]].max()) >= _EXACT:
                raise ValueError("partial sums beyond 2^53")
            self.slices.append((lo, width, column[mine] - lo, item[mine], weight[term[mine]].astype(np.float64)))

    def scores(self, column: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """(documents x items) of 64-bit scores; ``column`` is scratch, -1 for every term of the vocabulary."""
        column[self.terms] = np.arange(len(self.terms))
        at = column[term]
        column[self.terms] = -1
        total = np.zeros((n_docs, self.n), np.int64)
        for lo, width, c, i, w in self.slices:
            mine = (at >= lo) & (at < lo + width)
            tile = np.zeros((n_docs, width))
            tile[row[mine], at[mine] - lo] = impact[mine]
            weights = np.zeros((width, self.n))
            weights[c, i] = w
            total += (tile @ weights).astype(np.int64)
        return total


class TopK:
    """The k best (score, id) of every item: higher scores first, then smaller ids, missing ids last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        for j in np.flatnonzero((scores >= self.least[first : first + scores.shape[1]]).any(0)):
            # A score equal to the k-th best may still win by its id.
            rows = np.flatnonzero(scores[:, j] >= self.least[first + j])
            old = self.kept[first + j]
            s, i, m = (np.concatenate(p) for p in zip(old, (scores[rows, j], ids[rows], missing[rows])))
            order = np.lexsort((i, m, -s))[: self.k]
            self.kept[first + j] = (s[order], i[order], m[order])
            if len(order) == self.k:
                self.least[first + j] = s[order[-1]]


def _rank_block(documents: DataFrame, doc_id: str, text: str, block: list[tuple], first: int, id_type, k: int) -> DataFrame | None:
    """item, item_id, doc_id, score: every task's best documents of a block of items."""
    sc = documents.sparkSession.sparkContext
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, terms in block for w in terms}))}
    if not vocabulary:
        return None
    counted = _term_counts(documents, doc_id, text, vocabulary)
    size = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not size.docs:
        return None
    n_docs, n_terms = size.docs, size.terms
    df = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("ids").alias("t")).groupBy("t").count().toLocalIterator():
        df[row.t] = row["count"]
    weight = np.array([term_weight(n_docs, int(d)) for d in df], np.int64)
    numbers = [[vocabulary[w] for w in terms] for _, terms in block]
    shared = sc.broadcast((weight, numbers, [i for i, _ in block]))
    schema = StructType().add("item", LongType()).add("item_id", id_type).add("doc_id", LongType()).add("score", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, numbers, names = shared.value
        tiles = [(lo, ItemTile(numbers[lo : lo + TILE_ITEMS], weight)) for lo in range(0, len(numbers), TILE_ITEMS)]
        best = TopK(len(numbers), k)
        column = np.full(len(weight), -1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(lo, TILE_DOCS)
                lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), lengths)
                term = part.column(2).flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)
                m = np.array([length_factor(n, n_docs, n_terms) for n in part.column(1).to_pylist()], np.int64)
                impact = impacts(tf, m[row])
                missing = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for at, tile in tiles:
                    best.add(at, tile.scores(column, row, term, impact, part.num_rows), ids, missing)
        out = to_arrow_schema(schema)
        for j, (s, i, m) in enumerate(best.kept):
            if len(s):
                columns = [pa.array([first + j] * len(s), pa.int64()), pa.array([names[j]] * len(s), out.field(1).type), pa.array(i, mask=m), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return counted.mapInArrow(run, schema)


def rank_documents(
    documents: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item, scores above 0."""
    id_type = items.schema[item_id].dataType
    found, first = None, 0
    for block in _item_blocks(items, item_id, item_text, block_bytes):
        part = _rank_block(documents, doc_id, text, block, first, id_type, k)
        first += len(block)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        schema = StructType().add("item_id", id_type).add("rank", IntegerType()).add("doc_id", LongType()).add("score", LongType())
        return documents.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
