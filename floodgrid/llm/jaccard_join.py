"""Exact Jaccard self-join on word n-grams, as classes of linked documents.

A document is the set of its 64-bit shingle hashes. The join skips work by relations between sets, at
three levels:

* Equal sets are one node; copies never meet.
* Answers of highly similar sets are derived: a node whose min-hash bands agree with a smaller node's
  is compared with that one first. If they link, it has the same class, and pairs within a class
  need no comparison.
* The rest is a prefix join. Shingles are ordered from rare to frequent by a counting sketch of the
  whole table, and only the first ``n - ceil(t n) + 1`` of a set are indexed. An index list is ordered
  by set size; a probe skips on to the next size block, and by position: where two sets first meet,
  the shorter rest bounds their overlap. Lists longer than ``LIST_BLOCK`` are cut into blocks that
  meet pairwise in different tasks (sets of one block meet in several of them; pairs are made distinct).

Only lists that hold different classes go on. Their rows take the sets' parity bitmaps along (bits that
differ in two bitmaps are at most the shingles in which the sets differ), so that the task that holds a
list hands on no pair but those whose bitmaps leave a link possible: what is shuffled grows with the
lists' rows, not with their pairs. Those pairs are compared on whole sets, made again from the texts of
just those documents. No pair of different texts is lost; the sketch, the bands, the bitmaps and the
bit set only steer which work is skipped.

Cases: null texts, empty texts and texts without words have an empty set and link with nothing; a
text with fewer words than a shingle is one shingle; equal ids are separate documents of one class
if they link; documents without an id take part and have a null class if it has no id; an empty table
gives an empty result. Hashes of 64 bits make two different shingles of a pair equal with a
probability of about 1e-11 for texts of 5,000 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.functions.graph import components
from floodgrid.functions.skew import join_hot
from floodgrid.llm.texts import clear_others, kept_by_worker
from floodgrid.runtime import discard, settled
from floodgrid.runtime import write_and_read as materialize

SHINGLE, THRESHOLD = 4, 85
SKETCH_BITS, SKETCH_SLICES = 22, 16
BANDS, ROWS = 4, 2
LIST_BLOCK = 2000
FILTER_BITS = 23
WORDS_KEPT = 100_000
# Bytes of sets that a task holds before it hands them on, and rows whose arrays it holds at once.
CHUNK = 1 << 22
PIECE = 256
# Largest bitmap of a set, in bytes.
BITMAP = 512
# Pairs that share one copy of a set.
PAIRS_A_COPY = 1000
# Pairs of a row of a list that are checked in the first round, and by how many times more in each that follows.
FIRST_PAIRS, MORE_PAIRS = 1, 16
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = kept_by_worker(_WordHashes())


def _start_task() -> None:
    """Frees what earlier stages keep in this worker."""
    clear_others(_HASHES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text (A-Z lower-cased, split at ASCII white space)."""
    words = text.lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    if not size:
        return h
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
    return np.unique(_mixed(total))


def prefix_length(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, t: int) -> bool:
    """100 x intersection >= t x union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < t * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= t * (len(a) + len(b) - common)


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap of at least twice as many bits as shingles; each shingle flips one."""
    size = max(64, 1 << int(2 * len(s) - 1).bit_length())
    flips = np.bincount((s >> _U(32) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A number of shingles in which two sets differ at least, from their bitmaps."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def fold_bits(bits: bytes, most: int) -> bytes:
    """The bitmap of the same set with at most ``most`` bytes."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def least_differences(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``least_difference`` of the bitmaps i and j of a list, for arrays of pairs."""
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    out = np.zeros(len(i), np.int64)
    kinds = size[i] << 32 | size[j]
    for kind in np.unique(kinds):
        a, b = int(kind) >> 32, int(kind) & 0xFFFFFFFF
        least = min(a, b)
        if not least:
            continue
        pairs = np.flatnonzero(kinds == kind)
        for at in np.array_split(pairs, len(pairs) * least // CHUNK + 1):
            x, y = (np.frombuffer(b"".join([bits[r] for r in rows[at]]), np.uint64).reshape(len(at), -1) for rows in (i, j))
            while x.shape[1] != y.shape[1]:
                wide = x if x.shape[1] > y.shape[1] else y
                folded = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
                x, y = (folded, y) if wide is x else (x, folded)
            out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    for batch in batches:
        yield batch, (x.as_py() or b"" for x in batch.column(column).cast(pa.binary()))


def frequency_levels(documents: DataFrame, text: str, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Per sketch cell, the binary logarithm of the number of shingles counted there (one byte each).

    Every task counts its share in 2^bits cells; the sums are made slice by slice in parallel. What
    comes to the driver is 2^bits bytes for any table.
    """
    cells = 1 << bits
    part = cells // SKETCH_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start_task()
        counts = np.zeros(cells, np.uint32)
        for _, texts in _texts(batches, 0):
            for t in texts:
                np.add.at(counts, (shingle_set(t, k) & _U(cells - 1)).astype(np.int64), 1)
        for s in range(SKETCH_SLICES):
            piece = counts[s * part : (s + 1) * part]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pa.compress(piece.tobytes(), "zstd", asbytes=True)])], ["s", "b"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(pa.decompress(b.as_py(), part * 4, "zstd", asbytes=True), np.uint32)
                sums[s] = sums.get(s, np.zeros(part, np.uint64)) + got
        for s, total in sums.items():
            levels = np.log2(total.astype(np.float64) + 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([levels.tobytes()])], ["s", "b"])

    counted = documents.select(text).mapInArrow(count, "s int, b binary")
    out = np.zeros(cells, np.uint8)
    for row in counted.repartition(SKETCH_SLICES, "s").mapInArrow(add, "s int, b binary").collect():
        out[row.s * part : (row.s + 1) * part] = np.frombuffer(bytes(row.b), np.uint8)
    return out


def _signatures(documents: DataFrame, doc_id: str, text: str, k: int, t: int, levels) -> DataFrame:
    """doc_id, n, digest of the set, min-hash bands, the rarest ``prefix`` shingles in order, parity bitmap."""
    odd = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        mask = _U(len(level) - 1)
        pieces = (batch.slice(lo, PIECE) for batch in batches for lo in range(0, batch.num_rows, PIECE))
        for batch, texts in _texts(pieces, 1):
            n, digests, bands, prefixes, bitmaps, small = [], [], [], [], [], []
            for raw in texts:
                s = shingle_set(raw, k)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    bands.append([])
                    prefixes.append([])
                    bitmaps.append(b"")
                    small.append(b"")
                    continue
                bitmaps.append(fold_bits(parity_bits(s), BITMAP))
                # Half of it rides with the rows of lists: enough to tell unlike sets apart.
                small.append(fold_bits(bitmaps[-1], max(8, len(bitmaps[-1]) // 2)))
                low = np.array([(s * c).min() for c in odd]).reshape(BANDS, ROWS)
                key = _mixed(low[:, 0] + _U(3) * low[:, 1] + np.arange(BANDS, dtype=np.uint64))
                bands.append(key.view(np.int64))
                # A shingle's place in the order: its level, then its hash.
                place = level[(s & mask).astype(np.int64)].astype(np.uint64) << _U(58) | s >> _U(6)
                p = prefix_length(len(s), t)
                prefixes.append(np.sort(np.partition(place, p - 1)[:p]).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(prefixes, longs), pa.array(bitmaps, pa.binary()), pa.array(small, pa.binary())],
                ["doc_id", "n", "digest", "bands", "prefix", "bits", "small"],
            )

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n int, digest binary, bands array<bigint>, prefix array<bigint>, bits binary, small binary")


class _BitSet:
    """A set of ids as 2^FILTER_BITS bits, whatever their number; others are let through by chance."""

    def __init__(self, ids: DataFrame):
        places = ids.where("doc_id IS NOT NULL").select(self.cell("doc_id").alias("c"))
        bits = F.expr("bit_or(shiftleft(1L, CAST(c % 32 AS INT)))")
        words = places.groupBy(F.shiftright("c", 5).alias("w")).agg(bits.alias("bits"))
        table = np.zeros(1 << FILTER_BITS >> 5, np.uint32)
        for row in words.toLocalIterator():
            table[row.w] = row.bits
        self.bits = ids.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def cell(c: str) -> Column:
        """The place of an id; null without one."""
        col = F.col(f"`{c}`").cast("long")
        return F.when(col.isNotNull(), F.pmod(F.xxhash64(col), F.lit(1 << FILTER_BITS)))

    def filter(self) -> Callable[[pa.Array], np.ndarray]:
        """Which of an array of places may be in the set; rows without an id may."""
        bits = self.bits

        def may(cells: pa.Array) -> np.ndarray:
            null = cells.is_null().to_numpy(zero_copy_only=False)
            at = cells.fill_null(0).to_numpy(zero_copy_only=False)
            return null | (bits.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)

        return may


def _rows_by_bits(packed: DataFrame, bits: _BitSet, wanted: bool) -> DataFrame:
    """Rows (row, id, ...) whose id may be in the set, or those whose id is not."""
    may = bits.filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may(batch.column(batch.num_columns - 1))
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep == wanted))

    return packed.withColumn("cell", bits.cell("id")).mapInArrow(run, packed.schema)


def _screened(pairs: DataFrame, nodes: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) of nodes whose bitmaps leave a link possible."""
    slim = nodes.select("node", F.struct("n", "bits").alias("of"))
    one = join_hot(pairs, slim.select(F.col("node").alias("a"), F.col("of").alias("x")), "a", 100)
    both = join_hot(materialize(one), slim.select(F.col("node").alias("b"), F.col("of").alias("y")), "b", 100)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
            x, y = batch.column(3), batch.column(5)
            least = np.array([least_difference(x[i].as_py(), y[i].as_py()) for i in range(batch.num_rows)], np.int64)
            # Linked sets differ in at most (1 - t) / (1 + t) of the sum of their sizes.
            yield batch.select([0, 1]).filter(pa.array((100 + t) * least <= (100 - t) * (na + nb)))

    flat = both.select("a", "b", F.col("x.n").alias("na"), F.col("x.bits").alias("xb"), F.col("y.n").alias("nb"), F.col("y.bits").alias("yb"))
    return flat.mapInArrow(screen, "a bigint, b bigint")


def _dealt(pairs: DataFrame, bodies: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, ...) with a number ``copy``, and the body of the node in column ``end`` for every (end, copy).

    A node of many pairs is sent in copies, one for every ``PAIRS_A_COPY`` of them, so its pairs are
    spread over tasks and no body is broadcast.
    """
    copies = materialize(pairs.groupBy(end).agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies")).where("copies > 1"))
    copy = F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1))).cast("int")
    dealt = join_hot(pairs, copies, end, how="left").withColumn("copy", copy).drop("copies")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy")
    asked = bodies.join(pairs.select(F.col(end).alias("node")).distinct(), "node", "left_semi")
    sent = asked.join(copies.withColumnRenamed(end, "node"), "node", "left").select(F.col("node").alias(end), each, "body")
    return dealt, sent


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, doc_id: str, text: str, k: int, t: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link, written; the sets are deleted."""
    return settled(documents.sparkSession, lambda: _verified(pairs, nodes, documents, doc_id, text, k, t))


def _verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, doc_id: str, text: str, k: int, t: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = materialize(nodes.join(ends, "node", "left_semi").select("node", "digest", "doc_id"))
    bits = _BitSet(needed)
    may = bits.filter()
    rows = documents.select(bits.cell(doc_id).alias("cell"), F.col(f"`{text}`").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])

        digests, bodies, size = [], [], 0
        for batch in batches:
            for i in np.flatnonzero(may(batch.column(0))):
                bodies.append(shingle_set((batch.column(1)[int(i)].as_py() or "").encode(), k).tobytes())
                digests.append(hashlib.blake2b(bodies[-1], digest_size=16).digest())
                size += len(bodies[-1])
                if size > CHUNK:
                    yield out()
                    digests, bodies, size = [], [], 0
        yield out()

    made = rows.mapInArrow(sets, "digest binary, body binary")
    # A node's own document is enough; rows with the same id or without one may bring it again.
    bodies = materialize(made.join(needed.select("digest", "node"), "digest").groupBy("node").agg(F.max("body").alias("body")))
    dealt, sent = _dealt(pairs, bodies, "b")
    with_b = materialize(dealt.join(sent, ["b", "copy"]).select("a", "b", "body"))
    dealt, sent = _dealt(with_b, bodies, "a")
    # A node's body stands before its partners', so every row carries one body.
    heads = sent.select("a", F.lit(None).cast("long").alias("b"), "copy", "body")
    both = heads.unionByName(dealt).repartition("a", "copy").sortWithinPartitions("a", "copy", F.asc_nulls_first("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            good = []
            first, last = batch.column(0), batch.column(1).is_null().to_pylist()
            for i, is_head in enumerate(last):
                body = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                if is_head:
                    head = body.copy()
                elif linked(head, body, t):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([first.take(at), batch.column(1).take(at)], ["a", "b"])

    return both.select("a", "b", "body").mapInArrow(check, "a bigint, b bigint")


def best_of_rows(i: np.ndarray, j: np.ndarray, worth: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) are among the ``most`` worthiest that i is the first of, or j the second."""
    good = np.zeros(len(i), bool)
    for row, other in ((i, j), (j, i)):
        order = np.lexsort((other, -worth, row))
        starts = np.flatnonzero(np.concatenate(([True], row[order][1:] != row[order][:-1]))) if len(order) else order
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(order)]))))
        good[order[place < most]] = True
    return good


class PairRows:
    """The pairs found in lists, of which the ``most`` worthiest of every row are handed on."""

    HELD = 1 << 20

    def __init__(self, most: int):
        self.most, self.left = most, False
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray, worth: np.ndarray) -> None:
        self.found.append(np.stack((i, j, worth)).astype(np.int64))
        self.size += len(i)
        if self.size > self.HELD:
            self._prune()

    def _prune(self) -> None:
        rows = np.concatenate(self.found, axis=1) if self.found else np.zeros((3, 0), np.int64)
        good = best_of_rows(*rows, self.most)
        self.left |= not good.all()
        self.found, self.size = [rows[:, good]], int(good.sum())

    def batch(self, node: np.ndarray) -> pa.RecordBatch:
        """(a, b, more): pairs of nodes, and whether pairs were left out."""
        self._prune()
        i, j, _ = self.found[0]
        pairs = np.unique(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), self.left))], ["a", "b", "more"])


def classes_by_rounds(labelled: DataFrame, candidates: Callable[[DataFrame, int], DataFrame], check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``labelled`` (node, label, ...) with labels joined until no candidate pair of different labels is unchecked.

    A round takes only the best pairs of every row of a list, ``FIRST_PAIRS`` at first. In a dense group those
    join most sets, and the rest of its pairs, which grow with the square of the group, is never made. Where
    pairs were left out another round takes ``MORE_PAIRS`` times as many, without those already
    checked; the last round has left none out.
    """
    tried, most = None, FIRST_PAIRS
    while True:
        pairs = candidates(labelled, most)
        more = not pairs.where("more").isEmpty()
        fresh = pairs.select("a", "b")
        if tried is not None:
            fresh = materialize(fresh.join(tried, ["a", "b"], "left_anti"))
        tried = fresh if tried is None else tried.unionByName(fresh)
        if not fresh.isEmpty():
            links = check(fresh)
            label = labelled.select("node", "label")
            across = materialize(join_hot(links, label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a"))
            across = join_hot(across, label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            across = materialize(across.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
            if not across.isEmpty():
                wider = components(across).select(F.col("node").alias("label"), F.col("label").alias("wide"))
                joined = join_hot(labelled, wider, "label", how="left").withColumn("label", F.coalesce("wide", "label")).drop("wide")
                labelled = materialize(joined)
        if not more:
            return labelled
        most *= MORE_PAIRS


def _list_pairs(t: int, most: int) -> Callable:
    """Candidate pairs of index lists that arrive ordered by (token, blocks, size and position): for every
    row those with the ``most`` likest bitmaps, and whether there are others."""

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        """Pairs within whole lists, by growing distance in the list."""
        token, blocks, spot, node, label = (rows.column(c).to_numpy() for c in range(5))
        bits = rows.column(5).to_pylist()
        size, rest = spot >> 32, (spot >> 32) - (spot & 0xFFFFFFFF)
        number = np.concatenate(([0], np.cumsum((token[1:] != token[:-1]) | (blocks[1:] != blocks[:-1]))))
        found = PairRows(most)
        active = np.arange(len(number))
        d = 1
        while True:
            active = active[active + d < len(number)]
            # Lists are ordered by size, so beyond the first set that is too large all are.
            active = active[(number[active] == number[active + d]) & (100 * size[active] >= t * size[active + d])]
            if not len(active):
                break
            i, j = active, active + d
            both = size[i] + size[j]
            # By position: where two sets first meet, the shorter rest bounds what they have in common.
            good = (label[i] != label[j]) & ((100 + t) * np.minimum(rest[i], rest[j]) >= t * both)
            i, j, both = i[good], j[good], both[good]
            # Linked sets differ in at most (1 - t) / (1 + t) of the sum of their sizes.
            least = least_differences(bits, i, j)
            left = (100 + t) * least <= (100 - t) * both
            found.add(i[left], j[left], -least[left])
            d += 1
        return found.batch(node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            token, blocks = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            # The last list may go on in the next batch.
            changes = np.flatnonzero((token[1:] != token[:-1]) | (blocks[1:] != blocks[:-1]))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield pairs_of(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return run


def _mixed_lists(nodes: DataFrame, t: int, block: int) -> DataFrame:
    """token, length m, spot (size and position), node and label of the index lists that hold several labels.

    A token's first bits are the sketch's level, so its list has fewer than 2^(level + 1) sets. Lists
    that may be longer than a block are counted first and their hot tokens joined apart.
    """
    spot = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at").cast("long")).alias("spot")
    lists = nodes.select("node", "label", "n", F.posexplode("prefix").alias("at", "token")).select("token", spot, "node", "label")
    level = F.shiftrightunsigned("token", 58)
    long_from = block.bit_length() - 1
    of = [F.count("*").alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")]
    w, by_size = Window.partitionBy("token"), Window.partitionBy("token").orderBy("spot")
    size = F.col("spot") / (1 << 32)
    # By size: a row whose neighbours in the list are too small and too large has no partner in it.
    below, above = F.floor(F.lag("spot").over(by_size) / (1 << 32)), F.floor(F.lead("spot").over(by_size) / (1 << 32))
    near = F.coalesce(100 * below >= t * F.floor(size), F.lit(False)) | F.coalesce(100 * F.floor(size) >= t * above, F.lit(False))
    labels = [F.count("*").over(w).alias("m"), F.min("label").over(w).alias("l0"), F.max("label").over(w).alias("l1")]
    short = lists.where(level < long_from).select("*", *labels, near.alias("near")).where("near")
    long = materialize(lists.where(level >= long_from))
    counts = materialize(long.groupBy("token").agg(*of).where("l0 <> l1").select("token", "m"))
    columns = ["token", "m", "spot", "node", "label"]
    return short.where("l0 <> l1").select(columns).unionByName(join_hot(long, counts, "token").select(columns))


def _still_mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of index lists that hold several labels after some have been joined."""
    now = materialize(rows.select("token", "spot", "node").join(labels, "node"))
    counts = now.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    return join_hot(now, materialize(counts.select("token", "m")), "token").select("token", "m", "spot", "node", "label")


def _list_candidates(rows: DataFrame, bits: DataFrame, t: int, block: int, most: int) -> DataFrame:
    """Pairs (a, b, more) of the lists' rows; ``bits`` has a bitmap for every node.

    A list longer than a block is cut: block i meets block j in a list of its own, in which the sets of
    both stand.
    """
    parts = F.ceil(F.col("m") / block).cast("long")
    own = F.pmod(F.xxhash64("node"), parts)
    cut = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    met = (F.shiftleft(F.least("own", "other"), 21) + F.greatest("own", "other")).alias("blocks")
    full = cut.select("token", met, "spot", "node", "label").join(bits, "node")
    ordered = full.repartition("token", "blocks").sortWithinPartitions("token", "blocks", "spot")
    pairs = ordered.select("token", "blocks", "spot", "node", "label", "bits").mapInArrow(_list_pairs(t, most), "a bigint, b bigint, more boolean")
    # Two sets meet once in every list that they share.
    return materialize(pairs.groupBy("a", "b").agg(F.max("more").alias("more")))


def _candidates(nodes: DataFrame, t: int, block: int = LIST_BLOCK) -> DataFrame:
    """All pairs of nodes of different labels that share an indexed shingle and pass the bounds of size and position."""
    rows = materialize(_mixed_lists(nodes, t, block))
    return _list_candidates(rows, nodes.select("node", F.lit(b"").alias("bits")), t, block, 1 << 60).select("a", "b")


def link_classes(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, t: int = THRESHOLD
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every document."""
    spark = documents.sparkSession
    levels = spark.sparkContext.broadcast(frequency_levels(documents, text, k))
    made = materialize(_signatures(documents, doc_id, text, k, t, levels))
    full = made.where("n > 0")
    # One node per distinct set, numbered as it is written: ids may repeat on different texts or be missing.
    sets = full.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("small").alias("small")
    )
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()))
    # Of the documents themselves only the set's digest is needed from here on.
    whole, made = made, materialize(made.select("doc_id", "n", "digest"))
    discard(whole)

    # Highly similar sets: each node with the smallest node of the band most in common.
    banded = materialize(nodes.select("node", F.explode("bands").alias("band")))
    leaders = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("m")).where("m > 1").select("band", "leader")
    near = join_hot(banded, leaders, "band").where("leader < node").groupBy("node", "leader").agg(F.count("*").alias("m"))
    star = near.groupBy("node").agg(F.max_by("leader", F.struct("m", -F.col("leader"))).alias("leader"))
    star = materialize(star.select(F.col("node").alias("b"), F.col("leader").alias("a")).select("a", "b"))
    none = spark.createDataFrame([], "node bigint, label bigint")

    first = none
    pairs = star
    star = settled(spark, lambda: _screened(pairs, nodes, t))
    if star.limit(1).count():
        links = verified(star, nodes, documents, doc_id, text, k, t)
        if links.limit(1).count():
            first = components(links)
    labelled = materialize(nodes.select("node", "digest", "doc_id").join(first, "node", "left").withColumn("label", F.coalesce("label", "node")))

    bits = nodes.select("node", F.col("small").alias("bits"))
    lists: list[DataFrame] = []

    def candidates(labelled: DataFrame, most: int) -> DataFrame:
        labels = labelled.select("node", "label")
        if lists:
            # Lists of one label stay so: later rounds look at what the round before has left.
            before = lists.pop()
            lists.append(settled(spark, lambda: _still_mixed(before, labels)))
            discard(before)
        else:
            lists.append(settled(spark, lambda: _mixed_lists(materialize(nodes.select("node", "n", "prefix").join(labels, "node")), t, LIST_BLOCK)))
        return _list_candidates(lists[0], bits, t, LIST_BLOCK, most)

    labelled = classes_by_rounds(labelled, candidates, lambda pairs: verified(pairs, nodes, documents, doc_id, text, k, t))
    return with_classes(made, labelled.select("label", "digest", "doc_id"), none)


def with_classes(made: DataFrame, nodes: DataFrame, wider: DataFrame) -> DataFrame:
    """Documents (doc_id, n, digest) with their class: nodes have a label, ``wider`` joins some labels to one."""
    step = wider.select(F.col("node").alias("label"), F.col("label").alias("wide"))
    named = materialize(join_hot(nodes, step, "label", how="left").select("digest", "doc_id", F.coalesce("wide", "label").alias("class")))
    # The class's smallest id: nodes without an id have none to give.
    smallest = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    by_set = materialize(join_hot(named, smallest, "class").select("digest", "component_id"))
    rows = materialize(made.where("n > 0").select("digest", "doc_id", "n"))
    with_sets = join_hot(rows, by_set, "digest").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = made.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_sets.unionByName(empty)


def one_of_each_class(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, t: int = THRESHOLD) -> DataFrame:
    """The row with the smallest id of every class (rows without an id last), with all columns.

    Ids that are present and different name the rows. Else rows are numbered in a written copy, so
    that of repeated ids and of rows without one, too, a single row stays.
    """
    # Packed, so that no column's name can clash with the operator's.
    kept = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    packed = documents.select(kept, F.col(f"`{doc_id}`").cast("long").alias("id"))
    missing = packed.where("id IS NULL").limit(1).count()
    if not missing and packed.groupBy("id").count().where("count > 1").isEmpty():
        classes = settled(documents.sparkSession, lambda: link_classes(documents, doc_id, text, k, t))
        dropped = classes.where("doc_id <> component_id").select("doc_id")
    else:
        packed = materialize(documents.select(kept, F.col(f"`{doc_id}`").alias("given"), F.monotonically_increasing_id().alias("id")))
        texts = packed.select("id", F.col(f"row.`{text}`").alias("text"))
        classes = settled(documents.sparkSession, lambda: link_classes(texts, "id", "text", k, t))
        linked_rows = classes.withColumnRenamed("doc_id", "id").join(packed.select("id", "given"), "id")
        first = F.min(F.struct(F.col("given").isNull(), F.col("given"), F.col("id"))).alias("first")
        keepers = linked_rows.groupBy("component_id").agg(first).select(F.col("first.id").alias("doc_id"))
        dropped = materialize(classes.select("doc_id").join(keepers, "doc_id", "left_anti"))
        packed = packed.drop("given")
    # Only rows that may be dropped are shuffled.
    bits = _BitSet(dropped)
    sure = _rows_by_bits(packed, bits, wanted=False)
    rest = _rows_by_bits(packed, bits, wanted=True).join(dropped.withColumnRenamed("doc_id", "id"), "id", "left_anti")
    return sure.select("row.*").unionByName(rest.select("row.*"))
