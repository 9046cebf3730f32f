"""Near-duplicate classes by HyperMinHash registers.

A document is the set of its 64-bit shingle hashes, as in the Jaccard join. Every register (bucket)
hashes all shingles of a set anew and stores the smallest value in floating form: the count of its
leading zeros and ``MANTISSA`` bits after the leading one, 16 bits in all. Two registers agree with a
probability of the sets' Jaccard similarity, plus a small one of accidental agreement that is known
from the sets' sizes.

* Equal sets are one node; copies never meet.
* ``BAND_ROWS`` registers, 64 bits, are a band. Sets with a band in common are candidates. A pair of
  similarity s has none with a probability of (1 - s^4)^40: under 1e-9 at the threshold of 0.8 and
  under 1e-12 at 0.85. No other step can lose a link but with the probability ``TAIL``.
* First every node is compared with the smallest node of a band, the one most in common. Those that
  link have one class, and most lists of a band then hold one class only and end there.
* The rest is compared list by list, inside the task that holds a list: of sets of different classes,
  in the first band they have in common, the collision-corrected estimate must reach a bound that a
  link misses with the probability ``TAIL``, and parity bitmaps must leave a link possible. Lists
  longer than a block are cut into blocks that meet pairwise in different tasks.
* What is left is verified on whole sets, made again from the texts of just those documents: in rounds,
  the pairs with the highest estimates of every set first, so that a dense group is joined by
  few of its pairs; the last round has left no pair out.

Cases: null texts, empty texts and texts without words have an empty set and link with nothing; a
text with fewer words than a shingle is one shingle; equal ids are separate documents of one class if
they link, kept together or not at all; documents without an id take part, and have a null class and are
kept if it has no id; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.graph import components
from floodgrid.functions.skew import join_hot
from floodgrid.llm.jaccard_join import PairRows, classes_by_rounds, fold_bits, least_differences, parity_bits, shingle_set, verified, with_classes
from floodgrid.runtime import write_and_read as materialize

SHINGLE, THRESHOLD = 4, 80
REGISTERS, BAND_ROWS, MANTISSA = 160, 4, 10
BANDS = REGISTERS // BAND_ROWS
LIST_BLOCK = 1000
TAIL = 1e-12
# Rows of a batch whose sketches are held as arrays at once.
PIECE = 256
# Largest bitmap that rides with a list's rows, in bytes.
BITMAP = 512
_U32 = np.uint32


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    """A shift and an odd factor per register."""
    words = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(REGISTERS)), _U32)
    return words[0::2].copy(), words[1::2] | _U32(1)


_SHIFT, _FACTOR = _seeds()


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes: per register, leading zeros and first mantissa bits of its smallest value."""
    x = (s >> np.uint64(32)).astype(_U32)
    low = np.full(REGISTERS, 0xFFFFFFFF, _U32)
    # Pieces that stay in the processor's cache.
    for i in range(0, len(x), 128):
        low = np.minimum(low, ((x[i : i + 128, None] ^ _SHIFT) * _FACTOR).min(0))
    share, length = np.frexp(low.astype(np.float64))
    mantissa = np.where(low > 0, (share * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return ((32 - length.astype(np.int64)) << MANTISSA | mantissa).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(sets x bands): the registers of a band as one 64-bit value."""
    return np.ascontiguousarray(sketches).view(np.int64).reshape(len(sketches), BANDS)


@functools.cache
def _accidental() -> np.ndarray:
    """Probability that a register agrees on two disjoint sets, by the binary logarithms of their sizes."""
    q, k = np.meshgrid(np.arange(32), np.arange(1 << MANTISSA), indexing="ij")
    width = 2.0 ** -(q + 1) / (1 << MANTISSA)
    low = (2.0 ** -(q + 1) + k * width).ravel()
    p = []
    for level in range(25):
        n = 2.0**level
        p.append(np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(low + width.ravel(), 1 - 1e-16))))
    p = np.array(p)
    return p @ p.T


def corrected(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimates of the Jaccard similarity from numbers of agreeing registers and the sets' sizes."""
    level = lambda v: np.minimum(np.rint(np.log2(np.maximum(v, 1))).astype(np.int64), 24)
    c = _accidental()[level(n), level(m)]
    return (agreeing / REGISTERS - c) / (1 - c)


def least_estimate(t: int, tail: float = TAIL) -> float:
    """An estimate that pairs of similarity ``t`` per cent fall below with a probability of at most ``tail``."""
    p, below = t / 100, 0.0
    for agreeing in range(REGISTERS + 1):
        below += math.comb(REGISTERS, agreeing) * p**agreeing * (1 - p) ** (REGISTERS - agreeing)
        if below > tail:
            return (agreeing - 1) / REGISTERS
    return 0.0


def sketches(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, n, digest of the set, registers (16 bits each, one after another) and parity bitmap of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE):
                part = batch.slice(lo, PIECE)
                n, digests, regs, bits = [], [], [], []
                for raw in part.column(1).cast(pa.binary()):
                    s = shingle_set(raw.as_py() or b"", k)
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    regs.append(registers(s).tobytes() if len(s) else b"")
                    bits.append(fold_bits(parity_bits(s), BITMAP) if len(s) else b"")
                columns = [part.column(0), pa.array(n, pa.int32()), *(pa.array(v, pa.binary()) for v in (digests, regs, bits))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "regs", "bits"])

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n int, digest binary, regs binary, bits binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _banded(nodes: DataFrame) -> DataFrame:
    """node, band, key of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(1)))
                node = np.repeat(batch.column(0).to_numpy(), BANDS)
                band = np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(band), pa.array(keys.ravel())], ["node", "band", "key"])

    return nodes.select("node", "regs").mapInArrow(run, "node bigint, band int, key bigint")


def may_link(regs: np.ndarray, n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, t: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (i, j) of rows are left by estimate and bitmaps, and their numbers of agreeing registers."""
    good = 100 * np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j])
    at = np.flatnonzero(good)
    agreeing = np.concatenate([np.count_nonzero(regs[i[p]] == regs[j[p]], axis=1) for p in np.array_split(at, len(at) // 4096 + 1)])
    high = corrected(agreeing, n[i[at]], n[j[at]]) >= cut
    at, agreeing = at[high], agreeing[high]
    least = least_differences(bits, i[at], j[at])
    # Linked sets differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    left = (100 + t) * least <= (100 - t) * (n[i[at]] + n[j[at]])
    return at[left], agreeing[left]


def _star_left(star: DataFrame, nodes: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) that estimate and bitmaps leave."""
    cut = least_estimate(t)
    of = nodes.select("node", F.struct("n", "regs", "bits").alias("of"))
    one = join_hot(star, of.select(F.col("node").alias("a"), F.col("of").alias("x")), "a")
    both = one.join(of.select(F.col("node").alias("b"), F.col("of").alias("y")), "b")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.concatenate((_matrix(batch.column(3)), _matrix(batch.column(6))))
                n = np.concatenate([batch.column(c).to_numpy() for c in (2, 5)]).astype(np.int64)
                bits = batch.column(4).to_pylist() + batch.column(7).to_pylist()
                i = np.arange(batch.num_rows)
                yield batch.select([0, 1]).take(pa.array(may_link(regs, n, bits, i, i + batch.num_rows, t, cut)[0]))

    return both.select("a", "b", "x.n", "x.regs", "x.bits", F.col("y.n").alias("m"), F.col("y.regs").alias("regs2"), F.col("y.bits").alias("bits2")).mapInArrow(screen, "a bigint, b bigint")


def _list_pairs(t: int, most: int):
    """Pairs of different labels left in band lists that arrive ordered by (band, key, blocks, n): for every
    row those with the ``most`` agreeing registers, and whether there are others."""
    cut = least_estimate(t)

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        band, key, blocks, n, node, label = (rows.column(c).to_numpy() for c in range(6))
        n = n.astype(np.int64)
        regs, bits = _matrix(rows.column(6).combine_chunks()), rows.column(7).to_pylist()
        bands = band_keys(regs)
        change = (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (blocks[1:] != blocks[:-1])
        number = np.concatenate(([0], np.cumsum(change)))
        found = PairRows(most)
        active, d = np.arange(len(number)), 1
        while True:
            active = active[active + d < len(number)]
            # Lists are ordered by size, so beyond the first set that is too large all are.
            active = active[(number[active] == number[active + d]) & (100 * n[active] >= t * n[active + d])]
            if not len(active):
                break
            i = active[label[active] != label[active + d]]
            # The first band in common decides: the pair's other lists pass it over.
            i = i[(bands[i] == bands[i + d]).argmax(1) == band[i]] if len(i) else i
            if len(i):
                left, agreeing = may_link(regs, n, bits, i, i + d, t, cut)
                found.add(i[left], i[left] + d, agreeing)
            d += 1
        return found.batch(node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            band, key, blocks = (rows.column(c).to_numpy() for c in range(3))
            # The last list may go on in the next batch.
            changes = np.flatnonzero((key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (blocks[1:] != blocks[:-1]))
            if len(changes):
                cut_at = int(changes[-1]) + 1
                yield pairs_of(rows.slice(0, cut_at))
                held = rows.slice(cut_at).to_batches()
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return run


def _candidates(members: DataFrame, labelled: DataFrame, nodes: DataFrame, t: int, most: int, block: int = LIST_BLOCK) -> DataFrame:
    """Pairs (a, b, more) of nodes of different labels in one band list, as far as estimate and bitmaps leave them."""
    rows = materialize(members.join(labelled.select("node", "label"), "node"))
    lists = rows.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    mixed = materialize(join_hot(rows, lists.where("l0 <> l1").select("band", "key", "m"), ["band", "key"]))
    parts = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    # Block i of a long list meets block j in a list of its own, in which the sets of both stand.
    cut = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = (F.shiftleft(F.least("own", "other").cast("long"), 31) + F.greatest("own", "other")).alias("blocks")
    full = cut.select("band", "key", met, "node", "label").join(nodes.select("node", "n", "regs", "bits"), "node")
    ordered = full.repartition("band", "key", "blocks").sortWithinPartitions("band", "key", "blocks", "n", "node")
    pairs = ordered.select("band", "key", "blocks", "n", "node", "label", "regs", "bits").mapInArrow(_list_pairs(t, most), "a bigint, b bigint, more boolean")
    # Two sets in one block meet once per partner block.
    return materialize(pairs.groupBy("a", "b").agg(F.max("more").alias("more")))


def near_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, t: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept of every document."""
    spark = documents.sparkSession
    made = materialize(sketches(documents, doc_id, text, k))
    # One node per distinct set, numbered as it is written: ids may repeat on different texts or be missing.
    sets = made.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bits").alias("bits")
    )
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()))
    banded = materialize(_banded(nodes))
    lists = banded.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("m")).where("m > 1")
    members = materialize(join_hot(banded, lists.select("band", "key", "leader"), ["band", "key"]))

    near = members.where("leader < node").groupBy("node", "leader").agg(F.count("*").alias("m"))
    star = near.groupBy("node").agg(F.max_by("leader", F.struct("m", -F.col("leader"))).alias("leader"))
    star = materialize(star.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    none = spark.createDataFrame([], "node bigint, label bigint")
    first = none
    star = materialize(_star_left(star, nodes, t))
    if not star.isEmpty():
        links = verified(star, nodes, documents, doc_id, text, k, t)
        if not links.isEmpty():
            first = components(links)
    labelled = materialize(nodes.select("node", "digest", "doc_id").join(first, "node", "left").withColumn("label", F.coalesce("label", "node")))
    members = members.select("band", "key", "node")
    check = lambda pairs: verified(pairs, nodes, documents, doc_id, text, k, t)
    labelled = classes_by_rounds(labelled, lambda now, most: _candidates(members, now, nodes, t, most), check)
    classes = with_classes(made.select("doc_id", "n", "digest"), labelled.select("label", "digest", "doc_id"), none)
    return classes.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
