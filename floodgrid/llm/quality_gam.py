"""Quality classifier: a generalised additive model with pairwise interactions.

Each document gives a fixed list of text features. Features are cut into bins at quantiles. Training
goes round the features in turn: a depth-limited tree on one feature's bins is fitted to the current
gradient and added, damped, to that feature's lookup table. Then the pairs of features that explain
most of what is left are found by gain over their coarse two-way bins, and boosted in turn in the
same way as two-way tables. A score is the sum of one table entry per feature and pair, so scoring
is bin search and addition over whole arrays.

Training reads at most ``TRAIN_ROWS`` labelled rows (all of them up to that number, else a share
chosen by a hash of the id); features and scores cover every row.

Cases: a null or empty text has all features 0 and is scored like others; without any labelled row
of both classes the model is constant, the share of label 1 (0.5 without rows); ties between cuts
go to the lower bin; null labels are no labels; repeated rows score alike; extra columns are kept
in ``row``.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.llm.texts import map_texts
from floodgrid.runtime import write_and_read as materialize

TRAIN_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 64, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 60, 30, 0.2, 4
FEATURES = [
    "log_words", "word_length", "long_words", "symbols", "marks", "bars", "digits", "capitals", "caps_words",
    "non_ascii", "different_words", "most_frequent", "adjacent_repeats", "different_pairs", "different_triples",
    "lines", "line_repeats", "short_lines", "stops", "commas",
]
_MARKS = [ord(c) for c in "#*$%&<>"]


def features(raw: bytes) -> tuple[float, ...]:
    """The values of ``FEATURES``; shares are of bytes or words."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    visible = max(1, size - int(by[9:14].sum()) - int(by[32]))
    counts = Counter(words)
    upper = int(by[65:91].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = [len(w) for w in words]
    repeats = sum(map(bytes.__eq__, words, itertools.islice(words, 1, None)))
    pairs = len(set(zip(words, itertools.islice(words, 1, None))))
    triples = len(set(zip(words, itertools.islice(words, 1, None), itertools.islice(words, 2, None))))
    caps = sum(1 for w in words if w.isupper())
    return (
        math.log1p(n),
        visible / n,
        sum(1 for k in lengths if k > 16) / n,
        int(by[_MARKS].sum()) / visible,
        int(by[33] + by[63]) / n,
        int(by[124]) / n,
        int(by[48:58].sum()) / visible,
        upper / visible,
        caps / n,
        int(by[128:].sum()) / visible,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / max(1, n - 1),
        pairs / max(1, n - 1),
        triples / max(1, n - 2),
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        sum(1 for x in lines if len(x) < 30) / len(lines),
        int(by[46]) / n,
        int(by[44]) / n,
    )


@dataclass
class AdditiveModel:
    """Bin edges, one lookup table per feature, and one per chosen pair."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut of ordered bins with sums ``g``, ``h``, and its place."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
    gain[(left_h < 1e-3) | (right_h < 1e-3)] = -1
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k] - g.sum() ** 2 / (h.sum() + 1)), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values by bin of a tree of at most ``leaves`` leaves, grown best gain first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gains = [(*_split(g[a:b], h[a:b]), a, b) for a, b in parts if b - a > 1]
        best = max(gains, default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of one cut of either axis followed by one cut of the other in each half."""
    best_gain, best = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for k in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), -(g.sum() ** 2) / (h.sum() + 1)
            for rows in (slice(0, k), slice(k, None)):
                cg, ch = gg[rows].sum(0), hh[rows].sum(0)
                _, cut = _split(cg, ch)
                for cols in (slice(0, cut), slice(cut, None)):
                    sg, sh = cg[cols].sum(), ch[cols].sum()
                    out[rows, cols] = sg / (sh + 1)
                    gain += sg**2 / (sh + 1)
            if gain > best_gain:
                best_gain, best = gain, out.T if flip else out
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single features, then of the best pairs, on logistic loss."""
    share = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    model = AdditiveModel(math.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = gradient()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size))
            model.tables[j] += step
            total += step[b]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradient()
        cell = coarse[i] * sizes[j] + coarse[j]
        shape = (sizes[i], sizes[j])
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_pair_tree(*sums(i, j))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = RATE * _pair_tree(*sums(i, j))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _extractor():
    def work(raw: bytes) -> tuple:
        return (list(features(raw)),)

    return work


def train(featured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on labelled rows of ``featured`` (doc_id, x) that are not held out, at most about ``rows``."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    joined = featured.where(~held_out(F.col(doc_id))).join(known, F.col(doc_id) == F.col("id")).select(doc_id, "x", "y")
    joined = materialize(joined)
    n = joined.count()
    if n > rows:
        # Which rows train is a matter of their ids alone.
        joined = joined.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    # Sorted, so that sums do not depend on the order of tasks.
    sample = joined.select(doc_id, F.col("x").cast("array<float>").alias("x"), "y").toPandas().sort_values([doc_id, "y"])
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["y"].to_numpy(dtype=np.float64))


def score(featured: DataFrame, model: AdditiveModel) -> DataFrame:
    """``featured`` with ``score`` instead of its features ``x`` (last column)."""
    schema = featured.drop("x").withColumn("score", F.lit(0.0)).schema
    k = featured.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(k).flatten().to_numpy(zero_copy_only=False)
            # The same precision as in training, so that values meet the same bins.
            x = flat.astype(np.float32).astype(np.float64).reshape(-1, len(FEATURES))
            kept = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(x))], names=schema.names)

    return featured.mapInArrow(run, schema)


def classify(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None
) -> DataFrame:
    """The kept columns of every document with ``score``, learned from the labelled rows not held out."""
    columns = documents.columns if keep is None else keep
    packed = documents.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text")
    )
    featured = materialize(map_texts(packed, "text", _extractor, "x array<double>", ["doc_id", "row"]))
    model = train(featured.select("doc_id", "x"), labels.withColumnRenamed(doc_id, "doc_id"), "doc_id", label)
    return score(featured.select("row", "x"), model)
