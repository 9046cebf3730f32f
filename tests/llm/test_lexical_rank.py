"""Ranked lexical search against a plain scorer."""

import collections
import math
import random
import re

import numpy as np
import pytest

from floodgrid.llm import lexical_rank

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(t):
    return [w.translate(_LOWER) for w in _TERM.findall(t or "")]


def plain_ranking(docs, items, k=10):
    """(item_id, rank, doc_id, score) rows; every row of the items is ranked."""
    words = [(i, terms(t)) for i, t in docs]
    full = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(full), sum(len(w) for _, w in full)
    df = collections.Counter(t for _, w in full for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in full:
            tf, m = collections.Counter(w), 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in set(terms(text)) & set(tf)
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, missing, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if missing else i, -s))
    return sorted(out, key=str)


def ranking(documents, items, **kw):
    return sorted(map(tuple, lexical_rank.rank_documents(documents, items, **kw).collect()), key=str)


def make_items(prose, n=25):
    rng = random.Random(5)
    pool = sorted({w for _, t, _ in prose for w in t.split()})
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 30))).title()) for i in range(n)]
    return rows + [(100, None), (101, ""), (102, "?!"), (103, "nowhere unseen"), (None, rows[0][1]), (3, rows[3][1])]


def test_ranking_matches_plain_scores(spark, prose, prose_table):
    items = make_items(prose)
    frame = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    want = plain_ranking([(i, t) for i, t, _ in prose], items)
    assert len(want) > 200 and ranking(prose_table, frame) == want
    assert ranking(prose_table, frame, k=3) == [r for r in want if r[1] <= 3]


def test_small_tiles_slices_and_blocks_give_the_same(spark, prose, prose_table, monkeypatch):
    items = make_items(prose)
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    want = ranking(prose_table, frame)
    assert ranking(prose_table, frame, block_bytes=300) == want
    tiles = (lexical_rank.ItemTile([[0, 2, 5], [1, 2], []], np.array([5, 7, 0, 3, 4, 9])), np.array([0, 0, 1, 2]), np.array([0, 5, 2, 1]), np.array([3, 4, 5, 6]))
    column = np.full(6, -1)
    assert tiles[0].scores(column, *tiles[1:], 3).tolist() == [[51, 0, 0], [0, 0, 0], [0, 42, 0]] and (column == -1).all()
    monkeypatch.setattr(lexical_rank, "TILE_TERMS", 2)
    assert len(lexical_rank.ItemTile([list(range(6))], np.array([5, 7, 0, 3, 4, 9])).slices) == 3


def test_ties_are_decided_by_the_id_in_every_tile(spark):
    """Equal texts in all partitions, so that every tile's edge is a tie."""
    rows = [(i, "same words here" if i % 3 else "other words there") for i in range(1500)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    items = [(1, "same"), (2, "words"), (3, "there here")]
    got = ranking(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert got == plain_ranking(rows, items)
    assert [r[2] for r in sorted(got) if r[0] == 1] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14]


def test_top_k_keeps_smaller_ids_that_come_later():
    best = lexical_rank.TopK(1, 2)
    for score, i, missing in ((5, 9, False), (5, 8, False), (5, 0, True), (5, 3, False), (6, 20, False), (4, 1, False)):
        best.add(0, np.array([[score]]), np.array([i]), np.array([missing]))
    assert [x.tolist() for x in best.kept[0]] == [[6, 5], [20, 3], [False, False]]


def test_sums_beyond_double_precision_are_refused(monkeypatch):
    with pytest.raises(ValueError):
        lexical_rank.ItemTile([[0]], np.array([1 << 40]))


def test_ranking_on_odd_and_empty_tables(spark, odd):
    items = [("a", "ONE two x"), ("b", None), (None, "single 漢字")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in items], "item_id string, text string, doc_id int, score string")
    want = plain_ranking([(r.doc_id, r.text) for r in odd.collect()], items)
    assert want and ranking(odd, frame) == want
    none = lexical_rank.rank_documents(odd.limit(0), frame)
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranking(odd, frame.limit(0)) == [] and ranking(odd.where("text IS NULL"), frame) == []
