"""HyperMinHash classes against all pairs."""

import random
import re

import numpy as np
import pytest

from floodgrid.llm import hyperminhash as hmh
from floodgrid.llm import jaccard_join

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = _WORD.findall((t or "").translate(_LOWER))
        out[i] = frozenset(tuple(w[p : p + 4]) for p in range(max(1, len(w) - 3))) if w else frozenset()
    return out


def plain_classes(sets, t=80):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if 100 * common >= t * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def classes_of(table):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hmh.near_classes(table).collect()}


def near_group(n, words=200, changes=(3, 4, 5), seed=1):
    """Copies of one text, each with a few words of its own: most pairs are close to the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        mine = list(base)
        for _ in range(rng.choice(changes)):
            mine[rng.randrange(words)] = f"u{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(mine)))
    return rows


def test_classes_match_all_pairs(spark, prose, prose_table):
    assert classes_of(prose_table) == plain_classes(plain_sets([(i, t) for i, t, _ in prose]))


@pytest.mark.parametrize("block", [2000, 20])
def test_classes_of_a_group_around_the_threshold(spark, monkeypatch, block):
    rows = near_group(150) + [(1000 + i, t) for i, t in near_group(40, words=30, changes=(0, 1, 2), seed=2)]
    rows += [(2000 + i, t) for i, t in near_group(20, words=3000, changes=(20, 40, 60), seed=3)]
    monkeypatch.setattr(hmh._candidates, "__defaults__", (block,))
    sets = plain_sets(rows)
    want = plain_classes(sets)
    assert 5 < len({c for _, c, _ in want.values()}) < 200
    assert classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == want


def test_short_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 6)))) for i in range(60)]
    rows += [(100 + i, " ".join(f"v{k}" for k in range(i, i + 12))) for i in range(20)]
    assert classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == plain_classes(plain_sets(rows))


def test_registers_hold_leading_zeros_and_mantissa():
    rng = np.random.default_rng(2)
    s = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    low = (((s >> np.uint64(32)).astype(np.uint32)[:, None] ^ hmh._SHIFT) * hmh._FACTOR).min(0)
    for value, register in zip(low.tolist(), hmh.registers(s).tolist()):
        bits = f"{value:032b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        mantissa = (bits[zeros + 1 :] + "0" * 10)[:10]
        assert register == zeros << 10 | int(mantissa, 2)
    assert hmh.registers(s[:1]).tolist() != hmh.registers(s[1:2]).tolist()


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 0.95])
def test_estimates_are_corrected_for_collisions(share):
    rng = np.random.default_rng(5)
    found, n = [], 400
    common = round(2 * n * share / (1 + share))
    for _ in range(60):
        both = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
        a, b = hmh.registers(both[:n]), hmh.registers(both[n - common :])
        found.append(hmh.corrected(np.array([np.count_nonzero(a == b)]), np.array([n]), np.array([n]))[0])
    assert abs(np.mean(found) - common / (2 * n - common)) < 0.012
    agree = hmh._accidental()
    # The known constant 0.17 over 2^10 for sets of like sizes, whatever their size.
    assert abs(1024 * agree[9, 9] - 0.17) < 0.02 and abs(1024 * agree[15, 15] - 0.17) < 0.02 and agree[2, 12] < agree[9, 9]


def test_bound_of_estimates():
    cut = hmh.least_estimate(80)
    assert 0.5 < cut < 0.62 and hmh.least_estimate(80, 1e-3) > cut and hmh.least_estimate(100) == 159 / 160


def test_rows_handed_on_grow_with_links_not_with_pairs(spark, monkeypatch):
    """Pairs that leave the lists are few beside all pairs of a group."""
    left = []
    verified = jaccard_join.verified

    def counting(pairs, *args):
        left.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(hmh, "verified", counting)
    rows = near_group(300, changes=(2, 3, 4))
    sets = plain_sets(rows)
    links = sum(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i in sets for j in range(i))
    assert classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == plain_classes(sets)
    assert links > 50 * len(rows) and sum(left) < 12 * len(rows), (left, links)


def test_odd_and_empty_tables(spark, odd):
    got = sorted(map(tuple, hmh.near_classes(odd).collect()), key=str)
    sets = plain_sets([(r.text, r.text) for r in odd.collect()])
    want = []
    for r in odd.collect():
        mine = [o.doc_id for o in odd.collect() if sets[o.text] and sets[o.text] == sets[r.text] and o.doc_id is not None]
        component = min(mine) if mine else r.doc_id
        want.append((r.doc_id, len(sets[r.text]), component, r.doc_id == component))
    assert got == sorted(want, key=str)
    none = hmh.near_classes(odd.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "n_shingles", "component_id", "kept"]
