"""Radius clusters against all pairs, sparse, dense and on the radius."""

import numpy as np
import pytest

from floodgrid.operators import hydro


def plain(points, radius):
    label = {i: i for i in points}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(points)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if np.hypot(points[i][0] - points[j][0], points[i][1] - points[j][1]) <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def clusters(spark, points, radius, few):
    rows = [(i, float(x), float(y)) for i, (x, y) in points.items()]
    return {r.point_id: r.label for r in hydro.exit_clusters(spark.createDataFrame(rows, "point_id long, x double, y double"), radius, few).collect()}


def sparse():
    rng = np.random.default_rng(1)
    return {i: tuple(p) for i, p in enumerate(rng.random((150, 2)) * 30 - 15)}


def two_dense_squares():
    """Crowds about a radius apart: some reach each other, some do not by very little."""
    rng = np.random.default_rng(2)
    out = []
    for k, gap in enumerate((0.999, 1.0001, 1.4)):
        left = rng.random((60, 2)) * 0.3
        right = np.column_stack((rng.random(60) * 0.3 + left[:, 0].max() + gap - 0.0, rng.random(60) * 0.3))
        right[:, 0] += left[:, 0].max() + gap - right[:, 0].min()
        out += [tuple(p + (0, 20 * k)) for p in np.concatenate((left, right))]
    return dict(enumerate(out))


def lattice():
    return {i * 9 + j: (i * 1.0, j * 1.5) for i in range(9) for j in range(9)}


@pytest.mark.parametrize("make,few", [(sparse, 64), (sparse, 0), (two_dense_squares, 64), (two_dense_squares, 4), (lattice, 0), (lattice, 64)])
def test_clusters_match_all_pairs(spark, make, few):
    points = make()
    assert clusters(spark, points, 1.0, few) == plain(points, 1.0)


def test_crowds_are_decided_without_their_pairs(spark, monkeypatch):
    """Two crowds of 3,000 points in neighbouring squares, just out of reach: what is written stays near their number."""
    rng = np.random.default_rng(3)
    n = 3000
    left = np.column_stack((rng.random(n) * 0.2, rng.random(n) * 0.6))
    right = np.column_stack((rng.random(n) * 0.2 + 1.2001, rng.random(n) * 0.6))
    points = dict(enumerate(map(tuple, np.concatenate((left, right)))))
    written = []
    materialize = hydro.materialize

    def counting(df):
        out = materialize(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(hydro, "materialize", counting)
    got = clusters(spark, points, 1.0, 64)
    assert set(got.values()) == {0, n} and max(written) < 20 * n
