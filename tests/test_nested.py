"""Components of nested masks against labelling every mask on its own."""

import numpy as np
import pytest

from floodgrid.operators.grid import Grid
from floodgrid.operators.nested import nested_components


def plain(levels, marks):
    """(level, label, n, marks) with the smallest cell id as label."""
    h, w = levels.shape
    out = []
    for k in range(1, levels.max() + 1):
        seen = np.zeros((h, w), bool)
        for r, c in zip(*np.nonzero(levels >= k)):
            if seen[r, c]:
                continue
            stack, cells = [(r, c)], []
            seen[r, c] = True
            while stack:
                i, j = stack.pop()
                cells.append((i, j))
                for a in range(max(0, i - 1), min(h, i + 2)):
                    for b in range(max(0, j - 1), min(w, j + 2)):
                        if levels[a, b] >= k and not seen[a, b]:
                            seen[a, b] = True
                            stack.append((a, b))
            out.append((k, min(i * w + j for i, j in cells), len(cells), int(sum(marks[p] for p in cells))))
    return sorted(out)


@pytest.mark.parametrize("tile,small,seed", [(4, 0, 1), (5, 1 << 16, 2), (64, 0, 3), (64, 1 << 16, 4), (3, 40, 5)])
def test_nested_components(spark, tile, small, seed):
    rng = np.random.default_rng(seed)
    h, w = 17, 23
    levels = rng.integers(0, 5, (h, w)) * (rng.random((h, w)) < 0.8)
    if seed == 2:
        levels = np.add.outer(np.arange(h), np.arange(w)) // 8
    marks = rng.random((h, w)) < 0.4
    rows = [(r, c, int(levels[r, c]), int(marks[r, c])) for r in range(h) for c in range(w)]
    cells = spark.createDataFrame(rows, "row int, col int, level int, marked long").repartition(4)
    got = nested_components(cells, Grid(w, h), int(levels.max()), ["marked"], tile, small).collect()
    # Labels are cells of their component; by size and sums they are compared, and each is used once.
    assert sorted((r.level, r.n, r.marked) for r in got) == sorted((k, n, m) for k, _, n, m in plain(levels, marks))
    assert len({(r.level, r.label) for r in got}) == len(got)
    smallest = {k: sorted(label for q, label, _, _ in plain(levels, marks) if q == k) for k in range(1, levels.max() + 1)}
    assert sorted(r.label for r in got if r.level == 4 and levels.max() == 4) in ([], smallest.get(4))


def test_no_cell_passes(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1)], "row int, col int, level int, marked long")
    assert nested_components(cells, Grid(3, 3), 2, ["marked"]).collect() == []
