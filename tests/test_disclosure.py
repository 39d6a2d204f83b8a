"""Disclosure control against an attacker who knows the method and all that is shown."""

import random

import numpy as np
import pytest

from tidemark.operators import disclosure as DC


def attacked(cells, hidden, rows, columns):
    """Hidden cells whose value follows from the shown cells and the totals (linear algebra over the hidden ones)."""
    order = sorted(hidden)
    lines = [[(r, c) for c in columns if (r, c) in hidden] for r in rows] + [[(r, c) for r in rows if (r, c) in hidden] for c in columns]
    a = np.array([[1.0 if x in line else 0.0 for x in order] for line in lines if line])
    free = np.linalg.svd(a)[2][np.linalg.matrix_rank(a) :]  # the null space
    return [x for k, x in enumerate(order) if not (np.abs(free[:, k]) > 1e-9).any()]


def shifted(cells, hidden):
    """Hidden cells that another table of whole numbers, not negative, with the same totals fills otherwise."""
    out = set()
    for r, c in hidden:
        for r2, c2 in hidden:
            if r2 != r and c2 != c and (r, c2) in hidden and (r2, c) in hidden:
                up = cells.get((r, c2), 0) > 0 and cells.get((r2, c), 0) > 0
                down = cells.get((r, c), 0) > 0 and cells.get((r2, c2), 0) > 0
                if up or down:
                    out.add((r, c))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_no_hidden_cell_can_be_worked_out(spark, seed):
    rng = random.Random(seed)
    shape = (rng.randint(2, 6), rng.randint(2, 7))
    data = [(f"r{i}" if i else None, j) for i in range(shape[0]) for j in range(shape[1]) for _ in range(rng.choice([0, 1, 3, 8, 12, 25, 40]))]
    df = spark.createDataFrame(data, "a string, b long").repartition(2)
    got = DC.protected_table(df, "a", "b", k_min=10).collect()
    cells = {(r.row, r.column): r.rows for r in got if r.row and r.column}
    hidden = {k for k, n in cells.items() if n is None}
    names = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    totals = {(r.row, r.column): r.rows for r in got if not (r.row and r.column)}
    assert all(n is None or n >= 10 for n in [*cells.values(), *totals.values()])
    if not data or len(names[0]) < 2 or len(names[1]) < 2:
        return
    assert totals[None, None] == len(data)
    # The true counts of the hidden cells, from the folded data.
    fold = {}
    for which, labels in ((0, names[0]), (1, names[1])):
        for value in {x[which] for x in data}:
            text = str(value) if value is not None else "(none)"
            fold[which, value] = text if text in labels else DC.OTHER
    true = {}
    for a, b in data:
        key = fold[0, a], fold[1, b]
        true[key] = true.get(key, 0) + 1
    assert all(true.get(k, 0) == n for k, n in cells.items() if n is not None)
    assert {k for k, n in true.items() if n < 10} <= hidden
    if hidden:
        assert attacked(cells, hidden, *names) == []
        assert {k for k in hidden if 0 < true.get(k, 0) < 10} <= shifted(true, hidden)
        for which in (0, 1):
            for line in {k[which] for k in hidden}:
                assert sum(true.get(k, 0) for k in hidden if k[which] == line) >= 10 or all(k in hidden or not true.get(k) for k in true if k[which] == line)


def test_small_tables_and_single_lines(spark):
    assert DC.protected_table(spark.createDataFrame([("a", 1)] * 9, "a string, b long"), "a", "b").count() == 0
    one = DC.protected_table(spark.createDataFrame([("a", k % 2) for k in range(40)] + [("b", 0)], "a string, b long"), "a", "b").collect()
    assert all(r.rows is None or r.rows >= 10 for r in one) and any(r.row is None and r.column is None and r.rows == 41 for r in one)
