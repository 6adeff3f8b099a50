"""Codes and codebooks against a plain computation in Python's own integers."""

import math

import numpy as np
import pytest

from dealtrace.llm import part_codes as C

SCHEMA = "vec_id long, label int, embedding array<float>, far string, v int, code int, error string, tried int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2, "e", 3) for r in rows], SCHEMA)


def brute(rows, parts=8, k=16, rounds=6):
    """All rows that take part: (vec_id, label, code, error), and the entries."""
    kept = [(i, lab, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, _, v in kept[:k]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            moved.append([[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[p])])
        books = moved
    out = []
    for i, lab, v in kept:
        found = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


def vectors(n, seed, ties):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 16))
    v = centres[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, 16))
    v = np.round(v * 2) / 2 if ties else v
    return [(int(i), None if i % 7 == 0 else int(i) % 3, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("n, ties", [(300, False), (300, True), (9, False)])
def test_codes_equal_a_plain_computation(spark, n, ties):
    rows = vectors(n, n + ties, ties)
    rows += [(900, 1, None), (901, 1, [None] + [1.0] * 15), (902, 1, [math.nan] * 16), (903, 2, [math.inf] + [0.0] * 15)]
    rows += [(904, None, [0.0] * 16), (5, 1, rows[5][2]), (None, 2, [0.5] * 16), (905, 0, [1.0, 2.0])][: -1 if n > 9 else None]
    books = C.fit(table(spark, rows))
    want, entries = brute([r for r in rows if r[2] is None or len(r[2]) == 16])
    assert books.entries.tolist() == entries
    sums = {}
    for _, lab, _, error in want:
        sums[lab] = sums.get(lab, 0) + error
    got = sorted((tuple(r) for r in C.code_digest(books).collect()), key=str)
    sha = C.books_sha256(np.array(entries))
    assert got == sorted(((i, code, e, sums[lab], sha) for i, lab, code, e in want), key=str)


def test_bounds_prune_most_evaluations_and_change_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-9000, 9000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-400, 400, (4000, 8))
    entries = centres + rng.integers(-50, 50, centres.shape)
    pivots = C.choose_pivots(entries, 4)
    code, best, tried = C.assign(x, C._distances(x, pivots), entries, pivots)
    full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert tried < 0.25 * full.size


def test_large_components_and_ties_go_to_the_lower_entry():
    x = np.array([[C.LARGEST] * 8, [-C.LARGEST] * 8, [0] * 8])
    entries = np.array([[1] * 8, [-1] * 8, [C.LARGEST] * 8, [C.LARGEST] * 8])
    pivots = C.choose_pivots(entries, 4)
    code, best, _ = C.assign(x, C._distances(x, pivots), entries, pivots)
    assert code.tolist() == [2, 1, 0] and best.tolist() == [0, 8 * (C.LARGEST - 1) ** 2, 8]


def test_odd_tables(spark):
    empty = C.fit(table(spark, []))
    assert C.code_digest(empty).count() == 0 and C.code_digest(C.fit(table(spark, [(1, 1, None), (2, 1, [])]))).count() == 0
    one = C.code_digest(C.fit(table(spark, [(1, None, [1e30] * 8), (1, None, [1e30] * 8)]))).collect()
    assert [(r.vec_id, r.code, r.error) for r in one] == [(1, "00" * 8, 0)] * 2
    # Three components in eight parts: the last parts are zeros.
    short = C.code_digest(C.fit(table(spark, [(i, 1, [float(i), 0.0, 1.0]) for i in range(4)]))).collect()
    assert sorted(r.code[:2] for r in short) == ["00", "01", "02", "03"] and {r.error for r in short} == {0}
