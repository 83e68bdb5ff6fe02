"""Vector codes against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest

from flowguard.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v double, `trees.x` int, error string"


def plain(rows, parts, entries, rounds):
    """Row by row and entry by entry, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(r[0], [math.floor(float(np.float32(x)) * 1024) for x in r[1]], r[2]) for r in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(whole[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        found = [[nearest(c[p], books[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p] == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine)]
    out, per_label = [], {}
    for (vec, _, label), c in zip(whole, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((vec, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
        per_label[label] = per_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(map(str, [(*o[:4], per_label[o[3]], digest) for o in out]))


def coded(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1.0, 1, "y") for r in rows], SCHEMA)
    found = vectors.compress(frame, **options)
    assert found.columns == ["vec_id", "code", "error", "label", "label_error", "codebooks_sha256"]
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("parts, entries, block, leaf", [(4, 16, 50, 4), (2, 7, 1000, 32), (4, 256, 64, 2)])
def test_codes_equal_plain_rounds(spark, parts, entries, block, leaf):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8)) * 0.05
    rows = [(int(i * 7 % 400), [float(x) for x in centres[i % 6] + draw.normal(size=8) * 0.004], int(i % 3)) for i in range(240)]
    rows += [(9, [0.25] * 8, None)] * 90 + [(None, [-0.5] * 8, 1), (None, [-0.5] * 8, 1)]
    rows += [(1, None, 1), (2, [0.1] * 7 + [None], 1), (3, [0.1] * 7 + [math.nan], 1), (4, [math.inf] + [0.1] * 7, None), (5, [-math.inf] + [0.1] * 7, None)]
    assert coded(spark, rows, parts=parts, entries=entries, block=block, leaf=leaf) == plain(rows, parts, entries, 4)


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [2.0, 2.0], 1), (3, [1.0, 1.0], 1), (4, [1.0, -1.0], None)]
    assert coded(spark, rows, parts=2, entries=3, rounds=2) == plain(rows, 2, 3, 2)


def test_equal_and_separate_vectors_are_assigned_as_whole_nodes():
    draw = np.random.default_rng(1)
    points = np.concatenate([np.full((500, 4), 7), np.repeat(draw.integers(-9000, 9000, (20, 4)), 30, axis=0) + draw.integers(0, 20, (600, 4))])
    tree, book = vectors.Tree.grow(points, 8), vectors.Book(points[[0, 500, 530, 560, 1070]])
    codes, counts, sums = book.assign(tree, 5)
    distance = ((tree.points[:, None] - points[[0, 500, 530, 560, 1070]][None]) ** 2).sum(2)
    assert (codes == distance.argmin(1)).all() and counts.sum() == len(points)
    assert (sums.sum(0) == points.sum(0)).all()
    tree.points = np.zeros_like(tree.points)  # whole nodes never look at their points
    again = book.assign(tree, 5)[0]
    assert (again == codes).mean() > 0.9


def test_empty_tables_bad_lengths_and_sizes(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [math.nan] * 4, 1)]) == []
    for bad in ([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], [(1, [0.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception):
            coded(spark, bad)
