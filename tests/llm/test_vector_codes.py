import hashlib
import math
import random

import numpy as np

from lociflow.llm import vector_codes


def brute(rows, rounds=2):
    """key, code, error, label_error and digest of (key, vector, label) rows, by loops over all parts."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    vs = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in good]
    w = len(vs[0]) // 16
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, vs[i]))[:64]
    codes, books = [[0] * 16 for _ in good], []
    errors = [0] * len(good)
    for p in range(16):
        part = [tuple(v[p * w : p * w + w]) for v in vs]
        book = [part[i] for i in first]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            at = [near(x)[1] for x in part]
            book = [tuple(sum(x[j] for x, a in zip(part, at) if a == e) // at.count(e) for j in range(w)) if e in at else c for e, c in enumerate(book)]
        for i, x in enumerate(part):
            d, codes[i][p] = near(x)
            errors[i] += d
        books += [str(x) for c in book for x in c]
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{c:02x}" for c in code), e, sum(f for s, f in zip(good, errors) if s[2] == r[2]), digest) for r, code, e in zip(good, codes, errors))


def vectors(rng, n, width):
    base = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(7)]
    rows = []
    for i in range(n):
        v = [x + (rng.gauss(0, 0.02) if rng.random() < 0.3 else 0.0) for x in rng.choice(base)]
        rows.append((rng.choice([i, i, i % 9, None]), v, rng.choice([0, 1, None])))
    rows += [(1, None, 1), (2, [], 1), (3, [float("nan")] * width, 0), (4, [float("inf")] + [0.0] * (width - 1), 0), (5, [None] + [0.0] * (width - 1), None)]
    return rows + [rows[3]] * 40


def compressed(spark, rows):
    df = spark.createDataFrame([(k, v, l, "x", 1) for k, v, l in rows], "vec_id long, embedding array<float>, label int, code string, pos int").repartition(5)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())


def test_equals_brute_force(spark):
    for seed, n, width in ((1, 200, 32), (2, 30, 16), (3, 120, 48)):
        rows = vectors(random.Random(seed), n, width)
        assert compressed(spark, rows) == brute(rows)


def test_large_numbers_are_exact_and_bounded(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-60_000, 60_000) for _ in range(32)], i % 2) for i in range(90)]
    assert compressed(spark, rows) == brute(rows)
    out = compressed(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)])
    assert [r[2] for r in out] == [0, 0, 0]


def test_both_ways_to_measure_agree():
    rng = np.random.default_rng(5)
    for largest in (10, 1 << 24):
        x, book = rng.integers(-largest, largest, (700, 8)), rng.integers(-largest, largest, (64, 8))
        book[40] = book[3]
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        entry, error = vector_codes.nearest(x, book)
        assert (entry == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all() and 40 not in entry


def test_no_rows_other_lengths_and_one_row(spark):
    assert compressed(spark, []) == []
    assert compressed(spark, [(1, None, 1), (2, [1.0] * 15, 1)]) == []
    rows = [(i, [float(i)] * 16, 1) for i in range(3)]
    assert compressed(spark, rows + [(9, [1.0] * 32, 1), (8, [1.0] * 17, 1)]) == brute(rows)
    assert [r[1] for r in compressed(spark, rows[:1])] == ["00" * 16]
