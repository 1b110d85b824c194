import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versegrid.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The definition in Python integers."""
    kept = [(k, [math.floor(scale * x) for x in v], label) for k, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = {}
    for i in sorted(range(len(kept)), key=lambda i: (kept[i][0], kept[i][1])):
        first.setdefault(kept[i][0], cut[i])
    books = [[first[k][p] for k in sorted(first)[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [x[p] for x, c in zip(cut, chosen) if c[p][1] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    chosen, total = assign(), {}
    for (_, _, label), c in zip(kept, chosen):
        total[label] = total.get(label, 0) + sum(f for f, _ in c)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted([(k, "".join(f"{j:02x}" for _, j in c), sum(f for f, _ in c), total[label]) for (k, _, label), c in zip(kept, chosen)], key=repr), \
        hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, **options):
    coded, books = V.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    return sorted(((r.key, r.code, r.error, r.label_error) for r in coded.collect()), key=repr), V.digest(books)


@given(st.integers(1, 9), st.integers(0, 40), st.integers(0, 2**32))
def test_products_are_exact(width, power, seed):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(-(1 << power), (1 << power) + 1, (7, width)) for _ in range(2))
    want = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in y] for r in x]
    assert [[(w + 2**63) % 2**64 - 2**63 for w in row] for row in want] == V.exact_products(x, y).tolist()


def test_limbs_are_needed_and_right():
    x = np.array([[(1 << 29) - 1, -(1 << 29) + 3]])
    assert len(V.limbs(x, 10)) == 3
    assert V.exact_products(x, x)[0, 0] == sum(int(v) ** 2 for v in x[0])
    with pytest.raises(ValueError):
        V.nearest(np.array([[1 << 40]]), np.array([[0]]))


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([1, 2, None])) for i in range(60)]
    rows += [(100 + i, rows[3][1], 7) for i in range(20)]  # copies: ties and a hot entry
    rows += [(200, None, 1), (201, [None] * 8, 1), (202, [math.nan] * 8, 1), (203, [math.inf] + [0.0] * 7, 1)]
    rows += [(3, rows[5][1], 2), (4, rows[4][1], 2)]  # a key with two vectors, a repeated row
    rows += [(300 + i, [1e5 * rng.random() for _ in range(8)], 9) for i in range(3)]  # limbs
    for entries in (1, 7, 256):
        assert run(spark, rows, entries=entries) == brute(rows, entries=entries)
    assert run(spark, rows, parts=2, entries=5, rounds=1, scale=3) == brute(rows, 2, 5, 1, 3)


def test_odd_tables(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, [], 1), (None, [], None)])[0] == [(1, "00000000", 0, 0), (None, "00000000", 0, 0)]
    got, _ = run(spark, [(1, [0.5] * 4, 1), (2, [0.25] * 4, 1), (3, [1.0] * 5, 1), (4, [1.0], None)])
    assert got == [(1, "00000000", 0, 0), (2, "01010101", 0, 0), (3, None, None, 0), (4, None, None, None)]
    coded, books = V.vector_codes(spark.createDataFrame([(None, [1.0] * 4, 1)], SCHEMA))
    assert [tuple(r) for r in coded.collect()] == [(None, 1, None, None, None)]
    clash = spark.createDataFrame([(1, [0.5] * 4, 1)], SCHEMA).withColumns({c: F.lit(c) for c in ("key", "ints", "code", "error", "of", "usable")})
    assert V.vector_codes(clash)[0].count() == 1
    assert V.vector_codes(clash.withColumn("embedding", F.col("embedding").cast("array<float>")))[0].count() == 1
