import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from versegrid.llm import lm_scoring as M
from versegrid.llm.common import crc_mod


def trains(k):
    return zlib.crc32(str(k).encode()) % 7 != 2 if k is not None else True


def run(df, **options):
    return M.score_documents(df, crc_mod(F.col("doc_id"), 7) == 2, **options).collect()


@pytest.mark.parametrize("block", [50, M.BLOCK])
def test_against_plain_counts(docs, odd_rows, block):
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in odd_rows]
    own = [t for k, t in tokens if trains(k)]
    one, pair = Counter(w for t in own for w in t), Counter(p for t in own for p in zip([0, *t], t))
    first = Counter(w for t in own for w in [0, *t[:-1]])
    n, v = sum(one.values()), len(one)
    cells = Counter()
    grid = lambda p: -1 if p <= 0 else round(-math.log10(p) / M.STEP)
    for t in own:
        for a, b in zip([0, *t], t):
            h = first[a] - 1
            cells[int(np.frexp(h)[1]) if h else 0, grid((pair[a, b] - 1) / h if h else 0), grid((one[b] - 1) / (n - 1))] += 1
    weights = M.learned_weights([(*c, k) for c, k in cells.items()], v)
    want = []
    for k, t in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, b in zip([0, *t], t):
            l2, l1, l0 = weights[int(np.frexp(first[a])[1]) if first[a] else 0]
            score += math.log10((l2 * pair[a, b] / first[a] if first[a] else 0) + l1 * one[b] / n + l0 / (v + 1))
        want.append((k, not trains(k), len(t), sum(one[w] > 0 for w in t), n, base, score))
    got = sorted(((r.key, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in run(docs, block=block)), key=repr)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_weights_sum_to_one_and_prefer_what_predicts():
    w = M.learned_weights([(3, 10, 60, 900), (3, -1, 60, 100), (5, -1, 40, 10)], 1000)
    assert np.allclose(w.sum(1), 1) and w[3][0] > 0.5 and w[5][0] < 0.01 and (w[60] == w[5]).all()


def test_empty_and_no_training(spark, no_docs, clashing):
    assert run(no_docs) == []
    assert len(run(clashing)) == clashing.count()
    held = next(k for k in range(100) if not trains(k))
    (r,) = run(spark.createDataFrame([(held, "a b")], "doc_id long, text string"))
    assert (r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) == (3, 0, 0.0, 0.0, 0)


def test_asked_hashes_are_exact_and_smaller_than_six_bytes():
    hashes = np.random.default_rng(1).integers(1, 1 << 63, 50_000, dtype=np.uint64)
    hashes = np.concatenate([hashes, [M.START, M.END]]).astype(np.uint64)
    block = M.Block.__new__(M.Block)
    block.words = np.sort(hashes)
    for buckets in (4, 1 << 17):
        found, places, bounds = block.asked(1, buckets)
        assert sorted(places) == list(range(len(hashes)))
        cuts = [found[places[bounds[i]:bounds[i + 1]]] for i in range(buckets) if bounds[i] < bounds[i + 1]]
        sent = [M._short(c) for c in cuts]
        assert all((M._long(s) == c & np.uint64((1 << 48) - 1)).all() for s, c in zip(sent, cuts))
        if buckets == 4:
            assert sum(map(len, sent)) < 5 * len(hashes)
