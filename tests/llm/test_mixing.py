import re
from collections import Counter, defaultdict

import pytest

from versegrid.llm import mixing


def sizes(rows):
    return {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(rows)}


def reference_targets(rows):
    own, total = sizes(rows), defaultdict(int)
    for i, r in enumerate(rows):
        total[r[3]] += own[i]
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, stopped = {}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in stopped)
        unit = left / (sum(weight[s] for s in names if s not in stopped) or 1)
        target = {s: 2 * total[s] if s in stopped else unit * weight[s] for s in names}
        above = {s for s in names if target[s] > 2 * total[s]}
        if not above:
            return total, target
        stopped |= above


def test_targets_and_copies(docs, odd_rows):
    total, target = reference_targets(odd_rows)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
        if total[r.source]:
            assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)


def test_reruns_agree_and_mix_repeats_rows(docs):
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs.repartition(2)).collect()}
    times = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    repeated = Counter(r.doc_id for r in docs.collect())
    assert times == {k: n * repeated[k] for k, n in plan.items() if n}
    assert mixing.mixed(docs).columns == docs.columns


def test_taken_words_come_near_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "x", "abcd"[i % 4] if i % 2 else "a", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in mixing.mix_plan(df).selectExpr("source", "size * copies AS taken", "target").groupBy("source").agg(
            {"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.15)


def test_empty_and_clashing(no_docs, clashing):
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and {r.target for r in out.collect()} == {"target"}
