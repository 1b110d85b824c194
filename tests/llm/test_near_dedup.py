import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versegrid.llm import near_dedup as N
from versegrid.llm.common import reduced, without


def brute(rows, n, threshold=80):
    def shingles(text):
        words = (text or "").encode().lower().split()
        k = min(n, len(words))
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()

    sets, parent = [shingles(r[1]) for r in rows], {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    return {(r[0], len(s), root(r[0])) for r, s in zip(rows, sets)}


@pytest.mark.parametrize("n", [4, 5])
def test_against_all_pairs(docs, odd_rows, n):
    got = {(r.key, r.n_shingles, r.component) for r in N.near_duplicates(docs, shingle=n).collect()}
    assert got == brute(odd_rows, n)


def test_chain_of_near_copies_in_hot_buckets(spark, monkeypatch):
    """A long chain, each text linked to its neighbours only, and unrelated texts around one passage."""
    monkeypatch.setattr(N, "SMALL", 4)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(100)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(200 + i, passage + " " + " ".join(f"u{i}x{rng.randrange(9**9)}" for _ in range(14))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.key, r.n_shingles, r.component) for r in N.near_duplicates(df, shingle=4).collect()}
    assert got == brute(rows, 4)


def test_large_groups_below_and_at_the_threshold(spark, monkeypatch):
    """Many texts around one passage, at 0.75 of each other, some of them with near copies; also few words in many orders."""
    monkeypatch.setattr(N, "SMALL", 3)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(120):
        own = passage + [f"u{i}x{j}" for j in range(15)]
        rows.append((i, " ".join(own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*own[:-4], "v", "w"])))
            rows.append((2000 + i, " ".join(["start", *own])))
    for i in range(80):
        rows.append((3000 + i, " ".join(rng.choice("abc") for _ in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.key, r.n_shingles, r.component) for r in N.near_duplicates(df, shingle=4).collect()}
    assert got == brute(rows, 4)


def test_one_key_with_two_texts_links_them(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (7, b), (None, a), (None, None)], "doc_id long, text string")
    got = {(r.key, r.component, r.kept) for r in N.near_duplicates(df).collect()}
    assert got == {(5, 3, False), (3, 3, True), (7, 3, False), (None, None, True)}


def test_deduplicated(docs, odd_rows, clashing, no_docs):
    kept = {c for _, _, c in brute(odd_rows, 5)}
    out = N.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept)
    assert N.deduplicated(clashing).columns == clashing.columns
    assert N.deduplicated(no_docs).count() == 0 and N.near_duplicates(no_docs).count() == 0


def test_estimate_is_close(spark):
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 1.0):
        common = rng.integers(0, 2**63, int(4000 * share), np.uint64)
        own = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 4000 - len(common), np.uint64)])) for _ in range(2)]
        true = len(np.intersect1d(*own)) / len(np.union1d(*own))
        planes = [N.packed(N.minima(x)).tolist() for x in own]
        df = spark.createDataFrame([tuple(planes)], "a array<long>, b array<long>")
        assert df.select(N.estimate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(true, abs=0.15)


def test_bit_map_keeps_all_matches(spark):
    rows, keys = spark.range(5000), spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    near = {r.id for r in reduced(rows, "id", keys, "k").collect()}
    assert near >= set(range(0, 5000, 7)) and len(near) < 1000
    assert {r.id for r in without(rows, "id", keys, "k").collect()} == set(range(5000)) - set(range(0, 5000, 7))
    assert without(rows, "id", keys.limit(0), "k").count() == 5000


def test_parities_rule_out_pairs_below_the_threshold(spark):
    """Sets at the threshold always pass; of sets at 0.72 and 0.5 none does, whatever the signatures estimate."""
    rng, rows = np.random.default_rng(5), []
    for share, passes in ((0.8, True), (0.72, False), (0.5, False)):
        for _ in range(20):
            common = round(2 * 300 * share / (1 + share) + 0.5)
            both = rng.integers(0, 2**63, common, np.uint64)
            sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, 300 - common, np.uint64)])) for _ in range(2)]
            rows.append((300, 300, *[N.parities(x).tolist() for x in sets], passes))
    df = spark.createDataFrame(rows, "n_shingles_a long, n_shingles_b long, odd_a array<long>, odd_b array<long>, passes boolean")
    assert df.filter(N._parities_allow(80) != F.col("passes")).count() == 0


def test_group_of_near_copies_confirms_few_pairs(spark, monkeypatch):
    """Copies of one text with changed words, at 0.8 of each other on average: the pairs to confirm follow the members."""
    rng, confirmed = random.Random(3), []
    confirm = N._confirmed

    def counted(likely, *rest):
        confirmed.append(likely.count())
        return confirm(likely, *rest)

    monkeypatch.setattr(N, "_confirmed", counted)
    rows = []
    for i in range(240):
        words = [f"w{j}" for j in range(150)]
        for place in rng.sample(range(150), 4):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.key, r.n_shingles, r.component) for r in N.near_duplicates(df, shingle=4).collect()}
    assert got == brute(rows, 4)
    assert sum(confirmed) < 12 * len(rows)


def test_components_are_looked_for_twice_at_most(spark, monkeypatch):
    """A large group whose members resemble each other at about 0.8: its rounds do not follow the deals."""
    rng, calls = random.Random(4), []
    components = N._components
    monkeypatch.setattr(N, "_components", lambda links: calls.append(1) or components(links))
    rows = []
    for i in range(150):
        words = [f"w{j}" for j in range(150)]
        for place in rng.sample(range(150), 2 + i % 2):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.key, r.n_shingles, r.component) for r in N.near_duplicates(df, shingle=4).collect()}
    assert got == brute(rows, 4)
    assert len(calls) <= 2
