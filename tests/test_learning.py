import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from versegrid.operators import cluster as C
from versegrid.operators import learners as L
from versegrid.operators import metrics as M
from versegrid.operators import neighbours as N
from versegrid.operators import tfidf as V
from versegrid.operators.tokens import term_freq, tokens
from versegrid.plans import jobs


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)


def _tfidf_matrix(texts):
    """The weights by plain arithmetic: words as they are, no stop words or stems."""
    counts = [{w: t.split().count(w) for w in t.split() if len(w) > 1} for t in texts]
    df = {}
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    vocabulary = sorted(w for w in df if df[w] <= 0.7 * n)
    rows = np.array([[(1 + math.log(c[w])) * (math.log((1 + n) / (1 + df[w])) + 1) if w in c else 0.0 for w in vocabulary] for c in counts])
    rows = rows.reshape(n, len(vocabulary))
    norms = np.linalg.norm(rows, axis=1, keepdims=True) if len(vocabulary) else np.ones((n, 1))
    return vocabulary, np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _brute_dbscan(rows, eps, min_samples):
    near = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1)) <= eps + 1e-9
    core, labels, cluster = near.sum(1) >= min_samples, [-1] * len(rows), 0
    for i in range(len(rows)):
        if core[i] and labels[i] == -1:
            todo = [i]
            while todo:
                j = todo.pop()
                if labels[j] == -1:
                    labels[j] = cluster
                    if core[j]:
                        todo.extend(np.flatnonzero(near[j]))
            cluster += 1
    return near.sum(1).tolist(), labels


def test_tokens(spark):
    df = _docs(spark, ["I can't über_x a 12 THE cats"])
    assert sorted(r.term for r in tokens(df, "id", "text").collect()) == ["12", "cats", "über_x"]
    assert {r.term: r.tf for r in term_freq(_docs(spark, ["cat cats running run"]), "id", "text").collect()} == {"cat": 2, "run": 2}


def test_tfidf_against_arithmetic(spark):
    texts = ["aa bb bb cc", "aa cc dd", "aa ee", "", "ff ff ff bb"]
    docs = _docs(spark, texts)
    got = V.fit_transform(term_freq(docs, "id", "text", False, False), docs, "id").collect()
    vocabulary, rows = _tfidf_matrix(texts)
    want = {(i, w): rows[i, j] for i in range(len(texts)) for j, w in enumerate(vocabulary) if rows[i, j]}
    assert {(r.id, r.term): pytest.approx(r.weight) for r in got} == want


def test_document_frequency_bound_is_a_double(spark):
    # 0.7 * 10 is a shade below 7 in some products; both sides use doubles
    docs = _docs(spark, ["aa"] * 7 + ["bb"] * 3)
    kept = {r.term for r in V.idf(term_freq(docs, "id", "text", False, False), V.row_count(docs)).collect()}
    assert kept == {w for w, df in (("aa", 7), ("bb", 3)) if df <= 0.7 * 10}


def test_labelled_corpus(spark):
    lyrics = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "q"), (4, "r")], "trackid long, lyrics string")
    tags = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "rock"), (2, 2, ""), (3, 1, None)], "trackid long, ord int, tag string")
    assert sorted(tuple(r) for r in V.labelled_corpus(lyrics, tags).collect()) == [(1, "x", "new"), (1, "y", "new")]


@pytest.mark.parametrize("n", [1, 5, 10, 11])
def test_split_sizes(spark, n):
    parts = [r.part for r in V.split_parts(spark.range(n).withColumnRenamed("id", "k"), "k").collect()]
    assert (parts.count("testset"), len(parts)) == (math.ceil(n / 5), n)


def test_vectorize_split_uses_train_vocabulary_only(spark):
    texts = {i: f"common{i % 3} word{i} shared" for i in range(20)}
    lyrics = spark.createDataFrame(list(texts.items()), "trackid long, lyrics string")
    tags = spark.createDataFrame([(i, 1, "a" if i % 2 else "b") for i in texts], "trackid long, ord int, tag string")
    rows = jobs.vectorize(lyrics, tags, split=True).collect()
    train = [r for r in rows if r.part == "trainset"]
    assert (len(rows), len(train)) == (20, 16)
    # one own word per training row plus three common ones; "shared" is in every row
    assert {r.features.size for r in rows} == {16 + 3}
    assert all(r.features.norm(2) == pytest.approx(1) for r in rows)
    assert all(len(r.features.indices) == (2 if r.part == "trainset" else 1) for r in rows)


def test_empty_document_keeps_an_empty_vector(spark):
    corpus = spark.createDataFrame([(1, "aa bb", "x"), (2, "", "x"), (3, "cc", "y"), (4, "aa", "y")], "id long, text string, label string")
    rows = {r.id: r.features for r in jobs.vectorize_corpus(corpus, "id", split=False).collect()}
    assert rows[2] == Vectors.sparse(3, [], []) and rows[3] == Vectors.sparse(3, [2], [1.0])


TEXTS = st.lists(st.lists(st.sampled_from("aa bb cc dd ee ff gg hh ii jj kk".split()), max_size=14).map(" ".join), min_size=2, max_size=14)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(base=TEXTS, copies=st.lists(st.integers(0, 13), max_size=8), eps=st.sampled_from([0.3, 0.6, 0.9]))
def test_neighbours_and_dbscan_against_brute_force(spark, base, copies, eps):
    texts = base + [base[c % len(base)] for c in copies]
    docs = _docs(spark, texts)
    near = N.neighbourhood(term_freq(docs, "id", "text", False, False), docs, "id", eps)
    degrees, labels = _brute_dbscan(_tfidf_matrix(texts)[1], eps, 3)
    assert [r.degree for r in N.degrees(near, "id").orderBy("id").collect()] == degrees
    assert [r.cluster for r in C.dbscan(near, "id", 3).orderBy("id").collect()] == labels


def test_balls_replace_pairs_of_near_copies(spark):
    body = " ".join(f"word{i}" for i in range(700))
    texts = [f"{body} tail{i}" for i in range(40)] + [f"far{i} away{i}" for i in range(80)]
    docs = _docs(spark, texts)
    near = N.neighbourhood(term_freq(docs, "id", "text", False, False), docs, "id", 0.3)
    degrees, labels = _brute_dbscan(_tfidf_matrix(texts)[1], 0.3, 5)
    assert [r.degree for r in N.degrees(near, "id").orderBy("id").collect()] == degrees
    assert [r.cluster for r in C.dbscan(near, "id").orderBy("id").collect()] == labels
    assert near.cross.count() == 0 and near.balls.select("ball").distinct().count() == 81


def test_components_of_a_chain(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = spark.range(49).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = {r.node: r.root for r in C.connected_components(nodes, edges).collect()}
    assert roots == {i: 0 if i < 50 else i for i in range(60)}


def test_affinity_finds_two_groups(spark):
    points = {0: 0.0, 1: 0.1, 2: -0.12, 3: 5.0, 4: 5.1, 5: 4.85, 6: 100.0}
    near = [(i, k, -(points[i] - points[k]) ** 2) for i in points for k in points if i != k and abs(points[i] - points[k]) < 20]
    edges = spark.createDataFrame(near, "i long, k long, s double")
    nodes = spark.createDataFrame([(i,) for i in points], "node long")
    found = {r.node: r.exemplar for r in C.affinity_propagation(nodes, edges).collect()}
    assert {found[i] for i in (0, 1, 2)} == {0} and {found[i] for i in (3, 4, 5)} == {3} and found[6] == 6


def test_kmeans_separates(spark):
    rows = [(i, str(i % 2), Vectors.dense([10.0 * (i % 2), i * 0.01])) for i in range(20)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    scores = M.cluster_scores(C.kmeans(df, "id", runs=2)).first()
    assert tuple(scores) == pytest.approx((1.0, 1.0))


def test_cluster_scores(spark):
    def scores(pairs):
        return tuple(M.cluster_scores(spark.createDataFrame(pairs, "label string, cluster int")).first())
    assert scores([("a", 0), ("a", 0), ("b", 0)]) == pytest.approx((0.0, 1.0))
    assert scores([("a", 0), ("a", 1), ("b", 2)]) == pytest.approx((1.0, 0.5793801643))
    assert scores([("a", 0), ("a", 1)]) == pytest.approx((1.0, 0.0))


def test_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("b", "d")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    got = {r["class"]: tuple(r)[1:] for r in M.classification_report(df).collect()}
    assert got["a"] == pytest.approx((0.5, 0.5, 0.5, 2))
    assert got["b"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3))
    assert got["c"] == (0.0, 0.0, 0.0, 1) and got["d"] == (0.0, 0.0, 0.0, 0)
    assert tuple(M.accuracy_f1(df).first()) == pytest.approx((0.5, (0.5 * 2 + 2 / 3 * 3) / 6))


@pytest.fixture(scope="module")
def toy(spark):
    words = {"sea": "wave boat harbour sail tide", "hill": "peak rock climb ridge snow", "town": "tram street square lamp noise"}
    rng = np.random.default_rng(7)
    rows = []
    for i in range(90):
        label = list(words)[i % 3]
        own, every = words[label].split(), " ".join(words.values()).split()
        rows.append((i, " ".join([*rng.choice(own, 6), *rng.choice(every, 2)]), label))
    corpus = spark.createDataFrame(rows, "id long, text string, label string")
    return jobs.vectorized(corpus, "id", split=True)


def _accuracy(df):
    return M.accuracy_f1(df).first().accuracy


def test_rows_that_lose_all_terms_are_neighbours(spark):
    """Seven of eight documents have ``aa``, so it is pruned: those left without terms are all at distance 0."""
    texts = ["aa", "aa aa", "", "aa bb cc", "aa bb cc dd", "aa ee", "aa ff", "aa gg"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    near = N.neighbourhood(term_freq(docs, "id", "text"), docs.select("id"), "id")
    degree = {r.id: r.degree for r in near.members.join(N.rep_degrees(near), "rep").collect()}
    assert [degree[i] for i in range(3)] == [3, 3, 3] and degree[5] == degree[6] == 1


def test_components_of_a_long_path(spark):
    path = [*range(1, 61), 0]
    edges = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
    nodes = spark.range(70).withColumnRenamed("id", "node")
    roots = {r.node: r.root for r in C.connected_components(nodes, edges).collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[i] == i for i in range(61, 70))


def test_long_learners(spark, toy):
    _, long, index, docs = toy
    train, test = docs.filter("part = 'trainset'"), docs.filter("part = 'testset'")
    x, y = (long.join(d.select("id"), "id", "left_semi") for d in (train, test))
    bayes = L.naive_bayes(x, train, y, test, V.row_count(index), "id")
    assert bayes.count() == 18 and _accuracy(bayes) >= 0.85
    assert _accuracy(L.perceptron(x, train, y, test, "id", epochs=5)) >= 0.85


def test_vector_learners(spark, toy):
    vectors, *_ = toy
    train, test = (vectors.filter(f"part = '{p}'") for p in ("trainset", "testset"))
    for learner in (lambda *a: L.predict_svm(*a), lambda *a: L.predict_svm(*a, 1.0), lambda *a: L.predict_forest(*a, 1.0), lambda *a: L.predict_mlp(*a, 1.0)):
        assert _accuracy(learner(train, test, "id")) >= 0.85


def test_many_classes_and_rows_without_terms(spark):
    """A class per document, far more than columns would allow; a test row without terms takes the commonest class."""
    rows = [(i, f"t{i}", 1.0) for i in range(1500)]
    long = spark.createDataFrame(rows, "id long, term string, weight double")
    docs = spark.createDataFrame([(i, f"c{i:04d}") for i in range(1500)] + [(5000 + i, "c0007") for i in range(3)], "id long, label string")
    test_docs = spark.createDataFrame([(i, f"c{i:04d}") for i in range(0, 1500, 100)] + [(9999, "none")], "id long, label string")
    n_terms = F.lit(1500)
    got = {r.id: r.prediction for r in L.naive_bayes(long, docs, long.filter("id % 100 = 0"), test_docs, n_terms, "id").collect()}
    assert got == {i: f"c{i:04d}" for i in range(0, 1500, 100)} | {9999: "c0007"}


def test_perceptron_ends_when_no_row_is_wrong(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "id long, term string, weight double")
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "id long, label string")
    got = {r.id: r.prediction for r in L.perceptron(x, docs, x, docs, "id", epochs=1000).collect()}
    assert got == {1: "x", 2: "y"}


def test_selection_that_keeps_nothing_is_an_error(spark):
    from pyspark.ml.linalg import Vectors

    train = spark.createDataFrame([(i, "ab"[i % 2], Vectors.dense([1.0, 1.0])) for i in range(8)], ["id", "label", "features"])
    with pytest.raises(ValueError, match="keeps no column"):
        L.predict_forest(train, train, "id", cost=1e-6)
