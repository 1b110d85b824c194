"""Clustering: k-means, DBSCAN and sparse affinity propagation."""

from __future__ import annotations

import warnings
from multiprocessing.pool import ThreadPool

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.operators.neighbours import Neighbourhood, both_ways, pair_dots, pairs_within, rep_degrees
from versegrid.operators.ranking import global_row_number
from versegrid.session import drop_staged, stage

NOISE = -1
#: Steps of one round of the median.
BINS = 1024


def kmeans(vectors: DataFrame, key: str, label: str = "label", runs: int = 10, max_iter: int = 100,
           seed: int = 42) -> DataFrame:
    """``(key, label, cluster)`` of the cheapest of ``runs`` restarts, k = distinct labels."""
    data = vectors.select(key, label, "features").persist()
    k = data.select(label).distinct().count()
    with ThreadPool(4) as pool:
        models = pool.map(lambda run: KMeans(k=k, maxIter=max_iter, seed=seed + run).fit(data), range(runs))
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    assigned = best.transform(vectors).withColumnRenamed("prediction", "cluster")
    return assigned.select(key, label, "cluster")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)``: smallest node of each component; ``edges`` is ``(a, b)``.

    Alternating large and small stars (Kiveris et al. 2014) until the edges stay the
    same; there is no limit on rounds. Neighbours are never gathered: the smallest one
    of each node is an aggregate that joins back, so a hub is split like any hot key.
    """
    pairs = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "component-edges")
    mark = _edge_mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        # a row for each edge at most; copies go with the small star
        large = stage(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")), "component-edges")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        new = stage(moved.unionByName(low.withColumnRenamed("low", "v")).distinct(), "component-edges")
        drop_staged(large)
        before, mark = mark, _edge_mark(new)
        drop_staged(pairs)
        pairs = new
        if mark == before:
            break
    return nodes.join(pairs.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def _edge_mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums of an edge table; equal tables have equal marks."""
    return tuple(edges.select(F.xxhash64("u", "v").alias("h")).agg(
        F.count("*"), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first())


def dbscan(near: Neighbourhood, key: str, min_samples: int = 5) -> DataFrame:
    """``(key, cluster)``: clusters numbered by their smallest core row, noise is -1.

    A row with ``min_samples`` rows within eps, itself included, is core. A row that
    is not core joins the first cluster with a core row within eps.
    """
    reps = stage(rep_degrees(near).withColumn("core", F.col("degree") >= min_samples), "dbscan-reps")
    core = reps.filter("core")
    # core rows of one ball are mutual neighbours, so balls are the nodes to connect
    ball_of = core.select("rep", "ball")
    links = near.cross.join(ball_of.withColumnsRenamed({"rep": "a", "ball": "ball_a"}), "a").join(
        ball_of.withColumnsRenamed({"rep": "b", "ball": "ball_b"}), "b").select(
        F.col("ball_a").alias("a"), F.col("ball_b").alias("b")).filter("a <> b")
    joined = connected_components(core.select(F.col("ball").alias("node")).distinct(), links)
    core_root = core.join(joined.withColumnRenamed("node", "ball"), "ball")
    firsts = core_root.groupBy("root").agg(F.min("rep").alias("first"))
    numbered = global_row_number(firsts, ["first"], "_no").select("root", (F.col("_no") - 1).cast("int").alias("cluster"))
    core_cluster = stage(core_root.join(numbered, "root").select("rep", "ball", "cluster"), "dbscan-core")

    other = reps.filter("not core").select("rep", "ball")
    by_ball = other.join(core_cluster.select("ball", "cluster").distinct(), "ball").select("rep", "cluster")
    by_pair = both_ways(near.cross).join(other.select("rep"), "rep").join(
        core_cluster.select(F.col("rep").alias("other"), "cluster"), "other").select("rep", "cluster")
    border = by_ball.unionByName(by_pair)
    assigned = core_cluster.select("rep", "cluster").unionByName(border).groupBy("rep").agg(
        F.min("cluster").alias("cluster"))
    return near.members.join(assigned, "rep", "left").select(
        key, F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def similarity_edges(near: Neighbourhood) -> DataFrame:
    """``(i, k, s)``: directed negative squared distances of all neighbouring representatives.

    Pairs inside a ball are neighbours too; they are listed part by part of the ball. So the
    edges are the same however balls formed.
    """
    inside = pairs_within(near.balls.select("ball", "rep"), "ball", "rep").select(
        F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    pairs = near.cross.unionByName(pair_dots(stage(inside, "inside-pairs"), near.weights))
    return both_ways(pairs).select(F.col("rep").alias("i"), F.col("other").alias("k"),
                                   (-F.greatest(2 - 2 * F.col("dot"), F.lit(0.0))).alias("s"))


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column without nulls, None of an empty one.

    Each round counts the values of ``BINS`` equal steps between the bounds and goes on
    inside the steps that hold the middle, so the driver sees ``BINS`` counts a round and at
    last at most ``BINS`` values, however long the column is.
    """
    bounds = df.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if not bounds["n"]:
        return None
    value, low, high, below, left = F.col(column), bounds["low"], bounds["high"], 0, bounds["n"]
    middle = ((left - 1) // 2, left // 2)
    while left > BINS and low < high:
        step = F.least(F.floor((value - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        counts = df.filter(value.between(low, high)).groupBy(step.alias("step")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("step").collect()
        held, at = [], below
        for row in counts:
            if any(at <= m < at + row["n"] for m in middle):
                held.append((at, row))
            at += row["n"]
        new_low, new_high = held[0][1]["low"], held[-1][1]["high"]
        below, left = held[0][0], sum(row["n"] for _, row in held)
        if len(held) == 2 and held[0][1]["high"] < held[1][1]["low"]:  # the middle lies between two steps
            return (held[0][1]["high"] + held[1][1]["low"]) / 2
        if (new_low, new_high) == (low, high):  # no number between the bounds any more
            break
        low, high = new_low, new_high
    if low == high:
        return low
    rows = df.filter(value.between(low, high)).groupBy(column).agg(F.count("*").alias("n")).orderBy(column).collect()
    values, at = [], below
    for row in rows:
        values += [row[column] for m in middle if at <= m < at + row["n"]]
        at += row["n"]
    return sum(values) / 2


def affinity_propagation(nodes: DataFrame, edges: DataFrame, damping: float = 0.5, max_iter: int = 200,
                         settled: int = 15) -> DataFrame:
    """``(node, exemplar)`` by message passing on a sparse similarity graph (Frey & Dueck 2007).

    ``nodes`` is ``(node)``, ``edges`` ``(i, k, s)``. The preference is the median
    similarity. A hash-based jitter far below any real difference breaks ties, which
    would let messages swing forever. Each round's state is stored, and the loop ends
    when the exemplars, looked at every fifth round, stay the same for ``settled`` rounds.
    If they do not within ``max_iter`` rounds, the exemplars of the last round are the
    result and a warning says so.
    """
    preference = exact_median(edges, "s") or 0.0
    own = nodes.select(F.col("node").alias("i"), F.col("node").alias("k"), F.lit(preference).alias("s"))
    jitter = F.lit(1e-9) * F.pmod(F.xxhash64("i", "k"), F.lit(1000))
    start = edges.unionByName(own).withColumn("s", F.col("s") - jitter)
    state = stage(start.withColumns({"r": F.lit(0.0), "a": F.lit(0.0)}), "affinity")
    calm, last, look = 0, None, 5
    for done in range(1, max_iter + 1):
        new = stage(_message_round(state, damping), "affinity")
        drop_staged(state)
        state = new
        if done % look:
            continue
        mark = state.filter("i = k AND r + a > 0").agg(
            F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("i")), F.lit(0)).alias("h")).first()
        calm = calm + look if mark == last and mark["n"] else 0
        last = mark
        if calm >= settled:
            break
    else:
        warnings.warn(f"affinity propagation did not settle in {max_iter} rounds", RuntimeWarning, stacklevel=2)
    exemplars = state.filter("i = k AND r + a > 0").select("k")
    choice = state.join(exemplars, "k").groupBy("i").agg(
        F.max_by("k", F.struct(F.when(F.col("i") == F.col("k"), 1).otherwise(0), F.col("s"))).alias("k"))
    return nodes.join(choice.select(F.col("i").alias("node"), F.col("k").alias("exemplar")), "node", "left").select(
        "node", F.coalesce("exemplar", "node").alias("exemplar"))


def _message_round(state: DataFrame, damping: float) -> DataFrame:
    """One exchange of responsibilities ``r`` and availabilities ``a`` along ``(i, k, s, r, a)``.

    The two largest values per sender are ranked with a limit that Spark applies
    before the shuffle, and sums combine before theirs, so a hub with many edges
    sends a few rows per task.
    """
    value = F.col("a") + F.col("s")
    order = W.partitionBy("i").orderBy(F.desc("v"), "k")
    two = state.select("i", "k", value.alias("v")).withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    tops = two.groupBy("i").agg(
        F.max(F.when(F.col("_n") == 1, F.col("k"))).alias("_k"), F.max(F.when(F.col("_n") == 1, F.col("v"))).alias("_first"),
        F.max(F.when(F.col("_n") == 2, F.col("v"))).alias("_second"))
    rival = F.when(F.col("k") != F.col("_k"), F.col("_first")).otherwise(F.col("_second"))
    sent = state.join(tops, "i").withColumn(
        "r", damping * F.col("r") + (1 - damping) * (F.col("s") - F.coalesce(rival, F.lit(0.0))))
    sent = sent.select("i", "k", "s", "r", "a")
    is_own = F.col("i") == F.col("k")
    positive = F.when(is_own, F.col("r")).otherwise(F.greatest("r", F.lit(0.0)))
    received = sent.groupBy("k").agg(F.sum(positive).alias("_sum"), F.max(F.when(is_own, F.col("r"))).alias("_self"))
    given = F.when(is_own, F.col("_sum") - F.col("_self")).otherwise(
        F.least(F.lit(0.0), F.col("_sum") - F.greatest("r", F.lit(0.0))))
    return sent.join(received, "k").withColumn(
        "a", damping * F.col("a") + (1 - damping) * given).select("i", "k", "s", "r", "a")
