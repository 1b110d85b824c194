"""TF-IDF as relational steps, the labelled corpus and its split.

Weights follow a vectoriser with sublinear term frequency, smoothed inverse
document frequency, L2 rows, and terms in more than 70 % of documents removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.operators.ranking import global_row_number
from versegrid.operators.tokens import LEAST_ROWS, TASK_ROWS, dealt, tasks_for
from versegrid.session import stage, staging_path
from versegrid.sources.tables import read_as_vectors

MAX_DF = 0.7


def labelled_corpus(lyrics: DataFrame, tags: DataFrame) -> DataFrame:
    """``(trackid, lyrics, tag)``: lyrics with the last tag row of their track.

    ``tags`` carries ``ord``, its row order. The last row decides even when its tag
    is empty, and the track then drops out. Repeated lyrics rows stay.
    """
    last = tags.groupBy("trackid").agg(F.max_by("tag", "ord").alias("tag"))
    return lyrics.join(last.filter(F.col("tag") != ""), "trackid").select("trackid", "lyrics", "tag")


def distinct_labels(corpus: DataFrame, label: str = "tag") -> DataFrame:
    return corpus.agg(F.countDistinct(label).alias("n_labels"))


def row_count(df: DataFrame) -> Column:
    """The number of rows of ``df`` as a scalar subquery."""
    return df.agg(F.count("*")).scalar()


def doc_freq(tf: DataFrame, rows: int | None = None) -> DataFrame:
    """``(term, df)``; term frequencies have one row per document and term.

    ``rows`` is their number, or more. Without it they are counted, so ``tf`` should be a stored table then.
    """
    return dealt(tf.select("term"), tf.count() if rows is None else rows, "term").groupBy("term").agg(F.count("*").alias("df"))


def idf(tf: DataFrame, n_docs: Column, max_df: float = MAX_DF, rows: int | None = None) -> DataFrame:
    """``(term, df, idf)`` of the terms in at most ``max_df`` of ``n_docs`` documents; ``rows`` as in :func:`doc_freq`."""
    return with_idf(doc_freq(tf, rows), n_docs, max_df)


def with_idf(counted: DataFrame, n_docs: Column, max_df: float = MAX_DF) -> DataFrame:
    """``(term, df, idf)`` of those rows of ``(term, df)`` in at most ``max_df`` of ``n_docs`` documents."""
    kept = counted.filter(F.col("df") <= F.lit(max_df).cast("double") * n_docs)
    return kept.withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)


def weigh(tf: DataFrame, idf_table: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, term, weight)`` and the columns of ``carry``: L2-normalised rows; terms without an IDF drop.

    ``tf`` should be a stored table, as its rows are counted. Rows of a document meet once for
    the norm, in partitions of about ``TASK_ROWS`` however many rows there are. An IDF table too
    large for Catalyst to broadcast joins by shuffle before; it is dealt to as many partitions, and
    the counts follow it.
    """
    listed, rows = [c for c in idf_table.columns if c in ("term", "idf", *carry)], tf.count()
    raw = tf.join(dealt(idf_table.select(*listed), rows, "term"), "term").select(
        key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"), *carry)
    raw = raw.repartition(tasks_for(tf, rows, TASK_ROWS, LEAST_ROWS), key)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"), *carry)


def fit_transform(tf: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Weights of a corpus under its own IDF; the counts are stored, as both branches read them."""
    tf = stage(tf, "term-freq")
    return weigh(tf, idf(tf, row_count(docs)), key)


def split_parts(docs: DataFrame, key: str, train_share: float = 0.8) -> DataFrame:
    """``(key, part)``: the first ``ceil(n * (1 - share))`` keys by md5 are the test set.

    ``key`` numbers the rows uniquely. Only keys and their hashes are ranked.
    """
    hashed = docs.select(key, F.md5(F.col(key).cast("string")).alias("_hash"))
    ranked = global_row_number(hashed, ["_hash", key], "_rank")
    # the reference size rule in doubles: 1 - 0.8 is a shade below 0.2
    n_test = F.ceil(row_count(docs) * F.lit(1 - train_share))
    return ranked.select(key, F.when(F.col("_rank") <= n_test, "testset").otherwise("trainset").alias("part"))


def term_index(idf_table: DataFrame) -> DataFrame:
    """``(term, idx)``: columns in alphabetical order, from 0."""
    ranked = global_row_number(idf_table.select("term"), ["term"], "_rank")
    return ranked.select("term", (F.col("_rank") - 1).cast("int").alias("idx"))


def sparse_arrays(weights: DataFrame, index: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """``(key, size, indices, weights)`` per document; empty arrays when no term is left.

    ``weights`` that carry ``idx`` and lie by ``key`` stay where they are; others join with ``index`` by term.
    """
    placed = weights if "idx" in weights.columns else weights.join(index, "term")
    entries = placed.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_entries"))
    empty = F.array().cast("array<struct<idx:int,weight:double>>")
    return docs.select(key).join(entries, key, "left").select(
        key,
        row_count(index).cast("int").alias("size"),
        F.transform(F.coalesce("_entries", empty), lambda e: e["idx"]).alias("indices"),
        F.transform(F.coalesce("_entries", empty), lambda e: e["weight"]).alias("weights"),
    )


def sparse_vectors(arrays: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``features``, an ML sparse vector.

    The vector's stored form is written as a plain struct and read back as a
    vector, which also fixes the training table on shared storage.
    """
    stored = F.struct(F.lit(0).cast("byte").alias("type"), F.col("size"), F.col("indices"),
                      F.col("weights").alias("values"))
    path = staging_path(arrays.sparkSession, "vectors")
    arrays.select(*carry, stored.alias("features")).write.parquet(path)
    return read_as_vectors(arrays.sparkSession, path)


def corpus_profile(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: samples and features of the matrix."""
    n = row_count(docs)
    kept = doc_freq(tf).filter(F.col("df") <= F.lit(MAX_DF).cast("double") * n)
    return kept.agg(F.count("*").alias("features")).select(n.alias("samples"), "features")
