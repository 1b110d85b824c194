"""Tokens of a document table and their term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versegrid.functions.stem import stem as porter_stem

# English stop words, tested before stemming.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
#: Characters of text that a task counts the terms of, and least of them worth a task of their own.
TASK_CHARS, LEAST_CHARS = 8_000_000, 1_000_000
#: Rows of terms that a task sorts or adds up, and least of them worth a task of their own.
TASK_ROWS, LEAST_ROWS = 1_000_000, 100_000
# Word characters as letters, digits and underscore of every script.
WORD = r"([\p{L}\p{N}_]+)"


def tokens(docs: DataFrame, key: str, text: str, stop: bool = True) -> DataFrame:
    """``(key, term)`` for every word of two or more characters, stop words removed."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)).alias("term"))
    kept = words.filter(F.length("term") > 1)
    return kept.filter(~F.col("term").isin(STOP_WORDS)) if stop else kept


def stem_dictionary(terms: DataFrame, term: str = "term") -> DataFrame:
    """``(term, stem)``, each distinct term stemmed once."""
    return terms.select(term).distinct().withColumn("stem", porter_stem(F.col(term)))


def tasks_for(df: DataFrame, size: int, of_task: int, least: int) -> int:
    """Partitions for ``size``: as many as there are cores while each has ``least``, and more once they would pass ``of_task``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // of_task), min(cores, size // least))


def dealt(df: DataFrame, rows: int, column: str) -> DataFrame:
    """``df`` dealt by ``column`` to about one partition per ``TASK_ROWS`` of ``rows`` rows.

    A join or an aggregate by that column behind it runs in these partitions instead of the session's fixed
    number of them, and the other side of a join follows, so what a task holds does not grow with the input.
    """
    return df.repartition(tasks_for(df, rows, TASK_ROWS, LEAST_ROWS), column)


def term_freq(docs: DataFrame, key: str, text: str, stop: bool = True, stem: bool = True) -> DataFrame:
    """``(key, term, tf)`` with ``term`` the stem.

    The only exchange spreads whole documents by key. It is smaller than the token
    rows it stands for, and counting, stemming and re-counting then run inside the
    partitions, as do later steps that group by the same key. The number of partitions
    follows the characters of all texts, so the counts that a task holds do not grow with them.
    """
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    spread = docs.select(key, text).repartition(tasks_for(docs, chars, TASK_CHARS, LEAST_CHARS), key)
    counts = tokens(spread, key, text, stop).groupBy(key, "term").agg(F.count("*").alias("tf"))
    if not stem:
        return counts
    return counts.groupBy(key, porter_stem(F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))
