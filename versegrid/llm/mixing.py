"""Mixing sources to target weights by repetition rates.

Sizes are summed per source, each source gets a target, and a document is emitted
floor(rate) times plus once more with the probability of the fraction, where rate =
target / source size. Whether the extra copy comes is read off a hash of the key, so
reruns and retried tasks agree. Only one row per source is ever gathered; documents
are never grouped, so a source with a third of all rows costs nothing special.

Defined cases: a null text has size 0; a null source is a source of its own and comes
last; rows repeated with one key share their draw; a source of size 0 has target 0 and
emits nothing; an empty table gives an empty mix. Columns of the documents stay, those
named like an added column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versegrid.llm.common import fresh, n_words, unit_hash
from versegrid.operators.ranking import global_row_number
from versegrid.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def source_targets(docs: DataFrame, size: Column, source: str = "source", weights: tuple[float, ...] = WEIGHTS,
                   share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(mix_source, source_size, target)`` with one row per source, stored.

    Sources in code point order weigh ``weights`` in turn and share ``share`` times the
    total size. A target stops at ``most`` times its source's size; what is left over
    goes to the others by weight until no target is above its stop.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).alias("source_size"))
    keyed = sizes.select(F.col("mix_source").isNull().alias("_last"), "mix_source", "source_size")
    ranked = global_row_number(keyed, ["_last", "mix_source"], "_no")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_no") - 1) % len(weights) + 1).cast("int"))
    table = stage(ranked.select("mix_source", "source_size", turn.alias("_weight"),
                                (F.lit(float(most)) * F.col("source_size")).alias("_stop")), "mix-sources")
    level, stopped = 0.0, -1
    while True:  # ends: each round stops at least one more source
        above = F.col("_stop") < F.lit(level) * F.col("_weight")
        row = table.agg(
            F.sum("source_size").alias("total"), F.count_if(above).alias("stopped"),
            F.sum(F.when(above, F.col("_stop")).otherwise(0.0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("open")).first()
        if row["stopped"] == stopped or not row["open"]:
            break
        stopped = row["stopped"]
        level = (share * row["total"] - row["full"]) / row["open"]
    target = F.least(F.col("_stop"), F.lit(level) * F.col("_weight"))
    return table.select("mix_source", "source_size", target.alias("target"))


def _planned(docs: DataFrame, key: str, text: str, source: str, seed: str, **options) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of size, source_size, target and copies; and its name."""
    size, plan, at = n_words(F.col(text)), fresh(docs, "mix"), fresh(docs, "mix_source")
    goals = source_targets(docs, size, source, **options).withColumnsRenamed(
        {"mix_source": at, "source_size": f"{at}_size", "target": f"{at}_target"})
    joined = docs.withColumn(plan, size).join(goals, F.col(source).eqNullSafe(F.col(at)))
    whole, target = F.col(f"{at}_size"), F.col(f"{at}_target")
    rate = F.when(whole > 0, target / whole).otherwise(0.0)
    extra = (unit_hash(F.col(key), seed=seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(plan, F.struct(
        F.col(plan).alias("size"), whole.alias("source_size"), target.alias("target"),
        (F.floor(rate).cast("long") + extra).alias("copies"))).select(*docs.columns, plan), plan


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
             **options) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, the times each row is emitted."""
    planned, plan = _planned(docs, key, text, source, seed, **options)
    return planned.withColumns({c: F.col(plan)[c] for c in ("size", "source_size", "target", "copies")}).drop(plan)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
          **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``."""
    planned, plan = _planned(docs, key, text, source, seed, **options)
    copies = F.col(plan)["copies"].cast("int")
    return planned.withColumn(plan, F.explode(F.array_repeat(F.lit(True), copies))).drop(plan)
