import random

import corpus_pipeline as P
from samples import SCHEMA, sentence


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(6)
    item = sentence(rng, 40)
    rows = [(i, sentence(rng, 60), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(50, rows[3][1], "en", "a", 1), (51, item + " " + sentence(rng, 30), "en", "b", 1), (52, "12 34", None, "b", 1), (53, None, "en", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, step in P.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(step(spark, docs, str(tmp_path)).collect(), SCHEMA)
        assert docs.columns == columns
        left.append({r.doc_id for r in docs.collect()})
    clean = set(range(40))
    assert left[0] == clean | {50, 51} and left[1] == clean | {51} and left[2] == clean and left[3] <= clean
    out = P.run(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
