import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versegrid.llm import fim as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, rate=50, spm=80):
    text, h = text or "", hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.binary(max_size=50), st.integers(0, 50), st.integers(0, 50), st.integers(0, 50), st.integers(1, 9))
def test_rotation(data, a, b, c, block):
    a, b, c = sorted(min(x, len(data)) for x in (a, b, c))
    kept, M.BLOCK = M.BLOCK, block
    try:
        buffer = bytearray(data)
        M.rotate(buffer, a, b, c)
    finally:
        M.BLOCK = kept
    assert buffer == data[:a] + data[b:c] + data[a:b] + data[c:]


@given(st.text(alphabet="ab<>PSM \n\té中", max_size=30), st.data())
def test_round_trip(text, draw):
    data = text.encode()
    ends = [0, *M.unit_ends(np.frombuffer(data, np.uint8)).tolist()]
    assert ends[1:] == np.cumsum([len(u.encode()) for u in UNIT.findall(text)], dtype=int).tolist()
    first, second = sorted(draw.draw(st.sampled_from(ends)) for _ in range(2))
    if not any(s in data for s in (M.PREFIX, M.SUFFIX, M.MIDDLE)):
        for form in ("psm", "spm"):
            assert M.restored(M.transformed(data, first, second, form), form) == data
    p, m, s = data[:first], data[first:second], data[second:]
    assert M.transformed(data, first, second, "psm") == b"<P>" + p + b"<S>" + s + b"<M>" + m
    assert M.transformed(data, first, second, "spm") == b"<S>" + s + b"<P>" + p + b"<M>" + m


def test_against_brute_force(spark, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(M, "HANDED", 2000)
    extra = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(
        ["a <P> b", "x<S>", "<M>", "< P>", "<<", "trailing \n ", " \n", "<", "é 中\t\n"] * 12)], docs.schema)
    every = docs.unionByName(extra)
    want = sorted([(r[0], *brute(r[0], r[1])) for r in [tuple(r) for r in every.collect()]], key=repr)
    made = M.fill_in_middle(every)
    assert made.columns == [*docs.columns, "fim"]
    assert sorted([(r.doc_id, *r.fim) for r in made.collect()], key=repr) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = M.restore(made, F.col("fim.output"), F.col("fim.form"))
    assert back.filter(F.col("restored") != F.coalesce("text", F.lit(""))).count() == 0
    again = M.fill_in_middle(docs, seed=7, rate=100, spm_rate=0)
    assert {r.fim.form for r in again.collect()} == {"psm", "plain"}


def test_odd_tables(spark, docs, no_docs, clashing):
    assert M.fill_in_middle(no_docs).count() == 0
    wide = clashing.withColumns({"fim": F.lit(1), "fim_data": F.lit(2), "restored": F.lit(3)})
    made = M.fill_in_middle(wide)
    assert made.columns == [*[c for c in wide.columns if c != "fim"], "fim"]
    assert M.restore(made, F.col("fim.output"), F.col("fim.form")).filter("restored = coalesce(text, '')").count() == docs.count()
    long = spark.createDataFrame([(i, "wörd " * 400_000) for i in range(4)], "doc_id long, text string")
    made = M.fill_in_middle(long, rate=100)
    assert M.restore(made, F.col("fim.output"), F.col("fim.form")).filter("restored = text").count() == 4
    broken = spark.createDataFrame([(1, bytearray(b"ab \xff\xfe cd\xc3"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    made = M.fill_in_middle(broken, rate=100)
    back = M.restore(made, F.col("fim.output"), F.col("fim.form"))
    assert bytes(back.select(F.col("restored").cast("binary")).first()[0]) == b"ab \xff\xfe cd\xc3"
