import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from versegrid.llm import bpe
from versegrid.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)


def brute(rows, most=1024):
    """Pieces by repeated subtraction of the largest power of two that still fits."""
    out = []
    for key, text, *_ in rows:
        ids = np.array(MODEL.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        while start < len(ids):
            n = most
            while n > len(ids) - start:
                n //= 2
            out.append((key, start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), 0))
            start += n
    return sorted(out, key=repr)


PARTS = st.sampled_from([*"ab'stA1.! \n\t\r\xa0\x85\x1c é中😀", "<|", "<|endoftext|>", "\n\n"])


@settings(deadline=None)  # the first example loads the tokenizer
@given(st.lists(st.lists(PARTS, max_size=20).map("".join), max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encoder(PATH).ids(texts)]
    assert got == [MODEL.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_with_a_small_word_table(monkeypatch, odd_rows):
    monkeypatch.setattr(bpe, "TABLE_BYTES", 4000)
    monkeypatch.setattr(bpe, "GROUP", 300)
    texts = [r[1] or "" for r in odd_rows] + ["a  b", "x\n\ny z", " lead", "tail ", "one\n"]
    encode = bpe.Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.ids(texts)] == [MODEL.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.integers(1, 10000), st.integers(0, 12))
def test_lengths(n, power):
    lengths = P.binary_lengths(n, 1 << power)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and all(x.bit_count() == 1 for x in lengths)
    assert all(x == 1 << power or lengths.count(x) == 1 for x in lengths)


@pytest.mark.parametrize("most", [1, 64, 1024])
def test_against_brute_force(docs, odd_rows, most):
    stored = P.pack(docs, PATH, most=most)
    got = P.packed_pieces(stored).collect()
    assert sorted(((r.key, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got), key=repr) == brute(odd_rows, most)
    assert len({r.sequence_id for r in got}) == len(got) and min(r.sequence_id for r in got) >= 0
    in_order = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in in_order] == sorted(r.length for r in got)


def test_buckets_read_their_own_files(docs, odd_rows):
    stored = P.pack(docs, PATH)
    some = P.bucket(stored, 64)
    assert {len(r.ids) for r in some.collect()} == {256}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(length" in plan


def test_odd_tables(spark, docs, clashing, no_docs):
    assert P.packed_pieces(P.pack(no_docs, PATH)).count() == 0
    assert P.pack(clashing, PATH).count() == P.pack(docs, PATH).count()
    df = spark.createDataFrame([(None, None), (None, ""), ("k", "a b")], "id string, body string")
    got = sorted(((r.key, r.length, r.doc_tokens) for r in P.pack(df, PATH, key="id", text="body").collect()), key=repr)
    assert got == [("k", 1, 3), ("k", 2, 3), (None, 1, 1), (None, 1, 1)]
    with pytest.raises(ValueError):
        P.pack(docs, PATH, most=1000)
