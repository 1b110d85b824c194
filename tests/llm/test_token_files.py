import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from versegrid.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)


@settings(deadline=None)  # the first example loads the tokenizer
@given(st.text(alphabet="ab'stA1.! \n\t\r\xa0\x85\x1c é中😀", max_size=30))
def test_pieces_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(T.encoder(PATH)([text])[0], "<u4").tolist() == MODEL.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("plane", ["bit", "byte"])
def test_planes_round_trip(plane):
    for n in (1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
        assert (T.from_planes(T.to_planes(ids, plane), n, plane) == ids).all()


@pytest.mark.parametrize("plane, chunk", [("bit", 64), ("byte", 1000), ("bit", T.CHUNK)])
def test_files_round_trip(docs, odd_rows, tmp_path, plane, chunk):
    manifest = T.write_tokens(docs, PATH, f"file://{tmp_path}/t", plane=plane, chunk=chunk)
    start, want = 0, []
    for r in sorted(odd_rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(MODEL.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, T.token_index(manifest).collect()), key=lambda r: r[1]) == want


def test_empty_null_keys_and_extra_columns(spark, no_docs, clashing, tmp_path):
    assert T.token_index(T.write_tokens(no_docs, PATH, f"file://{tmp_path}/a")).count() == 0
    assert T.token_index(T.write_tokens(clashing, PATH, f"file://{tmp_path}/b")).count() == clashing.count()
    df = spark.createDataFrame([(2, "b"), (None, "a")], "doc_id long, text string")
    got = sorted(T.token_index(T.write_tokens(df, PATH, f"file://{tmp_path}/c")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2]


def test_unfinished_file_is_refused(tmp_path):
    import pyarrow as pa

    (tmp_path / "x").write_bytes(b"VGTP1" + bytes(50))
    with pytest.raises(ValueError):
        T.read_index(pa.OSFile(str(tmp_path / "x")))
