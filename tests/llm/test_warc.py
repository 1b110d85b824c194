import base64
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from versegrid.llm import warc as W

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def rows():
    out = [(i, f"http://x/{i}", f"<p>{'é' * (i % 50)}{i % 9}</p>") for i in range(200)]
    out += [(300, None, None), (301, "http://x/\r\nEvil: 1%0A", ""), (302, "u", FAKE), (303, "u", "x\r\n\r\n" + FAKE * 5 + FAKE[:40]),
            (304, "u", "big " * 60_000), (305, "u", "big " * 60_000), (305, "u", "big " * 60_000), (None, "u", "big " * 60_000), (-4, "u", "neg")]
    return out


def expected(pages, least=0):
    top = {}
    for i, _, html in pages:
        top[html or ""] = max(top.get(html or "", -10**9), -10**9 if i is None else i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= least and (-10**9 if i is None else i) < top[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                    top[html or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, least", [(1 << 12, 0), (1 << 20, 0), (700, 10)])
def test_round_trip(spark, tmp_path, block, least):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    W.write_archives(pages, folder, least=least)
    records = W.read_archives(spark, folder, block)
    assert sorted((tuple(r) for r in W.page_records(records).collect()), key=repr) == expected(rows(), least)
    got = {r.record_id: r for r in records.collect()}
    assert got["<urn:page:302>"].payload == FAKE.encode() and "<urn:page:666>" not in got
    assert got["<urn:page:301>"].target == "http://x/\r\nEvil: 1%0A" and got["<urn:page:300>"].target is None


def test_files_are_chains_of_records(spark, tmp_path):
    W.write_archives(spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    (name,) = glob.glob(f"{tmp_path}/w/part-*")
    data, at, n = open(name, "rb").read(), 0, 0
    while at < len(data):
        head, length = W._header_end(data, at)
        at += head + length + 4
        assert data[at - 4:at] == b"\r\n\r\n"
        n += 1
    assert n == len(rows())


def test_empty_and_extra_columns(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_archives(none, f"file://{tmp_path}/none")
    assert W.page_records(W.read_archives(spark, f"file://{tmp_path}/none")).count() == 0
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").withColumns(
        {c: F.lit(c) for c in ("id", "digest", "copy", "first", "n", "value")})
    W.write_archives(pages, f"file://{tmp_path}/one")
    assert [r.page_id for r in W.page_records(W.read_archives(spark, f"file://{tmp_path}/one")).collect()] == [1]


@pytest.mark.parametrize("place", [0, 2, 4])
@pytest.mark.parametrize("block", [1000, 1 << 17, W.BLOCK])
def test_long_headers(spark, tmp_path, place, block):
    """An address of 200 KB as the first, a middle and the last record of one file."""
    rows = [(i, "http://x/" + ("y" * 200_000 if i == place else str(i)), f"<p>{i}</p>") for i in range(5)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/a")
    got = W.read_archives(spark, f"file://{tmp_path}/a", block=block).collect()
    assert sorted((r.target, bytes(r.payload).decode()) for r in got) == sorted((u, h) for _, u, h in rows)


def test_damaged_files_raise(spark, tmp_path):
    import glob

    rows = [(i, f"http://x/{i}", "<p>text</p>" * (i + 1)) for i in range(6)]
    for name, change in (("cut", lambda d: d[:-20]), ("headless", lambda d: b"junk" + d)):
        folder = f"{tmp_path}/{name}"
        W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{folder}")
        [path] = [f for f in glob.glob(f"{folder}/part-*")]
        data = open(path, "rb").read()
        [crc] = glob.glob(f"{folder}/.part-*.crc") or [None]
        with open(path, "wb") as out:
            out.write(change(data))
        if crc:
            open(crc, "wb").close()
        for block in (300, W.BLOCK):
            with pytest.raises(Exception, match="no whole record|Checksum"):
                W.read_archives(spark, f"file://{folder}", block=block).collect()
