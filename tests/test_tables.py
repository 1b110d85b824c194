import json

from pyspark.sql import functions as F

from versegrid.operators import genres as G
from versegrid.operators.ranking import global_row_number
from versegrid.session import drop_staged, stage, staging_path
from versegrid.sources import tables as S

GENRES = [(0, "african", ["kwaito", "afrobeat"]), (1, "electronic", ["kwaito", "ambient", "neue deutsche härte"]),
          (2, "folk", []), (3, "latin", ["folk", "salsa"])]
SCHEMA = "ord int, genre string, subgenres array<string>"


def _genres(spark):
    return spark.createDataFrame(GENRES, SCHEMA)


def _best(spark, rows, **options):
    tags = spark.createDataFrame(rows, "artist string, name string, count long")
    return {r.artist: r.tag for r in G.best_genre(tags, _genres(spark), ["artist"], **options).collect()}


def test_tsv_keeps_quotes_blanks_and_empty_values(spark):
    rows = [(1, 'u"1', ' "A" ', "t"), (2, "", "b'", 'x""y'), (3, "back\\slash", "é", "z")]
    path = staging_path(spark, "test-tsv")
    S.write_tsv(spark.createDataFrame(rows, S.TRACKS), path)
    assert sorted(tuple(r) for r in S.read_tsv(spark, path, S.TRACKS).collect()) == rows


def test_genre_file(spark, tmp_path):
    path = tmp_path / "genres.json"
    path.write_text(json.dumps([{"genre": g, "subgenres": s} for _, g, s in GENRES], indent=1), encoding="utf8")
    assert [tuple(r) for r in S.read_genres(spark, str(path)).orderBy("ord").collect()] == GENRES


def test_dataset_parts(spark):
    path = staging_path(spark, "test-dataset")
    S.write_dataset(spark.createDataFrame([(1, "trainset"), (2, "testset")], "id int, part string"), path)
    assert [r.id for r in S.read_dataset(spark, path, "testset").collect()] == [2]
    assert S.read_dataset(spark, path).count() == 2


def test_union_keeps_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    assert S.union_shards([df, df, df]).count() == 6


def test_alias_belongs_to_first_genre(spark):
    got = {r.alias: r.genre for r in G.alias_to_genre(_genres(spark)).collect()}
    assert got["kwaito"] == "african" and got["folk"] == "folk" and got["latin"] == "latin" and got["salsa"] == "latin"


def test_best_genre(spark):
    got = _best(spark, [
        ("sum", "ambient", 3), ("sum", "electronic", 3), ("sum", "salsa", 5),
        ("tie", "salsa", 4), ("tie", "ambient", 4),
        ("unmatched", "seen live", 9), ("zero", "salsa", 0),
        ("case", "SALSA", 1), ("accent", "Afrobéat", 1), ("accent", "salsa", 1),
        ("unfolded list", "Neue Deutsche Härte", 5), ("unfolded list", "salsa", 1)])
    assert got == {"sum": "electronic", "tie": "electronic", "unmatched": "african", "zero": "african", "case": "latin",
                   "accent": "african", "unfolded list": "latin"}
    assert _best(spark, [("u", "seen live", 9), ("m", "salsa", 1)], unmatched="null") == {"u": None, "m": "latin"}


def test_genre_scores(spark):
    tags = spark.createDataFrame([("a", "ambient", 3), ("a", "electronic", 4), ("a", "x", 5)], "artist string, name string, count long")
    assert [tuple(r) for r in G.genre_scores(tags, _genres(spark), ["artist"]).collect()] == [("a", "electronic", 7)]


def test_tag_responses(spark):
    bodies = [("a", '{"toptags":{"tag":[{"name":"salsa","count":100},{"name":"folk","count":"7"}]}}'),
              ("b", '{"error":6,"message":"not found"}'), ("c", '{"toptags":{"tag":[]}}')]
    df = spark.createDataFrame(bodies, "artist string, body string")
    assert sorted(tuple(r) for r in G.parse_tag_responses(df, ["artist"], "body").collect()) == [("a", "folk", 7), ("a", "salsa", 100)]


def test_tracks_and_fallback(spark):
    tracks = spark.createDataFrame([(1, "a", "t"), (2, "a", "u"), (3, "b", "v"), (4, "c", "w")], "trackid long, artist string, title string")
    first = spark.createDataFrame([("a", "salsa", 1)], "artist string, name string, count long")
    second = spark.createDataFrame([("a", "ambient", 1), ("b", "ambient", 1)], "artist string, name string, count long")
    one = {r.trackid: r.tag for r in G.tag_tracks(tracks, first, _genres(spark)).collect()}
    both = {r.trackid: r.tag for r in G.tagger_fallback(tracks, [first, second], _genres(spark)).collect()}
    assert one == {1: "latin", 2: "latin"}
    assert both == {1: "latin", 2: "latin", 3: "electronic"}


def test_global_row_number(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = {r.k: r.n for r in global_row_number(df, ["k"], "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got), 1)}


def test_staged_tables_go_away(spark, tmp_path):
    df = stage(spark.range(10), "test-stage")
    files = df.inputFiles()
    drop_staged(df)
    import os
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_tsv_refuses_what_it_cannot_hold(spark, tmp_path):
    import pytest

    for i, bad in enumerate(("a\tb", "a\nb", "a\rb", "a\x00b")):
        df = spark.createDataFrame([(1, bad)], "trackid long, artist string")
        with pytest.raises(Exception, match="cannot be written as TSV"):
            S.write_tsv(df, str(tmp_path / str(i)))


def test_session_keeps_what_the_job_sets():
    """A submitted master and shuffle count survive; run apart, as a process has one session."""
    import os
    import subprocess
    import sys

    code = ("from versegrid.session import build_session; s = build_session(); "
            "print(s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[3] --conf spark.sql.shuffle.partitions=77 pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split()[-2:] == ["local[3]", "77"], out.stderr[-500:]


def test_genre_names_as_rows(spark, tmp_path):
    from versegrid.operators.genres import alias_of_names, alias_to_genre
    from versegrid.sources import tables as S

    listed = [(0, "rock", ["indie", "punk"]), (1, "pop", ["indie", "rock"]), (2, "folk", [])]
    lists = spark.createDataFrame(listed, "ord int, genre string, subgenres array<string>")
    rows = [(o, g, n) for o, g, names in listed for n in names or [None]]
    S.write_genre_names(spark.createDataFrame(rows, "ord int, genre string, name string").repartition(3), f"{tmp_path}/g")
    names = S.read_genre_names(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, names.collect()), key=repr) == sorted(rows, key=repr)
    want = [("folk", 2, "folk"), ("indie", 0, "rock"), ("pop", 1, "pop"), ("punk", 0, "rock"), ("rock", 0, "rock")]
    assert sorted(map(tuple, alias_of_names(names).collect())) == want == sorted(map(tuple, alias_to_genre(lists).collect()))
