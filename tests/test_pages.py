import pytest

from versegrid.functions.html_body import SITE_RULES, BodyRule, page_body
from versegrid.operators import pages as P
from versegrid.plans import jobs

METRO, COM, MODE, AZ = SITE_RULES
OK = {
    "metrolyrics": ["http://www.metrolyrics.com/no-one-lyrics-alicia-keys.html", "http://www.metrolyrics.com/because-the-night-lyrics-10000-maniacs.html"],
    "lyricscom": ["http://www.lyrics.com/tnt-lyrics-acdc.html"],
    "lyricsmode": ["http://www.lyricsmode.com/lyrics/a/ac_dc/t_n_t.html", "http://www.lyricsmode.com/lyrics/0-9/10000_maniacs/because_the_night.html"],
    "azlyrics": ["http://www.azlyrics.com/lyrics/10000maniacs/eatfortwo.html?x=1"],
}
REFUSED = ["http://elsewhere.example/one-lyrics-two.html", "http://www.metrolyrics.com/onlyonepart.html",
           "http://www.lyrics.com/No-Capitals-lyrics-here.html", "http://www.lyricsmode.com/lyrics/too-short.html",
           "http://www.lyricsmode.com/lyrics/78/a/b.html", "http://www.azlyrics.com/lyrics/a-dash/song.html",
           "x http://www.lyrics.com/one-lyrics-two.html"]


def test_routing(spark):
    rows = [(u,) for urls in OK.values() for u in urls] + [(u,) for u in REFUSED]
    got = {r.url: r.site for r in P.routed(spark.createDataFrame(rows, "url string")).collect()}
    assert got == {u: site for site, urls in OK.items() for u in urls}


def test_strict_route(spark):
    df = spark.createDataFrame([(OK["lyricscom"][0],), (REFUSED[0],)], "url string")
    assert [r.url for r in P.rejected(df, COM).collect()] == [REFUSED[0]]
    assert P.require_route(df.limit(1), COM).count() == 1
    with pytest.raises(Exception, match="cannot extract"):
        P.require_route(df, COM).collect()


@pytest.mark.parametrize("rule, html, expected", [
    (COM, '<div id="lyrics">a<br/>b &amp; <b>c</b><script>x</script></div>d', "ab & c"),
    (COM, "<div id='other'>a</div>", None),
    (COM, '<p id="lyrics"></p>', ""),
    (COM, '<div id="lyrics">a<p>b</div>c', "ab"),
    (COM, '<div id="lyrics">a</i>b<!-- no --></div>', "ab"),
    (MODE, '<p id="lyrics_text">x\n<i>y</i></p>z', "x\ny"),
    (METRO, '<div id="lyrics-body-text"><p>a</p> no <p id="mid-song-discussion">q</p><div><p>b</p></div></div><p>c</p>', "a  b"),
    (METRO, '<div id="lyrics-body-text"><p>a<p>b</p></div>', "ab b"),
    (METRO, "<p>none</p>", None),
    (AZ, '<div class="x lyricsh">t</div><div class="r">n</div><div>body<br>two</div><div>later</div>', "bodytwo"),
    (AZ, "<div>no anchor</div>", None),
    (AZ, '<div class="lyricsh">t</div><div class="r">n</div>', None),
    (AZ, '<div class="lyricsh"><div>inside</div></div>', "inside"),
    (BodyRule("t", ".", "text", "tag", "article"), "<article>1</article><article>2</article>", "1"),
])
def test_page_body(rule, html, expected):
    assert page_body(html, rule) == expected


def test_extract_keeps_bodies_that_clean_to_nothing(spark):
    tracks = spark.createDataFrame([(1, OK["lyricscom"][0], "A", "B"), (2, OK["azlyrics"][0], "A", "B"), (3, REFUSED[0], "A", "B"),
                                    (4, "http://www.lyrics.com/a-lyrics-b.html", "A", "B")],
                                   "trackid long, url string, artist string, title string")
    landed = spark.createDataFrame([
        (OK["lyricscom"][0], '<div id="lyrics"> É\n\nTwo </div>'), (OK["azlyrics"][0], '<b class="lyricsh"></b><div> \n </div>'),
        (REFUSED[0], '<div id="lyrics">x</div>'), ("http://www.lyrics.com/a-lyrics-b.html", '<div id="lyrics"></div>')], "url string, html string")
    assert {tuple(r) for r in jobs.extract(tracks, landed).collect()} == {(1, "e two"), (2, "")}


def test_each_page_is_parsed_once(spark):
    pages = spark.createDataFrame([(1, OK["lyricscom"][0], "<p></p>")], "trackid long, url string, html string")
    plan = jobs.extract(pages.drop("html"), pages.select("url", "html"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_artist_pages(spark):
    pages = P.artist_pages(spark, 3)
    assert pages.count() == 81
    assert pages.filter("idx = 'a' AND page = 2").first().url == "http://www.metrolyrics.com/artists-a-2.html"


def test_reachable_stops_at_redirects_and_gaps(spark):
    rows = [("a", 1, "u1", "u1"), ("a", 2, "u2", "u2"), ("a", 3, "u3", "u1"), ("a", 4, "u4", "u4"),
            ("b", 2, "v2", "v2"), ("c", 1, "w1", None), ("d", 1, "x1", "x1"), ("d", 3, "x3", "x3")]
    landed = spark.createDataFrame(rows, "idx string, page int, url string, final_url string")
    assert {r.url for r in P.reachable(landed, ["idx"]).collect()} == {"u1", "u2", "x1"}
    assert {r.url for r in P.reachable(landed, ["idx"], max_depth=1).collect()} == {"u1", "x1"}
    twice = P.reachable(landed.union(landed), ["idx"]).collect()
    assert sorted(r.url for r in twice) == ["u1", "u1", "u2", "u2", "x1", "x1"]
    long = spark.createDataFrame([("a", i, f"u{i}", f"u{i}") for i in range(1, 301)], landed.schema)
    assert P.reachable(long, ["idx"]).count() == 300


def _artist_list(*rows):
    cells = "".join(f'<tr><td><a class="x" href="{h}">{t}</a></td><td class="c">1</td></tr>' for h, t in rows)
    return f'<table class="top songs-table"><thead></thead><tbody>{cells}</tbody></table>'


def _song_list(*rows):
    cells = "".join(f'<tr><td class="n"><a href="http://no">{i}</a></td><td><a href="{h}">{t}</a></td></tr>' for i, (h, t) in enumerate(rows))
    return f'<table class="songs-table compact"><tbody>{cells}</tbody></table><table><tr><td><a href="z">z</a></td></tr></table>'


def test_crawl(spark):
    lists = spark.createDataFrame([
        (0, "1", 1, "l1", "l1", _artist_list(("http://m/x-lyrics.html", "X &amp; Co Lyrics"), ("http://m/odd.html", "Lyrics Band Lyrics"))),
        (1, "a", 1, "l2", "l2", _artist_list(("http://m/a-lyrics.html", "A's Lyrics\n"))),
        (1, "a", 2, "l3", "l2", _artist_list(("http://m/gone-lyrics.html", "Gone Lyrics")))],
        "idx_ord int, idx string, page int, url string, final_url string, html string")
    songs = spark.createDataFrame([
        ("http://m/x-alpage-1.html", "http://m/x-alpage-1.html", _song_list(("s1", "One Lyrics"), ("s2", "Two Lyrics"))),
        ("http://m/x-alpage-2.html", "http://m/x-alpage-2.html", _song_list(("s3", "Three Lyrics"))),
        ("http://m/x-alpage-3.html", "http://m/x-alpage-1.html", _song_list(("s9", "Nine Lyrics"))),
        ("http://m/odd.html", "http://m/odd.html", _song_list(("s4", "Four"))),
        ("http://m/a-alpage-1.html", "http://m/a-alpage-1.html", _song_list(("s5", "Five Lyrics"), ("s1", "One again Lyrics")))],
        "url string, final_url string, html string")
    got = [tuple(r) for r in jobs.crawl(lists, songs).orderBy("trackid").collect()]
    assert got == [(1, "s1", "X & Co", "One"), (2, "s2", "X & Co", "Two"), (3, "s3", "X & Co", "Three"),
                   (4, "s4", "Lyrics Band", "Four"), (5, "s5", "A's", "Five"), (6, "s1", "A's", "One again")]
    twice = [tuple(r) for r in jobs.crawl(lists.union(lists), songs.union(songs)).orderBy("trackid").collect()]
    assert twice == got
