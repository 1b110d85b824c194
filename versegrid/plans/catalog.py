"""The registered queries: every operator over the driver's tables.

Each takes ``(spark, folder)`` and returns a DataFrame over whole tables. Tables
stand for the pipeline's own as follows: documents for lyrics, labels for tags,
pages for landed pages, events for tag counts, orders and part for tracks,
embeddings for labelled vectors.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.functions import text as T
from versegrid.functions.html_body import BodyRule
from versegrid.functions.urls import track_urls
from versegrid.operators import cluster as C
from versegrid.operators import dense as D
from versegrid.operators import genres as G
from versegrid.operators import hinge as H
from versegrid.operators import learners as L
from versegrid.operators import metrics as M
from versegrid.operators import neighbours as N
from versegrid.operators import pages as P
from versegrid.operators import tfidf as V
from versegrid.operators.ranking import global_row_number
from versegrid.operators.tokens import dealt, stem_dictionary, term_freq
from versegrid.operators.tokens import tokens as token_rows
from versegrid.plans import jobs
from versegrid.session import stage, staging_path
from versegrid.sources import tables as S

ARTICLE_TEXT = BodyRule("blog", r"^https?://blog\.", "text", "tag", "article")
ARTICLE_PARAGRAPHS = BodyRule("mobile", r"^https?://m\.", "paragraphs", "tag", "article", skip_id="mid-song-discussion")
AFTER_AD = BodyRule("www", r"^https?://www\.", "next", "class", "ad", next_tag="footer")
HOST_RULES = (ARTICLE_TEXT, ARTICLE_PARAGRAPHS, AFTER_AD)
NAV_LIST = P.LinkLayout(r"(?s)<nav>(.*?)</nav>", "<li>", r'<a href="([^"]*)">([^<]*)</a>')
# a small genre list over the event types, with overlaps; "error" has no genre
EVENT_GENRES = [(0, "browse", ["view", "click"]), (1, "commerce", ["purchase", "click"]),
                (2, "view", ["signup"]), (3, "account", ["signup", "purchase"])]
WEIGHT_DIGITS = 6
DENSE_EPS = 1.2
COST = 1.0  # of feature selection, one for all sizes of these tables
OPTIMAL_WITHIN = 0.01


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_table(spark, sf, "documents")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_table(spark, sf, "pages")


def _event_tags(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    """Tag counts of users: ``(artist, name, count)``."""
    return S.read_table(spark, sf, "events").filter(where).groupBy(
        F.col("user_id").alias("artist"), F.col("event_type").alias("name")).agg(F.count("*").alias("count"))


def _event_genres(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_GENRES, "ord int, genre string, subgenres array<string>")


def _order_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("long").alias("trackid"), F.col("o_custkey").cast("long").alias("artist"),
        F.col("o_orderstatus").alias("title"))


def _label_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered tag rows of documents: quality first, then a later row for toxic ones, some empty."""
    labels = S.read_table(spark, sf, "labels")
    rows = F.filter(F.array(
        F.struct(F.lit(1).alias("ord"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("tag"), F.lit(True).alias("on")),
        F.struct(F.lit(2).alias("ord"), F.when(F.col("quality") == 1, "toxic").otherwise("").alias("tag"), (F.col("toxic") == 1).alias("on")),
    ), lambda r: r["on"])
    return labels.select(F.col("doc_id").alias("trackid"), F.explode(rows).alias("r")).select("trackid", "r.ord", "r.tag")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    lyrics = _documents(spark, sf).select(F.col("doc_id").alias("trackid"), F.col("text").alias("lyrics"))
    return V.labelled_corpus(lyrics, _label_tags(spark, sf))


def _labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).select(F.col("trackid").alias("doc_id"), F.col("lyrics").alias("text"), F.col("tag").alias("label"))


def _weights(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.round("weight", WEIGHT_DIGITS))


def _tf(spark: SparkSession, sf: str) -> DataFrame:
    return term_freq(_documents(spark, sf), "doc_id", "text")


def _stored_tf(spark: SparkSession, sf: str) -> DataFrame:
    return stage(_tf(spark, sf), "term-freq")


# -- sources and sinks ------------------------------------------------------------------

def tsv_round_trip(spark, sf):
    path = staging_path(spark, "tsv")
    part = S.read_table(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("trackid"), F.format_string("http://host/%s", "p_type").alias("url"),
        F.concat(F.lit('"'), F.col("p_brand")).alias("artist"), F.concat(F.col("p_name"), F.lit(' "live"')).alias("title"))
    S.write_tsv(part, path)
    return S.read_tsv(spark, path, S.TRACKS)


def dataset_round_trip(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "lang", "text")
    path = staging_path(spark, "dataset")
    S.write_dataset(docs.join(V.split_parts(docs, "doc_id"), "doc_id"), path)
    return S.read_dataset(spark, path, "testset").select("doc_id", "lang", "text", "part")


def shard_union(spark, sf):
    """Lyrics shards and a shard repeated by a second run: rows stay as often as they were read."""
    docs = _documents(spark, sf).select("doc_id", "lang", "n_chars")
    shards = [docs.filter(F.pmod("doc_id", F.lit(4)) == k) for k in range(4)]
    return S.union_shards([*shards, shards[1]])


# -- genre list ---------------------------------------------------------------------------

def _part_genres(spark, sf):
    """Types of parts as genres in alphabetical order, names of parts as their names; a row per name."""
    listed = S.read_table(spark, sf, "part").select(F.col("p_type").alias("genre"), F.col("p_name").alias("name")).distinct()
    numbered = global_row_number(listed.select("genre").distinct(), ["genre"], "no").select(
        "genre", (F.col("no") - 1).cast("int").alias("ord"))
    path = staging_path(spark, "genres")
    S.write_genre_names(listed.join(numbered, "genre"), path)
    return S.read_genre_names(spark, path)


def genre_dim(spark, sf):
    """A row per genre with its names in order; only the names of one genre stand in one row."""
    names = _part_genres(spark, sf).groupBy("ord", "genre").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return names.select("ord", "genre", F.array_join("names", "|").alias("subgenres"))


def alias_to_genre(spark, sf):
    return G.alias_of_names(_part_genres(spark, sf))


# -- text ---------------------------------------------------------------------------------

def _text_query(function):
    return lambda spark, sf: _documents(spark, sf).select("doc_id", function(F.col("text")).alias("value"))


def strip_suffix(spark, sf):
    title = F.concat(F.lit(" "), F.col("p_name"), F.lit(" Lyrics live Lyrics "))
    return S.read_table(spark, sf, "part").select(
        "p_partkey", T.strip_suffix(title).alias("title"), T.strip_suffix(title, compat=True).alias("compat_title"))


def decoded_text(spark, sf):
    """Texts as bytes, every third with malformed ones behind it, read back."""
    return _documents(spark, sf).select("doc_id", T.utf8_text(F.concat(
        F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF41C3"))).otherwise(F.unhex(F.lit(""))))).alias("value"))


def shard_letter(spark, sf):
    return S.read_table(spark, sf, "part").select("p_partkey", T.shard_letter(T.slug_underscore(
        F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name")))).alias("letter"))


def build_urls(spark, sf):
    urls = F.explode(track_urls(F.col("p_brand"), F.col("p_name"))).alias("u")
    return S.read_table(spark, sf, "part").select("p_partkey", urls).select("p_partkey", "u.site", "u.url")


# -- pages --------------------------------------------------------------------------------

def route_pages(spark, sf):
    return P.routed(_pages(spark, sf).select("page_id", "url"), HOST_RULES).select("page_id", "site")


def reject_pages(spark, sf):
    return P.rejected(_pages(spark, sf).select("page_id", "url"), ARTICLE_TEXT)


def page_links(spark, sf):
    return P.page_links(_pages(spark, sf))


def track_links(spark, sf):
    return P.list_links(_pages(spark, sf), ["page_id"], NAV_LIST)


def frontier_pattern(spark, sf):
    links = P.page_links(_pages(spark, sf)).withColumn("href", F.concat(
        F.col("href"), F.when(F.col("page_id") % 2 == 0, "-lyrics.html").otherwise("-songs.html")))
    pattern = P.songs_page_pattern(F.col("href"))
    return links.select("page_id", "href", pattern.alias("pattern"), P.songs_page_url(pattern, F.lit(2)).alias("second"))


def page_enumeration(spark, sf):
    """Pages in lists of 100, every third landed twice; an address with a fragment answers from elsewhere."""
    pages = _pages(spark, sf)
    landed = pages.unionByName(pages.filter("page_id % 3 = 0")).select(
        F.floor(F.col("page_id") / 100).alias("idx"), (F.col("page_id") % 100 + 1).alias("page"), "url",
        F.when(F.col("page_id") % 100 > 40, F.regexp_replace("url", "#.*$", "")).otherwise(F.col("url")).alias("final_url"))
    return P.reachable(landed, ["idx"])


def track_keys(spark, sf):
    links = track_links(spark, sf).withColumnRenamed("href", "url")
    return P.assign_track_keys(links, ["page_id", "pos"])


def artist_page_list(spark, sf):
    """Asked list pages that the landed pages could answer, matched by list and page number."""
    landed = _pages(spark, sf).select((F.col("page_id") % 27).cast("int").alias("idx_ord"),
                                      (F.floor(F.col("page_id") / 27) + 1).cast("int").alias("page"), "page_id")
    idx = F.get(F.array(*[F.lit(i) for i in P.ARTIST_INDICES]), F.col("idx_ord"))
    return landed.select("page_id", idx.alias("idx"), "page", P.artist_page_url(F.col("idx_ord"), F.col("page")).alias("url"))


def crawl_tracks(spark, sf):
    """The crawl stage on list pages made from part: brands are artists, parts their songs."""
    part = S.read_table(spark, sf, "part").select(
        "p_name", F.col("p_partkey").cast("long").alias("key"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b"))
    brand = F.concat(F.lit("http://host/brand-"), F.col("b"))
    artist_rows = part.select("b").distinct().select(
        (F.col("b") % 5).alias("idx_ord"), (F.floor(F.col("b") / 5) % 3 + 1).cast("int").alias("page"), "b",
        F.concat(F.lit('<tr><td><a href="'), brand, F.lit('-lyrics.html">Brand &amp; '), F.col("b"),
                 F.lit(" Lyrics</a></td><td>1</td></tr>")).alias("row"))
    url = F.concat(F.lit("http://host/list-"), F.col("idx_ord"), F.lit("-"), F.col("page"))
    artist_lists = _list_page(artist_rows.groupBy("idx_ord", "page"), "b", "songs-table").select(
        "idx_ord", F.col("idx_ord").cast("string").alias("idx"), "page", url.alias("url"), url.alias("final_url"), "html")
    song_rows = part.select("b", "key", (F.floor(F.col("key") / 1000) + 1).alias("page"), F.concat(
        F.lit('<tr><td class="star">*</td><td><a href="'), brand, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")),
        F.lit('.html">'), F.col("p_name"), F.lit(" Lyrics</a></td></tr>")).alias("row"))
    songs_url = F.concat(brand, F.lit("-alpage-"), F.col("page"), F.lit(".html"))
    song_lists = _list_page(song_rows.groupBy("b", "page"), "key", "songs-table compact").select(
        songs_url.alias("url"), songs_url.alias("final_url"), "html")
    return jobs.crawl(artist_lists, song_lists)


def _list_page(groups, order, css_class):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "row"))), lambda r: r["row"]), "")
    return groups.agg(F.concat(F.lit(f'<html><table class="{css_class}"><tbody>'), rows, F.lit("</tbody></table></html>")).alias("html"))


def site_rule_lyrics(spark, sf):
    """Document texts on pages of the four sites' layouts, extracted by the four site rules."""
    docs = _documents(spark, sf).select("doc_id", "text")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = F.col("doc_id").cast("string")
    layouts = [
        (F.concat(F.lit("http://www.metrolyrics.com/t-lyrics-"), at, F.lit(".html")),
         F.concat(F.lit('<div id="lyrics-body-text"><p>'), safe, F.lit('</p><p id="mid-song-discussion">no</p></div><p>no</p>'))),
        (F.concat(F.lit("http://www.lyrics.com/t-lyrics-"), at, F.lit(".html")),
         F.concat(F.lit('<p>no</p><div id="lyrics">'), safe, F.lit("</div>no"))),
        (F.concat(F.lit("http://www.lyricsmode.com/lyrics/t/a/"), at, F.lit(".html")),
         F.concat(F.lit('<p id="lyrics_text">'), safe, F.lit("</p>no"))),
        (F.concat(F.lit("http://www.azlyrics.com/lyrics/a/"), at, F.lit(".html")),
         F.concat(F.lit('<div class="lyricsh">no</div><div class="r">no</div><div>'), safe, F.lit("</div><div>no</div>"))),
    ]
    pages = F.get(F.array(*[F.struct(u.alias("url"), h.alias("html")) for u, h in layouts]), (F.col("doc_id") % 4).cast("int"))
    landed = docs.select(F.col("doc_id").alias("trackid"), pages.alias("p")).select("trackid", "p.url", "p.html")
    return jobs.extract(landed.select("trackid", "url"), landed.select("url", "html"))


def vectorize(spark, sf):
    """Lyrics with ordered tags, every seventh lyrics row twice, to vectors stored by part and read back."""
    docs = _documents(spark, sf).select(F.col("doc_id").alias("trackid"), F.col("text").alias("lyrics"))
    lyrics = docs.unionByName(docs.filter("trackid % 7 = 0"))
    path = staging_path(spark, "vectorize")
    S.write_dataset(jobs.vectorize(lyrics, _label_tags(spark, sf), split=True), path)
    stored = spark.read.schema("trackid long, label string, part string, features struct<type: tinyint, size: int, "
                               "indices: array<int>, values: array<double>>").parquet(path)
    return stored.select("trackid", "label", "part", "features.size",
                         F.array_join(F.transform("features.indices", lambda i: i.cast("string")), ",").alias("indices"),
                         F.round(F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x), 5).alias("weight_sum"))


def _bodies(rule):
    def query(spark, sf):
        pages = _pages(spark, sf).select("page_id", "html", F.lit(0).alias("rule_no"))
        return P.with_body(pages, [rule]).select("page_id", "body")
    return query


def nonempty_bodies(spark, sf):
    raw = F.regexp_replace("text", "^[A-M].*", "")
    return P.nonempty(_documents(spark, sf).select("doc_id", raw.alias("raw")), "raw")


def extract_lyrics(spark, sf):
    pages = _pages(spark, sf)
    tracks = pages.select(F.col("page_id").alias("trackid"), "url")
    return jobs.extract(tracks, pages.select("url", "html"), HOST_RULES)


# -- tags ---------------------------------------------------------------------------------

def tag_json(spark, sf):
    """Answers of the tag service made from event counts; users with a multiple of 10 get an error."""
    answers = _event_tags(spark, sf).groupBy("artist").agg(
        F.collect_list(F.struct("name", F.col("count").cast("string").alias("count"))).alias("tag"))
    body = F.when(F.col("artist") % 10 == 0, F.lit('{"error": 6, "message": "not found"}')).otherwise(
        F.to_json(F.struct(F.struct("tag").alias("toptags"))))
    return G.parse_tag_responses(answers.select("artist", body.alias("body")), ["artist"], "body")


def genre_scores(spark, sf):
    return G.genre_scores(_event_tags(spark, sf), _event_genres(spark), ["artist"])


def best_genre(spark, sf):
    return G.best_genre(_event_tags(spark, sf), _event_genres(spark), ["artist"])


def best_genre_track(spark, sf):
    tags = S.read_table(spark, sf, "events").groupBy(
        F.col("user_id").alias("artist"), F.col("props").alias("title"), F.col("event_type").alias("name")).agg(
        F.count("*").alias("count"))
    return G.best_genre(tags, _event_genres(spark), ["artist", "title"])


def tag_tracks(spark, sf):
    return jobs.tag(_order_tracks(spark, sf), [_event_tags(spark, sf)], _event_genres(spark))


def tagger_fallback(spark, sf):
    sources = [_event_tags(spark, sf, "value > 60"), _event_tags(spark, sf)]
    return jobs.tag(_order_tracks(spark, sf), sources, _event_genres(spark))


# -- corpus and TF-IDF --------------------------------------------------------------------

def labelled_corpus(spark, sf):
    return _corpus(spark, sf)


def distinct_labels(spark, sf):
    return V.distinct_labels(_corpus(spark, sf))


def tokens(spark, sf):
    return token_rows(_documents(spark, sf), "doc_id", "text", stop=False)


def tokens_no_stop(spark, sf):
    return token_rows(_documents(spark, sf), "doc_id", "text")


def stems(spark, sf):
    return stem_dictionary(token_rows(_documents(spark, sf), "doc_id", "text"))


def term_freq_query(spark, sf):
    return _tf(spark, sf)


def doc_freq(spark, sf):
    return V.doc_freq(_stored_tf(spark, sf))


def idf(spark, sf):
    docs = _documents(spark, sf)
    return V.idf(_stored_tf(spark, sf), V.row_count(docs)).withColumn("idf", F.round("idf", WEIGHT_DIGITS))


def tfidf(spark, sf):
    return _weights(V.fit_transform(_tf(spark, sf), _documents(spark, sf), "doc_id"))


def tfidf_plain(spark, sf):
    """TF-IDF of all words as they are, without stop words or stems."""
    docs = _documents(spark, sf)
    return _weights(V.fit_transform(term_freq(docs, "doc_id", "text", stop=False, stem=False), docs, "doc_id"))


def _split_corpus(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("label"))
    return jobs.weighted_corpus(docs, "doc_id", split=True)


def tfidf_transform(spark, sf):
    long, _, docs = _split_corpus(spark, sf)
    return _weights(long.join(docs.filter("part = 'testset'").select("doc_id"), "doc_id", "left_semi"))


def sparse_vectors(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("label"))
    long, index, rows = jobs.weighted_corpus(docs, "doc_id", split=False, columns=True)
    arrays = V.sparse_arrays(long, index, rows, "doc_id")
    return arrays.select("doc_id", "size", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"),
                         F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w), 5).alias("weight_sum"))


def split_parts(spark, sf):
    return V.split_parts(_documents(spark, sf), "doc_id")


def corpus_profile(spark, sf):
    return V.corpus_profile(_stored_tf(spark, sf), _documents(spark, sf))


def top_terms(spark, sf):
    """Flagship: the ten heaviest terms of each language by mean TF-IDF weight."""
    docs = _documents(spark, sf)
    tf = _stored_tf(spark, sf)
    weights = V.weigh(tf, V.idf(tf, V.row_count(docs)), "doc_id")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    named = weights.join(docs.select("doc_id", "lang"), "doc_id").select("lang", "term", "weight")
    totals = dealt(named, tf.count(), "term").groupBy("lang", "term").agg(F.sum("weight").alias("total"))
    mean = totals.join(sizes, "lang").select("lang", "term", F.round(F.col("total") / F.col("docs"), WEIGHT_DIGITS).alias("mean_weight"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("mean_weight"), "term"))
    return mean.withColumn("rank", rank.cast("long")).filter("rank <= 10")


# -- clustering ---------------------------------------------------------------------------

def _neighbourhood(spark, sf, eps=0.3):
    docs = _documents(spark, sf)
    return N.neighbourhood(term_freq(docs, "doc_id", "text"), docs, "doc_id", eps)


def eps_neighbours(spark, sf):
    return N.degrees(_neighbourhood(spark, sf), "doc_id")


def dbscan(spark, sf):
    return C.dbscan(_neighbourhood(spark, sf), "doc_id")


def _embeddings(spark, sf):
    rows = S.read_table(spark, sf, "embeddings")
    return rows.select("vec_id", F.col("label").cast("string").alias("label"),
                       array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def kmeans(spark, sf):
    return C.kmeans(_embeddings(spark, sf), "vec_id")


def eps_neighbours_dense(spark, sf):
    return D.degrees(S.read_table(spark, sf, "embeddings"), "vec_id", "embedding", DENSE_EPS)


def dbscan_dense(spark, sf):
    return D.dbscan(S.read_table(spark, sf, "embeddings"), "vec_id", "embedding", DENSE_EPS)


def _affinity(near, key):
    found = C.affinity_propagation(near.balls.select(F.col("rep").alias("node")), stage(C.similarity_edges(near), "edges"))
    return near.members.join(found.withColumnRenamed("node", "rep"), "rep").select(key, "exemplar")


def affinity(spark, sf):
    return _affinity(_neighbourhood(spark, sf, 0.8), "doc_id")


def cluster_scores(spark, sf):
    """The cluster stage: three algorithms on one corpus, one score row each."""
    corpus = _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("label"))
    return jobs.cluster(corpus, "doc_id")


def contingency(spark, sf):
    corpus = _corpus(spark, sf).select("trackid", "tag")
    langs = _documents(spark, sf).select(F.col("doc_id").alias("trackid"), "lang")
    return M.contingency(corpus.join(langs, "trackid"), "tag", "lang")


def homogeneity_completeness(spark, sf):
    corpus = _corpus(spark, sf).select("trackid", "tag")
    langs = _documents(spark, sf).select(F.col("doc_id").alias("trackid"), "lang")
    scores = M.cluster_scores(corpus.join(langs, "trackid"), "tag", "lang")
    return scores.select(F.round("homogeneity", 6).alias("homogeneity"), F.round("completeness", 6).alias("completeness"))


# -- learners -----------------------------------------------------------------------------

def _long_split(spark, sf):
    long, index, docs = jobs.weighted_corpus(_labelled_texts(spark, sf), "doc_id", split=True)
    train, test = docs.filter("part = 'trainset'"), docs.filter("part = 'testset'")
    rows = [long.join(d.select("doc_id"), "doc_id", "left_semi") for d in (train, test)]
    return rows[0], train, rows[1], test, V.row_count(index)


def naive_bayes(spark, sf):
    return L.naive_bayes(*_long_split(spark, sf), "doc_id")


def perceptron(spark, sf):
    train, train_docs, test, test_docs, _ = _long_split(spark, sf)
    return L.perceptron(train, train_docs, test, test_docs, "doc_id")


def _vector_split(spark, sf):
    rows = _embeddings(spark, sf)
    placed = stage(rows.join(V.split_parts(rows.select("vec_id"), "vec_id"), "vec_id"), "embeddings")
    return placed.filter("part = 'trainset'"), placed.filter("part = 'testset'")


def random_forest(spark, sf):
    return L.predict_forest(*_vector_split(spark, sf), "vec_id", COST)


def linear_svm(spark, sf):
    return L.predict_svm(*_vector_split(spark, sf), "vec_id")


def mlp(spark, sf):
    return L.predict_mlp(*_vector_split(spark, sf), "vec_id", COST)


def feature_selection(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("label"))
    vectors, _, index, _ = jobs.vectorized(docs, "doc_id", split=True)
    return L.selected_terms(vectors.filter("part = 'trainset'"), index, COST)


def svm_optimality(spark, sf):
    """Per language whether the cost of its machine is within the bound of the least possible one, by the duality gap."""
    docs = _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("label"))
    long, _, parts = jobs.weighted_corpus(docs, "doc_id", split=True)
    train = parts.filter("part = 'trainset'").select("doc_id", "label")
    rows = stage(long.join(train.select("doc_id"), "doc_id", "left_semi"), "train-rows")
    gap = H.duality_gap(rows, train, H.squared_hinge(rows, train, "doc_id"), "doc_id")
    return gap.select("class", (F.col("primal") - F.col("dual") <= OPTIMAL_WITHIN * F.col("primal")).alias("ok"))


def classify_all(spark, sf):
    vectors, long, index, docs = jobs.vectorized(_labelled_texts(spark, sf), "doc_id", split=True)
    path = staging_path(spark, "reports")
    S.write_reports(jobs.classify(vectors, long, index, docs, "doc_id", COST), path)
    return spark.read.parquet(path).select("algorithm", "class", "precision", "recall", "f1", "support")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def accuracy_f1(spark, sf):
    return _rounded(M.accuracy_f1(naive_bayes(spark, sf)), "accuracy", "weighted_f1")


def classification_report(spark, sf):
    return _rounded(M.classification_report(naive_bayes(spark, sf)), "precision", "recall", "f1")


QUERIES = {
    "tsv_round_trip": tsv_round_trip,
    "dataset_round_trip": dataset_round_trip,
    "shard_union": shard_union,
    "genre_dim": genre_dim,
    "alias_to_genre": alias_to_genre,
    "inline_text": _text_query(lambda c: T.inline(c, lower=True)),
    "fold_ascii": _text_query(T.fold_ascii),
    "decoded_text": decoded_text,
    "replace_last": _text_query(lambda c: T.replace_last(c, "e", "<E>", 2)),
    "strip_suffix": strip_suffix,
    "slug_dash": _text_query(T.slug_dash),
    "slug_underscore": _text_query(T.slug_underscore),
    "slug_compact": _text_query(T.slug_compact),
    "shard_letter": shard_letter,
    "build_urls": build_urls,
    "route_pages": route_pages,
    "reject_pages": reject_pages,
    "page_links": page_links,
    "track_links": track_links,
    "frontier_pattern": frontier_pattern,
    "page_enumeration": page_enumeration,
    "artist_page_list": artist_page_list,
    "track_keys": track_keys,
    "crawl_tracks": crawl_tracks,
    "site_rule_lyrics": site_rule_lyrics,
    "vectorize": vectorize,
    "page_bodies_text": _bodies(ARTICLE_TEXT),
    "page_bodies_paragraphs": _bodies(ARTICLE_PARAGRAPHS),
    "page_bodies_next": _bodies(AFTER_AD),
    "nonempty_bodies": nonempty_bodies,
    "extract_lyrics": extract_lyrics,
    "tag_json": tag_json,
    "genre_scores": genre_scores,
    "best_genre": best_genre,
    "best_genre_track": best_genre_track,
    "tag_tracks": tag_tracks,
    "tagger_fallback": tagger_fallback,
    "labelled_corpus": labelled_corpus,
    "distinct_labels": distinct_labels,
    "tokens": tokens,
    "tokens_no_stop": tokens_no_stop,
    "stems": stems,
    "term_freq": term_freq_query,
    "doc_freq": doc_freq,
    "idf": idf,
    "tfidf": tfidf,
    "tfidf_plain": tfidf_plain,
    "tfidf_transform": tfidf_transform,
    "sparse_vectors": sparse_vectors,
    "split_parts": split_parts,
    "corpus_profile": corpus_profile,
    "top_terms": top_terms,
    "eps_neighbours": eps_neighbours,
    "dbscan": dbscan,
    "eps_neighbours_dense": eps_neighbours_dense,
    "dbscan_dense": dbscan_dense,
    "kmeans": kmeans,
    "affinity": affinity,
    "cluster_scores": cluster_scores,
    "contingency": contingency,
    "homogeneity_completeness": homogeneity_completeness,
    "naive_bayes": naive_bayes,
    "perceptron": perceptron,
    "random_forest": random_forest,
    "linear_svm": linear_svm,
    "mlp": mlp,
    "feature_selection": feature_selection,
    "svm_optimality": svm_optimality,
    "classify_all": classify_all,
    "accuracy_f1": accuracy_f1,
    "classification_report": classification_report,
}
