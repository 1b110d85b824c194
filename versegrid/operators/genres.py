"""Genres of artists and tracks from weighted tag counts and a genre list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versegrid.functions.text import fold_ascii

TAG_RESPONSE = "error int, message string, toptags struct<tag:array<struct<name:string,count:string>>>"


def parse_tag_responses(responses: DataFrame, keys: list[str], body: str) -> DataFrame:
    """``(*keys, name, count)``: the tags of JSON answers; error answers have none."""
    parsed = responses.select(*keys, F.from_json(body, TAG_RESPONSE).alias("_r"))
    ok = parsed.filter(F.coalesce(F.col("_r.error"), F.lit(0)) == 0)
    tags = ok.select(*keys, F.explode("_r.toptags.tag").alias("_t"))
    return tags.select(*keys, F.col("_t.name").alias("name"), F.expr("try_cast(_t.count AS bigint)").alias("count"))


def alias_to_genre(genres: DataFrame) -> DataFrame:
    """``(alias, ord, genre)``: each name belongs to the first genre that lists it.

    A genre is its own alias, so matching a tag is one equality join.
    """
    return alias_of_names(genres.select("ord", "genre", F.explode_outer("subgenres").alias("name")))


def alias_of_names(names: DataFrame) -> DataFrame:
    """As :func:`alias_to_genre`, from one row ``(ord, genre, name)`` per name; a null name stands for none.

    Names are never gathered by genre, so a genre may list any number of them.
    """
    own = names.select("ord", "genre").distinct().select("ord", "genre", F.col("genre").alias("alias"))
    every = names.filter("name IS NOT NULL").select("ord", "genre", F.col("name").alias("alias")).unionByName(own)
    first = every.groupBy("alias").agg(F.min(F.struct("ord", "genre")).alias("g"))
    return first.select("alias", "g.ord", "g.genre")


def _scores(tags: DataFrame, genres: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, ord, genre, score)``, with a null genre for tags that match none.

    Counts are summed per tag name first, so that however many rows one artist
    has, the join sees each of their names once.
    """
    named = tags.groupBy(*keys, F.lower(fold_ascii(F.col("name"))).alias("alias")).agg(F.sum("count").alias("count"))
    matched = named.join(alias_to_genre(genres), "alias", "left")
    return matched.groupBy(*keys, "ord", "genre").agg(F.sum("count").alias("score"))


def genre_scores(tags: DataFrame, genres: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, genre, score)`` of the matched genres."""
    return _scores(tags, genres, keys).filter(F.col("genre").isNotNull()).select(*keys, "genre", "score")


def best_genre(tags: DataFrame, genres: DataFrame, keys: list[str], unmatched: str = "first") -> DataFrame:
    """``(*keys, tag)``: the genre with the highest score, the earlier one on a tie.

    Genres without a matching tag score 0, so tags that match nothing give the
    first genre of the list; ``unmatched='null'`` gives null instead.
    """
    listed = genres.agg(F.array_sort(F.collect_list(F.struct("ord", "genre")))).scalar()
    per_key = _scores(tags, genres, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "score")))).alias("_scores"))
    candidates = F.transform("_listed", lambda g: F.struct(
        F.coalesce(F.try_element_at("_scores", g["ord"]), F.lit(0)).alias("score"),
        (-g["ord"]).alias("rank"),
        g["genre"].alias("genre"),
    ))
    best = F.array_max(candidates)["genre"]
    tag = best if unmatched == "first" else F.when(F.size("_scores") > 0, best)
    return per_key.withColumn("_listed", listed).select(*keys, tag.alias("tag"))


def tag_tracks(tracks: DataFrame, tags: DataFrame, genres: DataFrame) -> DataFrame:
    """``(trackid, artist, title, tag)`` of the tracks whose artist has tags.

    Each artist is scored once, whatever the number of their tracks.
    """
    artists = tracks.select("artist").distinct()
    best = best_genre(tags.join(artists, "artist", "left_semi"), genres, ["artist"])
    return tracks.join(best, "artist").filter(F.col("tag") != "").select("trackid", "artist", "title", "tag")


def tagger_fallback(tracks: DataFrame, tag_sources: list[DataFrame], genres: DataFrame) -> DataFrame:
    """Like :func:`tag_tracks` with several sources; the first that knows the artist decides."""
    def add(known: DataFrame, numbered) -> DataFrame:
        i, tags = numbered
        best = best_genre(tags, genres, ["artist"]).withColumnRenamed("tag", f"_tag{i}")
        return known.join(best, "artist", "left")

    artists = reduce(add, enumerate(tag_sources), tracks.select("artist").distinct())
    tag = F.coalesce(*[F.nullif(F.col(f"_tag{i}"), F.lit("")) for i in range(len(tag_sources))])
    decided = artists.select("artist", tag.alias("tag")).filter(F.col("tag").isNotNull())
    return tracks.join(decided, "artist").select("trackid", "artist", "title", "tag")
