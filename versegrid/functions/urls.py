"""Canonical page addresses of a track on the four supported sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versegrid.functions.text import shard_letter, slug_compact, slug_dash, slug_underscore

SITES = ("metrolyrics", "lyricscom", "lyricsmode", "azlyrics")


def track_url(site: str, artist: Column, title: Column) -> Column:
    """Address of ``title`` by ``artist`` on ``site``."""
    if site == "metrolyrics" or site == "lyricscom":
        host = {"metrolyrics": "www.metrolyrics.com", "lyricscom": "www.lyrics.com"}[site]
        return F.concat(F.lit(f"http://{host}/"), slug_dash(title), F.lit("-lyrics-"),
                        slug_dash(artist), F.lit(".html"))
    if site == "lyricsmode":
        artist_slug = slug_underscore(artist)
        return F.concat(F.lit("http://www.lyricsmode.com/lyrics/"),
                        F.concat_ws("/", shard_letter(artist_slug), artist_slug, slug_underscore(title)),
                        F.lit(".html"))
    if site == "azlyrics":
        return F.concat(F.lit("http://www.azlyrics.com/lyrics/"),
                        F.concat_ws("/", slug_compact(artist), slug_compact(title)), F.lit(".html"))
    raise ValueError(f"unknown site {site!r}, expected one of {SITES}")


def track_urls(artist: Column, title: Column) -> Column:
    """``array<struct<site, url>>`` with one entry per site."""
    return F.array(*[
        F.struct(F.lit(site).alias("site"), track_url(site, artist, title).alias("url"))
        for site in SITES
    ])
