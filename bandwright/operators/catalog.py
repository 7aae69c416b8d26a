"""Catalog lookups, display texts, search and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTIST, ALBUM, TITLE, ALL = 1, 2, 4, 7
NO_ARTIST, NO_ALBUM = "Various", "Single"


def padded(track: Column) -> Column:
    return F.when(track < 10, F.concat(F.lit("0"), track.cast("string"))).otherwise(track.cast("string"))


def display_title() -> Column:
    """Without a title the path; with artist and album "NN - title"; else the title."""
    plain = F.coalesce(F.col("title"), F.lit("")) == ""
    both = (F.coalesce(F.col("artist"), F.lit("")) != "") & (F.coalesce(F.col("album"), F.lit("")) != "")
    return F.when(plain, F.col("fname")).when(both, F.concat(padded(F.col("track")), F.lit(" - "), F.col("title"))).otherwise(F.col("title"))


def stripped(shown: Column) -> Column:
    return F.regexp_replace(shown, r"^\d\d - ", "")


def now_playing(title: Column, artist: Column, album: Column) -> Column:
    """title by artist (album), without the parts that are missing."""
    by = F.when(F.coalesce(artist, F.lit("")) != "", F.concat(F.lit(" by "), artist)).otherwise("")
    of = F.when(F.coalesce(album, F.lit("")) != "", F.concat(F.lit(" ("), album, F.lit(")"))).otherwise("")
    return F.concat(title, by, of)


def shown(catalog: DataFrame) -> DataFrame:
    """(track_id, title, artist, album) as displayed."""
    return catalog.select("track_id", display_title().alias("title"), F.coalesce(F.nullif("artist", F.lit("")), F.lit(NO_ARTIST)).alias("artist"), F.coalesce(F.nullif("album", F.lit("")), F.lit(NO_ALBUM)).alias("album"))


def search(catalog: DataFrame, query: str, fields: int = ALL) -> DataFrame:
    """Displayed rows, lower-cased, of which a chosen field contains query in any case; an empty query finds all."""
    rows = shown(catalog).select("track_id", *(F.lower(c).alias(c) for c in ("title", "artist", "album")))
    hits = [F.col(c).contains(query.lower()) for c, bit in (("artist", ARTIST), ("album", ALBUM), ("title", TITLE)) if fields & bit]
    if not query:
        return rows
    found = F.lit(False)
    for h in hits:
        found = found | h
    return rows.where(found)


def browse(catalog: DataFrame) -> DataFrame:
    """(artist, album, n, titles): the tree's leaves joined in order of their text."""
    titles = F.array_join(F.array_sort(F.collect_list("title")), "|")
    return shown(catalog).groupBy("artist", "album").agg(F.count("*").alias("n"), titles.alias("titles"))


def by_path(catalog: DataFrame, path: str) -> DataFrame:
    return catalog.where(F.col("fname") == path).orderBy("track_id").limit(1)


def by_id(catalog: DataFrame, track_id: int, *fields: str) -> DataFrame:
    return catalog.where(F.col("track_id") == track_id).select(*fields)


def lookup(catalog: DataFrame, names: list[str], key: str = "title", strict: bool = False) -> DataFrame:
    """(pos, name, track_id) in the list's order: the first row of each name; track_id is null where there is none, or an error if strict."""
    spark = catalog.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("pos", "name"))
    first = catalog.join(F.broadcast(wanted.select("name").distinct()), F.col(key) == F.col("name"), "left_semi").groupBy(F.col(key).alias("name")).agg(F.min("track_id").alias("track_id"))
    out = wanted.join(first, "name", "left").select("pos", "name", "track_id")
    if strict and (missing := [r[0] for r in out.where("track_id is null").select("name").collect()]):
        raise LookupError(f"not in the catalog: {', '.join(missing)}")
    return out
