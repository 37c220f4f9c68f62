"""Paths, ids in names, and file roles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by role.
EXTENSIONS = {
    "video": ("mkv", "mp4", "avi", "m4v", "mov", "wmv", "mpg", "mpeg", "ts", "m2ts", "flv", "webm", "iso", "vob", "divx", "ogm", "rmvb", "3gp"),
    "subtitle": ("srt", "sub", "idx", "ass", "ssa", "vtt", "sup"),
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tbn"),
    "nfo": ("nfo", "xml"),
}
#: Words that mark extras.
EXTRA_WORDS = ("deleted", "behind", "featurette", "interview", "trailer", "outtake", "making", "extra", "bonus", "commentary", "scene", "bloopers", "gag")


def found(column: Column, pattern: str, group: int = 1) -> Column:
    """The group of a pattern's first match, null if there is none."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def normal(path: Column) -> Column:
    """Forward slashes, lower case, no slash at the end."""
    return F.rtrim(F.lower(F.translate(path, "\\", "/")), F.lit("/"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def stem(name: Column) -> Column:
    """A file's name without folders and extension, of either system's paths."""
    return F.regexp_replace(F.substring_index(F.translate(name, "\\", "/"), "/", -1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """An array of a path's folders, the nearest first, each as (depth, folder); equi-joins with it replace prefix joins."""
    parts = F.split(path, "/")
    n = F.size(parts)
    depth = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(depth, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder")))


def role(name: Column, exact: bool = False) -> Column:
    """video, subtitle, nfo, fanart, poster, banner, image or other. With `exact`, a stem that is just the word decides
    before one that holds it."""
    ext, low = extension(name), F.lower(stem(name))
    image = ext.isin(*EXTENSIONS["image"])
    words = ("fanart", "poster", "banner") if exact else ("fanart", "poster")
    out = F.when(ext.isin(*EXTENSIONS["video"]), "video").when(ext.isin(*EXTENSIONS["subtitle"]), "subtitle").when(ext.isin(*EXTENSIONS["nfo"]), "nfo")
    if exact:
        for w in words:
            out = out.when(image & (low == w), w)
    for w in words:
        out = out.when(image & low.contains(w), w)
    return out.when(image, "image").otherwise("other")


def looks_like_extra(path: Column) -> Column:
    """Any of the words in the stem or any folder above."""
    return F.regexp_replace(F.lower(path), r"\.[^./]*$", "").rlike("|".join(EXTRA_WORDS))


def ids_in_name(name: Column) -> Column:
    """(imdb_id, tmdb_id, year) from tags like {imdb-tt0000001}, {tmdb-5} and (1999)."""
    return F.struct(
        found(F.lower(name), r"\{imdb-(tt[0-9]{6,})\}").alias("imdb_id"),
        found(F.lower(name), r"\{tmdb-([0-9]+)\}").try_cast("bigint").alias("tmdb_id"),
        found(name, r"\(((?:19|20)[0-9]{2})\)").try_cast("int").alias("year"),
    )


def nfo_ids(text: Column) -> Column:
    """(imdb_id, tmdb_id, title, year) out of a metadata file by patterns alone, so that broken markup is no matter."""
    return F.struct(
        found(text, r"(tt[0-9]{6,})").alias("imdb_id"),
        found(text, r"(?is)<tmdbid>\s*([0-9]+)\s*</tmdbid>").try_cast("bigint").alias("tmdb_id"),
        F.trim(found(text, r"(?is)<title[^>]*>(.*?)</title>")).alias("title"),
        found(text, r"(?is)<year>\s*([0-9]{4})\s*</year>").try_cast("int").alias("year"),
    )
