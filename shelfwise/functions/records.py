"""Nested records: the film service's JSON and metadata files in XML, read by schemas and rules for their lists; metadata files out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.names import let

#: What is read of a film's record, and of a series'; other fields are left alone, absent ones are null.
FILM = """id bigint, title string, original_title string, overview string, tagline string, release_date string, runtime int, vote_average double, vote_count bigint,
  belongs_to_collection struct<id:bigint,name:string,overview:string>, genres array<struct<id:bigint,name:string>>, production_companies array<struct<name:string>>, production_countries array<struct<name:string>>,
  external_ids struct<imdb_id:string>, credits struct<cast:array<struct<name:string,character:string,order:int>>,crew:array<struct<name:string,job:string>>>,
  release_dates struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<certification:string>>>>>"""
SERIES = "seasons array<struct<season_number:int,air_date:string>>"
SEASON = "season_number string, episodes array<struct<episode_number:string,name:string>>"
_TAGS = ("imdbid", "imdb_id", "imdbnumber", "id", "tmdbid", "tmdb_id", "title", "originaltitle", "year", "runtime")
NFO = ", ".join(f"{t} array<string>" for t in _TAGS) + ", uniqueid array<struct<_type:string,_VALUE:string>>, _broken string"
#: Actors that a metadata file names, at most.
CAST = 10


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _first(values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.get(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))


def certification(film: Column, all_entries: bool = True, country: str = "US") -> Column:
    """The first certificate that is not empty among a country's releases: of all its entries, or of the first one alone."""
    entries = F.filter(film["release_dates"]["results"], lambda e: e["iso_3166_1"] == country)
    entries = entries if all_entries else F.slice(entries, 1, 1)
    return _first(F.flatten(F.transform(entries, lambda e: F.transform(F.coalesce(e["release_dates"], _none("struct<certification:string>")), lambda r: F.trim(r["certification"])))))


def directors(film: Column) -> Column:
    return F.transform(F.filter(film["credits"]["crew"], lambda c: c["job"] == "Director"), lambda c: F.coalesce(c["name"], F.lit("")))


def genres(film: Column) -> Column:
    """Names joined by ", "; null without any."""
    return F.nullif(F.array_join(F.transform(film["genres"], lambda g: F.coalesce(g["name"], F.lit(""))), ", "), F.lit(""))


def collection(film: Column) -> Column:
    """The collection's name without " Collection" at its end."""
    return F.trim(F.regexp_replace(film["belongs_to_collection"]["name"], r"(?i) collection$", ""))


def season_year(series: Column, number: Column | int) -> Column:
    """The year of the first air date that has one among entries of that season."""
    dates = F.transform(F.filter(series["seasons"], lambda s: s["season_number"] == number), lambda s: F.regexp_extract(s["air_date"], "^([0-9]{4})", 1))
    return _first(dates).try_cast("int")


def episode_titles(seasons: Column) -> Column:
    """(season, episode) -> title of an array of season records: entries with whole numbers and a title, the last of equal keys."""
    none = _none("struct<season:int,episode:int,title:string>")
    one = lambda s, e: F.struct(s["season_number"].try_cast("int").alias("season"), e["episode_number"].try_cast("int").alias("episode"), e["name"].alias("title"))
    each = F.flatten(F.transform(seasons, lambda s: F.coalesce(F.transform(s["episodes"], lambda e: one(s, e)), none)))
    good = F.filter(each, lambda x: x["season"].isNotNull() & x["episode"].isNotNull() & (F.coalesce(x["title"], F.lit("")) != ""))
    last = let(good, lambda g: F.filter(g, lambda x, k: ~F.exists(F.slice(g, k + 2, F.size(g) + 1), lambda y: (y["season"] == x["season"]) & (y["episode"] == x["episode"]))))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(F.struct(x["season"].alias("season"), x["episode"].alias("episode")), x["title"])))


def nfo(text: Column) -> Column:
    """(imdb_id, tmdb_id, title, year, runtime) of a metadata file. XML is read by its tags: the first of imdbid, imdb_id, imdbnumber
    and id that says something, which a uniqueid of type imdb overrules; a uniqueid of type tmdb before tmdbid and
    tmdb_id. Tags count where they stand directly in the root. What is no XML is searched for an IMDb id and an address."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "rowTag": "movie", "ignoreSurroundingSpaces": "true"}

    def said(x: Column, *tags: str) -> Column:
        return _first(F.flatten(F.array(*(F.transform(F.coalesce(x[t], _none("string")), lambda v: F.trim(v)) for t in tags))))

    def unique(x: Column, kind: str, pattern: str) -> Column:
        values = F.transform(F.filter(x["uniqueid"], lambda u: F.lower(u["_type"]) == kind), lambda u: F.regexp_extract(u["_VALUE"], pattern, 1) if pattern else F.regexp_replace(u["_VALUE"], "[^0-9]", ""))
        return _first(F.reverse(values))

    def read(x: Column) -> Column:
        broken = x["_broken"].isNotNull() | x.isNull()
        imdb = F.coalesce(unique(x, "imdb", r"(tt[0-9]{7,10})"), F.nullif(F.regexp_extract(said(x, "imdbid", "imdb_id", "imdbnumber", "id"), r"(tt[0-9]{7,10})", 1), F.lit("")))
        tmdb = F.coalesce(unique(x, "tmdb", ""), F.nullif(F.regexp_replace(said(x, "tmdbid", "tmdb_id"), "[^0-9]", ""), F.lit("")))
        return F.struct(
            F.when(broken, F.nullif(F.regexp_extract(text, r"(tt[0-9]{7,10})", 1), F.lit(""))).otherwise(imdb).alias("imdb_id"),
            F.when(broken, F.nullif(F.regexp_extract(text, r"themoviedb\.org/movie/([0-9]+)", 1), F.lit(""))).otherwise(tmdb).try_cast("bigint").alias("tmdb_id"),
            F.when(~broken, said(x, "title", "originaltitle")).alias("title"),
            F.when(~broken, F.regexp_extract(said(x, "year"), "([0-9]{4})", 1)).try_cast("int").alias("year"),
            F.when(~broken, F.regexp_extract(said(x, "runtime"), "([0-9]+)", 1)).try_cast("int").alias("runtime"),
        )

    return F.when(text.isNotNull(), let(F.from_xml(text, NFO, options), read))


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(tag: str, text: Column, indent: int = 1) -> Column:
    """A line with an element; one without text is closed at once."""
    pad = "  " * indent
    return F.when(F.coalesce(text, F.lit("")) == "", f"{pad}<{tag} />\n").otherwise(F.concat(F.lit(f"{pad}<{tag}>"), _xml(text), F.lit(f"</{tag}>\n")))


def _given(tag: str, text: Column, indent: int = 1) -> Column:
    """The same, nothing without text."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(_element(tag, text, indent))


def _each(values: Column, line) -> Column:
    return F.coalesce(F.array_join(F.transform(values, line), ""), F.lit(""))


def nfo_file(title: Column, year: Column, tmdb_id: Column, imdb_id: Column, runtime: Column, collection_name: Column, film: Column | None = None) -> Column:
    """A metadata file for a film: what identifies it, and with `film` (FILM) what else the service knows, ten actors at most."""
    number = lambda c: c.cast("string")
    about = F.lit("") if film is None else _given("overview", film["belongs_to_collection"]["overview"], 2)
    parts = [
        _given("title", title),
        _given("year", number(year)),
        F.when(runtime != 0, _given("runtime", number(runtime))).otherwise(""),
        _given("tmdbid", number(tmdb_id)),
        _given("imdbid", imdb_id),
        _given("id", imdb_id),
        F.when(F.coalesce(collection_name, F.lit("")) == "", "").otherwise(F.concat(F.lit("  <set>\n"), _element("name", collection_name, 2), F.coalesce(about, F.lit("")), F.lit("  </set>\n"))),
    ]
    if film is not None:
        actor = lambda a: F.concat(F.lit("  <actor>\n"), _element("name", a["name"], 2), _element("role", a["character"], 2), _given("order", number(a["order"]), 2), F.lit("  </actor>\n"))
        named = lambda tag: lambda x: _element(tag, x["name"])
        parts += [
            _given("originaltitle", film["original_title"]),
            _given("plot", film["overview"]),
            _given("tagline", film["tagline"]),
            _given("premiered", film["release_date"]),
            _each(film["genres"], named("genre")),
            _each(film["production_companies"], named("studio")),
            _each(film["production_countries"], named("country")),
            F.when(film["vote_average"] != 0, _given("rating", F.bround(film["vote_average"].cast("decimal(10,4)"), 1).cast("string"))).otherwise(""),
            F.when(film["vote_count"] != 0, _given("votes", number(film["vote_count"]))).otherwise(""),
            _given("mpaa", certification(film)),
            _each(F.slice(film["credits"]["cast"], 1, CAST), actor),
            _each(F.filter(directors(film), lambda d: d != ""), lambda d: _element("director", d)),
        ]
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<movie>\n'), *(F.coalesce(p, F.lit("")) for p in parts), F.lit("</movie>"))
