"""Nested records against plain Python over the same JSON and XML."""

import json
import random
import re
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from shelfwise.functions import records


def a_film(rng, k):
    maybe = lambda x: x if rng.random() < 0.7 else None
    name = lambda: rng.choice(["Ann <B> & C", "Zoë", "", "D"])
    entry = lambda: {"iso_3166_1": rng.choice(["US", "US", "DE"]), "release_dates": maybe([{"certification": rng.choice(["", " ", "PG", " R "])} for _ in range(rng.randint(0, 3))])}
    return {
        "id": k,
        "title": f"T{k}",
        "original_title": maybe(f"O & {k}"),
        "overview": maybe("a > b"),
        "tagline": maybe(""),
        "release_date": maybe(f"19{k % 90 + 10}-01-02"),
        "vote_average": maybe(rng.choice([0.0, 7.25, 8.0])),
        "vote_count": maybe(rng.choice([0, 12])),
        "belongs_to_collection": maybe({"id": 1, "name": rng.choice(["Big Collection", "Small", "THE COLLECTION"]), "overview": maybe("about")}),
        "genres": maybe([{"id": g, "name": f"G{g}"} for g in range(rng.randint(0, 3))]),
        "production_companies": maybe([{"name": name()}]),
        "production_countries": maybe([{"name": "X"}]),
        "credits": maybe({"cast": maybe([{"name": name(), "character": name(), "order": maybe(c)} for c in range(rng.randint(0, 13))]), "crew": maybe([{"name": name(), "job": rng.choice(["Director", "Editor"])} for _ in range(3)])}),
        "release_dates": maybe({"results": [entry() for _ in range(rng.randint(0, 3))]}),
    }


def certified(film, first_only):
    for e in (film["release_dates"] or {}).get("results", []):
        if e["iso_3166_1"] == "US":
            for r in e["release_dates"] or []:
                if r["certification"].strip():
                    return r["certification"].strip()
            if first_only:
                return None
    return None


def plain_nfo(film, runtime):
    movie = ET.Element("movie")

    def add(tag, text, to=movie, always=False):
        if always or text not in (None, ""):
            ET.SubElement(to, tag).text = None if text is None else str(text)

    add("title", film["title"])
    add("year", 1999)
    add("runtime", runtime or None)
    add("tmdbid", film["id"])
    add("imdbid", "tt1" if film["id"] % 2 else None)
    add("id", "tt1" if film["id"] % 2 else None)
    held = film["belongs_to_collection"] or {}
    if held:
        coll = ET.SubElement(movie, "set")
        add("name", held["name"], coll)
        add("overview", held["overview"], coll)
    for tag, field in (("originaltitle", "original_title"), ("plot", "overview"), ("tagline", "tagline"), ("premiered", "release_date")):
        add(tag, film[field])
    for tag, field in (("genre", "genres"), ("studio", "production_companies"), ("country", "production_countries")):
        for x in film[field] or []:
            add(tag, x["name"], always=True)
    add("rating", f"{film['vote_average']:.1f}" if film["vote_average"] else None)
    add("votes", film["vote_count"] or None)
    add("mpaa", certified(film, False))
    credits = film["credits"] or {}
    for c in (credits.get("cast") or [])[:10]:
        actor = ET.SubElement(movie, "actor")
        add("name", c["name"], actor, True)
        add("role", c["character"], actor, True)
        add("order", c["order"], actor)
    for c in credits.get("crew") or []:
        if c["job"] == "Director":
            add("director", c["name"])
    ET.indent(movie, space="  ")
    return '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + ET.tostring(movie, encoding="unicode")


def test_film_records(spark):
    rng = random.Random(3)
    films = [a_film(rng, k) for k in range(1, 120)]
    df = spark.createDataFrame([(f["id"], json.dumps(f), f["id"] % 3 * 50) for f in films] + [(0, "{}", None)], "id int, body string, runtime int")
    f = F.col("f")
    out = df.withColumn("f", F.from_json("body", records.FILM)).select(
        "id",
        records.certification(f).alias("any"),
        records.certification(f, all_entries=False).alias("first"),
        F.get(records.directors(f), F.lit(0)).alias("director"),
        records.genres(f).alias("genres"),
        records.collection(f).alias("collection"),
        records.nfo_file(f["title"], F.lit(1999), f["id"], F.when(f["id"] % 2 == 1, "tt1"), F.col("runtime"), f["belongs_to_collection"]["name"], f).alias("nfo"),
    )
    got = {r.id: r for r in out.collect()}
    assert got[0].nfo.endswith("<movie>\n  <year>1999</year>\n</movie>") and got[0].any is None
    for film in films:
        r = got[film["id"]]
        assert (r.any, r.first) == (certified(film, False), certified(film, True))
        crew = [c["name"] for c in (film["credits"] or {}).get("crew") or [] if c["job"] == "Director"]
        assert r.director == (crew[0] if crew else None)
        assert r.genres == (", ".join(g["name"] for g in film["genres"] or []) or None)
        assert r.collection == (re.sub("(?i) collection$", "", film["belongs_to_collection"]["name"]) if film["belongs_to_collection"] else None)
        assert r.nfo == plain_nfo(film, film["id"] % 3 * 50)


def test_series_records(spark):
    series = [{"seasons": [{"season_number": 1, "air_date": None}, {"season_number": 1, "air_date": "2001-05-05"}, {"season_number": 2, "air_date": "20"}]}, {}, {"seasons": None}]
    df = spark.createDataFrame([(json.dumps(s),) for s in series], "body string").withColumn("s", F.from_json("body", records.SERIES))
    assert [tuple(r) for r in df.select(records.season_year(F.col("s"), 1), records.season_year(F.col("s"), 2)).collect()] == [(2001, None), (None, None), (None, None)]
    seasons = [{"season_number": 1, "episodes": [{"episode_number": 1, "name": "A"}, {"episode_number": "2", "name": ""}, {"episode_number": "x", "name": "B"}, {"episode_number": 1, "name": "C"}]}, {"season_number": None, "episodes": [{"episode_number": 1, "name": "D"}]}, {"season_number": 0, "episodes": None}, {"season_number": 2, "episodes": [{"episode_number": 7, "name": "E"}]}]
    df = spark.createDataFrame([(json.dumps(seasons),), ("[]",)], "body string").withColumn("s", F.from_json("body", f"array<struct<{records.SEASON.replace(' array', ':array').replace(' string', ':string')}>>"))
    got = [{(k.season, k.episode): v for k, v in r[0].items()} for r in df.select(records.episode_titles(F.col("s"))).collect()]
    assert got == [{(1, 1): "C", (2, 7): "E"}, {}]


def test_metadata_files(spark):
    files = {
        "<movie><title> A </title><year>In 1999.</year><imdbid>x</imdbid><id>tt1234567</id><tmdbid>no 42</tmdbid><runtime>90 min</runtime></movie>": (None, 42, "A", 1999, 90),
        "<movie><imdb_id>see tt1234567</imdb_id><uniqueid type='IMDB'>tt7654321</uniqueid><uniqueid type='tmdb'>77</uniqueid><tmdbid>1</tmdbid></movie>": ("tt7654321", 77, None, None, None),
        "<movie><title></title><originaltitle>B &amp; C</originaltitle><imdbid/><id>tt12345678901</id></movie>": ("tt1234567890", None, "B & C", None, None),
        "<movie><uniqueid type='imdb'>tt1111111</uniqueid><uniqueid type='imdb'>none</uniqueid><uniqueid type='imdb'>tt2222222</uniqueid></movie>": ("tt2222222", None, None, None, None),
        "plain tt7777777 and https://www.themoviedb.org/movie/55-x": ("tt7777777", 55, None, None, None),
        "<movie><title>broken tt8888888": ("tt8888888", None, None, None, None),
        "": (None, None, None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in files] + [(None,)], "t string")
    got = [r[0] and tuple(r[0]) for r in df.select(records.nfo(F.col("t"))).collect()]
    assert got == [*files.values(), None]
