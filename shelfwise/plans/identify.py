"""Which film a title is: by ids, then by searches; against catalogues kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identified(titles: DataFrame, films: DataFrame) -> DataFrame:
    """(title_id, film_id, via, flags) of titles (title_id, nfo_imdb, nfo_tmdb, name, year) in films (film_id, imdb, name, year).

    The first that leads to a film counts: the IMDb id of the metadata file, its other id, a search for the name with the
    year, and, if a year brought nothing, one without. A search with a year finds films of that name a year apart at most,
    and takes one of that very year first; of several, the one with the smallest id. Flags tell how sure it was.
    Searches meet counts for each name and year, so a very common name makes no pairs of titles and films.
    """
    by_imdb = films.where("imdb is not null").groupBy(F.col("imdb").alias("nfo_imdb")).agg(F.min("film_id").alias("imdb_film"))
    by_id = films.select(F.col("film_id").alias("nfo_tmdb"), F.col("film_id").alias("tmdb_film")).distinct()
    yearly = films.groupBy("name", F.col("year").alias("near")).agg(F.count("*").alias("n"), F.min("film_id").alias("first"))
    named = films.groupBy("name").agg(F.count("*").alias("all_n"), F.min("film_id").alias("all_first"))
    near = titles.where("year is not null and name is not null").select("title_id", "name", "year", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("near"))
    same = F.col("near") == F.col("year")
    searched = near.join(yearly, ["name", "near"]).groupBy("title_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("year_n"), F.min(F.when(same, F.col("first"))).alias("year_first"))
    out = titles.join(by_imdb, "nfo_imdb", "left").join(by_id, "nfo_tmdb", "left").join(searched, "title_id", "left").join(named, "name", "left")
    dated = F.col("year").isNotNull()
    found = F.coalesce(F.when(dated, F.coalesce("year_first", "first")).otherwise(F.col("all_first")), F.lit(None))
    n = F.when(dated, F.col("n")).otherwise(F.col("all_n"))
    via = (
        F.when(F.col("imdb_film").isNotNull(), "nfo_imdb")
        .when(F.col("tmdb_film").isNotNull(), "nfo_tmdb")
        .when(found.isNotNull(), "search")
        .when(dated & F.col("all_first").isNotNull(), "search_without_year")
        .otherwise("no-tmdb-match")
    )
    out = out.withColumn("via", via)
    searched_flags = (
        F.when(n == 1, "single-tmdb-match")
        .when(dated & (F.col("year_n") == 1), "multi-match-year-disambiguated")
        .when(dated, "multi-match-year-filter-failed")
        .otherwise("multi-match-no-year")
    )
    flags = F.when(F.col("via") == "search", searched_flags).when(F.col("via") == "search_without_year", "year-not-matched").otherwise("")
    film = F.when(F.col("via") == "nfo_imdb", F.col("imdb_film")).when(F.col("via") == "nfo_tmdb", F.col("tmdb_film")).when(F.col("via") == "search", found).when(F.col("via") == "search_without_year", F.col("all_first"))
    return out.select("title_id", film.alias("film_id"), "via", flags.alias("flags"))
