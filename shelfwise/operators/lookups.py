"""Answers of a remote service that are kept as a table: keys, what is still to be asked, and collections of films in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.staging import staged

#: The language that a request has if it names none; the statuses whose answers are kept, and the body of a kept refusal.
LANGUAGE, KEPT, REFUSED = "en-US", (200, 404, 401), '{"__status__": %d}'
_FOUND = "movie_results array<struct<id:bigint>>"
_FILM = "belongs_to_collection struct<id:bigint,name:string>"
_PARTS = "parts array<struct<id:bigint,title:string,original_title:string,release_date:string>>"


def _escaped(text: Column) -> Column:
    """As in JSON that is plain ASCII: anything beyond is written by its number, in two halves if it is a large one."""
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    rest = lambda n: n - 0x10000

    def one(c: Column) -> Column:
        n = F.ascii(c)
        named = F.when(c == "\\", "\\\\").when(c == '"', '\\"').when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f")
        pair = F.concat(four(F.shiftright(rest(n), 10) + 0xD800), four(rest(n).bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return named.when((n >= 32) & (n < 128), c).when(n < 0x10000, four(n)).otherwise(pair)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def request_key(path: Column, texts: dict[str, Column] | None = None, numbers: dict[str, Column] | None = None, language: str | None = LANGUAGE) -> Column:
    """path?{"name": value, ...}, names in order; a parameter that is null is not in the key, an access key never is."""
    given = {"language": F.lit(language)} if language else {}
    given |= texts or {}
    parts = {k: F.concat(F.lit(f'"{k}": "'), _escaped(v), F.lit('"')) for k, v in given.items() if k != "api_key"}
    parts |= {k: F.concat(F.lit(f'"{k}": '), v.cast("string")) for k, v in (numbers or {}).items()}
    return F.concat(path, F.lit("?{"), F.concat_ws(", ", *(parts[k] for k in sorted(parts))), F.lit("}"))


def kept(answers: DataFrame) -> DataFrame:
    """(key, body) of answers (key, status, body, asked) that are worth keeping, the last of each key: successes, and refusals
    that would come again, as such. Other errors are not kept, so they are asked again."""
    body = F.when(F.col("status") == 200, F.col("body")).otherwise(F.format_string(REFUSED, F.col("status")))
    some = answers.where(F.col("status").isin(*KEPT)).withColumn("body", body)
    return some.groupBy("key").agg(F.max_by("body", "asked").alias("body"))


def asked(requests: DataFrame, cache: DataFrame, schema: str) -> DataFrame:
    """`requests` (key, ...) with known (the cache has an answer) and answer, by `schema`: null for refusals and broken bodies."""
    held = cache.select(F.col("key").alias("__key"), "body")
    joined = requests.join(held, F.col("key") == F.col("__key"), "left")
    refused = F.get_json_object("body", "$.__status__").isNotNull()
    return joined.withColumn("known", F.col("body").isNotNull()).withColumn("answer", F.when(~refused, F.from_json("body", schema))).drop("body", "__key")


def collections(series: DataFrame, alone: DataFrame, cache: DataFrame, today: str, unreleased: bool = False) -> tuple[DataFrame, DataFrame]:
    """(missing, to_fetch): the parts of collections that a library lacks, and the keys that the cache has no answer for.

    `series` (folder, imdb) opens the collections that its films are in; films that stand `alone` (imdb) count as owned in these
    but open none. Each step asks the cache for what the step before has newly found: ids of films, their collections, the
    parts, the parts' ids. missing: (collection_id, name, folders, film_id, title, imdb, release_date); parts without a date or
    with one after `today` are left out unless `unreleased`. A film id that several collections have counts for the one
    with the greatest id."""
    owned = series.where("imdb is not null").select("folder", F.lower("imdb").alias("imdb")).distinct()
    found = asked(owned.select("imdb").distinct().withColumn("key", request_key(F.concat(F.lit("/find/"), "imdb"), {"external_source": F.lit("imdb_id")})), cache, _FOUND)
    found = staged(found.select("key", "known", "imdb", F.get(F.col("answer.movie_results"), F.lit(0))["id"].alias("film")), "found")
    films = found.where("film is not null").select("film").distinct()
    films = asked(films.withColumn("key", request_key(F.concat(F.lit("/movie/"), F.col("film").cast("string")))), cache, _FILM)
    films = staged(films.select("key", "known", "film", "answer.belongs_to_collection.*"), "films").withColumnsRenamed({"id": "collection"})
    tracked = films.where("collection is not null").groupBy("collection").agg(F.min("name").alias("name"))
    opened = asked(tracked.withColumn("key", request_key(F.concat(F.lit("/collection/"), F.col("collection").cast("string")))), cache, _PARTS)
    opened = staged(opened.select("key", "known", "collection", "name", F.col("answer.parts").alias("parts")), "opened")
    parts = opened.select("collection", "name", F.explode("parts").alias("p")).select("collection", "name", F.col("p.id").alias("film"), F.coalesce(F.nullif("p.title", F.lit("")), F.nullif("p.original_title", F.lit("")), F.lit("")).alias("title"), F.coalesce("p.release_date", F.lit("")).alias("release_date"))
    outside = asked(parts.select("film").distinct().withColumn("key", request_key(F.concat(F.lit("/movie/"), F.col("film").cast("string"), F.lit("/external_ids")))), cache, "imdb_id string")
    outside = staged(outside.select("key", "known", "film", F.nullif(F.lower("answer.imdb_id"), F.lit("")).alias("imdb")), "outside")
    parts = staged(parts.join(outside.select("film", "imdb"), "film", "left"), "parts")

    mine = owned.join(found.where("film is not null").select("imdb", "film"), "imdb").join(films.where("collection is not null").select("film", "collection"), "film")
    folders = mine.groupBy("collection").agg(F.array_join(F.array_sort(F.collect_set("folder")), " | ").alias("folders"))
    names = parts.where("imdb is not null").groupBy("imdb").agg(F.max(F.struct("collection", "film")).alias("t"))
    credited = alone.where("imdb is not null").select(F.lower("imdb").alias("imdb")).distinct().join(names, "imdb").select("t.*")
    have = mine.select("collection", "film").unionByName(credited).distinct()
    lacking = parts.join(have, ["collection", "film"], "left_anti").join(folders, "collection")
    if not unreleased:
        lacking = lacking.where((F.col("release_date") != "") & (F.col("release_date") <= today))
    missing = lacking.select(F.col("collection").alias("collection_id"), "name", "folders", F.col("film").alias("film_id"), "title", "imdb", "release_date")
    open_ = [t.where(~F.col("known")).select("key") for t in (found, films, opened, outside)]
    return missing, open_[0].unionByName(open_[1]).unionByName(open_[2]).unionByName(open_[3])
