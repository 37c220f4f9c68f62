"""What becomes of new files: grouped into titles, identified, given a target, held against the batch and the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import names, paths
from shelfwise.operators.staging import shuffled
from shelfwise.plans import scoring

#: The confidence from which a title goes in by itself, and the most that one keeps whose target others want too.
SURE, CONTESTED = 70, 30
FOLDER, ARCHIVE_3D, REPLACED = "Movies", "3D MKV", "duplicates/intake_replaced"


def titles(files: DataFrame) -> DataFrame:
    """(path, name, stem, pixels, bitrate, sidecars, nfo) of files (path, content, pixels, bitrate): each video is a title of its
    own, with the other files of its folder whose names start with its stem, whatever the case. nfo: what the
    metadata file with the smallest path says.

    A sidecar meets videos by the beginnings of its name, so folders of many files make no pairs."""
    named = files.select("*", F.substring_index("path", "/", -1).alias("name")).withColumn("folder", paths.parent(F.col("path")))
    kind = paths.role(F.col("name"))
    videos = named.where(kind == "video").select("path", "name", "folder", paths.stem(F.col("name")).alias("stem"), "pixels", "bitrate")
    others = named.where(kind != "video").select(F.col("path").alias("sidecar"), F.lower("name").alias("low"), kind.alias("kind"), "content", "folder")
    begins = F.transform(F.sequence(F.lit(1), F.length("low")), lambda n: F.substring(F.col("low"), F.lit(1), n))
    met = others.where("low <> ''").withColumn("begin", F.explode(begins)).join(shuffled(videos.select("path", "folder", F.lower("stem").alias("begin"))), ["folder", "begin"])
    content = F.when(F.col("kind") == "nfo", F.struct("sidecar", "content"))
    found = met.groupBy("path").agg(F.sort_array(F.collect_list("sidecar")).alias("sidecars"), F.min(content)["content"].alias("nfo"))
    return videos.join(shuffled(found), "path", "left").withColumn("sidecars", F.coalesce("sidecars", F.array().cast("array<string>")))


def identified(titles: DataFrame, films: DataFrame) -> DataFrame:
    """Titles with edition, format_3d, extra, and of the film (film_id, imdb, title, year, collection, all null without one)
    what `films` says, beside confidence and note.

    The first that is there decides: an IMDb id in the name, another id in the name (neither falls through if no film has
    it), the id of the metadata file, a search for the guessed title with its year, then one without. Of several films the
    one with the smallest id counts; searches meet counts for each title and year."""
    plain = F.regexp_replace("stem", rf"(?i)\{{edition-[^}}]+\}}|\b(?:{'|'.join(v for v, _ in names.VARIANTS)}|{'|'.join(names.FORMATS_3D)}|3D)\b", " ")

    def said(stem: Column) -> Column:
        title = names.guessed_title(F.concat(F.regexp_replace(stem, r"(?i)[\s\-_.]*\bExtras?(?:\s+[0-9]+)?\s*$", ""), F.lit(".mkv")))
        return F.struct(names.extra_label(stem).alias("extra"), title.alias("g"))

    marks = titles.withColumn("ids", paths.ids_in_name(F.col("name"))).withColumn("edition", names.variant(F.col("stem"))).withColumn("format_3d", names.format_3d(F.col("stem")))
    marks = marks.withColumn("said", names.let(F.trim(F.regexp_replace(plain, r"[\s\-]+$", "")), said))
    marks = marks.withColumns({"extra": F.col("said.extra"), "guess": F.nullif(F.lower(F.trim("said.g.title")), F.lit("")), "guess_year": F.col("said.g.year"), "nfo_imdb": paths.nfo_ids(F.col("nfo"))["imdb_id"]})

    one = F.min(F.struct("film_id", "imdb", "title", "year", "collection"))
    by_imdb = films.where("imdb is not null").groupBy("imdb").agg(one.alias("f")).select(F.col("imdb").alias("key"), "f")
    yearly = films.groupBy(F.lower("title").alias("guess"), F.col("year").alias("guess_year")).agg(one.alias("year_film"), F.count("*").alias("year_n"))
    named = films.groupBy(F.lower("title").alias("guess")).agg(one.alias("any_film"), F.count("*").alias("any_n"))
    out = marks.join(shuffled(by_imdb.select(F.col("key").alias("name_imdb"), F.col("f").alias("name_film"))), F.col("ids.imdb_id") == F.col("name_imdb"), "left")
    by_id = films.groupBy("film_id").agg(one.alias("id_film"))
    out = out.join(shuffled(by_id.withColumnRenamed("film_id", "name_tmdb")), F.col("ids.tmdb_id") == F.col("name_tmdb"), "left")
    out = out.join(shuffled(by_imdb.select(F.col("key").alias("nfo_imdb"), F.col("f").alias("nfo_film"))), "nfo_imdb", "left")
    out = out.join(shuffled(yearly), ["guess", "guess_year"], "left").join(shuffled(named), "guess", "left")

    dated = F.col("year_film").isNotNull()
    searched, n = F.coalesce("year_film", "any_film"), F.coalesce("year_n", "any_n")
    sure = scoring.intake_confidence(F.lit(False), F.col("guess_year"), searched["year"], F.lit(True), n)
    steps = (
        (F.col("ids.imdb_id").isNotNull(), F.col("name_film"), "name_imdb"),
        (F.col("ids.tmdb_id").isNotNull(), F.col("id_film"), "name_tmdb"),
        (F.col("nfo_film").isNotNull(), F.col("nfo_film"), "nfo_imdb"),
    )

    def first(values, last):
        case = F.when(steps[0][0], values[0])
        for (rule, _, _), value in list(zip(steps, values, strict=True))[1:]:
            case = case.when(rule, value)
        return case.otherwise(last)

    film = first([f for _, f, _ in steps], searched)
    confidence = first([F.when(f.isNotNull(), 95).otherwise(0) for _, f, _ in steps], F.when(searched.isNull(), 0).otherwise(sure))
    via = F.when(F.col("guess").isNull(), "no_title").when(searched.isNull(), "no_match").when(dated, "search").otherwise("search_without_year")
    note = first([F.when(f.isNotNull(), how).otherwise(F.concat(F.lit(how), F.lit("_unknown"))) for _, f, how in steps], via)
    kept = out.select("path", "name", "stem", "pixels", "bitrate", "sidecars", "edition", "format_3d", "extra", film.alias("film"), confidence.alias("confidence"), note.alias("note"))
    return kept.select("*", "film.*").drop("film")


def targeted(found: DataFrame) -> DataFrame:
    """`found` with folder, target and role: where the video goes. Editions and formats in 3D share the film's folder under
    names of their own; extras go below it; 3D films as .mkv to an archive (role "archive"). Null without a film or year."""
    ext = F.concat(F.lit("."), paths.extension(F.col("name")))
    archive = F.col("extra").isNull() & F.col("format_3d").isNotNull() & (F.lower("name").endswith(".mkv"))
    role = F.when(F.col("extra").isNotNull(), "extra").when(archive, "archive").otherwise("film")
    tag = F.when(F.col("imdb").isNotNull(), F.concat(F.lit("{imdb-"), "imdb", F.lit("}"))).otherwise(F.concat(F.lit("{tmdb-"), F.col("film_id").cast("string"), F.lit("}")))
    dated = F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    edition = F.coalesce(F.concat(F.lit(" {edition-"), "edition", F.lit("}")), F.lit(""))
    file = F.when(F.col("extra").isNotNull(), F.concat(dated, F.lit(" - "), "extra")).otherwise(F.concat(dated, edition, F.lit(" "), tag, F.coalesce(F.concat(F.lit(" - 3D."), "format_3d"), F.lit(""))))
    clean = F.transform(F.array("collection", F.concat(dated, F.lit(" "), tag), file), lambda x: names.sanitized(x, "plan"))

    def placed(parts: Column) -> Column:
        home = F.concat_ws("/", F.lit(FOLDER), parts[0], parts[1])
        folder = F.when(F.col("extra").isNotNull(), F.concat(home, F.lit("/Extras"))).when(archive, ARCHIVE_3D).otherwise(home)
        return F.struct(folder.alias("folder"), F.concat(folder, F.lit("/"), parts[2], ext).alias("target"))

    known = F.col("title").isNotNull() & F.col("year").isNotNull()
    return found.withColumn("role", role).withColumn("at", F.when(known, names.let(clean, placed))).select("*", "at.*").drop("at")


def outcomes(targets: DataFrame, library: DataFrame, force: bool = False, replace_existing: bool = False) -> DataFrame:
    """Titles with wanted, confidence and outcome, against a library (key, path, pixels, bitrate), key being a target in lower case.

    wanted counts the batch's titles of one target; more than one are "collision" and never go in. A target that the library
    holds: a film goes by quality, "replace", "duplicate" (the new one goes to the duplicates) or "undecided" where a
    measure is missing (`replace_existing` makes that "replace"); extras and archived films are "exists". Then there are
    "unresolved" without a film, "review" below SURE (unless `force`), and "install"."""
    keyed = targets.withColumn("key", F.lower("target"))
    wanted = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("wanted"))
    held = library.select("key", F.col("path").alias("held"), F.col("pixels").alias("held_pixels"), F.col("bitrate").alias("held_bitrate"))
    rows = keyed.join(shuffled(wanted), "key", "left").join(shuffled(held), "key", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0).cast("long")))
    quality = scoring.replacement(F.col("held_pixels"), F.col("pixels"), F.col("held_bitrate").cast("double"), F.col("bitrate").cast("double"))
    rows = rows.withColumn("confidence", F.when(F.col("wanted") > 1, F.least("confidence", F.lit(CONTESTED))).otherwise(F.col("confidence")))
    undecided = F.lit("replace" if replace_existing else "undecided")
    outcome = (
        F.when(F.col("target").isNull(), "unresolved")
        .when(F.col("wanted") > 1, "collision")
        .when((F.col("confidence") < SURE) & ~F.lit(force), "review")
        .when(F.col("held").isNull(), "install")
        .when(F.col("role") != "film", "exists")
        .when(quality == "undecided", undecided)
        .when(quality == "keep", "duplicate")
        .otherwise(quality)
    )
    return rows.withColumn("outcome", outcome)


def moves(decided: DataFrame) -> DataFrame:
    """(path, place, op, source, to): what to do for each title that goes somewhere, in order of place. What is replaced is put
    aside first; sidecars keep what follows the video's stem, those of extras and of archived films stay where they are."""
    aside = F.concat(F.lit(f"{REPLACED}/"), F.substring_index("folder", "/", -1), F.lit("/"))
    step = lambda op, source, to: F.struct(F.lit(op).alias("op"), source.alias("source"), to.alias("to"))
    goes_in = F.col("outcome").isin("install", "replace")
    base = F.regexp_replace("target", r"\.[^./]*$", "")
    beside = F.transform("sidecars", lambda s: step("move", s, F.when(F.col("outcome") == "duplicate", F.concat(aside, F.substring_index(s, "/", -1))).otherwise(F.concat(base, F.substring(F.substring_index(s, "/", -1), F.length("stem") + 1, F.lit(1 << 20))))))
    taken = F.when((F.col("role") == "film") | (F.col("outcome") == "duplicate"), beside).otherwise(F.array().cast(_STEPS))
    first = F.when(F.col("outcome") == "replace", F.array(step("set_aside", F.col("target"), F.concat(aside, F.substring_index("target", "/", -1))))).otherwise(F.array().cast(_STEPS))
    folder = F.when(goes_in, F.array(step("mkdir", F.lit(None).cast("string"), F.col("folder")))).otherwise(F.array().cast(_STEPS))
    video = F.array(step("move", F.col("path"), F.when(goes_in, F.col("target")).otherwise(F.concat(aside, F.col("name")))))
    steps = F.concat(first, folder, video, taken)
    some = decided.where(F.col("outcome").isin("install", "replace", "duplicate"))
    return some.select("path", F.posexplode(steps).alias("place", "s")).select("path", (F.col("place") + 1).alias("place"), "s.*")


_STEPS = "array<struct<op:string,source:string,to:string>>"


def planned(files: DataFrame, films: DataFrame, library: DataFrame, **options) -> DataFrame:
    """Files to outcomes: titles, identified, targeted and decided."""
    return outcomes(targeted(identified(titles(files), films)), library, **options)
