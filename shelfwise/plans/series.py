"""What carrying out a plan of series would do: sources that share a target merge, episodes that meet are settled, and each file
goes to its season with what belongs to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import names, paths
from shelfwise.operators.staging import staged
from shelfwise.plans import journal

#: Files of a series' folder and of a season's that go along, art of seasons beside the series, and extensions of sidecars.
ROOT_FILES = (
    *("tvshow.nfo", "show.nfo", "poster.jpg", "poster.png", "folder.jpg", "folder.png", "fanart.jpg", "fanart.png", "backdrop.jpg"),
    *("banner.jpg", "banner.png", "logo.jpg", "logo.png", "clearart.png", "clearlogo.png", "characterart.png", "thumb.jpg"),
)
SEASON_FILES = ("season.nfo", "poster.jpg", "poster.png", "folder.jpg", "folder.png", "fanart.jpg", "fanart.png", "backdrop.jpg", "banner.jpg", "banner.png", "thumb.jpg", "season-thumb.jpg")
SEASON_ART = r"(?i)^season[0-9]{1,3}-(?:poster|fanart|banner|landscape)\.(?:jpg|jpeg|png|webp)$"
SIDECARS = ("nfo", "xml", "srt", "sub", "idx", "ass", "ssa", "vtt", "sup", "smi", "jpg", "jpeg", "png", "tbn", "webp", "gif")
ASIDE = "duplicates"


def merge_groups(plan: DataFrame) -> DataFrame:
    """`plan` with primary and target: rows of one target folder, whatever its case, that have one id of the film service are one
    group, named by its smallest series_id; rows of a target whose ids differ or are missing are in none (null)."""
    keyed = plan.withColumn("target", F.rtrim(F.translate("target_folder", "\\", "/"), F.lit("/"))).withColumn("key", F.lower("target"))
    sized = keyed.where("key is not null").groupBy("key").agg(F.min("series_id").alias("first"), F.min_by("target", "series_id").alias("first_target"), F.count("*").alias("n"), F.min("tmdb_series_id").alias("low"), F.max("tmdb_series_id").alias("high"), F.count("tmdb_series_id").alias("named"))
    whole = (F.col("n") == 1) | ((F.col("low") == F.col("high")) & (F.col("named") == F.col("n")))
    return keyed.join(sized, "key", "left").withColumn("primary", F.when(whole, F.col("first"))).withColumn("target", F.col("first_target")).drop("key", "first", "first_target", "n", "low", "high", "named")


def settled(episodes: DataFrame) -> DataFrame:
    """`episodes` (primary, merged, series_id, path, size, hash, key) with keeper (the path that stays) and reason (null for it). Of files of
    one episode: if those that are not empty have one hash, the first series' stays, or the first path's inside one source; else the
    largest, on ties by the same order."""
    hashed = F.when((F.col("size") > 0) & (F.col("hash") != ""), F.col("hash"))
    # of files with one hash between them any order of size is left aside
    agreed = episodes.groupBy("primary", "key").agg((F.min(hashed) == F.max(hashed)).alias("same"), F.min(F.struct("series_id", "path")).alias("first"), F.min(F.struct((-F.coalesce("size", F.lit(0))).alias("size"), "series_id", "path")).alias("largest"))
    keeper = F.when(F.coalesce("same", F.lit(False)), F.col("first.path")).otherwise(F.col("largest.path"))
    reason = F.when(F.coalesce("same", F.lit(False)), "duplicate_identical").otherwise(F.concat(F.lit("duplicate_smaller_size="), F.coalesce("size", F.lit(0)).cast("string")))
    out = episodes.join(agreed, ["primary", "key"]).withColumn("keeper", keeper)
    return out.withColumn("reason", F.when(F.col("path") != F.col("keeper"), reason)).drop("same", "first", "largest")


def season_folder(season: Column, year: Column) -> Column:
    return F.when(season == 0, "Specials").otherwise(names.sanitized(F.concat(F.lit("Season "), names.two(season), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("")), F.lit(")")), "plan"))


def episode_file(series: Column, season: Column, episode: Column, last: Column, title: Column, name: Column) -> Column:
    """"Series S01E02 - Title.mkv", or S01E02-E03 for several."""
    key = names.episode_key(season, episode, F.coalesce(last, episode))
    base = names.sanitized(F.concat(names.sanitized(series, "plan"), F.lit(" "), key, F.lit(" - "), F.coalesce(names.sanitized(title, "plan"), F.lit(""))), "plan")
    return F.concat(base, F.regexp_extract(name, r"(\.[^.]*)$", 1))


def actions(plan: DataFrame, files: DataFrame, seasons: DataFrame, titles: DataFrame, present: DataFrame) -> DataFrame:
    """(series_id, stage, op, source, target, reason) of a plan (series_id, source_folder, target_folder, tmdb_series_id, matched_series).

    files: series_id, path, size, hash, season, episode, episode_end (null for what is no episode); seasons: tmdb_series_id, season, year;
    titles: tmdb_series_id, season, episode, title; present: path, size, hash of what is at the targets.

    A: groups without an episode fail, or are done already if their target holds videos. B: of files of one episode one stays, the others
    are put aside. C: seasons that nothing is known of are to be looked up. E: folders of the series and its seasons. F: episodes move;
    where another file is there, an equal or larger one stays and the new one is put aside, else it makes room. G: sidecars beside a
    moved episode. H: files of the series' own folder, and I: of its season folders, where an episode moved. J: source folders that may
    be empty then, inner ones first by place in reason. Rows of targets in conflict do nothing."""
    grouped = merge_groups(plan).where("primary is not null")
    sizes = grouped.groupBy("primary").agg(F.count("*").alias("members"))
    heads = grouped.where("series_id = primary").select("primary", F.col("matched_series").alias("series"), "tmdb_series_id")
    rows = files.join(grouped.select("series_id", "primary", "target", "source_folder"), "series_id").join(heads, "primary").join(sizes, "primary")
    rows = staged(rows.withColumn("name", F.substring_index("path", "/", -1)).withColumn("folder", paths.parent(F.col("path"))), "series-files")
    episodes = rows.where("season is not null and episode is not null").withColumn("key", names.episode_key(F.col("season"), F.col("episode"), F.coalesce("episode_end", "episode")))
    aside = F.concat(F.lit(f"{ASIDE}/"), F.substring_index("target", "/", -1), F.lit("/"))
    put_aside = F.concat(aside, names.sanitized(F.concat(F.lit("sid"), F.col("series_id").cast("string"), F.lit("_"), "key", F.lit("_"), "name"), "plan"))
    chosen = staged(settled(episodes), "episodes")
    kept = chosen.where("reason is null").join(seasons.select("tmdb_series_id", "season", F.col("year").alias("season_year")), ["tmdb_series_id", "season"], "left").join(titles.select("tmdb_series_id", "season", "episode", "title"), ["tmdb_series_id", "season", "episode"], "left")
    kept = kept.withColumn("season_dir", F.concat("target", F.lit("/"), season_folder(F.col("season"), F.col("season_year"))))
    kept = kept.withColumn("to", F.concat("season_dir", F.lit("/"), episode_file(F.col("series"), F.col("season"), F.col("episode"), F.col("episode_end"), F.col("title"), F.col("name"))))
    there = present.select(F.col("path").alias("to"), F.col("size").alias("dst_size"), F.nullif("hash", F.lit("")).alias("dst_hash"))
    met = kept.withColumn("src_hash", F.nullif("hash", F.lit(""))).withColumn("src_size", F.col("size")).join(there, "to", "left").withColumn("verdict", journal.across_runs())
    kept = met = staged(met, "series-moves")
    moved = met.where("verdict <> 'use_target'")

    none = F.lit(None).cast("string")

    def step(df: DataFrame, stage: str, op: str, source: Column, target: Column, reason: Column = none) -> DataFrame:
        return df.select(F.col("series_id").cast("long"), F.lit(stage).alias("stage"), F.lit(op).alias("op"), source.alias("source"), target.alias("target"), reason.cast("string").alias("reason"))

    empty = grouped.join(episodes.select("primary").distinct(), "primary", "left_anti").select("series_id", "target", F.lower("target").alias("key"))
    full = present.where(paths.role(F.col("path")) == "video").select(F.explode(paths.ancestors(F.lower("path"))).alias("a")).select(F.col("a.folder").alias("key")).distinct().withColumn("full", F.lit(True))
    failed = empty.join(full, "key", "left")
    unknown = kept.where("season_year is null").join(seasons.select("tmdb_series_id", "season", F.lit(True).alias("known")), ["tmdb_series_id", "season"], "left").where("known is null")
    beside = rows.where(paths.extension(F.col("name")).isin(*SIDECARS)).select("folder", F.col("path").alias("side"), paths.stem(F.col("name")).alias("side_stem"), F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("side_ext"))
    ends = F.filter(F.sequence(F.lit(1), F.length("side_stem")), lambda n: (n == F.length("side_stem")) | F.substring(F.col("side_stem"), n + 1, F.lit(1)).isin(".", "-", "_"))
    beside = beside.where("side_stem <> ''").withColumn("stem", F.explode(F.transform(ends, lambda n: F.substring(F.col("side_stem"), F.lit(1), n))))
    along = moved.withColumn("stem", paths.stem(F.col("name"))).join(beside, ["folder", "stem"])
    side_to = F.concat(F.regexp_replace("to", r"\.[^./]*$", ""), F.substring(F.col("side_stem"), F.length("stem") + 1, F.lit(1 << 20)), "side_ext")
    gave = moved.select("series_id").distinct()
    own = rows.join(gave, "series_id").where(F.col("folder") == F.rtrim(F.translate("source_folder", "\\", "/"), F.lit("/")))
    rooted = own.where(F.lower("name").isin(*ROOT_FILES) | F.col("name").rlike(SEASON_ART))
    # a season folder's files go where its first episode goes
    seasonal = met.where(F.col("folder") != F.rtrim(F.translate("source_folder", "\\", "/"), F.lit("/"))).groupBy("primary", "folder").agg(F.min_by("season_dir", F.struct("season", "episode", "path")).alias("season_to"))
    inner = rows.where(F.lower("name").isin(*SEASON_FILES)).join(gave, "series_id").join(seasonal, ["primary", "folder"])
    # every folder of a source, itself included
    sources = grouped.select("series_id", F.rtrim(F.translate("source_folder", "\\", "/"), F.lit("/")).alias("source"))
    above = files.select("series_id", F.explode(paths.ancestors(F.col("path"))).alias("a")).select("series_id", F.col("a.folder").alias("folder")).distinct().join(sources, "series_id")
    above = above.where((F.col("folder") == F.col("source")) | F.col("folder").startswith(F.concat("source", F.lit("/"))))
    depth = F.size(F.split("folder", "/"))
    parts = [
        step(failed.where("full"), "A", "done_already", none, F.col("target"), F.lit("source empty, target populated")),
        step(failed.where("full is null"), "A", "fail", none, F.col("target"), F.lit("no parseable episodes")),
        step(chosen.where("reason is not null"), "B", "quarantine", F.col("path"), put_aside, F.col("reason")),
        step(unknown.select(F.col("primary").alias("series_id"), "tmdb_series_id", "season").distinct(), "C", "look_up", none, none, F.concat_ws(" ", "tmdb_series_id", F.lit("season"), "season")),
        step(kept.select(F.col("primary").alias("series_id"), "target").distinct(), "E", "mkdir", none, F.col("target")),
        step(kept.select(F.col("primary").alias("series_id"), "season_dir").distinct(), "E", "mkdir", none, F.col("season_dir")),
        step(met.where("verdict = 'use_target'"), "F", "quarantine", F.col("path"), put_aside, F.when(F.col("src_hash") == F.col("dst_hash"), "cross_run_identical_hash").otherwise(F.concat(F.lit("cross_run_source_smaller_size="), F.coalesce("size", F.lit(0)).cast("string")))),
        step(met.where("verdict = 'use_source'"), "F", "make_room", F.col("to"), F.concat(aside, names.sanitized(F.concat(F.lit("sid"), F.col("series_id").cast("string"), F.lit("_target_"), F.substring_index("to", "/", -1)), "plan")), F.concat(F.lit("cross_run_target_smaller_size="), F.col("dst_size").cast("string"))),
        step(moved, "F", "move", F.col("path"), F.col("to")),
        step(along, "G", "move", F.col("side"), side_to),
        step(rooted, "H", "move", F.col("path"), F.concat("target", F.lit("/"), "name")),
        step(inner, "I", "move", F.col("path"), F.concat("season_to", F.lit("/"), "name")),
        step(above, "J", "rmdir", F.col("folder"), none, F.lpad((1000 - depth).cast("string"), 4, "0")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
