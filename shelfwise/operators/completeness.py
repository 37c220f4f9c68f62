"""What is owned against what is expected: ranges, statuses and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.staging import spread


def compacted(numbers: DataFrame, group: list[str], number: str, name: str = "ranges") -> DataFrame:
    """A group's distinct numbers as "1-3, 5, 7-9": numbers less their rank are equal inside a run."""
    distinct = numbers.select(*group, number).distinct()
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(number))
    runs = distinct.withColumn("_run", F.col(number) - rank).groupBy(*group, "_run").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("text")))), lambda x: x["text"])
    return runs.groupBy(*group).agg(F.array_join(listed, ", ").alias(name))


def lacking(wanted: DataFrame, owned: DataFrame, group: list[str], number: str, source: DataFrame) -> DataFrame:
    """(group, number): what is wanted and not owned. Both are dealt once, by the group alone, into partitions for the files of
    `source`; all that goes by the group afterwards finds its rows there."""
    both = wanted.select(*group, number, F.lit(False).alias("held")).unionByName(owned.select(*group, number, F.lit(True).alias("held")))
    return spread(both, *group, source=source).groupBy(*group, number).agg(F.bool_or("held").alias("held")).where("not held").select(*group, number)


def season_status(expected: Column, owned: Column) -> Column:
    """Of two arrays of episode numbers (null: no such season)."""
    missing, extra = F.size(F.array_except(expected, owned)), F.size(F.array_except(owned, expected))
    return (
        F.when(expected.isNull(), "unexpected")
        .when(owned.isNull(), "missing")
        .when(missing > 0, "incomplete")
        .when(extra > 0, "extra")
        .otherwise("complete")
    )


def ladder(have: Column, expected: Column) -> Column:
    """A show's place by its share of what is expected."""
    share = F.try_divide(have, expected)
    return (
        F.when(F.coalesce(expected, F.lit(0)) == 0, "no_expected")
        .when(F.coalesce(have, F.lit(0)) == 0, "missing")
        .when(share >= 1, "complete")
        .when(share >= 0.9, "near_complete")
        .when(share >= 0.1, "partial")
        .otherwise("barely_started")
    )


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `old` whose key `new` still has, untouched, and those of `new` that are not there yet."""
    kept = old.join(new.select(*key).distinct(), key, "left_semi").withColumn("origin", F.lit("kept"))
    added = new.join(old.select(*key).distinct(), key, "left_anti").withColumn("origin", F.lit("added"))
    return kept.unionByName(added)


def with_edits(rows: DataFrame, edits: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`rows` with what a user wrote before in `columns`, where that isn't blank."""
    renamed = edits.select(*key, *[F.col(c).alias(f"_was_{c}") for c in columns])
    joined = rows.join(renamed, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.trim(F.col(f"_was_{c}").cast("string")), F.lit("")), F.col(c).cast("string"))).drop(f"_was_{c}")
    return joined


def episodes_on_disk(files: DataFrame) -> DataFrame:
    """(series, season, episodes, videos) of video files (series, season_folder, name): the distinct episodes that names in season
    folders give each season, a name with several all of them, in either order; and the number of videos in the season's folders,
    null where no folder is of it. Names decide where they differ from their folder; "Specials" is season 0."""
    folder = F.when(F.col("season_folder").rlike(r"(?i)^Specials\s*$"), 0).otherwise(F.regexp_extract("season_folder", r"(?i)^Season\s*([0-9]{1,3})(?:\s*\([0-9]{4}\))?\s*$", 1).try_cast("int"))
    inside = files.withColumn("in_folder", folder).where("in_folder is not null")
    pattern = r"(?i)S([0-9]{1,3})E([0-9]{1,4})(?:[-eE]+([0-9]{1,4}))?"
    first, last = F.regexp_extract("name", pattern, 2).try_cast("int"), F.regexp_extract("name", pattern, 3).try_cast("int")
    named = inside.select("series", F.regexp_extract("name", pattern, 1).try_cast("int").alias("season"), first.alias("a"), F.coalesce(last, first).alias("b")).where("season is not null")
    each = named.select("series", "season", F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b"))).alias("episode")).distinct()
    found = each.groupBy("series", "season").agg(F.count("*").alias("episodes"))
    videos = inside.groupBy("series", F.col("in_folder").alias("season")).agg(F.count("*").alias("videos"))
    return found.join(videos, ["series", "season"], "full_outer").select("series", "season", F.coalesce("episodes", F.lit(0).cast("long")).alias("episodes"), "videos")


def show_summaries(seasons: DataFrame, capped: bool = True) -> DataFrame:
    """A row for each show of seasons (show, season, expected, have; null: not there): seasons and episodes expected and owned of regular
    seasons, the percentage, specials (season 0) apart, and lists of missing, incomplete and unexpected seasons.

    `capped` counts no more of a season than is expected and leaves out what nobody expects; without it all that is owned of
    seasons that are known counts, so a show may have more than a hundred per cent. Incomplete seasons read S02(3/8)."""
    expected, have = F.coalesce("expected", F.lit(0)), F.coalesce("have", F.lit(0))
    regular, known = F.col("season") > 0, F.col("expected").isNotNull()
    wanted = regular & (expected > 0)
    counted = F.when(wanted, F.least(have, expected)) if capped else F.when(regular & known, have)
    listed = lambda rule, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(rule, F.struct("season", text.alias("text"))))), lambda x: x["text"]), ", ")
    number = F.col("season").cast("string")
    part = F.concat(F.lit("S"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit("("), have.cast("string"), F.lit("/"), expected.cast("string"), F.lit(")"))
    sums = seasons.groupBy("show").agg(
        F.count_if(wanted).alias("seasons_expected"),
        F.count_if(regular & (have > 0) if capped else regular & known & (have > 0)).alias("seasons_have"),
        F.sum(F.when(regular, expected).otherwise(0)).cast("long").alias("episodes_expected"),
        F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias("episodes_have"),
        F.sum(F.when(F.col("season") == 0, expected).otherwise(0)).cast("long").alias("specials_expected"),
        F.sum(F.when(F.col("season") == 0, have).otherwise(0)).cast("long").alias("specials_have"),
        listed(wanted & (have == 0), number).alias("missing"),
        listed(wanted & (have > 0) & (have < expected), part).alias("incomplete"),
        listed(~known & (have > 0) & (regular if capped else F.lit(True)), number).alias("unexpected"),
    )
    share = F.round(F.coalesce(F.try_divide(100.0 * F.col("episodes_have"), F.col("episodes_expected")), F.lit(0.0)), 1)
    return sums.withColumn("percent", share)
