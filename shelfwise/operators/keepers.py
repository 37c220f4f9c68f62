"""Duplicate groups and which copy of each to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharing_size(files: DataFrame, size: str) -> DataFrame:
    """Files whose size some other file has too; only those are worth hashing. Unknown and zero sizes never count.

    The sizes are counted first and joined back, so that a very common size meets partial sums and no window.
    """
    known = files.where(F.col(size) > 0)
    common = known.groupBy(size).agg(F.count("*").alias("_n")).where("_n > 1").select(size)
    return known.join(common, size)


def same_content(files: DataFrame, size: str, content: str) -> DataFrame:
    """Files with their content's hash, where another file has the same size and hash."""
    hashed = sharing_size(files, size).withColumn("hash", F.sha2(content, 256))
    common = hashed.groupBy(size, "hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(common, [size, "hash"])


def best_first(files: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """place: 1 for the copy to keep. The order has to end in something unique, so that ties fall the same way always."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def best(files: DataFrame, group: list[str], order: Column, *fields: str) -> DataFrame:
    """The fields of each group's first row by `order` (ascending), by partial aggregation: for groups of any size."""
    row = F.min_by(F.struct(*fields), order)
    return files.groupBy(*group).agg(row.alias("_row")).select(*group, *[F.col(f"_row.{f}").alias(f) for f in fields])


#: Folder names of genre buckets, and parts of names that speak against a copy.
GENRE_BUCKETS = (
    *("90s", "80s", "70s", "60s", "Oldies", "Country", "Pop", "Rock", "Classical", "Irish", "Gaelic", "Alternative", "Jazz", "Folk", "New Age", "Christmas", "Halloween", "Hip Hop", "Rap", "Blues", "Reggae", "R&B", "Soul", "Indie"),
    *("Electronic", "Dance", "Metal", "Punk", "Latin", "World", "Disco", "Sound Effects", "Video Game Sounds", "WVUM", "Spanish", "Italian", "French", "German", "Japanese", "Korean", "Chinese"),
)
BAD_TOKENS = ("torrent", "www.", "rip-", "compilation", "various", "playlist", "(va)", " va ", "mix-", "mix ", " top ", "top 100", "top 50", " best of ")


def path_score(path: Column, buckets=GENRE_BUCKETS, bad_tokens=BAD_TOKENS) -> Column:
    """Lower is better: 1000 for a genre bucket as the top folder, 200 once for any bad token, 200 for a site's name
    as a folder, 5 for each part of the path and 1 for each 20 characters."""
    low, parts = F.lower(path), F.split(path, r"[\\/]")
    bad = F.exists(F.array(*map(F.lit, bad_tokens)), lambda token: low.contains(token))
    return (F.when(parts[0].isin(*buckets), 1000).otherwise(0) + F.when(bad, 200).otherwise(0) + F.when(low.rlike(r"\.com[\\/]"), 200).otherwise(0) + 5 * F.size(parts) + F.floor(F.length(path) / 20)).cast("int")


def collisions(moves: DataFrame, target: str, source: str) -> DataFrame:
    """Targets that more than one source would go to: how many, and a note with the first three and the number of the
    rest. The three are ranked before they are listed, so a target of very many sources makes no long list."""
    keyed = moves.select(F.lower(target).alias("target_key"), F.col(source).alias("_source"))
    counts = keyed.groupBy("target_key").agg(F.count("*").alias("n")).where("n > 1")
    ranked = keyed.withColumn("_place", F.row_number().over(Window.partitionBy("target_key").orderBy("_source"))).where("_place <= 3")
    first = ranked.groupBy("target_key").agg(F.array_sort(F.collect_list("_source")).alias("some"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" (+"), F.col("n") - 3, F.lit(" more)"))).otherwise("")
    return counts.join(first, "target_key").select("target_key", "n", F.concat(F.concat_ws(", ", "some"), more).alias("note"))


def against_library(suspects: DataFrame, library: DataFrame, size: str, hash_: str, name: str) -> DataFrame:
    """Suspects as duplicate or unique: the library is cut to sizes that suspects have before hashes are compared."""
    pruned = library.join(suspects.select(size).distinct(), size, "left_semi")
    held = pruned.groupBy(F.col(hash_).alias("_h")).agg(F.array_join(F.array_sort(F.collect_list(F.col(name).cast("string"))), " | ").alias("matches"))
    joined = suspects.join(held, F.col(hash_) == F.col("_h"), "left").drop("_h")
    status = F.when(F.col(hash_).isNull(), "hash_failed").when(F.col("matches").isNotNull(), "duplicate").otherwise("unique")
    return joined.withColumn("status", status)


def film_order(root: str) -> list:
    """The order of a film's copies (unresolved, path, height, bitrate, size, confidence, title_id), the one to keep first: resolved, in a
    folder with a year in brackets, not loose in `root`, then the greater height, bitrate, size and confidence, the longer path, and
    the first title."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    number = lambda c: F.desc(F.coalesce(F.col(c), F.lit(0)))
    return [
        F.coalesce("unresolved", F.lit("")) != "",
        ~F.substring_index(folder, "/", -1).rlike(r"\([0-9]{4}\)"),
        folder == root.rstrip("/"),
        *(number(c) for c in ("height", "bitrate", "size", "confidence")),
        F.desc(F.length("path")),
        F.col("title_id"),
    ]


#: Names that say season and episode and no more.
CANONICAL = r"(?i)^S[0-9]{2}E[0-9]{2,3}\.srt$"


def subtitle_order(ranker: str) -> list:
    """The order of copies of a subtitle (path, size, mtime) by "largest", "canonical" or "newest": a name that is nothing but season and
    episode counts first or second, the name decides last."""
    name = F.substring_index("path", "/", -1)
    size, plain = F.desc(F.coalesce("size", F.lit(0))), ~name.rlike(CANONICAL)
    return {"largest": [size, plain, name], "canonical": [plain, size, name], "newest": [F.desc(F.coalesce("mtime", F.lit(0))), plain, name]}[ranker]


def image_order(kind: str, language: str = "en") -> list:
    """The order of a title's images, the best first: by whether they are in `language` or in none, then

    "poster" and "wide" by votes, then the narrower or wider in thousandths (lang, vote, width, height); "logo" by likes (lang, likes);
    "series" by votes, then width, where images of the best class of languages alone count, null being the second (lang, vote,
    width). Missing numbers are 0, a missing height is 1."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    if kind == "logo":
        low = F.lower(F.coalesce("lang", F.lit("")))
        return [F.when(low == language, 0).when(low.isin("", "00"), 1).otherwise(2), F.desc(number("likes"))]
    if kind == "series":
        return [F.when(F.col("lang") == language, 0).when(F.col("lang").isNull(), 1).otherwise(2), F.desc(number("vote")), F.desc(number("width"))]
    known = F.coalesce("lang", F.lit(""))
    rank = F.when(known == language, 0).when(known == "", 1).otherwise(2)
    height = F.when(number("height") == 0, 1).otherwise(F.col("height"))
    aspect = number("width") / F.greatest(height, F.lit(1))
    return [rank, F.desc(number("vote")), ((-aspect if kind == "wide" else aspect) * 1000).cast("int")]
