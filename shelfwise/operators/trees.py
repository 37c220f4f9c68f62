"""Joins and rollups over folder trees: every path meets its ancestors by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import paths
from shelfwise.operators.staging import shuffled


def with_ancestors(files: DataFrame, path: str) -> DataFrame:
    return files.withColumn("_a", F.explode(paths.ancestors(F.col(path)))).select("*", "_a.depth", "_a.folder").drop("_a")


def subtree_totals(files: DataFrame, path: str, size: str) -> DataFrame:
    """For each folder, the files and bytes in and under it, and those directly in it."""
    up = with_ancestors(files, path)
    direct = F.col("folder") == paths.parent(F.col(path))
    return up.groupBy("folder").agg(F.count("*").alias("files"), F.sum(size).alias("total"), F.count_if(direct).alias("direct_files"))


def nearest(files: DataFrame, folders: DataFrame, path: str, max_hops: int = 8) -> DataFrame:
    """Each file with its nearest ancestor among `folders` (folder), at most `max_hops` up; files without one are left
    out."""
    hops = F.size(F.split(path, "/")) - F.col("depth")
    up = with_ancestors(files, path).where(hops <= max_hops)
    return up.join(folders.select("folder").distinct(), "folder").groupBy(*files.columns).agg(F.max_by("folder", "depth").alias("nearest"))


def files_of_titles(titles: DataFrame, files: DataFrame, folder: str, path: str) -> DataFrame:
    """Titles (folder may be a file's own path) with the files in or under them; a title that is itself a file has the
    files next to it whose names start with its stem. Starts meet as equal strings: each name is cut at all its lengths, so
    titles and files of one folder make no pairs but those that are a result."""
    under = titles.join(shuffled(with_ancestors(files, path)), F.lower(folder) == F.lower("folder")).drop("depth", "folder")
    flat = titles.where(F.lower(F.col(folder)).rlike(r"\.(?:mkv|mp4|avi|html)$"))
    flat = flat.withColumns({"_parent": F.lower(paths.parent(F.col(folder))), "_cut": F.lower(paths.stem(F.col(folder)))})
    side = files.withColumns({"_parent": F.lower(paths.parent(F.col(path))), "_stem": F.lower(paths.stem(F.col(path)))})
    cuts = F.transform(F.sequence(F.lit(0), F.length("_stem")), lambda n: F.substring("_stem", 1, n))
    near = flat.join(shuffled(side.withColumn("_cut", F.explode(cuts)).drop("_stem")), ["_parent", "_cut"])
    return under.unionByName(near.select(under.columns)).distinct()


def leaves(files: DataFrame, path: str) -> DataFrame:
    """(folder): the folders of files that hold no folder with files."""
    folders = files.select(paths.parent(F.col(path)).alias("folder")).distinct()
    above = folders.select(F.explode(paths.ancestors(F.col("folder"))["folder"]).alias("folder")).distinct()
    return folders.join(above, "folder", "left_anti")


def name_key(name: Column) -> Column:
    """A folder's or show's name without tags, signs, case and a leading article."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), r"[{(][^)}]*[)}]", " "), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(out, "^ *the ", ""))


def folder_of_each(shows: DataFrame, folders: DataFrame, key: str, name: str, tmdb: str, folder: str, order: str) -> DataFrame:
    """(key, folder, tier): a folder for each show that has one: by the id in its name (1), by the plain name (2), by one plain
    name beginning the other (3); in a tier, the name whose length is nearest. Beginnings meet as equal strings: each
    name is cut at all its lengths, so that no pairs are tried; and shows and folders of one plain name whose own names are as long
    are one class, of whose folders only the first by `order` can be taken, so that neither do the members of two classes meet."""
    s = shows.select(key, F.col(name).alias("_show"), F.col(tmdb).alias("_tmdb"), name_key(F.col(name)).alias("_key"))
    f = folders.select(F.col(folder).alias("_folder"), F.col(order).alias("_order"), F.nullif(F.regexp_extract(folder, r"\{tmdb-([0-9]+)\}", 1), F.lit("")).alias("_tmdb"), name_key(F.col(folder)).alias("_key"))
    cut = lambda t: t.withColumn("_cut", F.explode(F.transform(F.sequence(F.lit(1), F.length("_key")), lambda n: F.substring("_key", 1, n)))).where("_key <> ''")
    shown = s.where("_key <> ''").select("_key", F.length("_show").alias("_n")).distinct()
    held = f.withColumn("_m", F.length("_folder"))
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min(F.struct("_order", "_folder")).alias("o")).select(*by, "o.*")
    keyed = first(held.where("_key <> ''"), "_key", "_m")
    found = lambda pairs, tier, *by: pairs.groupBy(*by).agg(F.min(F.struct(F.lit(tier).alias("tier"), F.abs(F.col("_m") - F.col("_n")).alias("_apart"), "_order", "_folder")).alias("b"))
    by_id = found(s.withColumn("_n", F.length("_show")).join(first(held.where("_tmdb is not null"), "_tmdb", "_m"), "_tmdb"), 1, key)
    classes = ["_key", "_n"]
    by_name = found(shown.join(keyed, "_key"), 2, *classes)
    longer = found(cut(shown).join(keyed.withColumnRenamed("_key", "_cut"), "_cut"), 3, *classes)
    shorter = found(shown.join(first(cut(keyed), "_cut", "_m").withColumnRenamed("_cut", "_key"), "_key"), 3, *classes)
    by_class = by_name.unionByName(longer).unionByName(shorter).groupBy(*classes).agg(F.min("b").alias("b"))
    every = by_id.unionByName(s.withColumn("_n", F.length("_show")).join(by_class, classes).select(key, "b"))
    return every.groupBy(key).agg(F.min("b").alias("b")).select(key, F.col("b._folder").alias("folder"), "b.tier")
