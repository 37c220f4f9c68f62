"""Names that meet: each gets one of its own, as if they came one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ordering import running
from shelfwise.operators.staging import drop, staged

#: The greatest number of a ".recovered" name, and the mark of what a merge would overwrite.
MOST_RECOVERED, MERGED = 49, "_dup_"
#: What a number before the extension looks like when a collision has put it there.
_NUMBER = "(?:[2-9]|[1-9][0-9]+)"


def _split(name: Column) -> tuple[Column, Column]:
    """What stands before the last dot, and the dot with the rest; a name without a dot, or with one in front only, has no rest."""
    plain = ~name.rlike(r"^.+\.[^.]*$")
    return F.when(plain, name).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)), F.when(plain, "").otherwise(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def numbered(name: Column, number: Column) -> Column:
    """x.2.srt of x.srt."""
    base, rest = _split(name)
    return F.concat(base, F.lit("."), number.cast("string"), rest)


def _parent(key: Column) -> Column:
    """The name that `key` may be a numbered form of, null if none: x.srt of x.2.srt, x of x.2."""
    inner = F.concat(F.regexp_extract(key, rf"^(.+)\.{_NUMBER}(\.[^.]*)$", 1), F.regexp_extract(key, rf"^(.+)\.{_NUMBER}(\.[^.]*)$", 2))
    bare = F.regexp_extract(key, rf"^([^.]+|\.[^.]*)\.{_NUMBER}$", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), F.nullif(bare, F.lit("")))


def _number(key: Column) -> Column:
    return F.coalesce(F.regexp_extract(key, rf"\.({_NUMBER})\.[^.]*$", 1).try_cast("long"), F.regexp_extract(key, rf"^(?:[^.]+|\.[^.]*)\.({_NUMBER})$", 1).try_cast("long"))


def _skipping(m: Column, blocked: Column) -> Column:
    """The m-th number from 2 on that is not among the `blocked` ones, which are in order."""
    return F.aggregate(blocked, m + 1, lambda i, b: i + F.when(b <= i, 1).otherwise(0))


def distinct_names(wants: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(folder, place, name, final) of names that files (folder, place, name) want, place being their order in a folder.

    As if file after file took its name: one that an earlier file has, or that is among `taken` (folder, name), becomes x.2.srt,
    x.3.srt and so on, with the first number that is free by then; a later file that wants x.2.srt itself then becomes
    x.2.2.srt. Case does not matter. Names without an extension get the number at their end.

    The numbers that a name gives away go up, past those that a file took by name before; so what a file gets follows from its rank
    among those that want the same and from these few. Numbered names (x.2.srt) come a round after the names they are
    numbered forms of; there are as many rounds as there are numbers in a row in a name. Ranks of a very common name
    are made by ranges, in many tasks. Null names stay null; places of a folder must differ."""
    rows = wants.select("folder", F.col("place").cast("long").alias("place"), "name")
    if taken is not None:
        rows = rows.unionByName(taken.select("folder", F.lit(-1).cast("long").alias("place"), "name").distinct())
    keyed = rows.where("name is not null").withColumn("key", F.lower("name"))
    start = F.struct(F.col("key").alias("key"), F.lit(0).alias("depth"))
    climb = F.aggregate(
        F.sequence(F.lit(1), F.size(F.split("key", r"\."))), start, lambda s, _: F.struct(F.coalesce(_parent(s["key"]), s["key"]).alias("key"), (s["depth"] + F.when(_parent(s["key"]).isNotNull(), 1).otherwise(0)).alias("depth"))
    )
    keyed = staged(keyed.withColumn("depth", climb["depth"]), "wants")
    deepest = keyed.agg(F.max("depth")).first()[0]
    lost, made = None, []
    for depth in range(0 if deepest is None else deepest + 1):
        mine = keyed.where(F.col("depth") == depth).select("folder", "key", "place", "name")
        children = keyed.where(F.col("depth") == depth + 1).groupBy("folder", F.col("key").alias("child")).agg(F.min("place").alias("place"))
        asks = children.select("folder", _parent(F.col("child")).alias("key"), "place", F.lit(None).cast("string").alias("name"), "child", F.lit(0).alias("wants"))
        both = mine.select("*", F.lit(None).cast("string").alias("child"), F.lit(1).alias("wants")).unionByName(asks)
        ranked = running(both, [F.col("place"), F.col("wants"), F.col("child")], ("folder", "key"), F.col("wants"), "rank")
        gave = F.lit(False) if lost is None else F.coalesce("gave", F.lit(False))
        ranked = ranked if lost is None else ranked.join(lost, ["folder", "key"], "left")
        # of those that want a name, all but the first go on, or all if a number given before took it
        ranked = staged(ranked.withColumn("over", F.greatest(F.lit(0), F.col("rank") - F.when(gave, 0).otherwise(1))).select("folder", "key", "place", "name", "child", "over"), "ranked")
        number = F.struct(_number(F.col("child")).alias("i"), F.col("over"), "child")
        held = ranked.where("child is not null").groupBy("folder", "key").agg(F.array_sort(F.collect_list(number)).alias("children"))
        # a child keeps its number if fewer went on before it than there are free numbers up to its own
        empty = F.struct(F.array().cast("array<bigint>").alias("blocked"), F.array().cast("array<string>").alias("lost"))
        keeps = lambda s, c: c["over"] < c["i"] - 1 - F.size(s["blocked"])
        walk = F.aggregate("children", empty, lambda s, c: F.struct(F.when(keeps(s, c), F.concat(s["blocked"], F.array(c["i"]))).otherwise(s["blocked"]).alias("blocked"), F.when(keeps(s, c), s["lost"]).otherwise(F.concat(s["lost"], F.array(c["child"]))).alias("lost")))
        held = staged(held.select("folder", "key", walk.alias("w")).select("folder", "key", "w.*"), "held")
        given = ranked.where("child is null").join(held.select("folder", "key", "blocked"), ["folder", "key"], "left")
        free = _skipping(F.col("over"), F.coalesce("blocked", F.array().cast("array<bigint>")))
        made.append(staged(given.where("place >= 0").select("folder", "place", "name", F.when(F.col("over") > 0, numbered(F.col("name"), free)).otherwise(F.col("name")).alias("final")), "named"))
        drop(ranked)
        lost = held.select("folder", F.explode("lost").alias("key"), F.lit(True).alias("gave"))
    out = wants.where("name is null").select("folder", F.col("place").cast("long").alias("place"), "name", F.col("name").alias("final"))
    for part in made:
        out = out.unionByName(part)
    return out


def recovered_names(restores: DataFrame, existing: DataFrame) -> DataFrame:
    """(place, path, final) of files that go back to where they came from (place, path), in order of place: where the path is
    there already (`existing`: path) or an earlier one took it, x.recovered.srt, then x.recovered2.srt and so on, the first
    that is free; null beyond MOST_RECOVERED."""
    held = existing.select("path").distinct()
    base, rest = _split_path(F.col("path"))
    mark = r"^(.*)\.recovered([2-9]|[1-9][0-9]+)?(\.[^./]*)?$"
    of = F.concat(F.regexp_extract("path", mark, 1), F.regexp_extract("path", mark, 3))
    marked = held.where(F.col("path").rlike(mark)).groupBy(of.alias("path")).agg(F.array_sort(F.collect_set(F.coalesce(F.regexp_extract("path", mark, 2).try_cast("long"), F.lit(1)))).alias("numbers"))
    ranked = running(restores.select(F.col("place").cast("long").alias("place"), "path"), [F.col("place")], ("path",), 1, "rank")
    ranked = ranked.join(held.withColumn("there", F.lit(True)), "path", "left").join(marked, "path", "left")
    over = F.col("rank") - F.when(F.col("there"), 0).otherwise(1)
    n = F.aggregate(F.coalesce("numbers", F.array().cast("array<bigint>")), over, lambda i, b: i + F.when(b <= i, 1).otherwise(0))
    named = F.concat(base, F.lit(".recovered"), F.when(n > 1, n.cast("string")).otherwise(""), rest)
    final = F.when(over < 1, F.col("path")).when(n <= MOST_RECOVERED, named)
    return ranked.select("place", "path", final.alias("final"))


def _split_path(path: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(path, r"[^./]\.?(\.[^./]+)$", 1)
    return F.substring(path, F.lit(1), F.length(path) - F.length(rest)), rest


def merged_names(children: DataFrame, existing: DataFrame) -> DataFrame:
    """(folder, name, final) of children (folder, name) that move into a folder: marked by _dup_ in front where `existing`
    (folder, name) has one of that name."""
    there = existing.select("folder", "name").distinct().withColumn("there", F.lit(True))
    rows = children.select("folder", "name").join(there, ["folder", "name"], "left")
    return rows.select("folder", "name", F.when(F.col("there"), F.concat(F.lit(MERGED), "name")).otherwise(F.col("name")).alias("final"))
