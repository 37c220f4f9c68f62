"""Journals: latest targets, rollback plans, decisions about moves, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import names, paths
from shelfwise.operators.ordering import running


def latest(journal: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key."""
    return journal.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def rollback(journal: DataFrame) -> DataFrame:
    """The inverse of each step that succeeded, to be done newest first (place). Markers have none and are left out."""
    op = F.col("op")
    inverse = (
        F.when(op.isin("rename", "move", "dup_move"), "move_back")
        .when(op == "copy", "restore_and_delete")
        .when(op == "mkdir", "rmdir_if_empty")
        .when(op == "rmdir", "mkdir")
        .when(op == "write_file", "delete")
        .when(op == "backup", "restore")
        .when(op.isin("verify", "run_start", "run_end", "delete"), None)
        .otherwise("unknown")
    )
    return journal.where("result = 'ok'").withColumn("inverse", inverse).where("inverse is not null")


def selected(journal: DataFrame, run: str | None = None, title: int | None = None, since: str | None = None) -> DataFrame:
    """The lines (line, ts, run_id, title_id, ...) of a run, of a title in the latest run that has it, or from a time on: exactly
    one of the three is given. Lines without a time are in no `since`."""
    if (run is not None) + (title is not None) + (since is not None) != 1:
        raise ValueError("one of run, title and since is needed")
    if run is not None:
        return journal.where(F.col("run_id") == run)
    if since is not None:
        return journal.where(F.col("ts") >= F.to_timestamp(F.lit(since)))
    return latest_runs(journal.where(F.col("title_id") == title))


def latest_runs(journal: DataFrame) -> DataFrame:
    """Each title's lines of the run that its last line is of."""
    last = journal.groupBy(F.col("title_id").alias("__title")).agg(F.max_by("run_id", "line").alias("__run"))
    same = F.col("title_id").eqNullSafe(F.col("__title")) & F.col("run_id").eqNullSafe(F.col("__run"))
    return journal.join(last, same).drop("__title", "__run")


def rollback_steps(journal: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(place, line, inverse, source, target) of lines (line, ts, op, result, from_, to), for each `group`: what undoes them, in an
    order in which it can be done.

    Folders that were removed come back first, outer ones before inner ones. Then files go back, the newest step first, the later
    line first where times are equal; copies are put back and removed in one step, so a line that deleted the original
    after a copy needs none of its own. Folders that were made go last, inner ones first, if nothing is left in them.
    Lines that did not succeed, markers and checks have no step; unknown operations come as "unknown"."""
    steps = rollback(journal)
    inverse = F.col("inverse")
    phase = F.when(inverse == "mkdir", 0).when(inverse == "rmdir_if_empty", 2).otherwise(1)
    source = F.when(inverse.isin("move_back", "restore_and_delete", "restore", "delete", "rmdir_if_empty"), F.col("to"))
    target = F.when(inverse.isin("move_back", "restore_and_delete", "restore", "mkdir"), F.col("from_"))
    depth = F.size(F.split(F.coalesce("from_", "to"), "/"))
    nested = F.when(phase == 0, depth).when(phase == 2, -depth).otherwise(0)
    rows = steps.select(*group, "line", "inverse", source.alias("source"), target.alias("target"), phase.alias("phase"), nested.alias("nested"), "ts")
    placed = running(rows, [F.col("phase"), F.col("nested"), F.desc("ts"), F.desc("line")], group)
    return placed.select(*group, F.col("place").cast("int").alias("place"), "line", "inverse", "source", "target")


def move_decision(same_path="from_ = to", source="src_size", target="dst_size"):
    """What a move comes to, by the sizes at both ends (null: not there)."""
    s, t = F.col(source), F.col(target)
    return (
        F.when(F.expr(same_path), "already_there")
        .when(s.isNull() & t.isNotNull(), "already_done")
        .when(s.isNull(), "missing")
        .when(t.isNull(), "move")
        .when(s == t, "drop_source")
        .otherwise("conflict")
    )


def across_runs(source="src_size", target="dst_size", source_hash="src_hash", target_hash="dst_hash"):
    """Which file stays if an earlier run left one at the target: equal content keeps the target, else the larger stays,
    the source on ties."""
    s, t = F.col(source), F.col(target)
    return F.when(t.isNull() | ((s == t) & (s > 0)), "no_conflict").when(F.col(source_hash) == F.col(target_hash), "use_target").when(s >= t, "use_source").otherwise("use_target")


def patched(manifest: DataFrame, moves: DataFrame, dropped: DataFrame, path: str) -> DataFrame:
    """A manifest after a run: dropped paths gone, moved ones under their new names."""
    left = manifest.join(dropped.select(F.col(path).alias("_d")), F.col(path) == F.col("_d"), "left_anti")
    renamed = left.join(moves.select(F.col("from_").alias("_f"), F.col("to").alias("_t")), F.col(path) == F.col("_f"), "left")
    return renamed.withColumn(path, F.coalesce("_t", path)).drop("_f", "_t")


#: What image names add to a video's stem.
DECORATIONS = ("-thumb", "-poster", "-fanart", "-banner", "-landscape", "-clearart", "-clearlogo", "-logo")
SIDECARS = ("nfo", "xml", "srt", "sub", "idx", "ass", "ssa", "vtt", "sup", "smi", "jpg", "jpeg", "png", "tbn", "webp", "gif")


def decoration(stem: Column) -> Column:
    """What a sidecar's stem adds to its video's: the mark of an image, else a language of two or three letters; "" for none."""
    mark = F.regexp_extract(stem, "(?i)(" + "|".join(DECORATIONS) + ")$", 1)
    return F.when(mark != "", mark).otherwise(F.regexp_extract(stem, r"(\.\p{L}{2,3})$", 1))


def swept(journal: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, path, outcome, to) of the sidecars among `files` (source, path) left in source folders: "video_present" where
    their video is still there, "no_match" where no journal says where it went, "already_there" where the new name is
    taken (`existing`: path), else "swept".

    journal: written (when its file was), line, op, result, episode_key, from_, to. Of the successful renames and copies of
    episodes with one stem, whatever its case, the last one says where the video is now."""
    plain = lambda c: F.translate(c, "\\", "/")
    stem = lambda c: F.regexp_replace(F.substring_index(plain(c), "/", -1), r"\.[^.]*$", "")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    done = journal.where(F.col("op").isin("rename", "copy") & (F.col("result") == "ok") & given("episode_key") & given("from_") & given("to"))
    went = done.groupBy(F.lower(stem(F.col("from_"))).alias("base")).agg(F.max_by("to", F.struct("written", "line")).alias("video")).where("base <> ''")
    named = files.select("source", "path", F.substring_index(plain(F.col("path")), "/", -1).alias("name")).withColumn("stem", stem(F.col("name")))
    videos = named.where(paths.extension(F.col("name")).isin(*paths.EXTENSIONS["video"])).select("source", F.lower("stem").alias("base"), F.lit(True).alias("present")).distinct()
    sides = named.where(paths.extension(F.col("name")).isin(*SIDECARS)).withColumn("mark", decoration(F.col("stem")))
    sides = sides.withColumn("base", F.lower(F.substring(F.col("stem"), F.lit(1), F.length("stem") - F.length("mark"))))
    found = sides.join(videos, ["source", "base"], "left").join(went, "base", "left")
    clean = names.swept_name(F.concat(stem(F.col("video")), "mark", F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    found = found.withColumn("to", F.concat(F.regexp_extract(plain(F.col("video")), "^(.*/)[^/]*$", 1), clean))
    found = found.join(existing.select(F.col("path").alias("to"), F.lit(True).alias("taken")).distinct(), "to", "left")
    outcome = F.when(F.col("present"), "video_present").when(F.col("video").isNull(), "no_match").when(F.col("taken"), "already_there").otherwise("swept")
    return found.select("source", "path", outcome.alias("outcome"), F.when(outcome.isin("already_there", "swept"), F.col("to")).alias("to"))
