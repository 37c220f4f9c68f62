"""What carrying a plan out would do, as rows of actions; and what stands against it or went wrong, as rows of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.staging import spread, staged


def actions(titles: DataFrame, files: DataFrame) -> DataFrame:
    """(title_id, stage, op, source, target) of titles (title_id, target, stem) with files (title_id, path, name, ext, role).

    B makes the folder, C moves the main video, D sidecars (their endings after the video's stem stay), E writes the
    metadata file and keeps a backup of one that is there, F moves extras into a folder of their own, G removes source
    folders. Titles without a main video fail in stage A and do nothing else.
    """
    main = files.where("role = 'main_video'").groupBy("title_id").agg(F.min_by(F.struct("path", "ext"), "path").alias("m"))
    ready = titles.join(main.hint("shuffle_hash"), "title_id").select("title_id", "target", "stem", "m.*")
    failed = titles.join(main.select("title_id").hint("shuffle_hash"), "title_id", "left_anti")
    # files stream past the titles of their part, which a task holds, and what is once for a title follows from its folders
    met = ready.select("title_id", "target", "stem").hint("shuffle_hash")
    folders = files.groupBy("title_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.max(F.col("role") == "nfo").alias("old"), F.max(F.col("role") == "extra").alias("extras"))
    folders = staged(folders, "folders")
    once = folders.groupBy("title_id").agg(F.max("old").alias("old"), F.max("extras").alias("extras")).where("old or extras").join(met, "title_id")
    moved = spread(files.where("role in ('sidecar', 'extra')").select("title_id", "path", "name", "role"), "title_id", source=files).join(met, "title_id")
    rows = lambda df, stage, op, source, target: df.select("title_id", F.lit(stage).alias("stage"), F.lit(op).alias("op"), source.alias("source"), target.alias("target"))
    none = F.lit(None).cast("string")
    place = lambda *parts: F.concat(F.col("target"), F.lit("/"), *parts)
    action = lambda stage, op, source, target: F.struct(F.lit(stage).alias("stage"), F.lit(op).alias("op"), source.alias("source"), target.alias("target"))
    nfo = place("stem", F.lit(".nfo"))
    extra_dir = place(F.lit("Extras"))
    each = F.array(action("B", "mkdir", none, F.col("target")), action("C", "move", F.col("path"), place("stem", F.lit("."), "ext")), action("E", "write_file", none, nfo))
    sidecar = F.col("role") == "sidecar"
    ending = F.regexp_extract("name", r"((?:\.[a-z]{2,3})?(?:\.forced)?\.[^.]*)$", 1)
    parts = [
        rows(failed, "A", "fail", none, none),
        ready.select("title_id", F.explode(each).alias("a")).select("title_id", "a.*"),
        moved.select("title_id", F.when(sidecar, "D").otherwise("F").alias("stage"), F.lit("move").alias("op"), F.col("path").alias("source"), F.when(sidecar, place("stem", ending)).otherwise(F.concat(extra_dir, F.lit("/"), F.col("name"))).alias("target")),
        rows(once.where("old").select("title_id", "target", "stem").distinct(), "E", "backup", nfo, F.concat(nfo, F.lit(".bak"))),
        rows(once.where("extras").select("title_id", "target").distinct(), "F", "mkdir", none, extra_dir),
        rows(folders.select("title_id", "folder").join(met.select("title_id").hint("shuffle_hash"), "title_id", "left_semi"), "G", "rmdir", F.col("folder"), none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verified(t: dict[str, Column]) -> Column:
    """The codes of what is wrong with a title that was carried out, each with its severity; checks after one that makes them
    meaningless are left out. `t`: target, target_exists, readable, video (its name, null if none), expected, size, planned_size
    (null: unreadable, 0 or null: unknown), nfo, nfo_tmdb, nfo_imdb, tmdb, imdb, hash, planned_hash, folder, parent."""
    no_target = F.coalesce(t["target"], F.lit("")).isin("", ".")
    gone, unreadable, empty = ~t["target_exists"], ~t["readable"], t["video"].isNull()
    goes_on = ~(no_target | gone | unreadable | empty)
    both = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    has_nfo = goes_on & t["nfo"]
    no_ids = t["nfo_tmdb"].isNull() & t["nfo_imdb"].isNull()
    sized = goes_on & (F.coalesce(t["planned_size"], F.lit(0)) > 0)
    hashed = sized & t["planned_hash"].isNotNull()
    marked = lambda name: F.coalesce(name.contains("{imdb-tt") | name.contains("{tmdb-"), F.lit(False))
    rules = (
        (no_target, "target_folder_missing_field", "error"),
        (~no_target & gone, "target_folder_missing", "error"),
        (~no_target & ~gone & unreadable, "target_folder_unreadable", "error"),
        (~no_target & ~gone & ~unreadable & empty, "video_missing", "error"),
        (goes_on & (t["video"] != t["expected"]), "video_name_mismatch", "warn"),
        (sized & t["size"].isNotNull() & (t["size"] != t["planned_size"]), "size_drift", "error"),
        (sized & t["size"].isNull(), "video_unreadable", "error"),
        (goes_on & ~t["nfo"], "nfo_missing", "warn"),
        (has_nfo & no_ids, "nfo_unparseable", "error"),
        (has_nfo & both(t["nfo_tmdb"], t["tmdb"]), "nfo_tmdb_mismatch", "error"),
        (has_nfo & both(t["nfo_imdb"], t["imdb"]), "nfo_imdb_mismatch", "error"),
        (hashed & both(t["hash"], t["planned_hash"]), "hash_mismatch", "error"),
        (hashed & t["hash"].isNull(), "hash_failed", "warn"),
        (goes_on & ~marked(t["folder"]) & ~marked(t["parent"]), "folder_name_pattern", "warn"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for rule, code, severity in rules]))
