"""What stands against carrying a plan out, and what went wrong across titles: rows of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import names, paths

#: Room that a drive has to have beyond what moves there, the length from which a path needs a prefix, and words
#: that say nothing of a series.
SPARE, LONG_PATH = 1.05, 240
MERGE_STOP_WORDS = ("the", "a", "an", "of", "and", "to", "in", "for", "on", "at", "show", "series", "complete", "collection", "volume", "vol", "disc", "dvd", "dvdrip", "pack", "xvid", "x264", "x265", "rip", "bluray", "hdtv", "pdtv", "axxo")


def _issues(df: DataFrame, code: str, severity: str, path: Column | None = None, title: str | None = "title_id") -> DataFrame:
    return df.select((F.col(title) if title else F.lit(None)).cast("long").alias("title_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(None) if path is None else path).cast("string").alias("path"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", ".")


def _final(plan: DataFrame) -> Column:
    """The path of a title's main video when the plan is carried out."""
    ext = paths.extension(F.coalesce("main_video_path", F.lit("")))
    stem = names.sanitized(F.concat(F.coalesce("matched_title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(") {imdb-"), F.coalesce("imdb_id", F.lit("")), F.lit("}")), "plan")
    return F.concat("target_folder", F.lit("/"), stem, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def _drive(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"^([A-Za-z]:)", 1))


def _under(path: Column, root: str) -> Column:
    return F.concat(paths.normal(path), F.lit("/")).startswith(root.rstrip("/").lower() + "/")


def _second_of(rows: DataFrame, key: Column) -> DataFrame:
    """Rows whose key an earlier title has."""
    keyed = rows.withColumn("key", F.lower(key))
    first = keyed.groupBy("key").agg(F.min("title_id").alias("first"))
    return keyed.join(first, "key").where("title_id > first")


def films(plan: DataFrame, inventory: DataFrame, duplicates: DataFrame, disk: DataFrame, drives: DataFrame, root: str, duplicates_writable: bool = True) -> DataFrame:
    """(title_id, severity, code, path) of what stands against a plan of films; errors would stop it.

    plan: title_id, action, executed_at, target_folder, tmdb_id, imdb_id, matched_title, year, duplicate_role, main_video_path.
    inventory: title_id, path, size_bytes. duplicates: keeper, losers. disk: path, size (null where it can't be told). drives: drive,
    free (null where it can't be told). Only pending rows to be done by themselves are looked at, but for the roles of duplicates, which
    have to agree with the plan. A missing field is a row for each of the three; titles that are duplicates collide with nothing."""
    auto = plan.where((F.upper("action") == "AUTO") & (F.coalesce("executed_at", F.lit("")) == ""))
    placed = auto.where(~_blank("target_folder"))
    roles = plan.select(F.col("title_id").alias("known"), F.coalesce("duplicate_role", F.lit("")).alias("role"))
    keepers = duplicates.join(roles, F.col("keeper") == F.col("known"), "left")
    losers = keepers.where("known is not null").select("keeper", F.explode("losers").alias("loser")).join(roles.withColumnsRenamed({"known": "loser_known", "role": "loser_role"}), F.col("loser") == F.col("loser_known"), "left")
    files = inventory.join(auto.select("title_id", "target_folder"), "title_id")
    found = files.join(disk.select("path", F.col("size").alias("now"), F.lit(True).alias("there")), "path", "left")
    across = files.where(~_blank("target_folder") & (_drive(F.col("path")) != _drive(F.col("target_folder"))))
    needs = across.where(_drive(F.col("target_folder")) != "").groupBy(_drive(F.col("target_folder")).alias("drive")).agg(F.sum("size_bytes").alias("need")).join(drives, "drive", "left")
    own = placed.where(~F.coalesce("duplicate_role", F.lit("")).startswith("duplicate_of:"))
    parts = [
        _issues(keepers.where("known is null"), "dup_keeper_not_in_plan", "warning", title="keeper"),
        _issues(keepers.where("known is not null and role not in ('', 'keeper')"), "dup_role_mismatch", "warning", title="keeper"),
        _issues(losers.where("loser_known is null"), "dup_loser_not_in_plan", "warning", title="loser"),
        _issues(losers.where(F.col("loser_role") != F.concat(F.lit("duplicate_of:"), F.col("keeper").cast("string"))), "dup_role_mismatch", "warning", title="loser"),
        *(_issues(auto.where(_blank(c)), "missing_field", "error", F.lit(c)) for c in ("target_folder", "tmdb_id", "matched_title")),
        _issues(placed.where(~_under(F.col("target_folder"), root)), "target_outside_root", "error", F.col("target_folder")),
        _issues(auto.join(inventory.select("title_id").distinct(), "title_id", "left_anti"), "no_inventory_files", "error"),
        _issues(found.where("there is null"), "source_missing", "error", F.col("path")),
        _issues(found.where("now is not null and coalesce(size_bytes, 0) <> 0 and now <> size_bytes"), "size_drift", "error", F.col("path")),
        _issues(found.where("there and now is null"), "stat_failed", "error", F.col("path")),
        _issues(_second_of(own, _final(own)), "duplicate_target", "error", F.col("key")),
        _issues(across.agg(F.sum("size_bytes").alias("need")).where("need > 0"), "cross_drive_volume", "warning", F.col("need").cast("string"), None),
        _issues(needs.where(F.col("free") < F.col("need") * SPARE), "insufficient_space", "error", F.col("drive"), None),
        _issues(needs.where("free is null"), "disk_usage_check_failed", "warning", F.col("drive"), None),
        _issues(placed.where(~_blank("matched_title") & (F.length(_final(placed)) > LONG_PATH)), "long_path", "warning", _final(placed)),
    ]
    if not duplicates_writable:
        parts.append(_issues(plan.sparkSession.range(1), "duplicates_dir_unwritable", "error", title=None))
    return _all(parts)


def shares_a_word(source: Column, series: Column) -> Column:
    """Whether the source folder's name shares a telling word with the series; one without any passes."""

    def words(text: Column) -> Column:
        bare = F.regexp_replace(text, r"\([0-9]{4}(?:-[0-9]{4})?\)|\{[^}]*\}", "")
        return F.filter(F.split(F.lower(F.regexp_replace(bare, "[^a-zA-Z0-9]+", " ")), " "), lambda w: (F.length(w) > 3) & ~w.isin(*MERGE_STOP_WORDS))

    leaf = F.substring_index(F.rtrim(F.translate(source, "\\", "/"), F.lit("/")), "/", -1)
    said = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(series, F.lit("")) != "")
    return ~said | (F.size(words(leaf)) == 0) | F.arrays_overlap(words(leaf), words(series))


def series(plan: DataFrame, disk: DataFrame, root: str) -> DataFrame:
    """(title_id, severity, code, path) of what stands against a plan of series (series_id, action, executed_at, source_folder,
    target_folder, tmdb_series_id, matched_series). `disk`: path of the folders that are there. Rows of one target are a merge if all
    have the same id of the film service, else a conflict, one row without a title; a merge takes only folders that share a
    telling word with the series."""
    auto = plan.where((F.upper("action") == "AUTO") & (F.coalesce("executed_at", F.lit("")) == "")).withColumn("title_id", F.col("series_id"))
    placed = auto.where(~_blank("target_folder")).withColumn("target", F.lower(F.translate("target_folder", "\\", "/")))
    sized = placed.groupBy("target").agg(F.count("*").alias("n"), F.min("tmdb_series_id").alias("low"), F.max("tmdb_series_id").alias("high"), F.count("tmdb_series_id").alias("named"))
    agree = (F.col("low") == F.col("high")) & (F.col("named") == F.col("n"))
    merged = placed.join(sized.where((F.col("n") > 1) & agree).select("target"), "target")
    there = disk.select(paths.normal(F.col("path")).alias("there")).distinct()
    source = auto.where(~_blank("source_folder")).withColumn("there", paths.normal(F.col("source_folder")))
    return _all(
        [
            _issues(auto.where(_blank("tmdb_series_id")), "missing_tmdb_id", "error", F.col("source_folder")),
            _issues(auto.where(_blank("matched_series")), "missing_matched_series", "error", F.col("source_folder")),
            _issues(auto.where(_blank("target_folder")), "missing_target_folder", "error", F.col("source_folder")),
            _issues(placed.where(~F.col("target").startswith(root.rstrip("/").lower())), "target_outside_tv_root", "error", F.col("source_folder")),
            _issues(source.join(there, "there", "left_anti"), "source_missing", "error", F.col("source_folder")),
            _issues(sized.where((F.col("n") > 1) & ~F.coalesce(agree, F.lit(False))), "duplicate_target", "error", F.col("target"), None),
            _issues(merged.where(~shares_a_word(F.col("source_folder"), F.col("matched_series"))), "merge_source_mismatch", "error", F.col("source_folder")),
        ]
    )


def losers(titles: DataFrame, inventory: DataFrame, disk: DataFrame, root: str, aside: str) -> DataFrame:
    """(title_id, severity, code, path) of titles (title_id) that lost to a duplicate: their main video (inventory: title_id, path,
    size_bytes, role) should lie under `aside` as it lay under `root`, by its name alone if it lay elsewhere."""
    main = inventory.where("role = 'main_video'").groupBy("title_id").agg(F.min(F.struct("path", "size_bytes")).alias("m")).select("title_id", "m.*")
    inside = F.when(_under(F.col("path"), root), F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))).otherwise(F.substring_index("path", "/", -1))
    rows = titles.select("title_id").join(main, "title_id", "left").withColumn("expected", F.concat(F.lit(aside.rstrip("/") + "/"), inside))
    now = disk.select(F.col("path").alias("at"), F.col("size").alias("now"), F.lit(True).alias("there"))
    moved = rows.join(now, F.col("expected") == F.col("at"), "left").drop("at")
    still = moved.where("path is not null and there is null").drop("there", "now").join(now.withColumnRenamed("there", "still"), F.col("path") == F.col("at"), "left")
    return _all(
        [
            _issues(rows.where("path is null"), "dup_loser_no_inventory", "warn"),
            _issues(moved.where("there and coalesce(size_bytes, 0) <> 0 and now <> size_bytes"), "dup_loser_size_drift", "warn", F.col("expected")),
            _issues(still.where("still"), "dup_loser_still_at_source", "info", F.col("path")),
            _issues(still.where("still is null"), "dup_loser_missing", "error", F.col("expected")),
        ]
    )


def library(plan: DataFrame, folders: DataFrame) -> DataFrame:
    """(title_id, severity, code, path) across a library after a run: titles that resolve to one path, ids that several folders (path)
    bear, and folders of an id that no finished title of the plan has (as information). Folders below one with an id do not count, nor
    do those more than four deep."""
    done = plan.where((F.upper("action") == "AUTO") & (F.coalesce("executed_at", F.lit("")) != ""))
    own = done.where(~_blank("target_folder") & ~F.coalesce("duplicate_role", F.lit("")).startswith("duplicate_of:"))
    imdb = lambda c: paths.found(F.lower(c), r"\{imdb-(tt[0-9]{7,10})\}")
    above = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: imdb(p).isNotNull())
    tagged = folders.where((F.size(F.split("path", "/")) <= 5) & ~above).withColumn("imdb", imdb(F.substring_index("path", "/", -1))).where("imdb is not null")
    many = tagged.groupBy("imdb").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), " | ").alias("path")).where("n > 1")  # a film's folders
    planned = done.select(F.lower("imdb_id").alias("imdb")).where("imdb <> ''").distinct()
    return _all(
        [
            _issues(_second_of(own, _final(own)), "duplicate_target", "error", F.col("key")),
            _issues(many, "duplicate_imdb_id", "error", F.col("path"), None),
            _issues(tagged.join(planned, "imdb", "left_anti"), "imdb_folder_not_in_plan", "info", F.col("path"), None),
        ]
    )
