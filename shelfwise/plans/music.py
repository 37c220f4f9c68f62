"""Where music goes: each part of the new path with where it was taken from, and what to do with what is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import names
from shelfwise.functions.paths import found

#: Extensions without loss.
LOSSLESS = ("flac", "wav", "aiff", "aif", "alac", "ape", "wv", "tta", "dsf", "dff")


def _present(text: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))


def routed(files: DataFrame) -> DataFrame:
    """files (bucket, path, artist, album, title, track, date, ...) with artist_used, artist_source, album_used, album_source,
    year_used, year_source, track_used, track_source, title_used, title_source, new_path and reasons (for a review).

    Each field is its tag or else the best that path and file name offer, with the place it came from. The bucket decides the
    folders: artists and genres by letter and artist, soundtracks and compilations by album, radio plays and audiobooks by
    name, games by game, effects as they are; anything else is for review.
    """
    segs = F.split("path", "/")
    n = F.size(segs)
    stem = F.regexp_replace(F.element_at(segs, -1), r"\.[^.]*$", "")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    at = lambda k: F.try_element_at(segs, F.lit(k))
    bucket, artist, album = F.col("bucket"), _present(F.col("artist")), _present(F.col("album"))
    genre = bucket == "DISSOLVE"
    by_folder = F.when((bucket == "ARTIST") & (n > 1), at(1)).when(genre & (n > 2), at(2)).when(genre, "_Unknown Artist").when(bucket == "COMPILATION", "Various Artists").otherwise("")
    source = F.when((bucket == "ARTIST") & (n > 1), "depth1_folder").when(genre & (n > 2), "depth2_folder").when(genre | (bucket == "COMPILATION"), "fallback").otherwise("")
    disc = r"(?i)^(?:cd\s*[0-9]+|disc\s*[0-9]+)$"
    folder = F.when(n > 1, at(-2))
    parent, grand = F.when(~folder.rlike(disc), folder), F.when(folder.rlike(disc) & (n > 2), at(-3))
    album_used = F.coalesce(album, parent, grand, F.lit("_Unknown Album"))
    inner = found(album_used, r"^((?:19|20)[0-9]{2})\s*[-_]\s*.+$").try_cast("int")
    year, number = names.year_of(F.col("date")), found(stem, r"^\s*([0-9]{1,3})[\s\-_.]+").try_cast("int")
    tagged = names.track_of(F.col("track"))
    from_name = F.when(number.between(1, 999), names.two(number))
    left = F.trim(F.regexp_replace(stem, r"^\s*[0-9]{1,3}\s*[-_.]\s*", ""))
    out = files.withColumns({
        "artist_used": F.coalesce(artist, by_folder), "artist_source": F.when(artist.isNotNull(), "tag").otherwise(source),
        # an expression that Spark interprets keeps this out of a stage's one method, which is too large to be compiled
        "album_used": names.let(album_used, lambda al: F.coalesce(found(al, r"^(?:19|20)[0-9]{2}\s*[-_]\s*(.+)$"), al)),
        "album_source": F.when(album.isNotNull(), "tag").when(parent.isNotNull(), "parent_folder").when(grand.isNotNull(), "grandparent_folder").otherwise("fallback"),
        "year_used": F.coalesce(year, inner), "year_source": F.when(year.isNotNull(), "tag").when(inner.isNotNull(), "album_folder").otherwise("missing"),
        "track_used": F.coalesce(tagged, from_name), "track_source": F.when(tagged.isNotNull(), "tag").when(from_name.isNotNull(), "filename").otherwise("missing"),
        "title_used": F.coalesce(_present(F.col("title")), F.nullif(left, F.lit("")), F.lit("Unknown Title")),
        "title_source": F.when(_present(F.col("title")).isNotNull(), "tag").when(left != "", "filename").otherwise("fallback"),
    })
    a = F.col("artist_used")
    head = F.when(F.col("track_used").isNotNull(), F.concat(F.col("track_used"), F.lit(" - "))).otherwise("")
    track = F.concat(head, F.when(bucket == "COMPILATION", F.concat(a, F.lit(" - "))).otherwise(""), F.col("title_used"))
    album_folder = F.concat(F.when(F.col("year_used").isNotNull(), F.concat(F.col("year_used").cast("string"), F.lit(" - "))).otherwise(""), F.col("album_used"))
    second = F.when(n > 2, at(2))
    known_artist = F.nullif(a, F.lit(""))
    by = F.when(bucket == "RADIO", F.coalesce(known_artist, second, F.lit("_Unknown"))).when(bucket == "AUDIOBOOK", F.coalesce(known_artist, F.lit("_Unknown Author"))).when(bucket == "VIDEOGAME", F.coalesce(second, F.lit("_Unknown Game"))).otherwise(a)
    middle = F.when(bucket == "SOUNDEFFECTS", F.slice(segs, F.lit(2), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    # cleaned once, in a column of their own: in each branch of the path by itself, a name is cleaned again wherever a step names it
    out = out.withColumn("_safe", names.all_sanitized(F.concat(F.array(track, album_folder, by), middle), "inventory"))
    safe = lambda k: F.col("_safe")[k]
    file, album_folder, by = F.concat(safe(0), ext), safe(1), safe(2)
    join = lambda *parts: F.concat_ws("/", *parts)
    tail = F.slice("_safe", F.lit(4), F.size("_safe"))
    path = (
        F.when(bucket.isin("ARTIST", "DISSOLVE"), join(names.letter(a), by, album_folder, file))
        .when(bucket == "SOUNDTRACK", join(F.lit("Soundtracks"), album_folder, file))
        .when(bucket == "COMPILATION", join(F.lit("Compilations"), album_folder, file))
        .when(bucket == "RADIO", join(F.lit("Radio"), by, album_folder, file))
        .when(bucket == "AUDIOBOOK", join(F.lit("Audiobooks"), by, album_folder, file))
        .when(bucket == "COMEDY", join(F.lit("Comedy"), names.letter(a), by, album_folder, file))
        .when(bucket == "SOUNDEFFECTS", join(F.lit("Sound Effects"), F.array_join(F.array_append(tail, file), "/")))
        .when(bucket == "VIDEOGAME", join(F.lit("Video Game Soundtracks"), by, file))
        .otherwise(join(F.lit("_Review"), F.col("path")))
    )
    out = out.withColumn("new_path", path).drop("_safe")
    needs = ~bucket.isin("SOUNDTRACK", "COMPILATION", "RADIO", "AUDIOBOOK", "SOUNDEFFECTS", "VIDEOGAME")
    known = bucket.isin("ARTIST", "DISSOLVE", "SOUNDTRACK", "COMPILATION", "RADIO", "AUDIOBOOK", "COMEDY", "SOUNDEFFECTS", "VIDEOGAME")
    reasons = F.array_compact(F.array(
        F.when((F.col("artist_source") == "fallback") & genre, "artist_missing_in_genre_bucket"),
        F.when((F.col("artist_used") == "") & needs, "artist_missing"),
        F.when(F.col("album_source") == "fallback", "album_missing"),
        F.when(F.col("title_source") == "fallback", "title_missing"),
        F.when(~known, F.concat(F.lit("unknown_bucket:"), bucket)),
        F.when(F.col("new_path").contains("_Unknown") | F.col("new_path").contains("_Review"), "unknown_destination_segment"),
    ))
    return out.withColumn("reasons", F.array_join(reasons, ";"))


def leftovers(files: DataFrame, new_tree: DataFrame) -> DataFrame:
    """(id, decision, place) of leftover files (id, path, ext, hash, bitrate, tags, artist, title, target) against the new tree
    (hash, path).

    In order: a copy of a file in the new tree; a copy of a better one among the leftovers; no artist or title; a place that
    is taken; to be renamed, or the loser of those that want one place. Better is without loss, then a higher bitrate, more
    tags, a shorter path and the first by letter. Winners of a hash and of a place are found by partial aggregation.
    """
    better = F.struct(~F.col("ext").isin(*LOSSLESS), -F.coalesce("bitrate", F.lit(0)), -F.col("tags"), F.length("path"), F.lower("path"), "id")
    hashed = F.col("hash").isNotNull() & (F.col("hash") != "")
    there = new_tree.where(hashed).select("hash").distinct().withColumn("there", F.lit(True))
    taken = new_tree.select(F.lower("path").alias("key")).distinct().withColumn("taken", F.lit(True))
    winners = files.where(hashed).groupBy("hash").agg(F.min_by("id", better).alias("winner"))
    out = files.withColumn("key", F.lower("target")).join(there, "hash", "left").join(winners, "hash", "left").join(taken, "key", "left")
    decision = (
        F.when(F.col("there"), "HASH_DUPLICATE_OF_NEW")
        .when(F.col("winner") != F.col("id"), "HASH_DUPLICATE_INTERNAL")
        .when(_present(F.col("artist")).isNull() | _present(F.col("title")).isNull(), "NEEDS_REVIEW")
        .when(F.col("taken"), "DESTINATION_COLLISION")
        .otherwise("NEEDS_RENAME")
    )
    out = out.withColumn("decision", decision)
    first = out.where("decision = 'NEEDS_RENAME'").groupBy("key").agg(F.min_by("id", better).alias("first"))
    out = out.join(first, "key", "left")
    last = F.when((F.col("decision") == "NEEDS_RENAME") & (F.col("first") != F.col("id")), "NEEDS_RENAME_LOSER").otherwise(F.col("decision"))
    return out.select("id", last.alias("decision"), F.when(last.isin("NEEDS_RENAME", "NEEDS_RENAME_LOSER"), F.col("target")).alias("place"))


#: Review reasons by what becomes of them: dropped as the folder is trusted, a sign of an artist that is too short, a
#: sign that the old place was right, and dropped if it is the only one.
TRUST_FOLDER, SHORT_ARTIST, KEEP_OLD, ALONE = ("artist_tag_disagrees", "album_tag_disagrees"), ("artist_too_short",), ("album_looks_like_compilation", "album_is_just_a_year", "album_unknown"), ("many_changes",)
#: From so many changes on a row is an improvement; beginnings that are no artists.
MANY_CHANGES, NO_ARTIST = 3, ("the album", "track")


def artist_of_file(path: Column) -> Column:
    """The artist that "Artist - Title" or "01 Artist - Album - Title" names, of two characters or more; null if none does."""
    name = F.substring_index(F.rtrim(F.translate(path, "/", "\\"), F.lit("\\")), "\\", -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"^\s*[0-9]{1,3}[\s\-_.]+", "")
    artist = F.trim(F.substring_index(stem, " - ", 1))
    no_artist = F.lower(artist).rlike("^(?:" + "|".join(NO_ARTIST) + ")")
    return F.when(stem.contains(" - ") & (F.length(artist) >= 2) & ~no_artist, artist)


def _transitions(recover: bool) -> tuple:
    """What becomes of a reason, as rules in order: (when it applies, what it does). A rule sees the reason, how many there are, and
    the state so far; it drops the reason, keeps it, sets the row to keep the old, or puts the file's artist in place."""
    short = lambda r, n, s: r.isin(*SHORT_ARTIST)
    single = lambda s: names.single_letter(s["artist"])
    rules = [(lambda r, n, s: r.isin(*TRUST_FOLDER), "drop")]
    if recover:
        rules.append((lambda r, n, s: short(r, n, s) & single(s) & s["file"].isNotNull(), "recover"))
    return (
        *rules,
        (lambda r, n, s: short(r, n, s) & single(s), "keep_old"),
        (lambda r, n, s: short(r, n, s) & names.plausible_artist(s["artist"]), "drop"),
        (lambda r, n, s: r.isin(*KEEP_OLD), "keep_old"),
        (lambda r, n, s: r.isin(*ALONE) & (n == 1), "drop"),
        (lambda r, n, s: F.lit(True), "keep"),
    )


def reviewed(notes: Column, artist: Column, path: Column, changes: Column, recover: bool = False) -> Column:
    """(classification, notes, artist, artist_source) of a row in review, by folding its reasons ("; " apart, in order) over the
    transitions: REVIEW if a reason is left, KEEP_OLD if one says so or nothing changes, IMPROVEMENT if much does, else
    AUTO_APPLY. A measure behind a reason, _(sim=0.5), does not matter for what becomes of it; `recover` lets the file's name
    give an artist of one letter a better one, which later reasons see. Null notes are none; changes that are no number are 0."""
    reasons = F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), ";"), lambda r: F.trim(r)), lambda r: r != "")

    def state(kept, keep_old, artist, source, file):
        return F.struct(kept.alias("kept"), keep_old.alias("keep_old"), artist.alias("artist"), source.alias("source"), file.alias("file"))

    def folded(all_reasons: Column) -> Column:
        n = F.size(all_reasons)
        start = state(F.array().cast("array<string>"), F.lit(False), artist, F.lit(None).cast("string"), artist_of_file(path))

        def step(s: Column, raw: Column) -> Column:
            plain = F.regexp_replace(raw, r"_\(sim=[0-9.]+\)", "")
            effect = None
            for rule, name in _transitions(recover):
                effect = F.when(rule(plain, n, s), name) if effect is None else effect.when(rule(plain, n, s), name)
            return names.let(effect, lambda e: state(F.when(e == "keep", F.concat(s["kept"], F.array(raw))).otherwise(s["kept"]), s["keep_old"] | (e == "keep_old"), F.when(e == "recover", s["file"]).otherwise(s["artist"]), F.when(e == "recover", "filename_recovered").otherwise(s["source"]), s["file"]))

        return F.aggregate(all_reasons, start, step)

    changed = F.coalesce(F.trim(changes.cast("string")).try_cast("int"), F.lit(0))

    def outcome(s: Column) -> Column:
        kind = F.when(F.size(s["kept"]) > 0, "REVIEW").when(s["keep_old"] | (changed == 0), "KEEP_OLD").when(changed >= MANY_CHANGES, "IMPROVEMENT").otherwise("AUTO_APPLY")
        return F.struct(kind.alias("classification"), F.array_join(s["kept"], ";").alias("notes"), s["artist"].alias("artist"), s["source"].alias("artist_source"))

    return names.let(names.let(reasons, folded), outcome)


def file_hint(path: Column) -> Column:
    """(artist, title, folder) that a music file's path names: "Artist - Title" after a track number, else the title alone; and the
    folder under "Music", else the file's own."""
    plain = F.translate(path, "/", "\\")
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(plain, "\\", -1), r"(?<=.)\.[^.]*$", ""), r"^\s*[0-9]{1,3}[\s\-_.]+", "")
    parts = F.split(plain, r"\\")
    at = F.array_position(parts, "Music").cast("int")
    under = F.when((at > 0) & (at < F.size(parts)), F.get(parts, at)).when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise("")
    split = stem.contains(" - ")
    return F.struct(F.when(split, F.trim(F.substring_index(stem, " - ", 1))).otherwise("").alias("artist"), F.trim(F.when(split, F.regexp_replace(stem, "^.*? - ", "")).otherwise(stem)).alias("title"), under.alias("folder"))


def held_share(a: Column, b: Column) -> Column:
    """If one plain text holds the other, the shorter's share of the longer's length; else 0."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), shorter / longer).otherwise(0.0)


def first_acoustid_class(status: Column, score: Column, title: Column, artist: Column, hint: Column) -> Column:
    """What to do with a fingerprint's match by its score, the better similarity of its title to the file's and of its artist to the
    file's or the folder's, and whether there is any such hint."""
    return (
        F.when(F.trim(F.coalesce(status, F.lit(""))) != "match", F.concat(F.lit("SKIP_"), F.trim(F.coalesce(status, F.lit("")))))
        .when((score >= 0.95) & (title >= 0.7) & (artist >= 0.5), "AUTO_APPLY")
        .when((score >= 0.95) & (title >= 0.6), "AUTO_APPLY_OK")
        .when((score >= 0.95) & ~hint, "REVIEW_NO_HINT")
        .when((score >= 0.9) & ((title >= 0.4) | (artist >= 0.6)), "REVIEW_PARTIAL")
        .when(score >= 0.9, "REVIEW_HIGH")
        .otherwise("REVIEW_LOW")
    )
