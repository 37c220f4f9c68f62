"""Scores, ladders and rule codes of identification and reorganisation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _points(*rules: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for rule, points in rules:
        out = out + F.when(rule, points).otherwise(0)
    return out


def _first(*rules: tuple[Column, object], otherwise=None) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for rule, value in rules[1:]:
        out = out.when(rule, value)
    return out.otherwise(otherwise)


def movie_confidence(nfo: Column, similarity: Column, exact: Column, year: Column, found_year: Column, runtime: Column, found_runtime: Column, flags: Column, extra: Column) -> Column:
    """0 to 100 for a title's match; unknown parts are null and give nothing. `flags`: how the match came about, as
    the cascade says: single-tmdb-match, multi-match-year-filter-failed, multi-match-no-year, year-not-matched."""
    gap = F.abs(year - found_year)
    off = F.abs(runtime - found_runtime) / F.greatest(F.lit(1), found_runtime)
    close = F.coalesce(off <= 0.05, F.lit(False))
    by_name = _first((similarity >= 0.9, 30), (similarity >= 0.75, 18), (similarity >= 0.6, 5), otherwise=0)
    by_year = _first((gap == 0, 30), (gap == 1, 15), otherwise=0)
    by_length = _first((off <= 0.05, 15), (off <= 0.1, 6), otherwise=0)
    has = lambda flag: F.array_contains(flags, flag)
    ambiguous = _first((exact, 0), (has("multi-match-year-filter-failed"), -15), (has("multi-match-no-year"), -10), otherwise=0)
    more = _points(
        (nfo, 50),
        (exact, 15),
        (exact & close, 15),
        (has("single-tmdb-match"), 5),
        (has("year-not-matched"), -10),
        (year.isNull() & ~nfo & found_year.isNull() & ~(exact & close), -10),
        (extra, -20),
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), by_name + by_year + by_length + ambiguous + more))


def movie_action(confidence: Column, target: Column) -> Column:
    return _first(((confidence >= 75) & (target != ""), "AUTO"), (confidence >= 30, "REVIEW"), otherwise="UNRESOLVED")


def tv_match(similarity: Column, exact: Column, folder_year: Column, year: Column, only: Column) -> Column:
    """50 for the name, 15 if exact, 30, 20 or 10 for the year (10 without one in the folder), 5 if alone; at most 100."""
    gap = F.abs(folder_year - year)
    by_year = _first((folder_year.isNull(), 10), (gap == 0, 30), (gap <= 1, 20), (gap <= 3, 10), otherwise=0)
    return F.least(F.lit(100), F.floor(similarity * 50).cast("int") + by_year + _points((exact, 15), (only, 5)))


def intake_confidence(has_id: Column, year: Column, found_year: Column, exact: Column, n: Column) -> Column:
    """The ladder of a new file: ids, then years, then how many candidates there are."""
    gap = F.abs(year - found_year)
    return _first(
        (has_id, 95),
        (year.isNotNull() & (gap == 0) & (n <= 3), 95),
        (year.isNotNull() & (gap == 0), 85),
        (year.isNotNull() & (gap <= 1) & exact & (n <= 3), 85),
        (year.isNotNull() & (gap <= 1) & exact, 75),
        (year.isNotNull(), 60),
        (n == 1, 80),
        (exact & (n <= 3), 75),
        (exact, 60),
        otherwise=40,
    )


def candidate_score(similarity: Column, year_gap: Column, popularity: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1 - F.coalesce(year_gap, F.lit(5)) / 5)
    return 0.6 * similarity + 0.2 * near + 0.2 * F.least(F.lit(1.0), popularity / 50)


def candidate_verdict(score: Column, votes: Column, margin: Column, n: Column) -> Column:
    """How sure the best of `n` candidates is: HIGH if it is good, known and well ahead of the next, or good and alone."""
    return _first(((score >= 0.85) & (votes > 20) & (margin >= 0.2), "HIGH"), ((n == 1) & (score >= 0.75), "HIGH"), (score >= 0.5, "MEDIUM"), otherwise="NONE")


def replacement(old_pixels: Column, new_pixels: Column, old_rate: Column, new_rate: Column) -> Column:
    """Whether a new copy replaces the old: by pixels, then by bitrate unless within five hundredths."""
    return _first(
        (old_pixels.isNull() | new_pixels.isNull(), "undecided"),
        (new_pixels > old_pixels, "replace"),
        (new_pixels < old_pixels, "keep"),
        ((old_rate > 0) & (F.abs(new_rate - old_rate) / F.nullif(old_rate, F.lit(0.0)) < 0.05), "keep"),
        (new_rate > old_rate, "replace"),
        otherwise="keep",
    )


def episode_replacement(same_path: Column, exists: Column, old: tuple[Column, Column, Column], new: tuple[Column, Column, Column]) -> Column:
    """What becomes of a new copy of an episode: "skip" where it is its own target, "move" where nothing is there, else by height,
    bitrate and size (null: 0), the first that differs: "replace", "discard_new" or "tie"."""
    key = lambda parts: F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(f"k{n}") for n, c in enumerate(parts)))
    return _first((same_path, "skip"), (~exists, "move"), (key(new) > key(old), "replace"), (key(new) < key(old), "discard_new"), otherwise="tie")


def duration_class(minutes: Column) -> Column:
    return _first((minutes < 10, "trivial"), (minutes < 25, "tv_short"), (minutes < 50, "tv_episode"), (minutes < 75, "tv_special"), (minutes < 240, "movie"), otherwise="oversized")


def duration_severity(kind: Column) -> Column:
    return _first((kind.isin("tv_short", "tv_episode"), "flag"), (kind == "movie", "ok"), otherwise="note")


def compilation_suspicion(publisher: Column, theme: Column, pattern: Column, artists: Column) -> Column:
    """0 to 1 that an album filed under an artist is a compilation."""
    parts = F.when(publisher, 0.6).otherwise(0.0) + F.when(theme, 0.4).otherwise(0.0) + F.when(pattern, 0.5).otherwise(0.0) + F.when(artists >= 3, 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), parts)


def tv_suspicion(strong: Column, weak: Column, duration: Column, tv_only: Column) -> Column:
    """Points that a film is an episode: 30 for each name with a strong pattern, 8 for each weak one, by runtime and id."""
    by_length = _first((duration.isin("tv_short", "tv_episode"), 25), (duration == "tv_special", 5), otherwise=0)
    return 30 * strong + 8 * weak + by_length + _points((tv_only, 40))


def folder_category(files: Column, tagged: Column, artists: Column, top_share: Column) -> Column:
    return _first(
        (files == 0, "REVIEW"),
        (tagged == 0, "REVIEW"),
        (artists == 1, "ARTIST"),
        ((artists <= 3) & (top_share >= 0.7), "ARTIST"),
        (top_share >= 0.6, "ARTIST"),
        ((artists >= 20) & (top_share < 0.2), "COMPILATION"),
        ((artists >= 8) & (top_share < 0.4), "COMPILATION"),
        otherwise="REVIEW",
    )


def pruned_reasons(notes: Column, dropped: tuple[str, ...]) -> Column:
    """Reasons ("; " apart) without those dropped; suffixes like _(sim=0.5) do not matter for that."""
    reasons = F.filter(F.transform(F.split(notes, ";"), lambda r: F.trim(r)), lambda r: r != "")
    return F.filter(reasons, lambda r: ~F.regexp_replace(r, r"_\(sim=[^)]*\)$", "").isin(*dropped))


def acoustid_class(status: Column, score: Column, named: Column, title_words: Column, artist_words: Column, title: Column, artist: Column, hint: Column) -> Column:
    """What to do with a fingerprint's match, by its score and the agreement of words and strings with the hints. `named`:
    it has an artist or a title; `title`, `artist`: similarities of strings."""
    best_title, best_artist = F.greatest(title, title_words), F.greatest(artist, artist_words)
    return _first(
        (status != "match", F.concat(F.lit("SKIP_"), status)),
        (~named, "SKIP_empty_match"),
        ((score >= 0.9) & (title_words >= 0.7) & (artist_words >= 0.5), "AUTO_APPLY"),
        ((score >= 0.9) & (title_words >= 0.7), "AUTO_APPLY_OK"),
        ((score >= 0.9) & (artist_words >= 0.7) & (best_title >= 0.4), "AUTO_APPLY_OK"),
        ((score >= 0.95) & (best_title >= 0.7) & (best_artist >= 0.5), "AUTO_APPLY"),
        ((score >= 0.95) & (best_title >= 0.6), "AUTO_APPLY_OK"),
        ((score >= 0.95) & ~hint, "REVIEW_NO_HINT"),
        ((score >= 0.9) & ((best_title >= 0.4) | (best_artist >= 0.5)), "REVIEW_PARTIAL"),
        (score >= 0.9, "REVIEW_HIGH"),
        otherwise="REVIEW_LOW",
    )


def codes(*rules: tuple[Column, str]) -> Column:
    """The codes of all rules that hold, as an array in their order."""
    return F.array_compact(F.array(*[F.when(rule, code) for rule, code in rules]))
