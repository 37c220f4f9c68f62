"""Names of titles, episodes and tracks, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.paths import found

#: How each profile replaces characters that file systems refuse, greatest lengths, what an empty name becomes,
#: and where reserved names get an underscore.
PROFILES = {
    "inventory": {"swaps": {":": " - ", "/": " ", "\\": " ", '"': "'", "|": "-", "·": "-", "…": "..."}, "limit": 180, "empty": "_", "reserved": "after"},
    "plan": {"swaps": {":": " - ", "/": " ", "\\": " ", '"': "'", "|": "-", "<": "(", ">": ")"}, "limit": None, "empty": "", "reserved": "after"},
    "music": {"swaps": {"<": "(", ">": ")", ":": " -", '"': "'", "/": " ", "\\": " ", "|": "-"}, "limit": 180, "empty": "", "reserved": None},
    "leftover": {"swaps": {"<": "(", ">": ")", ":": " -", '"': "'", "/": " ", "\\": " ", "|": "-"}, "limit": 120, "empty": "", "reserved": "before"},
    "segment": {"swaps": {}, "limit": 100, "empty": "untitled", "reserved": None},
}
RESERVED = ("con", "prn", "aux", "nul", *(f"{p}{n}" for p in ("com", "lpt") for n in range(1, 10)))
#: Words that say nothing of a series; marks of quality and release; what numbers a folder in front.
STOP_WORDS = ("the", "a", "an", "and", "of", "in", "on", "at", "to", "for", "complete", "show", "shows", "series", "season", "seasons", "episode", "episodes", "edition", "collection", "collections", "volume", "volumes", "vol")
QUALITY_TAGS = (
    *("480p", "576p", "720p", "1080p", "1440p", "2160p", "4k", "uhd", "hd", "sd", r"hdr10\+?", "hdr", "dolby ?vision", "dovi", "sdr"),
    *("bluray", "blu-?ray", "bdrip", "brrip", "dvdrip", "webrip", "web-?dl", "hdtv", "hdrip", "pdtv", "dsr", "dsrip", "remux", "repack", "proper", "internal", "extended", "director.?s? cut", "unrated", "limited"),
    *("x264", "x265", r"h\.?264", r"h\.?265", "hevc", "avc", "xvid", "divx", "vp9", "av1"),
    *("mp3", "aac", r"aac2\.0", "ac3", "eac3", "dts(?:-?hd)?(?:-?ma)?", "flac", "opus", "truehd", "atmos", r"dd5\.1", r"dd2\.0", r"5\.1", r"2\.0", r"7\.1"),
    *("yify", r"yts(?:\.\w+)?", "rarbg", "ettv", "eztv", "nogrp", "fov", "sva", "killers", "lol", "asap", "fum", "dimension", "immerse"),
    *(r"disc ?\d+", r"d\d+", r"cd\d+", r"title ?\d+"),
)
LEADING_MARKS = (r"\s*\d{1,3}\s*[-._]?\s+", r"\s*disc\s*\d+\s+", r"\s*t\d{2,3}\s+", r"\s*_?title\s*\d+\s*", r"\s*playlist[\s_]*\d+\s*", r"\s*\[[^\]]+\]\s*", r"\s*\([^)]+\)\s*")
YEARS = r"\((?:19|20)\d{2}(?:[\s\-–—]+(?:(?:19|20)\d{2}|\d{2})?)?\)"
ARTICLES = ("the", "a", "an", "el", "la", "los", "las", "les")


def let(value: Column, body) -> Column:
    """body(value), with the value made once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _refused(name: Column, profile: str) -> Column:
    out = reduce(lambda c, swap: F.replace(c, F.lit(swap[0]), F.lit(swap[1])), PROFILES[profile]["swaps"].items(), name)
    out = F.regexp_replace(out, r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"^[ .]+|[ .]+$" if profile == "segment" else r"[. ]+$", "")


def _unreserved(out: Column, profile: str) -> Column:
    p = PROFILES[profile]
    if p["reserved"] == "after":
        out = F.when(F.lower(out).isin(*RESERVED), F.concat(out, F.lit("_"))).otherwise(out)
    if p["reserved"] == "before":
        out = F.when(F.substring_index(F.lower(out), ".", 1).isin(*RESERVED), F.concat(F.lit("_"), out)).otherwise(out)
    if p["limit"]:
        out = F.substring(out, 1, p["limit"])
        out = out if profile == "segment" else F.regexp_replace(out, r"[. ]+$", "")
    return out


def _named(out: Column, profile: str) -> Column:
    return F.when(out == "", PROFILES[profile]["empty"]).otherwise(out)


def sanitized(name: Column, profile: str = "inventory") -> Column:
    """A name that any file system takes, by a profile: what it has no swap for is deleted."""
    return _named(_unreserved(_refused(name, profile), profile), profile)


def all_sanitized(names: Column, profile: str = "inventory") -> Column:
    """The sanitized forms of an array of names. A step's result is made once however often the next names it."""
    finished = lambda out: let(_unreserved(out, profile), lambda o: _named(o, profile))
    return F.transform(names, lambda name: let(_refused(name, profile), finished))


def show_folder(name: Column) -> Column:
    """A folder's name of ASCII letters, digits, spaces, dots, underscores and hyphens alone; "show" if nothing is left."""
    out = F.regexp_replace(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9 ._-]", "")), r"\s+", " ")
    return F.when(out == "", "show").otherwise(out)


def swept_name(name: Column) -> Column:
    """A file's name as a sweep of sidecars writes it: like the profile "plan", but control characters and dots at its end stay."""
    swaps = (*PROFILES["plan"]["swaps"].items(), ("?", ""), ("*", ""))
    out = reduce(lambda c, swap: F.replace(c, F.lit(swap[0]), F.lit(swap[1])), swaps, name)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def movie_target(title: Column, year: Column, imdb_id: Column) -> Column:
    """"Title (Year) {imdb-id}"; empty where one of the three is missing."""
    known = title.isNotNull() & year.isNotNull() & imdb_id.isNotNull()
    return F.when(known, F.concat(sanitized(title), F.lit(" ("), year.cast("string"), F.lit(") {imdb-"), imdb_id, F.lit("}"))).otherwise("")


def season_folder(season: Column) -> Column:
    return F.when(season == 0, "Specials").otherwise(F.concat(F.lit("Season "), two(season)))


def two(number: Column) -> Column:
    """At least two digits."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def episode_key(season: Column, episode: Column, last: Column | None = None) -> Column:
    """S01E02, or S01E02-E03 for several."""
    key = F.concat(F.lit("S"), two(season), F.lit("E"), two(episode))
    return key if last is None else F.when(last > episode, F.concat(key, F.lit("-E"), two(last))).otherwise(key)


#: Season and episode in names, by patterns of falling certainty. Java's lookarounds keep them off longer words.
_S_E = r"(?<![a-z0-9])s([0-9]{1,3})[\s._-]?e([0-9]{1,4})(?:[\s._-]*[e-][\s._-]*([0-9]{1,4}))?(?![a-z0-9])"
_X_FORM = r"(?<![a-z0-9])([0-9]{1,3})x([0-9]{1,4})(?:[\s._-]*-[\s._-]*(?:[0-9]{1,3}x)?([0-9]{1,4}))?(?![a-z0-9])"
_EP_WORD = r"(?<![a-z0-9])(?:episode|ep|e)[\s._-]*()([0-9]{1,4})(?:[\s._-]*-[\s._-]*([0-9]{1,4}))?(?![a-z0-9])"
_BARE = r"(?<![a-z0-9])([0-9]{1,4})(?![a-z0-9])"
_SPECIAL = r"\b(?:specials?|ova|oad|extras?|christmas|holiday|new ?year|behind the scenes|making of|deleted scenes?|gag reel|bloopers?)\b"


def _episode(low: Column, season: Column, absolute: bool) -> Column:
    """The struct of parsed_episode. A pattern is tried where those before it found nothing, and its groups are taken in one go."""

    def result(season, episode, last, pattern, confidence, several):
        kept = F.when(last > episode, last)
        sure = F.when(kept.isNotNull(), several).otherwise(confidence)
        special = (season == 0) | low.rlike(_SPECIAL)
        return F.struct(season.alias("season"), episode.alias("episode"), kept.alias("last"), F.lit(pattern).alias("pattern"), sure.alias("confidence"), F.coalesce(special, F.lit(False)).alias("special"), F.coalesce(last < episode, F.lit(False)).alias("falling"))

    none = F.lit(None).cast("int")

    def tried(pattern, found_, otherwise):
        def groups(match):
            parts = F.split(F.regexp_replace(match, pattern, "$1\u0001$2\u0001$3"), "\u0001")
            return F.when(match != "", let(F.transform(parts, lambda g: g.try_cast("int")), found_)).otherwise(otherwise)

        return let(F.regexp_extract(low, pattern, 0), groups)

    numbers = F.filter(F.transform(F.regexp_extract_all(low, F.lit(_BARE), F.lit(1)), lambda n: n.try_cast("int")), lambda n: (n < 1900) | (n > 2099))

    def bare(n):
        out = F.when(season.isNotNull() & n.isNotNull(), result(season, n, none, "season_bare", F.lit(65), F.lit(65)))
        return out.when(n >= 2, result(F.lit(0), n, none, "absolute", F.lit(40), F.lit(40))) if absolute else out

    out = let(F.try_element_at(numbers, F.lit(1)), bare)
    if not absolute:
        out = F.when(season.isNotNull(), out)
    in_folder = tried(_EP_WORD, lambda g: result(season, g[1], g[2], "season_ep", F.lit(80), F.lit(75)), out)
    out = F.when(season.isNotNull(), in_folder).otherwise(out)
    out = tried(_X_FORM, lambda g: result(g[0], g[1], g[2], "x_form", F.lit(88), F.lit(82)), out)
    return tried(_S_E, lambda g: result(g[0], g[1], g[2], "s_e", F.lit(95), F.lit(90)), out)


def _stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.[a-zA-Z0-9]{2,4}$", ""))


def _season_of(folder: Column) -> Column:
    of = F.lower(folder)
    return F.when(of.rlike(r"^\s*specials?\s*(?:\([0-9]{4}\))?\s*$"), 0).otherwise(found(of, r"^\s*season\s*([0-9]{1,3})\s*(?:\([0-9]{4}\))?\s*$").try_cast("int"))


def parsed_episode(name: Column, folder: Column, absolute: bool = False) -> Column:
    """(season, episode, last, pattern, confidence, special, falling) of a file's name, by the first pattern that fits: S01E02
    with an optional range, 1x02, "ep 2" or a bare number in a season's folder, and, if asked for, an absolute number. Numbers
    that are years are no episodes; a range that falls is cut to its first episode. `last` is null without a range."""
    return let(F.struct(_stem(name).alias("low"), _season_of(folder).alias("season")), lambda p: _episode(p["low"], p["season"], absolute))


def with_episode(files: DataFrame, name: Column, folder: Column, into: str = "episode", absolute: bool = False) -> DataFrame:
    """`files` with parsed_episode in a column."""
    return files.withColumn(into, parsed_episode(name, folder, absolute))


_TAGS = rf"(?i)(?<![\w'])(?:{'|'.join(QUALITY_TAGS)})(?![\w'])"


def series_name(name: Column) -> Column:
    """The text before the first episode marker, without brackets, quality tags, years and separators."""
    out = F.regexp_replace(name, r"\.[a-zA-Z0-9]{2,4}$", "")
    out = F.regexp_replace(out, r"(?<=\w)[._]+(?=\w)", " ")
    out = F.regexp_replace(out, r"(?is)(?<![a-z0-9])(?:s[0-9]{1,3}[\s._-]?e[0-9]{1,4}|[0-9]{1,3}x[0-9]{1,4}|(?:episode|ep|e)[\s._-]*[0-9]{1,4})(?![a-z0-9]).*$", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\[[^\]]*\]", " "), _TAGS, " "), YEARS, " ")
    return F.regexp_replace(F.regexp_replace(out, r"[-_.\s]+", " "), r"^[ ,]+|[ ,]+$", "")


def folder_tokens(name: Column) -> Column:
    """A folder's telling words, in order: without years and brackets, numbers and marks in front (again and again), quality
    tags, stop words and single letters."""
    out = F.trim(F.regexp_replace(name, r"[\\/\s]+$", ""))
    out = F.regexp_replace(F.regexp_replace(out, YEARS, " "), r"\[[^\]]*\]", " ")
    out = F.regexp_replace(out, r"(?<=\w)[._]+(?=\w)", " ")
    out = F.regexp_replace(F.regexp_replace(out, rf"(?i)^(?:{'|'.join(LEADING_MARKS)})+", ""), _TAGS, " ")
    return F.filter(F.split(F.lower(out), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


#: Tokens of releases, and parts that make any token one; the same for names of episodes.
RELEASE_TOKENS = (
    *("complete", "completeseries", "completedvd", "collection", "volume", "vol", "disc", "discs", "dvd", "dvdrip", "bluray", "bd", "brrip", "bdrip", "hdtv", "pdtv", "webrip", "webdl"),
    *("1080p", "720p", "480p", "576p", "2160p", "4k", "uhd", "x264", "x265", "h264", "h265", "hevc", "xvid", "divx", "aac", "ac3", "mp3", "dts", "dolby", "remastered", "extended", "uncut"),
    *("directors", "proper", "repack", "internal", "limited", "rerip", "subbed", "dubbed", "uncensored", "censored", "axxo", "yify", "rarbg", "ettv", "fgt", "ntb", "evo", "ftp", "seasons", "series", "pack", "packs", "boxset"),
)
RELEASE_PARTS = ("dvdrip", "bluray", "brrip", "bdrip", "hdtv", "pdtv", "webrip", "x264", "x265", "h264", "h265", "hevc", "xvid", "1080p", "720p", "480p", "2160p", "axxo", "yify", "rarbg")
EPISODE_CRUFT = (
    *("dvdrip", "bluray", "brrip", "bdrip", "hdtv", "pdtv", "webrip", "webdl", "x264", "x265", "h264", "h265", "hevc", "xvid", "divx", "1080p", "720p", "480p", "576p", "2160p", "4k", "uhd"),
    *("aac", "ac3", "mp3", "dts", "5.1", "axxo", "yify", "rarbg", "ettv", "fgt", "complete", "remastered", "extended", "uncut", "proper", "repack", "pack", "vol", "volume", "disc"),
)


def _kept_words(words: Column, whole: tuple[str, ...], parts: tuple[str, ...], edges: str) -> Column:
    """Words that are no release token, hold none of the parts and are no number of four digits or more."""
    low = lambda t: F.regexp_replace(F.lower(t), rf"^[{edges}]+|[{edges}]+$", "")
    starts: dict[str, list[str]] = {}
    for p in parts:
        starts.setdefault(p[0], []).append(p[1:].replace(".", "[.]"))
    some = f"(?=[{''.join(starts)}])(?:{'|'.join(f'{c}(?:{"|".join(ends)})' for c, ends in starts.items())})"  # tried only where a first letter fits
    kept = lambda w: (w != "") & ~w.isin(*whole) & ~w.rlike(some) & ~w.rlike("^[0-9]{4,}$")
    return F.array_join(F.filter(words, lambda t: let(low(t), kept)), " ")


def clean_folder(name: Column) -> Column:
    """(name, year): a folder's name without release tokens, brackets and seasons, and the year that it states."""
    year = found(name, r"\b((?:19|20)[0-9]{2})\b").try_cast("int")
    out = F.regexp_replace(F.regexp_replace(name, r"[(\[]?\b(?:19|20)[0-9]{2}\b[)\]]?", " "), r"[\[({][^\])}]*[\])}]", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\b(?:s|season|series|seasons)\s*[0-9]+(?:[-–][0-9]+)?\b", " "), r"[._\-\s]+", " ")
    return F.struct(_kept_words(F.split(F.trim(out), " "), RELEASE_TOKENS, RELEASE_PARTS, r"\-.,()").alias("name"), year.alias("year"))


def show_hint(file: Column) -> Column:
    """What an episode's file says of its show: the stem up to the first episode number or " - ", without release tokens."""
    out = F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), r"(?is)\b(?:s[0-9]+e[0-9]+|season\s*[0-9]+|episode\s*[0-9]+|[0-9]+x[0-9]+|[0-9]{1,3}\b).*$", "")
    return clean_folder(F.regexp_replace(out, r"(?s)(?: - | — |_-_).*$", ""))["name"]


def title_hint(file: Column) -> Column:
    """What an episode's file says of the episode's title: without brackets, markers, a number in front and cruft."""
    out = F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), r"[\[({][^\])}]*[\])}]", " ")
    out = F.regexp_replace(out, r"(?i)\b(?:s[0-9]+\s*-?\s*e[0-9]+|season\s*[0-9]+|episode\s*[0-9]+|ep\s*[0-9]+|[0-9]+x[0-9]+)\b", " ")
    out = F.regexp_replace(out, r"^\s*[0-9]{1,3}\s*[-.]\s*", "")
    return _kept_words(F.split(F.regexp_replace(out, r"^[\s\-_.]+", ""), r"[\s\-_.]+"), EPISODE_CRUFT, EPISODE_CRUFT, r"\-.,()'\x22")


def guessed_title(name: Column) -> Column:
    """(title, year) of a rip's name: the extension, marks of discs behind and a sequence number in front go (up to 99, or if
    a year follows), names in capitals and underscores get capitals at words' starts; then what stands before the year."""
    out = let(F.regexp_replace(name, r"(?i)\.[a-z0-9]{1,4}$", ""), _unshouted)
    out = let(F.regexp_replace(out, r"(?i)(?:[-_\s]+(?:t[0-9]{2,3}|title[\s_]*[0-9]+|playlist[\s_]*[0-9]+|disc[\s_]*[0-9]+)\s*)+$", ""), _unnumbered)
    return let(out, _title_and_year)


def _unshouted(out: Column) -> Column:
    letters = F.regexp_replace(out, "[^A-Za-z]", "")
    shouted = (F.length(letters) >= 4) & (letters == F.upper(letters)) & out.contains("_")
    return F.when(shouted, F.initcap(F.replace(out, F.lit("_"), F.lit(" ")))).otherwise(out)


def _unnumbered(out: Column) -> Column:
    number, rest = found(out, r"^([0-9]{1,4})\s*[-.]\s*.+$").try_cast("int"), found(out, r"^[0-9]{1,4}\s*[-.]\s*(.+)$")
    return F.when((number <= 99) | rest.rlike(r"\b(?:19|20)[0-9]{2}\b"), rest).otherwise(out)


def _title_and_year(out: Column) -> Column:
    year = found(out, r"\b((?:19|20)[0-9]{2})\b").try_cast("int")
    before = F.regexp_replace(out, r"[\s._(\[-]*\b(?:19|20)[0-9]{2}\b.*$", "")
    title = F.trim(F.regexp_replace(F.when(before == "", out).otherwise(before), r"[._\s]+", " "))
    return F.struct(title.alias("title"), year.alias("year"))


def leading_number(name: Column) -> Column:
    """A number at a name's start that isn't a year."""
    n = found(name, r"^\s*([0-9]{1,4})(?:[^0-9]|$)").try_cast("int")
    return F.when((n < 1900) | (n > 2099), n)


def letter(name: Column, articles=ARTICLES) -> Column:
    """The letter that a name is filed under, articles apart; 0-9 for digits, _Other, _Unknown for none."""
    rest = F.trim(F.regexp_replace(F.trim(name), rf"(?i)^(?:{'|'.join(articles)})\s+", ""))

    def of(rest: Column) -> Column:
        first = F.upper(F.substring(rest, 1, 1))
        return F.when(F.coalesce(rest, F.lit("")) == "", "_Unknown").when(first.rlike("[A-Z]"), first).when(first.rlike("[0-9]"), "0-9").otherwise("_Other")

    return let(rest, of)


def article_sort_key(title: Column) -> Column:
    """Lists sort by titles without the letters of "the " and then "a " at their start: character sets, not words."""
    return F.ltrim(F.ltrim(F.lower(title), F.lit("the ")), F.lit("a "))


def weakly_tagged(artist: Column, title: Column) -> Column:
    return (F.trim(F.coalesce(artist, F.lit(""))) == "") | (F.trim(F.coalesce(title, F.lit(""))) == "")


def plausible_artist(name: Column) -> Column:
    """A real name however short: two characters or more, letters, digits and a few signs."""
    return F.coalesce((F.length(F.trim(name)) >= 2) & F.trim(name).rlike(r"^[\p{L}\p{N}&+-]+$"), F.lit(False))


def single_letter(name: Column) -> Column:
    """No artist, or one letter: an accident of filing."""
    return (F.coalesce(name, F.lit("")) == "") | (F.length(F.trim(name)) == 1)


def year_of(date: Column) -> Column:
    return found(date, "((?:19|20)[0-9]{2})").try_cast("int")


def track_of(tag: Column) -> Column:
    """"01" of "1/12"; null if there is no number."""
    return two(found(tag, r"^\s*([0-9]+)").try_cast("int"))


#: Variants by their markers, the first that fits counts.
VARIANTS = (
    (r"extended[\s_.]+director'?s[\s_.]+cut", "Extended Director's Cut"),
    (r"director'?s[\s_.]+cut", "Director's Cut"),
    (r"ultimate[\s_.]+edition", "Ultimate Edition"),
    (r"special[\s_.]+edition", "Special Edition"),
    (r"extended[\s_.]+edition", "Extended"),
    (r"extended[\s_.]+cut", "Extended Cut"),
    (r"theatrical[\s_.]+cut", "Theatrical Cut"),
    (r"final[\s_.]+cut", "Final Cut"),
    ("remastered", "Remastered"),
    ("unrated", "Unrated"),
    ("extended", "Extended"),
    ("theatrical", "Theatrical"),
)
FORMATS_3D = ("HSBS", "FSBS", "HOU", "FOU")


def variant(name: Column) -> Column:
    """The edition that a tag {edition-…} names, else the first marker in the text."""
    marked = reduce(lambda out, v: out.when(name.rlike(rf"(?i)\b{v[0]}\b"), v[1]), VARIANTS[1:], F.when(name.rlike(rf"(?i)\b{VARIANTS[0][0]}\b"), VARIANTS[0][1]))
    return F.coalesce(F.initcap(F.trim(F.replace(found(name, r"(?i)\{edition-([^}]+)\}"), F.lit("_"), F.lit(" ")))), marked)


def format_3d(name: Column) -> Column:
    """The format of a film in 3D; HSBS where the name says 3D alone."""
    return F.coalesce(F.upper(found(name, rf"(?i)\b({'|'.join(FORMATS_3D)})\b")), F.when(name.rlike(r"(?i)\b3D\b"), "HSBS"))


def extra_label(stem: Column) -> Column:
    """"Extra", "Extras" or "Extra 2", if a stem ends so."""
    mark, number = found(stem, r"(?i)\b(Extras?)(?:\s+[0-9]+)?\s*$"), found(stem, r"(?i)\bExtras?\s+([0-9]+)\s*$")
    return F.when(number.isNotNull(), F.concat(F.lit("Extra "), number)).when(F.lower(mark) == "extras", "Extras").when(mark.isNotNull(), "Extra")


def variant_template(base: Column, edition: Column, format_: Column) -> Column:
    """A file name's template with the edition before its last id tag and the format in 3D at its end."""
    tag = F.concat(F.lit("{{edition-"), edition, F.lit("}}"))
    put = F.when(base.rlike(r".\{\{"), F.regexp_replace(base, F.lit(r"^(.+)(\{\{)"), F.concat(F.lit("$1"), F.regexp_replace(tag, r"([$\\])", r"\\$1"), F.lit(" $2")))).otherwise(F.concat(base, F.lit(" "), tag))
    return F.concat(F.when(edition.isNotNull(), put).otherwise(base), F.coalesce(F.concat(F.lit(" - 3D."), format_), F.lit("")))


def cleaned(title: Column) -> Column:
    """A tag's title without brackets (three levels deep), "feat." and what follows, and spare spaces."""
    out = title
    for _ in range(3):
        out = F.regexp_replace(out, r"\([^()]*\)|\[[^\[\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?i)\s+(?:feat|ft)\.?\s.*$", ""), " +", " "))


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again: texts of Latin-1 characters alone that hold a letter of damage before a
    continuation byte, if their bytes are UTF-8. Others stay as they are."""
    damaged = text.rlike("[\u00c0-\u00c3][\u0080-\u00bf]") & text.rlike("^[\u0000-\u00ff]*$")
    raw = F.encode(F.when(damaged, text), "ISO-8859-1")
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), text)
