"""Sidecars left behind, copies in order, and episodes on disk, a case for each rule."""

from pyspark.sql import functions as F

from shelfwise.operators import completeness, keepers
from shelfwise.plans import journal


def test_sidecars_left_behind(spark):
    lines = [
        (1, 1, "rename", "ok", "S01E01", r"I:\a\Ep 1.avi", "H:/TV/Show/Show - Old.avi"),
        (2, 0, "copy", "ok", "S01E01", "I:/b/EP 1.mkv", "H:/TV/Show/S: New.mkv"),
        (1, 5, "rename", "error", "S01E02", "I:/a/ep2.avi", "H:/x.avi"),
        (1, 6, "rename", "ok", None, "I:/a/ep3.avi", "H:/x.avi"),
        (1, 7, "mkdir", "ok", "S01E04", "I:/a/ep4.avi", "H:/x.avi"),
        (1, 8, "rename", "ok", "S01E05", "I:/a/ep5.avi", "H:/TV/five.avi"),
        (1, 9, "rename", "ok", "S01E06", "I:/a/ep6.avi", "H:/TV/six.avi"),
    ]
    files = ["ep 1.EN.srt", "ep 1-Poster.jpg", "ep 1.forced.srt", "ep2.nfo", "ep3.nfo", "ep4.nfo", "ep5.nfo", "ep6.nfo", "sub/EP6.mp4", "readme.txt", "ep5.deu.srt", "noext"]
    got = journal.swept(
        spark.createDataFrame(lines, "written int, line int, op string, result string, episode_key string, from_ string, to string"),
        spark.createDataFrame([("src", f"I:/src/{f}") for f in files] + [("other", "I:/o/ep6.srt")], "source string, path string"),
        spark.createDataFrame([("H:/TV/five.nfo",)], "path string"),
    )
    assert {(r.path, r.outcome, r.to) for r in got.collect()} == {
        ("I:/src/ep 1.EN.srt", "swept", "H:/TV/Show/S - New.EN.srt"),
        ("I:/src/ep 1-Poster.jpg", "swept", "H:/TV/Show/S - New-Poster.jpg"), ("I:/src/ep 1.forced.srt", "no_match", None),
        *((f"I:/src/ep{k}.nfo", "no_match", None) for k in (2, 3, 4)), ("I:/src/ep5.nfo", "already_there", "H:/TV/five.nfo"), ("I:/src/ep6.nfo", "video_present", None),
        ("I:/src/ep5.deu.srt", "swept", "H:/TV/five.deu.srt"), ("I:/o/ep6.srt", "swept", "H:/TV/six.srt"),
    }


def test_copies_of_a_film(spark):
    base = {"unresolved": None, "path": "H:/M/Film (1999)/f.mkv", "height": 1, "bitrate": 1, "size": 1, "confidence": 1}
    better = [{}, {"path": "H:/M/Set/Film (1999)/f.mkv"}, {"confidence": 2}, {"size": 3}, {"bitrate": 4}, {"height": 5}]
    worse = [{"height": None}, {"path": "H:/M/Film/f.mkv", "height": 9}, {"path": "H:/M/f.mkv", "height": 9}, {"path": "H:/M/f.mkv", "height": 9, "unresolved": "x"}]
    copies = [base | change for change in [*reversed(better), *worse]]
    rows = [(k, "g", *(c[f] for f in base)) for k, c in enumerate(copies)] + [(99, "g", *(base[f] for f in base))]
    df = spark.createDataFrame(rows, "title_id int, g string, unresolved string, path string, height int, bitrate int, size int, confidence int").repartition(3)
    placed = keepers.best_first(df, ["g"], keepers.film_order("H:/M/")).orderBy("place").collect()
    assert [r.title_id for r in placed] == [*range(len(better)), 99, *range(len(better), len(copies))]


def test_subtitle_rankings(spark):
    rows = [("a/S01E01.srt", 1, 5), ("a/s01e002.SRT", 2, 1), ("a/Show S01E01.srt", 9, 7), ("a/S1E1.srt", 9, 7), ("a/x.srt", None, None)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, path string, size int, mtime int")
    order = lambda ranker: [r.path[2:] for r in keepers.best_first(df, ["g"], keepers.subtitle_order(ranker)).orderBy("place").collect()]
    assert order("canonical") == ["s01e002.SRT", "S01E01.srt", "S1E1.srt", "Show S01E01.srt", "x.srt"]
    assert order("largest") == ["S1E1.srt", "Show S01E01.srt", "s01e002.SRT", "S01E01.srt", "x.srt"]
    assert order("newest") == ["S1E1.srt", "Show S01E01.srt", "S01E01.srt", "s01e002.SRT", "x.srt"]


def test_episodes_in_season_folders(spark):
    rows = [("Season 01 (2001)", "a S01E01.mkv"), ("Season 1", "b s01e03-E01.mkv"), ("Specials ", "c S00E05.mkv"), ("Season 2", "no number.mkv"), ("Season 2", "d S03E09.mkv"), ("Extras", "S09E09.mkv"), ("Season 12345", "S09E09.mkv"), ("Season 1", "S01E0007eE8.mkv")]
    got = completeness.episodes_on_disk(spark.createDataFrame([("x", *r) for r in rows], "series string, season_folder string, name string"))
    assert {(r.season, r.episodes, r.videos) for r in got.collect()} == {(0, 1, 1), (1, 5, 3), (2, 0, 2), (3, 1, None)}
    assert got.where(F.col("series").isNull()).count() == 0


def test_summaries_of_shows(spark):
    rows = [("a", 0, 3, 5), ("a", 1, 8, 8), ("a", 2, 8, 9), ("a", 3, 8, 3), ("a", 4, 5, None), ("a", 5, None, 2), ("a", 6, 0, 1), ("b", 1, None, None), ("c", 12, 2, 1)]
    df = spark.createDataFrame(rows, "show string, season int, expected int, have int")
    capped = {r.show: tuple(r)[1:] for r in completeness.show_summaries(df).collect()}
    assert capped["a"] == (4, 5, 29, 19, 3, 5, "4", "S03(3/8)", "5", 65.5)
    assert capped["b"] == (0, 0, 0, 0, 0, 0, "", "", "", 0.0) and capped["c"] == (1, 1, 2, 1, 0, 0, "", "S12(1/2)", "", 50.0)
    whole = {r.show: (r.seasons_have, r.episodes_have, r.percent) for r in completeness.show_summaries(df, capped=False).collect()}
    assert whole["a"] == (4, 21, 72.4)
