"""Plans of series: merges, episodes that meet, and what goes along, a case for each rule."""

from shelfwise.plans import series

ROWS = [
    (1, "I:/Show A/", "H:/TV/Show (2001)", 7, "Show"),
    (2, "I:/Show B", "h:/tv/show (2001)", 7, "Show"),
    (3, "I:/Other", "H:/TV/Other (2002)", 8, "Other: One"),
    (4, "I:/Empty", "H:/TV/Full", 9, "Full"),
    (5, "I:/None", "H:/TV/None", 10, "None"),
    (6, "I:/C", "H:/TV/Clash", 11, "C"),
    (7, "I:/D", "H:/TV/clash", 12, "D"),
]
FILES = [
    (1, "I:/Show A/s1/a.S01E01.mkv", 10, "x", 1, 1, None),
    (1, "I:/Show A/s1/a.S01E01.en.srt", 1, None, None, None, None),
    (1, "I:/Show A/s1/a.S01E01-thumb.jpg", 1, None, None, None, None),
    (1, "I:/Show A/s1/a.S01E010.srt", 1, None, None, None, None),
    (1, "I:/Show A/s1/poster.jpg", 1, None, None, None, None),
    (1, "I:/Show A/poster.jpg", 1, None, None, None, None),
    (1, "I:/Show A/Season01-Poster.JPG", 1, None, None, None, None),
    (1, "I:/Show A/notes.txt", 1, None, None, None, None),
    (1, "I:/Show A/s1/a.S01E02.mkv", 10, "p", 1, 2, 3),
    (2, "I:/Show B/b.S01E01.mkv", 10, "x", 1, 1, None),
    (2, "I:/Show B/b.S01E02-E03.mkv", 30, "q", 1, 2, 3),
    (2, "I:/Show B/b.S01E02-E03.srt", 1, None, None, None, None),
    (2, "I:/Show B/tvshow.nfo", 1, None, None, None, None),
    (3, "I:/Other/o1.mkv", 5, "m", 0, 1, None),
    (3, "I:/Other/o2.mkv", 5, "n", 2, 1, None),
    (3, "I:/Other/o3.mkv", 9, "k", 2, 2, None),
    (3, "I:/Other/o4.mkv", 4, "same", 2, 3, None),
    (3, "I:/Other/poster.png", 4, "", None, None, None),
    (5, "I:/None/readme.txt", 4, "", None, None, None),
    (6, "I:/C/c.mkv", 4, "", 1, 1, None),
]
SHOW = "H:/TV/Show (2001)"
OTHER = "H:/TV/Other (2002)"


def test_actions(spark):
    plan = spark.createDataFrame(ROWS, "series_id int, source_folder string, target_folder string, tmdb_series_id int, matched_series string")
    files = spark.createDataFrame(FILES, "series_id int, path string, size bigint, hash string, season int, episode int, episode_end int").repartition(3)
    seasons = spark.createDataFrame([(7, 1, 2001), (8, 0, None)], "tmdb_series_id int, season int, year int")
    titles = spark.createDataFrame([(7, 1, 1, "The: Start"), (8, 2, 2, "Two")], "tmdb_series_id int, season int, episode int, title string")
    present = spark.createDataFrame([(f"{OTHER}/Season 02 ()/Other - One S02E01 -.mkv", 7, "z"), (f"{OTHER}/Season 02 ()/Other - One S02E02 - Two.mkv", 3, "y"), (f"{OTHER}/Season 02 ()/Other - One S02E03 -.mkv", 9, "same"), ("H:/TV/full/Season 01/x.mkv", 1, "h")], "path string, size bigint, hash string")
    got = {(r.series_id, r.stage, r.op, r.source, r.target, r.reason) for r in series.actions(plan, files, seasons, titles, present).collect() if r.stage != "J"}
    move = lambda i, stage, a, b: (i, stage, "move", a, b, None)
    assert got == {
        (4, "A", "done_already", None, "H:/TV/Full", "source empty, target populated"),
        (5, "A", "fail", None, "H:/TV/None", "no parseable episodes"),
        (2, "B", "quarantine", "I:/Show B/b.S01E01.mkv", "duplicates/Show (2001)/sid2_S01E01_b.S01E01.mkv", "duplicate_identical"),
        (1, "B", "quarantine", "I:/Show A/s1/a.S01E02.mkv", "duplicates/Show (2001)/sid1_S01E02-E03_a.S01E02.mkv", "duplicate_smaller_size=10"),
        (3, "C", "look_up", None, None, "8 season 2"),
        *((1, "E", "mkdir", None, t, None) for t in (SHOW, f"{SHOW}/Season 01 (2001)")),
        *((3, "E", "mkdir", None, t, None) for t in (OTHER, f"{OTHER}/Specials", f"{OTHER}/Season 02 ()")),
        move(1, "F", "I:/Show A/s1/a.S01E01.mkv", f"{SHOW}/Season 01 (2001)/Show S01E01 - The - Start.mkv"),
        move(2, "F", "I:/Show B/b.S01E02-E03.mkv", f"{SHOW}/Season 01 (2001)/Show S01E02-E03 -.mkv"),
        move(3, "F", "I:/Other/o1.mkv", f"{OTHER}/Specials/Other - One S00E01 -.mkv"),
        (3, "F", "quarantine", "I:/Other/o2.mkv", "duplicates/Other (2002)/sid3_S02E01_o2.mkv", "cross_run_source_smaller_size=5"),
        (3, "F", "make_room", f"{OTHER}/Season 02 ()/Other - One S02E02 - Two.mkv", "duplicates/Other (2002)/sid3_target_Other - One S02E02 - Two.mkv", "cross_run_target_smaller_size=3"),
        move(3, "F", "I:/Other/o3.mkv", f"{OTHER}/Season 02 ()/Other - One S02E02 - Two.mkv"),
        (3, "F", "quarantine", "I:/Other/o4.mkv", "duplicates/Other (2002)/sid3_S02E03_o4.mkv", "cross_run_identical_hash"),
        move(1, "G", "I:/Show A/s1/a.S01E01.en.srt", f"{SHOW}/Season 01 (2001)/Show S01E01 - The - Start.en.srt"),
        move(1, "G", "I:/Show A/s1/a.S01E01-thumb.jpg", f"{SHOW}/Season 01 (2001)/Show S01E01 - The - Start-thumb.jpg"),
        move(2, "G", "I:/Show B/b.S01E02-E03.srt", f"{SHOW}/Season 01 (2001)/Show S01E02-E03 -.srt"),
        move(1, "H", "I:/Show A/poster.jpg", f"{SHOW}/poster.jpg"),
        move(1, "H", "I:/Show A/Season01-Poster.JPG", f"{SHOW}/Season01-Poster.JPG"),
        move(2, "H", "I:/Show B/tvshow.nfo", f"{SHOW}/tvshow.nfo"),
        move(3, "H", "I:/Other/poster.png", f"{OTHER}/poster.png"),
        move(1, "I", "I:/Show A/s1/poster.jpg", f"{SHOW}/Season 01 (2001)/poster.jpg"),
    }
    emptied = [(r.series_id, r.source) for r in series.actions(plan, files, seasons, titles, present).where("stage = 'J'").orderBy("series_id", "reason").collect()]
    assert emptied == [(1, "I:/Show A/s1"), (1, "I:/Show A"), (2, "I:/Show B"), (3, "I:/Other"), (5, "I:/None")]
