"""Proposals for series that a search did not settle, from the searches to the plan."""

from pyspark.sql import functions as F

from shelfwise.plans import proposals

PLAN = "series_id int, source_folder string, action string, flags string, tmdb_series_id bigint, matched_series string, matched_year int, target_folder string, confidence string, notes string"


def row(i, folder, flags="no_tmdb_results", action="SKIP", tmdb=None, notes=None):
    return i, folder, action, flags, tmdb, None, None, None, "0", notes


ROWS = [
    row(1, "I:/Red Show (2001) complete"),
    row(2, "I:\\Blue.Show.1080p\\", notes="old"),
    row(3, "I:/Green Show 1999", "x;multi_result_3;no_tmdb_results", tmdb=5),
    row(4, "I:/Odd One"),
    row(5, "I:/1080p"),
    row(6, "I:/Red Show", "no_tmdb_results;retmdb_attempted"),
    row(7, "I:/Red Show", action="AUTO"),
    row(8, "I:/Two Of Them", "multi_result_2"),
    row(9, "I:/Gone (2001)"),
]


def test_searches_to_commit(spark):
    plan = spark.createDataFrame(ROWS, PLAN)
    open_ = proposals.eligible(plan)
    assert sorted(r.series_id for r in open_.collect()) == [1, 2, 3, 4, 5, 9]
    assert sorted(r.series_id for r in proposals.eligible(plan, several=True).collect()) == [1, 2, 3, 4, 5, 8, 9]
    hints = spark.createDataFrame([(2, "blue show"), (4, "The Hint"), (9, "gone")], "series_id int, hint string")
    asked = {(r.series_id, r.nth, r.strategy, r.query, r.year) for r in proposals.searches(open_, hints).collect()}
    assert asked == {
        (1, 1, "folder_clean", "Red Show", 2001), (1, 3, "folder_clean_no_year", "Red Show", None), (2, 1, "folder_clean", "Blue Show", None), (3, 1, "folder_clean", "Green Show", 1999), (3, 3, "folder_clean_no_year", "Green Show", None),
        (4, 1, "folder_clean", "Odd One", None), (4, 2, "episode_hint", "The Hint", None), (9, 1, "folder_clean", "Gone", 2001), (9, 3, "folder_clean_no_year", "Gone", None),
    }
    answers = [
        ("Red Show", 2001, 0, 11, "Red Show", 2001, 50, 50.0), ("Red Show", 2001, 1, 12, "Another", 1980, 50, 1.0),
        ("Blue Show", None, 0, 21, "Blue Show", 2005, 5, 80.0), ("Blue Show", None, 1, 22, "Blue Show", None, 500, 80.0),
        ("Green Show", None, 0, 31, "Green Show: Extra", 1990, 90, 99.0),
        ("Green Show", 1999, 0, 32, "zzz qqq", None, 0, None),
        ("The Hint", None, 0, 41, "Hint, The", None, 1, 0.0),
        *(("Gone", 2001, k, 90 + k, f"x{k} yy", None, 0, None) for k in range(7)),
    ]
    got = proposals.proposed(open_, hints, spark.createDataFrame(answers, "query string, year int, rank int, id bigint, name string, first_year int, votes bigint, popularity double").repartition(3))
    got = got.cache()
    by = {r.series_id: r for r in got.collect()}
    assert (by[1].verdict, by[1].strategy, by[1].pick, [c.label for c in by[1].candidates]) == ("HIGH", "folder_clean", 1, ["11|Red Show (2001)", "12|Another (1980)"])
    assert by[1].candidates[0].score == 1.0
    assert (by[2].verdict, by[2].pick, [c.label for c in by[2].candidates]) == ("MEDIUM", None, ["21|Blue Show (2005)", "22|Blue Show"])  # equal scores: the service's order
    assert (by[3].verdict, by[3].strategy, by[3].year, by[3].pick) == ("MEDIUM", "folder_clean_no_year", None, None)
    assert (by[4].strategy, by[4].query) == ("episode_hint", "The Hint") if by[4].verdict != "NONE" else by[4].strategy == "folder_clean"
    assert (by[5].verdict, by[5].strategy, by[5].query, by[5].candidates) == ("NONE", "no_query", "", [])
    assert (by[9].verdict, by[9].strategy, len(by[9].candidates)) == ("NONE", "folder_clean", 5)

    picks = {1: "1", 2: " 2 ", 3: "1", 4: "9", 5: None, 9: "0"}
    edited = got.drop("pick").join(spark.createDataFrame(list(picks.items()), "series_id int, pick string"), "series_id")
    after = {r.series_id: r for r in proposals.committed(plan, edited, "H:/TV/").collect()}
    assert len(after) == len(ROWS)
    assert after[1][2:] == ("AUTO", "retmdb_committed", 11, "Red Show", 2001, "H:/TV/Red Show (2001) {tmdb-11}", "70", "retmdb: matched via folder_clean (cand=1)", "accepted")
    assert after[2][2:] == ("AUTO", "retmdb_committed", 22, "Blue Show", None, "H:/TV/Blue Show () {tmdb-22}", "70", "old; retmdb: matched via folder_clean (cand=2)", "accepted")
    assert after[3][2:] == ("AUTO", "x;disambig_committed", 31, "Green Show: Extra", 1990, "H:/TV/Green Show - Extra (1990) {tmdb-31}", "70", "disambig: matched via folder_clean_no_year (cand=1)", "accepted")
    assert (after[4].outcome, after[4].flags) == ("error", "no_tmdb_results")
    assert (after[5].outcome, after[5].flags) == ("rejected", "no_tmdb_results;retmdb_attempted") == (after[9].outcome, after[9].flags)
    assert (after[6].outcome, after[6].flags, after[8].outcome) == (None, "no_tmdb_results;retmdb_attempted", None)
    assert proposals.eligible(proposals.committed(plan, edited, "H:/TV/").drop("outcome")).where(F.col("series_id") != 4).count() == 0
