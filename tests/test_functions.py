"""Case tables of column functions, sources and plans."""

import json

import re

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import fuzzy, names, paths
from shelfwise.operators import completeness, graph, keepers, retrieval, trees
from shelfwise.plans import journal, scoring
from shelfwise.sources import tolerant
from shelfwise.streaming import intake


def values(spark, column, *rows, schema="x string, y string"):
    width = len(schema.split(","))
    df = spark.createDataFrame([(*r, *([None] * width))[:width] for r in (r if isinstance(r, tuple) else (r,) for r in rows)], schema)
    return [r[0] for r in df.select(column.alias("v")).collect()]


@pytest.mark.parametrize(
    "name, folder, want",
    [
        ("Show.S01E02.mkv", "", (1, 2, None, "s_e", 95)),
        ("show s1e2-e4.avi", "", (1, 2, 4, "s_e", 90)),
        ("show.s01e05-e03.mkv", "", (1, 5, None, "s_e", 95)),
        ("Ep 3-5.mkv", "season 4 (2001)", (4, 3, 5, "season_ep", 75)),
        ("clip x264 h265.mkv", "", None),
        ("Show 3x07.mkv", "", (3, 7, None, "x_form", 88)),
        ("Episode 9.mkv", "Season 2", (2, 9, None, "season_ep", 80)),
        ("09 - Name.mkv", "Season 02", (2, 9, None, "season_bare", 65)),
        ("Special 2.mkv", "Specials", (0, 2, None, "season_bare", 65)),
        ("1999 story.mkv", "Season 1", None),
        ("Nothing.mkv", "", None),
    ],
)
def test_episodes(spark, name, folder, want):
    (got,) = values(spark, names.parsed_episode(F.col("x"), F.col("y")), (name, folder))
    assert (got and tuple(got)[:5]) == want


def test_absolute_numbers_only_if_asked_for(spark):
    (got,) = values(spark, names.parsed_episode(F.col("x"), F.col("y"), absolute=True), ("Show 57.mkv", ""))
    assert tuple(got)[:5] == (0, 57, None, "absolute", 40)


def test_names(spark):
    assert values(spark, names.sanitized(F.col("x")), "A: B/C?", "<x>", "con", " . ", None) == ["A - B C", "x", "con_", "_", None]
    assert values(spark, names.sanitized(F.col("x"), "plan"), "<A>: B", "...") == ["(A) - B", ""]
    assert values(spark, names.sanitized(F.col("x"), "leftover"), "con.x", "A:B") == ["_con.x", "A -B"]
    assert values(spark, names.sanitized(F.col("x"), "segment"), "A: B/C", " . ") == ["A BC", "untitled"]
    assert values(spark, names.letter(F.col("x")), "The Beatles", "  a ha", "9 lives", "Ärzte", "", None) == ["B", "H", "0-9", "_Other", "_Unknown", "_Unknown"]
    assert values(spark, names.variant(F.col("x")), "X.Extended.Cut", "X {edition-Fan} extended", "X extended directors cut", "X") == ["Extended Cut", "Fan", "Extended Director's Cut", None]
    assert values(spark, names.cleaned(F.col("x")), "Song (live (at [x])) feat. Y", "Plain") == ["Song", "Plain"]
    assert values(spark, names.track_of(F.col("x")), "1/12", "11", "x") == ["01", "11", None]
    assert values(spark, names.leading_number(F.col("x")), "07 - x", "1999 x", "x 7") == [7, None, None]
    assert values(spark, names.folder_tokens(F.col("x")), "The Big Show (1999) [x264] 720p", "Disc 2 T00 Mr. Bean's 1080p", "") == [["big"], ["mr", "bean"], [""]][:2] + [[]]
    assert values(spark, names.series_name(F.col("x")), "My.Show.S01E02.720p.mkv", "My Show 1x02.avi") == ["My Show", "My Show"]
    damage = ["CafÃ©", "Café", "Ã© Ä", "Ã© 中", "AlegrÃ\xada", "Ä©", "", "Ã\xa9\nÃ¼", "Â", "Ã\x80 x"]

    def by_python(s):
        if not re.search("[\u00c0-\u00c3][\u0080-\u00bf]", s):
            return s
        try:
            return s.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return s

    assert values(spark, names.repaired(F.col("x")), *damage) == [by_python(s) for s in damage]
    assert values(spark, names.article_sort_key(F.col("x")), "The Hat") == ["t"]


def test_paths(spark):
    assert values(spark, paths.role(F.col("x")), "a/b.MKV", "x-fanart.jpg", "poster.png", "cover.jpg", "a.srt", "b.nfo", "c") == ["video", "fanart", "poster", "image", "subtitle", "nfo", "other"]
    assert values(spark, paths.role(F.col("x"), exact=True), "banner.jpg", "poster.jpg") == ["banner", "poster"]
    assert values(spark, paths.looks_like_extra(F.col("x")), "Extras/a.mkv", "a/outtake.mkv", "a/b.mkv") == [True, True, False]
    assert [tuple(v) for v in values(spark, paths.ids_in_name(F.col("x")), "X (1999) {imdb-tt0123456}", "X {tmdb-7}", "X")] == [("tt0123456", None, 1999), (None, 7, None), (None, None, None)]
    (found,) = values(spark, paths.nfo_ids(F.col("x")), "<movie><title> A </title><year>1999</year><id>tt0123456</movie")
    assert tuple(found) == ("tt0123456", None, "A", 1999)
    assert [(a["depth"], a["folder"]) for a in values(spark, paths.ancestors(F.col("x")), "a/b/c.mkv")[0]] == [(2, "a/b"), (1, "a")]
    assert values(spark, paths.stem(F.col("x")), r"C:\a\b.c.mkv", "x/y.srt") == ["b.c", "y"]


def test_trees(spark):
    files = spark.createDataFrame([(1, "m/A/a.mkv"), (2, "m/A/subs/a.srt"), (3, "m/B.mkv"), (4, "m/B.srt"), (5, "x.txt")], "id int, path string")
    folders = spark.createDataFrame([("m/A",), ("m",)], "folder string")
    assert sorted((r.id, r.nearest) for r in trees.nearest(files, folders, "path").collect()) == [(1, "m/A"), (2, "m/A"), (3, "m"), (4, "m")]
    assert trees.nearest(files, folders.where("folder = 'm'"), "path", max_hops=1).count() == 2
    titles = spark.createDataFrame([("M/a",), ("m/B.mkv",)], "title string")
    got = sorted((r.title, r.id) for r in trees.files_of_titles(titles, files, "title", "path").collect())
    assert got == [("M/a", 1), ("M/a", 2), ("m/B.mkv", 3), ("m/B.mkv", 4)]


def test_keepers(spark):
    assert values(spark, keepers.path_score(F.col("x")), "Rock/a", "Good/Playlist/a", "site.com/a") == [1010, 215, 210]
    files = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 5, "a"), (4, 5, "a"), (5, None, "a")], "id int, size int, text string")
    assert sorted(r.id for r in keepers.same_content(files, "size", "text").collect()) == [3, 4]


def test_completeness(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 3, 5, 7, 8, 3)] + [("b", 4)], "g string, n int")
    assert {r.g: r.ranges for r in completeness.compacted(rows, ["g"], "n").collect()} == {"a": "1-3, 5, 7-8", "b": "4"}
    ladder = completeness.ladder(F.col("x").cast("int"), F.col("y").cast("int"))
    assert values(spark, ladder, ("0", "5"), ("5", "5"), ("9", "10"), ("1", "5"), ("1", "50"), ("1", "0"), (None, None)) == ["missing", "complete", "near_complete", "partial", "barely_started", "no_expected", "no_expected"]
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "mine"), (2, "gone")], [(1, "new"), (3, "new")]))
    assert sorted(map(tuple, completeness.upserted(old, new, ["k"]).collect())) == [(1, "mine", "kept"), (3, "new", "added")]


def test_graph(spark):
    items = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "b", "a"]), (3, ["a", "b", "c", "d"]), (4, ["x"]), (5, []), (6, ["a", "b", "c"])], "id int, ws array<string>")
    got = {(r.a, r.b) for r in graph.similar_pairs(items, "id", "ws", 0.75).collect()}
    assert got == {(1, 2), (1, 6), (1, 3)}
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a int, b int")
    assert {(r.id, r.component) for r in graph.components(links).collect()} == {*((k, 1) for k in range(1, 41)), (100, 100), (101, 100)}


def test_retrieval(spark):
    assert values(spark, retrieval.dialogue(F.col("x")), "<i>Hi</i> [noise]\nJOHN: go (on)") == ["Hi go"]
    assert values(spark, retrieval.query_terms(F.col("x"), 3), "The cat sat; cat mats ran") == [["cat", "sat", "mats"]]


def test_journal(spark, tmp_path):
    lines = [{"ts": f"2024-01-0{k}T00:00:00", "run_id": "r", "title_id": 1, "op": op, "result": res, "from_": "a", "to": "b"} for k, op, res in ((1, "rename", "ok"), (2, "mkdir", "error"), (3, "verify", "ok"), (4, "odd", "ok"))]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    read = tolerant.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert read.count() == 4
    assert sorted((r.op, r.inverse) for r in journal.rollback(read).collect()) == [("odd", "unknown"), ("rename", "move_back")]
    tolerant.append_journal(read.limit(2), str(tmp_path / "out"))
    assert {r.result for r in spark.read.json(str(tmp_path / "out")).collect()} == {"dry-run"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffname,n\nCafé,1\n,2\n".encode())
    (tmp_path / "b.csv").write_bytes("name,n\nCafé,1\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("name,n\nCafé,1\n".encode("utf-16"))
    for name, rows in (("a", [("Café", "1"), (None, "2")]), ("b", [("Café", "1")]), ("c", [("Café", "1")])):
        df = tolerant.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["name", "n"] and [tuple(r) for r in df.collect()] == rows
    (tmp_path / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:03,000 --> 00:00:04,000\nBOB: there [door]\n")
    assert tolerant.read_subtitles(spark, str(tmp_path / "s.srt")).first().text == "Hello there"
    (tmp_path / "l.tsv").write_text("new\told\tmoved\nshort\tline\n")
    assert [tuple(r) for r in tolerant.read_log(spark, str(tmp_path / "l.tsv")).collect()] == [("new", "old", "moved")]
    (tmp_path / "shows.txt").write_text("# list\nOne\n\nTwo\n")
    assert [r.show for r in tolerant.read_show_list(spark, str(tmp_path / "shows.txt")).collect()] == ["One", "Two"]
    assert tolerant.files(spark, str(tmp_path)).where("path like '%.csv'").count() == 3
    cache = spark.createDataFrame([("k1", '{"title": "A"}'), ("k2", '{"__status__": 404}')], "key string, response string")
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "id string")
    found, misses = tolerant.cached(cache, wanted, "id", "title string")
    assert {r.id: r.found and r.found.title for r in found.collect()} == {"k1": "A", "k2": None, "k3": None} and [r.id for r in misses.collect()] == ["k3"]


def test_scores(spark):
    quality = scoring.replacement(*(F.col(c) for c in "abcd"))
    df = spark.createDataFrame([(1, 2, 1.0, 1.0), (2, 1, 1.0, 9.0), (1, 1, 100.0, 104.0), (1, 1, 100.0, 120.0), (None, 1, 1.0, 1.0)], "a int, b int, c double, d double")
    assert [r[0] for r in df.select(quality).collect()] == ["replace", "keep", "keep", "replace", "undecided"]
    assert values(spark, scoring.duration_class(F.col("x").cast("double")), "9", "24", "49", "74", "239", "240") == ["trivial", "tv_short", "tv_episode", "tv_special", "movie", "oversized"]
    assert values(spark, scoring.pruned_reasons(F.col("x"), ("a",)), "a_(sim=0.1); b;; a") == [["b"]]


def test_fuzzy(spark):
    assert values(spark, fuzzy.folded(F.col("x")), "Æon Flüx", "Straße", None) == ["aeon flux", "strasse", None]
    assert values(spark, F.round(fuzzy.sequence_ratio(F.col("x"), F.col("y")), 3), ("abcd", "bcde"), ("", "x"), (None, "x")) == [0.75, 0.0, 0.0]


def test_intake_sees_each_file_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    make = lambda ks: spark.createDataFrame([(k, k, float(k)) for k in ks], "event_id long, user_id long, value double")
    make(range(10)).coalesce(1).write.mode("append").parquet(source)
    assert intake.take_in(spark, source, store).count() == 10
    assert intake.take_in(spark, source, store).count() == 10
    make(range(100, 105)).coalesce(1).write.mode("append").parquet(source)
    assert intake.take_in(spark, source, store).count() == 15


def test_entry_without_the_llm_folders(tmp_path):
    """In a copy without them, the rest registers and runs."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(top, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300).returncode == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_intake_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert intake.take_in(spark, str(tmp_path / "in"), str(tmp_path / "store"), schema="event_id long, user_id long, value double").count() == 0


def test_hints(spark):
    assert values(spark, names.guessed_title(F.col("x")), "BARBIE_AND_THE_DOOR_T00", "03 - Foo (1971)", "1994 - Foo.mkv") == [("Barbie And The Door", None), ("Foo", 1971), ("1994 - Foo", 1994)]
    assert values(spark, names.clean_folder(F.col("x")), "Mr. Show (1995) Season 1-3 PackDvDrip", "30 Rock 2006") == [("Mr Show", 1995), ("30 Rock", 2006)]
    assert values(spark, names.show_hint(F.col("x")), "Blue.Sky.S01E02.mkv", "Go - x.avi") == ["Blue Sky", "Go"]
    assert values(spark, names.title_hint(F.col("x")), "01 - Go Snow Part 4 (720p) x264.mkv", "[ax] Show 1x03 End.avi") == ["Go Snow Part 4", "Show End"]
    assert values(spark, names.extra_label(F.col("x")), "X Extra 2", "X extras", "Extra Ordinary") == ["Extra 2", "Extras", None]
    assert values(spark, names.format_3d(F.col("x")), "X 3D HOU", "X.3D", "X") == ["HOU", "HSBS", None]


def test_similarities(spark):
    pairs = spark.createDataFrame([("Café Ole", "cafe-ole!"), ("The Hat", "hat"), ("", "x"), ("abc", "xyz")], "a string, b string")
    title, name = ([round(r[0], 4) for r in pairs.select(f(F.col("a"), F.col("b"))).collect()] for f in (fuzzy.title_similarity, fuzzy.name_similarity))
    assert title == [1.0, 0.8, 0.0, 0.0]
    assert name == [1.0, round(0.6 * 0.6 + 0.4 * 0.5, 4), 0.0, 0.0]


def test_csv_encoding_is_each_files_own_over_all_its_bytes(spark, tmp_path):
    from shelfwise.sources import tolerant

    plain = "name,n\n" + "plain,1\n" * 10_000
    (tmp_path / "a.csv").write_bytes((plain + "café “x”,2\n").encode("cp1252"))
    (tmp_path / "b.csv").write_bytes((plain + "naïve,3\n").encode("utf-8"))
    found = {r["n"]: r["name"] for r in tolerant.read_csv(spark, str(tmp_path)).distinct().collect()}
    assert found == {"1": "plain", "2": "café “x”", "3": "naïve"}
    assert tolerant.read_csv(spark, str(tmp_path / "a.csv")).where("n = 2").first()["name"] == "café “x”"


def test_csv_of_many_files_in_three_encodings(spark, tmp_path):
    """Columns of all files, quoted line ends, ragged rows, bytes that no Windows character has, and one plan for the folder."""
    for k in range(30):
        text = f"name,n{',more' if k % 5 == 0 else ''}\n\"caf\u00e9, {k}\",{k}{',x' if k % 5 == 0 else ''}\n\n\"two\nlines\",\n short\n"
        encoding = ("utf-8-sig", "cp1252", "utf-16")[k % 3]
        (tmp_path / f"f{k:02}.csv").write_bytes(text.encode(encoding))
    (tmp_path / "z.csv").write_bytes("n,name\n1,\u20acuro\n".encode("cp1252") + b"2,\x81\x80\n3,a\x00b,beyond\n")
    (tmp_path / "zz.csv").write_bytes(b"")
    df = tolerant.read_csv(spark, str(tmp_path))
    assert df.columns == ["name", "n", "more"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == 30 * 3 + 3
    assert sorted(r for r in rows if r[0] and r[0].startswith("caf")) == sorted((f"caf\u00e9, {k}", str(k), "x" if k % 5 == 0 else None) for k in range(30))
    assert rows.count(("two\nlines", None, None)) == 30 and rows.count(("short", None, None)) == 30
    assert {r for r in rows if r[1] in ("1", "2", "3") and not r[0].startswith("caf")} == {("\x80uro", "1", None), ("\x81\x80", "2", None), ("ab", "3", None)}
    assert tolerant.read_csv(spark, str(tmp_path / "zz.csv")).count() == 0
