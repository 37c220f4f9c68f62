"""New files as a stream: outcomes batch by batch, batches tried again, runs that die, and the versions behind them."""

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import intake as plans
from shelfwise.streaming import intake
from shelfwise.streaming.versions import Table, VersionedStore

FILMS = [
    (1, "tt0000001", "Alpha", 1999, None),
    (2, "tt0000002", "Alpha", 2005, None),
    (3, None, "Beta Gamma", 2001, "Greek"),
    (4, "tt0000004", "Solo", 2010, None),
    (5, "tt0000005", "No Year", None, None),
    (4, "tt0000004", "Solo", 2010, None),
]
A1 = "Movies/Alpha (1999) {imdb-tt0000001}/Alpha (1999) {imdb-tt0000001}"
S4 = "Movies/Solo (2010) {imdb-tt0000004}"
BATCHES = [
    [
        ("drop/a/Alpha (1999) {imdb-tt0000001}.mkv", None, 1000, 50),
        ("drop/a/alpha (1999) {IMDB-TT0000001}.en.srt", None, None, None),
        ("drop/a/x {imdb-tt9999999}.mkv", None, 1000, 50),
        ("drop/a/y {tmdb-3}.mp4", None, 1000, 50),
        ("drop/b/Beta.Gamma.2001.1080p.mkv", None, 1000, 50),
        ("drop/c/alpha.avi", None, 1000, 50),
        ("drop/c/rip.mkv", None, 700, 50),
        ("drop/c/RIP.nfo", "<id>tt0000002</id>", None, None),
        ("drop/d/Solo.2010.mp4", None, 1000, 50),
        ("drop/e/solo (2010).mp4", None, 1000, 50),
        ("drop/e/nothing like it.mkv", None, 1000, 50),
        ("drop/e/tt {imdb-tt0000005}.mkv", None, 1000, 50),
        ("drop/e/readme.txt", None, None, None),
        (None, None, 1, 1),
    ],
    [
        ("drop/f/Alpha.1999.mkv", None, 2000, 10),
        ("drop/f/Alpha.1999.de.srt", None, None, None),
        ("drop/g/Solo Extra 2.mkv", None, 10, 10),
        ("drop/g/Solo 3D HSBS.mkv", None, 10, 10),
        ("drop/g/Solo Director's Cut.mkv", None, 10, 10),
        ("drop/g/Alpha (2004).mp4", None, 10, 10),
        ("drop/g/Alpha (2017).mp4", None, 10, 10),
    ],
    [
        ("drop/h/alpha 1999.mkv", None, 1500, 90),
        ("drop/h/Alpha.2005.mkv", None, None, None),
        ("drop/h/Solo Extra 2.mkv", None, 10, 10),
        ("drop/h/Solo 3D.mkv", None, 10, 10),
    ],
]
WANT = [
    {
        "drop/a/Alpha (1999) {imdb-tt0000001}.mkv": (1, 95, "name_imdb", A1 + ".mkv", "install"),
        "drop/a/x {imdb-tt9999999}.mkv": (None, 0, "name_imdb_unknown", None, "unresolved"),
        "drop/a/y {tmdb-3}.mp4": (3, 95, "name_tmdb", "Movies/Greek/Beta Gamma (2001) {tmdb-3}/Beta Gamma (2001) {tmdb-3}.mp4", "install"),
        "drop/b/Beta.Gamma.2001.1080p.mkv": (3, 95, "search", "Movies/Greek/Beta Gamma (2001) {tmdb-3}/Beta Gamma (2001) {tmdb-3}.mkv", "install"),
        "drop/c/alpha.avi": (1, 75, "search_without_year", A1 + ".avi", "install"),
        "drop/c/rip.mkv": (2, 95, "nfo_imdb", A1.replace("1999", "2005").replace("0001", "0002") + ".mkv", "install"),
        "drop/d/Solo.2010.mp4": (4, 30, "search", S4 + "/Solo (2010) {imdb-tt0000004}.mp4", "collision"),
        "drop/e/solo (2010).mp4": (4, 30, "search", S4 + "/Solo (2010) {imdb-tt0000004}.mp4", "collision"),
        "drop/e/nothing like it.mkv": (None, 0, "no_match", None, "unresolved"),
        "drop/e/tt {imdb-tt0000005}.mkv": (5, 95, "name_imdb", None, "unresolved"),
    },
    {
        "drop/f/Alpha.1999.mkv": (1, 95, "search", A1 + ".mkv", "replace"),
        "drop/g/Solo Extra 2.mkv": (4, 75, "search_without_year", S4 + "/Extras/Solo (2010) - Extra 2.mkv", "install"),
        "drop/g/Solo 3D HSBS.mkv": (4, 75, "search_without_year", "3D MKV/Solo (2010) {imdb-tt0000004} - 3D.HSBS.mkv", "install"),
        "drop/g/Solo Director's Cut.mkv": (4, 75, "search_without_year", S4 + "/Solo (2010) {edition-Director's Cut} {imdb-tt0000004}.mkv", "install"),
        "drop/g/Alpha (2004).mp4": (1, 60, "search_without_year", A1 + ".mp4", "collision"),
        "drop/g/Alpha (2017).mp4": (1, 60, "search_without_year", A1 + ".mp4", "collision"),
    },
    {
        "drop/h/alpha 1999.mkv": (1, 95, "search", A1 + ".mkv", "duplicate"),
        "drop/h/Alpha.2005.mkv": (2, 95, "search", A1.replace("1999", "2005").replace("0001", "0002") + ".mkv", "undecided"),
        "drop/h/Solo Extra 2.mkv": (4, 75, "search_without_year", S4 + "/Extras/Solo (2010) - Extra 2.mkv", "exists"),
        "drop/h/Solo 3D.mkv": (4, 75, "search_without_year", "3D MKV/Solo (2010) {imdb-tt0000004} - 3D.HSBS.mkv", "exists"),
    },
]
# two rows of film 4 count as two candidates of one name; contested targets keep 30 at most
WANT[1] = {k: (f, 30 if o == "collision" else c, n, t, o) for k, (f, c, n, t, o) in WANT[1].items()}


@pytest.fixture(scope="module")
def films(spark):
    return spark.createDataFrame(FILMS, "film_id bigint, imdb string, title string, year int, collection string")


def files(spark, k):
    return spark.createDataFrame(BATCHES[k], intake.FILES)


def outcomes(store):
    return {r.path: (r.film_id, r.confidence, r.note, r.target, r.outcome) for r in store.read("outcomes").collect()}


def tables(store):
    return {t: sorted(map(repr, store.read(t).collect())) for t in store.tables}


def test_batches_see_the_library_that_earlier_ones_left(spark, films, tmp_path):
    store, want = intake.film_store(spark, f"file://{tmp_path}/s"), {}
    for k in range(3):
        assert intake.take_batch(store, files(spark, k), films, k)
        want |= WANT[k]
        assert outcomes(store) == want
        before = tables(store)
        assert not intake.take_batch(store, files(spark, 0), films, k)  # tried again, whatever it holds
        assert tables(store) == before and store.version() == k + 1
    held = {r.target: r.pixels for r in store.read("library").collect()}
    assert held[A1 + ".mkv"] == 2000
    moves = [(r.op, r.source, r.to) for r in store.read("moves").orderBy("batch", "path", "place").collect()]
    assert ("move", "drop/a/alpha (1999) {IMDB-TT0000001}.en.srt", A1 + ".en.srt") in moves
    aside = "duplicates/intake_replaced/Alpha (1999) {imdb-tt0000001}/"
    at = moves.index(("set_aside", A1 + ".mkv", aside + "Alpha (1999) {imdb-tt0000001}.mkv"))
    assert moves[at + 1 : at + 4] == [("mkdir", None, A1.rpartition("/")[0]), ("move", "drop/f/Alpha.1999.mkv", A1 + ".mkv"), ("move", "drop/f/Alpha.1999.de.srt", A1 + ".de.srt")]
    assert ("move", "drop/h/alpha 1999.mkv", aside + "alpha 1999.mkv") in moves
    assert not [m for m in moves if m[1] and m[1].startswith(("drop/d/", "drop/e/"))]


def test_one_batch_at_once_finds_its_collisions(spark, films):
    rows = [r for b in BATCHES for r in b if r[0]]
    got = plans.planned(spark.createDataFrame(rows, intake.FILES), films, spark.createDataFrame([], intake.LIBRARY.schema))
    counts = {r.path: (r.wanted, r.outcome) for r in got.collect()}
    assert counts["drop/f/Alpha.1999.mkv"] == (3, "collision") == counts["drop/h/alpha 1999.mkv"]
    assert counts["drop/b/Beta.Gamma.2001.1080p.mkv"] == (1, "install")
    forced = plans.planned(files(spark, 1).where("path like '%(2004)%'"), films, spark.createDataFrame([], intake.LIBRARY.schema), force=True)
    assert [r.outcome for r in forced.collect()] == ["install"]


def test_stream_takes_each_file_in_once(spark, films, tmp_path):
    """Three drops; the second run dies after its commit and before the stream's own, so its batch comes again."""
    drop = f"{tmp_path}/drop"
    store = f"file://{tmp_path}/store"
    files(spark, 0).coalesce(1).write.parquet(drop)
    kept = tables(intake.take_films(spark, drop, films, store))
    commit, calls = intake.VersionedStore.commit, []

    def dies(self, *args):
        calls.append(commit(self, *args))
        raise RuntimeError("lost")

    files(spark, 1).coalesce(1).write.mode("append").parquet(drop)
    intake.VersionedStore.commit = dies
    try:
        with pytest.raises(Exception, match="lost"):
            intake.take_films(spark, drop, films, store)
    finally:
        intake.VersionedStore.commit = commit
    found = intake.film_store(spark, store)
    assert calls == [True] and outcomes(found) == WANT[0] | WANT[1] and tables(found) != kept
    files(spark, 2).coalesce(1).write.mode("append").parquet(drop)
    done = tables(intake.take_films(spark, drop, films, store, files_at_once=1))
    assert outcomes(found) == WANT[0] | WANT[1] | WANT[2]
    assert tables(intake.take_films(spark, drop, films, store)) == done  # nothing new


def test_versions(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/v", {"a": Table("k string, v int, x string", ("k",)), "b": Table("k int, j int", ("k", "j"))}, buckets=4)
    assert store.version() == 0 and store.read("a").count() == 0
    df = lambda rows: spark.createDataFrame(rows, "k string, v int, x string")
    assert store.commit("s", 0, {"a": df([(f"k{i}", i, None) for i in range(20)]), "b": spark.createDataFrame([(1, 2)], "k int, j int")})
    assert store.commit("t", 0, {"a": df([("k3", 33, "x"), ("new", 1, None)])}, {"a": df([("k4", 0, None), ("none", 0, None)])})
    assert not store.commit("s", 0, {"a": df([("k1", 99, None)])}) and not store.committed("s", 1)
    want = {f"k{i}": i for i in range(20) if i != 4} | {"k3": 33, "new": 1}
    assert {r.k: r.v for r in store.read("a").collect()} == want and store.read("b").count() == 1
    assert store.read("a", 1).count() == 20  # versions stay readable

    broken = df([("k1", 1, None)]).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.commit("s", 1, {"b": spark.createDataFrame([(5, 5)], "k int, j int"), "a": broken})
    assert store.version() == 2 and store.read("b").count() == 1  # all tables or none
    assert store.commit("s", 1, {}, {"a": df([(k, 0, None) for k in want])}) and store.read("a").count() == 0
    store.forget()
    assert store.version() == 3 and store.read("b").count() == 1
    other = VersionedStore(spark, f"file://{tmp_path}/v", store.tables, buckets=4)
    assert other.commit("s", 2, {"a": df([("z", 1, None)])}) and store.read("a").count() == 1


def test_matching_resumes_where_it_died(spark, tmp_path):
    """A run that dies between two commits leaves, once resumed, the rows of a run in one go; resets keep transcripts."""
    from shelfwise.streaming import matching

    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    index = spark.createDataFrame([(k, f"show{k % 3}", " ".join(words[k * 10 : k * 10 + 14])) for k in range(28)], "doc bigint, show string, text string")
    files = [(f"f{k}", f"show{k % 3}" if k % 4 else "elsewhere", " ".join(words[k * 10 : k * 10 + 10])) for k in range(28)]
    files += [("silent", "show1", None), ("strange", "show1", "nothing known"), ("both", "show0", words[0] + " " + words[31]), ("f1", "show0", "again"), (None, "show0", "x")]
    df = spark.createDataFrame(files, "path string, show string, transcript string")

    def run(folder, dies):
        store = matching.states(spark, f"file://{tmp_path}/{folder}")
        assert matching.prepare(store, df, 0) and not matching.prepare(store, df, 0)
        if dies:
            commit, calls = VersionedStore.commit, []

            def once(self, *args):
                if len(calls) == 2:
                    raise RuntimeError("lost")
                calls.append(1)
                return commit(self, *args)

            VersionedStore.commit = once
            try:
                with pytest.raises(RuntimeError, match="lost"):
                    matching.identify(store, index, "r", 4)
            finally:
                VersionedStore.commit = commit
        left = matching.identify(store, index, "r", 4)
        assert left == (2 if dies else 4)
        return store

    whole, resumed = run("a", False), run("b", True)
    rows = tables(whole)["states"]
    assert rows == tables(resumed)["states"]
    status = {r.path: (r.status, r.doc, r.score) for r in whole.read("states").collect()}
    assert status["silent"] == ("error", None, None) and status["strange"] == ("no_match", None, 0.0)
    assert status["f5"][:2] == ("ok", 5) and status["f8"][:2] == ("cross_show_match", 8) and status["both"][0] == "low_confidence"
    before = whole.version()
    matching.identify(whole, index, "next", 2)
    assert tables(whole)["states"] == rows and whole.version() == before + 2  # matches across shows were looked at again
    matching.reset(whole, 0)
    again = {r.path: (r.status, r.transcript is None, r.doc) for r in whole.read("states").collect()}
    assert again["f5"] == ("prepared", False, None) and again["silent"] == ("error", True, None)
    matching.reset(whole, 1, include_errors=True)
    assert "silent" not in {r.path for r in whole.read("states").collect()}
    matching.identify(whole, index, "third", 1)
    assert [r for r in tables(whole)["states"] if "silent" not in r] == [r for r in rows if "silent" not in r]
