"""What grows no faster than the input: rows inside a plan, and tables that are not collected at the driver."""

import random

from pyspark.sql import functions as F

from shelfwise import registry
from shelfwise.operators import completeness, graph, retrieval, staging, titles, trees
from shelfwise.plans import intake, music, stages
from shelfwise.streaming import matching


def nodes(df):
    """All operators of a query that has run, through the stages of adaptive execution."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    left = [execution.executedPlan()]
    while left:
        node = left.pop()
        yield node
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        left += [node.children().apply(k) for k in range(node.children().size())]


def most_rows(df):
    """The most rows that an operator gave out."""
    counts = (node.metrics().get("numOutputRows") for node in nodes(df))
    return max(c.get().value() for c in counts if c.isDefined())


def test_names_of_a_plan_are_not_collected(spark):
    """A name has hundreds of runs, and Spark takes them for as few as the names."""
    names = spark.range(50).select(F.col("id").alias("row"), F.concat(F.lit("big ring "), F.md5(F.col("id").cast("string"))).alias("name"))
    found = titles.best_in_plan(names.select(F.col("row").alias("id"), F.concat("name", F.lit(" uncut")).alias("name")), names)
    assert found.where("row = id").count() == 50
    assert not [n for n in nodes(found) if n.getClass().getSimpleName() == "BroadcastHashJoinExec"]


def test_names_of_a_plan_make_few_rows(spark):
    """A name made a row for each run of its words with each other word and size, some sixty."""
    n = 3000
    word = lambda *some: F.element_at(F.array(*map(F.lit, some)), (F.col("id") % len(some) + 1).cast("int"))
    plan = spark.range(n).select(F.col("id").alias("row"), F.concat_ws(" ", F.lit("the"), word("red", "blue", "old"), word("ring", "bolt"), F.md5(F.col("id").cast("string")), word("large", "small", "promo", "medium", "economy")).alias("name"))
    guesses = plan.select(F.col("row").alias("id"), F.concat("name", F.when(F.col("row") % 2 == 0, " uncut").otherwise("")).alias("name"))
    guesses = guesses.select("id", F.when(F.col("id") % 3 == 0, F.regexp_replace("name", r"^\S+ \S+ ", "")).otherwise(F.col("name")).alias("name"))
    found = titles.best_in_plan(guesses, plan)
    assert most_rows(found) <= 4 * n
    assert found.where("row = id").count() == n - n // 6  # cut and longer by a word: 3 of 5 words shared, neither inside the other


def test_shows_and_folders_of_one_name_make_no_pairs(spark):
    n = 2000
    shows = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("Show"), F.when(F.col("id") % 2 == 0, " X").otherwise("")).alias("name"), F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).alias("tmdb"))
    folders = spark.range(n).select(F.col("id").alias("o"), F.concat(F.lit("The Show"), F.when(F.col("id") % 3 == 0, F.lit(" X (1999)")).when(F.col("id") % 3 == 1, F.concat(F.lit(" {tmdb-"), F.col("id").cast("string"), F.lit("}"))).otherwise("")).alias("folder"))
    got = trees.folder_of_each(shows, folders, "k", "name", "tmdb", "folder", "o")
    assert most_rows(got) <= 20 * n
    for r in got.collect():
        by_id = r.k % 50 == 0 and r.k % 3 == 1
        want = (f"The Show {{tmdb-{r.k}}}", 1) if by_id else ("The Show X (1999)", 2) if r.k % 2 == 0 else ("The Show", 2)
        assert (r.folder, r.tier) == want
    assert got.count() == n


def test_films_of_an_intake_are_not_collected(spark):
    """Files that compress well are taken for small, so films were collected at the driver once for each way of finding one."""
    files = spark.range(20).select(F.concat(F.lit("drop/a film "), "id", F.lit(" (1999).mkv")).alias("path"), F.lit(None).cast("string").alias("content"), F.lit(1).cast("long").alias("pixels"), F.lit(1).cast("long").alias("bitrate"))
    films = spark.range(20).select(F.col("id").alias("film_id"), F.lit(None).cast("string").alias("imdb"), F.concat(F.lit("a film "), "id").alias("title"), F.lit(1999).alias("year"), F.lit(None).cast("string").alias("collection"))
    library = spark.createDataFrame([], "key string, path string, pixels long, bitrate long")
    out = intake.planned(files, films, library)
    assert out.where("outcome = 'install'").count() == 20
    assert not [n for n in nodes(out) if n.getClass().getSimpleName() == "BroadcastHashJoinExec"]


def test_partitions_follow_the_files(spark, monkeypatch, tmp_path):
    """Where files ask for more partitions than the session has, ranks, gaps and actions are dealt into them, once."""
    monkeypatch.setattr(staging, "PART_BYTES", 1000)
    spark.range(20000).selectExpr("id % 50 as l_partkey", "id as l_orderkey", "cast(1 as int) as l_linenumber", "double(id) as l_quantity", "0d as l_extendedprice", "0d as l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    ranked = registry.QUERIES["video_cluster_rank"](spark, str(tmp_path))
    assert ranked.where("rank = 0 and keep = 'KEEP'").count() == 50
    source = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    gaps = completeness.lacking(spark.range(40).selectExpr("id % 4 as s", "id as e"), spark.range(0, 40, 2).selectExpr("id % 4 as s", "id as e"), ["s"], "e", source)
    assert sorted(r.e for r in gaps.collect()) == list(range(1, 40, 2))
    for df in (ranked, completeness.compacted(gaps, ["s"], "e")):
        dealt = [n.outputPartitioning().numPartitions() for n in nodes(df) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
        assert dealt and min(dealt) > 4


def test_texts_of_an_index_are_cut_into_terms_once(spark, monkeypatch, tmp_path):
    cut, terms = [], retrieval.terms
    monkeypatch.setattr(retrieval, "terms", lambda *a, **k: cut.append(1) or terms(*a, **k))
    store = matching.states(spark, f"file://{tmp_path}/states")
    texts = [(k, "s", f"alpha beta word{'abcdefghij'[k]}") for k in range(10)]
    matching.prepare(store, spark.createDataFrame([(str(k), "s", t) for k, _, t in texts], "path string, show string, transcript string"), 0)
    assert matching.identify(store, spark.createDataFrame([*texts, (10, "s", None)], "doc long, show string, text string"), "first", 3) == 3
    assert {int(r.path): r.doc for r in store.read("states").collect()} == {k: k for k in range(10)}
    assert len(cut) == 2  # the texts, and the transcripts


def test_names_that_share_words_make_no_pairs(spark):
    """Every second name holds the same two words, every third two others; the links are as few as the sets of words."""
    n = 1500
    names = spark.range(n).select("id", F.array(F.lit("often"), F.lit("brands"), F.when(F.col("id") % 2 == 0, "even").otherwise("odds"), F.concat(F.lit("k"), (F.col("id") / 5).cast("int").cast("string"))).alias("tokens"), (F.col("id") % 7 == 0).alias("numbered"))
    made = []
    kept, graph.components = graph.components, lambda links, rows=None: made.append(links) or kept(links, rows)
    try:
        assert graph.merge_groups(names).count() == 0  # one group of more than a hundred
    finally:
        graph.components = kept
    assert made[0].count() <= 20 * n


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "abcd", "abcdef", "ghijk", "lmnopqr", "st", "uvw", *(f"w{k}" for k in range(40))]
    items = [(k, rng.choices(words, k=rng.randint(1, 6)), rng.random() < 0.3) for k in range(160)]
    top = list(range(len(items)))
    for a, wa, na in items:
        for b, wb, nb in items[:a]:
            x, y = set(wa), set(wb)
            both = x & y
            m, chars = len(both), sum(map(len, both))
            inside = (both == x and na or both == y and nb) and chars >= 6
            if both and (x == y or inside or m >= 2 and m / min(len(x), len(y)) >= 0.5 and chars >= 8 or m >= 3 or m / len(x | y) >= 0.7):
                low, high = sorted((top[a], top[b]))
                top = [low if t == high else t for t in top]
    want = {}
    for k, t in enumerate(top):
        want.setdefault(t, []).append(k)
    shared = lambda g: set.intersection(*(set(items[k][1]) for k in g))
    want = {k: t for t, g in want.items() if 2 <= len(g) <= 200 and (shared(g) or 2 * sum(items[k][2] for k in g) >= len(g)) for k in g}
    got = graph.merge_groups(spark.createDataFrame(items, "id long, tokens array<string>, numbered boolean"), 2, 200)
    assert {r.id: r.component for r in got.collect()} == want
    assert want


def test_files_of_a_folder_meet_titles_by_the_starts_of_names(spark):
    """A join by folder alone tries all titles of a folder with all its files and holds their names against each other after that."""
    names = ["10.html", "1.html", "100.txt", "2.html", "A.HTML", "abc.html", ".html", "b"]
    files = spark.createDataFrame([(k, f"{folder}/{n}") for k, (folder, n) in enumerate((f, n) for f in ("h/x", "H/X", "h/y") for n in names)], "id long, path string")
    titles = files.where("lower(path) like '%.html'").select(F.col("path").alias("title"))
    got = trees.files_of_titles(titles, files, "title", "path")
    low = lambda p: (p.rpartition("/")[0].lower(), p.rpartition("/")[2].rpartition(".")[0].lower() if "." in p else p.rpartition("/")[2].lower())
    held = [(r.id, r.path) for r in files.collect()]
    want = {(t, k) for _, t in held if t.lower().endswith(".html") for k, p in held if low(t)[0] == low(p)[0] and low(p)[1].startswith(low(t)[1])}
    assert sorted((r.title, r.id) for r in got.collect()) == sorted(want)
    assert not [n for n in nodes(got) if "Join" in n.getClass().getSimpleName() and n.condition().isDefined()]


def test_actions_of_files_sort_no_files(spark):
    """Sorts of all files for each kind of action added up in a task; files stream past their titles instead."""
    rows = [(t, f"old/{t}/{k % 2}/f{k}.{e}", f"f{k}.{e}", e, role) for t in range(20) for k, (e, role) in enumerate((("mkv", "main_video" if t else "extra"), ("en.srt", "sidecar"), ("nfo", "nfo"), ("mkv", "extra"), ("mkv", "extra")))]
    files = spark.createDataFrame(rows, "title_id long, path string, name string, ext string, role string")
    out = stages.actions(spark.range(21).selectExpr("id as title_id", "concat('T/', id) as target", "concat('t', id) as stem"), files)
    found = [n for n in nodes(out) if n.getClass().getSimpleName() in ("SortMergeJoinExec", "BroadcastHashJoinExec")]
    assert not found
    assert sorted(map(tuple, out.where("title_id in (0, 20)").collect())) == [(0, "A", "fail", None, None), (20, "A", "fail", None, None)]
    assert sorted((r.stage, r.op, r.source or "", r.target or "") for r in out.where("title_id = 7").collect()) == [
        ("B", "mkdir", "", "T/7"), ("C", "move", "old/7/0/f0.mkv", "T/7/t7.mkv"), ("D", "move", "old/7/1/f1.en.srt", "T/7/t7.en.srt"), ("E", "backup", "T/7/t7.nfo", "T/7/t7.nfo.bak"), ("E", "write_file", "", "T/7/t7.nfo"),
        ("F", "mkdir", "", "T/7/Extras"), ("F", "move", "old/7/0/f4.mkv", "T/7/Extras/f4.mkv"), ("F", "move", "old/7/1/f3.mkv", "T/7/Extras/f3.mkv"), ("G", "rmdir", "old/7/0", ""), ("G", "rmdir", "old/7/1", ""),
    ]


def test_names_of_tracks_are_cleaned_once(spark):
    """In each branch of the path by itself, a name was cleaned again wherever a step of the cleaning named it: 408 times."""
    tags = [f"cast(null as string) as {c}" for c in ("artist", "album", "title", "track", "date")]
    out = music.routed(spark.range(3).selectExpr("if(id = 0, 'ARTIST', if(id = 1, 'SOUNDEFFECTS', 'RADIO')) as bucket", "concat('The B:d/x/con/0', id, ' - a?b. .mp3') as path", *tags))
    assert sorted(r.new_path for r in out.collect()) == ["B/The B - d/con_/ab.mp3", "Radio/x/con_/02 - ab.mp3", "Sound Effects/x/con_/01 - ab.mp3"]
    assert out._jdf.queryExecution().executedPlan().toString().count("regexp_replace") < 100
