"""Scoring, rule and fuzzy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import fuzzy, names
from shelfwise.operators import titles
from shelfwise.plans import scoring
from shelfwise.registry import query, read

_KIND = "case when value < 10 then 'trivial' when value < 25 then 'tv_short' when value < 50 then 'tv_episode' when value < 75 then 'tv_special' when value < 240 then 'movie' else 'oversized' end"


@query(f"select event_id, {_KIND} as kind, case when value >= 10 and value < 50 then 'flag' when value >= 75 and value < 240 then 'ok' else 'note' end as severity from events")
def duration_class(spark, d):
    kind = scoring.duration_class(F.col("value"))
    return read(spark, d, "events").select("event_id", kind.alias("kind"), scoring.duration_severity(kind).alias("severity"))


@query(f"select {_KIND} as kind, count(*)::bigint as n, sum(floor(value / 50))::bigint as bands from events group by 1")
def bitrate_histogram(spark, d):
    return read(spark, d, "events").groupBy(scoring.duration_class(F.col("value")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") / 50)).alias("bands"))


@query(f"""
select event_id, {_KIND} as kind, value from events
order by case when value >= 10 and value < 50 then 0 when value >= 75 and value < 240 then 2 else 1 end, value desc, event_id limit 50
""")
def severity_sort(spark, d):
    """The first fifty lines of a report, the gravest first."""
    kind = scoring.duration_class(F.col("value"))
    place = F.when(scoring.duration_severity(kind) == "flag", 0).when(scoring.duration_severity(kind) == "ok", 2).otherwise(1)
    return read(spark, d, "events").orderBy(place, F.desc("value"), "event_id").limit(50).select("event_id", kind.alias("kind"), "value")


_FLAGS = """case o_orderkey % 7 when 0 then 'single-tmdb-match' when 1 then 'multi-match-year-filter-failed' when 2 then 'multi-match-no-year' when 3 then 'year-not-matched' when 4 then 'single-tmdb-match;year-not-matched' else '' end"""


@query(f"""
with f as (select o_orderkey, o_orderkey % 9 = 0 as nfo, (o_orderkey % 101) / 100.0::double as sim, o_orderkey % 4 = 0 as exact, string_split({_FLAGS}, ';') as flags,
  case when o_orderkey % 5 > 0 then 1990 + o_orderkey % 3 end as year, case when o_orderkey % 11 > 0 then 1991 end as fy,
  (80 + o_orderkey % 50)::double as rt, 100.0::double as frt, o_orderkey % 13 = 0 as extra from orders),
g as (select *, abs(year - fy) as gap, abs(rt - frt) / greatest(1, frt) as off from f),
s as (select o_orderkey, greatest(0, least(100,
   case when sim >= 0.9 then 30 when sim >= 0.75 then 18 when sim >= 0.6 then 5 else 0 end + case when gap = 0 then 30 when gap = 1 then 15 else 0 end
 + case when off <= 0.05 then 15 when off <= 0.1 then 6 else 0 end + case when nfo then 50 else 0 end + case when exact then 15 else 0 end
 + case when exact and off <= 0.05 then 15 else 0 end + case when list_contains(flags, 'single-tmdb-match') then 5 else 0 end
 + case when exact then 0 when list_contains(flags, 'multi-match-year-filter-failed') then -15 when list_contains(flags, 'multi-match-no-year') then -10 else 0 end
 + case when list_contains(flags, 'year-not-matched') then -10 else 0 end
 + case when year is null and not nfo and fy is null and not (exact and off <= 0.05) then -10 else 0 end + case when extra then -20 else 0 end))::int as confidence from g)
select *, case when confidence >= 75 and o_orderkey % 6 > 0 then 'AUTO' when confidence >= 30 then 'REVIEW' else 'UNRESOLVED' end as action from s
""")
def confidence_rubric(spark, d):
    """Confidence and action of movie matches."""
    k = F.col("o_orderkey")
    flags = F.split(F.expr(_FLAGS), ";")
    confidence = scoring.movie_confidence(k % 9 == 0, (k % 101) / 100.0, k % 4 == 0, F.when(k % 5 > 0, 1990 + k % 3), F.when(k % 11 > 0, 1991), (80 + k % 50).cast("double"), F.lit(100.0), flags, k % 13 == 0)
    rows = read(spark, d, "orders").select("o_orderkey", confidence.cast("int").alias("confidence"))
    return rows.withColumn("action", scoring.movie_action(F.col("confidence"), F.when(k % 6 > 0, "target").otherwise("")))


@query("""
select o_orderkey, least(100, floor((o_orderkey % 101) / 100.0::double * 50)::int + case when o_orderkey % 4 = 0 then 10 when abs(o_orderkey % 6 - 2) = 0 then 30 when abs(o_orderkey % 6 - 2) <= 1 then 20
  when abs(o_orderkey % 6 - 2) <= 3 then 10 else 0 end + case when o_orderkey % 3 = 0 then 15 else 0 end + case when o_orderkey % 5 = 0 then 5 else 0 end)::int as score from orders
""")
def tv_match_score(spark, d):
    k = F.col("o_orderkey")
    score = scoring.tv_match((k % 101) / 100.0, k % 3 == 0, F.when(k % 4 != 0, k % 6), F.lit(2), k % 5 == 0)
    return read(spark, d, "orders").select("o_orderkey", score.cast("int").alias("score"))


@query("""
with f as (select o_orderkey, o_orderkey % 10 = 0 as id, case when o_orderkey % 3 > 0 then o_orderkey % 4 end as year, o_orderkey % 2 = 0 as exact, o_orderkey % 6 + 1 as n from orders)
select o_orderkey, case when id then 95 when year = 1 and n <= 3 then 95 when year = 1 then 85 when abs(year - 1) <= 1 and exact and n <= 3 then 85 when abs(year - 1) <= 1 and exact then 75
  when year is not null then 60 when n = 1 then 80 when exact and n <= 3 then 75 when exact then 60 else 40 end::int as confidence from f
""")
def intake_ladder(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", scoring.intake_confidence(k % 10 == 0, F.when(k % 3 > 0, k % 4), F.lit(1), k % 2 == 0, k % 6 + 1).alias("confidence"))


@query("""
with p as (select l_orderkey, l_linenumber, min(l_quantity) as op, max(l_quantity) as np, min(l_extendedprice) as o, max(l_extendedprice) as n from lineitem group by all)
select l_orderkey, l_linenumber, case when np > op then 'replace' when np < op then 'keep' when o > 0 and abs(n - o) / o < 0.05 then 'keep' when n > o then 'replace' else 'keep' end as decision from p
""")
def quality_decision(spark, d):
    """Whether the better of two copies replaces the other."""
    lows = [f("l_quantity").alias(n) for f, n in ((F.min, "op"), (F.max, "np"))] + [f("l_extendedprice").alias(n) for f, n in ((F.min, "o"), (F.max, "n"))]
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*lows)
    return rows.select("l_orderkey", "l_linenumber", scoring.replacement(F.col("op"), F.col("np"), F.col("o"), F.col("n")).alias("decision"))


_EPISODE_COPIES = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 9 = 0 as same_path, l_partkey % 4 > 0 as there, l_partkey % 3 * 360 as old_height, l_suppkey % 3 * 360 as new_height,
  case when l_partkey % 5 > 0 then l_linenumber % 2 end as old_rate, l_suppkey % 2 as new_rate, cast(floor(l_quantity / 10) as bigint) as old_size, cast(l_linenumber as bigint) as new_size from lineitem"""


@query(f"""
with c as ({_EPISODE_COPIES})
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when same_path then 'skip' when not there then 'move'
  when new_height <> old_height then case when new_height > old_height then 'replace' else 'discard_new' end when new_rate <> coalesce(old_rate, 0) then case when new_rate > coalesce(old_rate, 0) then 'replace' else 'discard_new' end
  when new_size > old_size then 'replace' when new_size < old_size then 'discard_new' else 'tie' end as decision from c
""")
def episode_quality_decision(spark, d):
    """Whether a new copy of an episode replaces the one that is there, by height, then bitrate, then size."""
    read(spark, d, "lineitem").createOrReplaceTempView("_copies_lineitem")
    rows = spark.sql(_EPISODE_COPIES.replace("from lineitem", "from _copies_lineitem"))
    keys = [tuple(F.col(f"{when}_{what}") for what in ("height", "rate", "size")) for when in ("old", "new")]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.episode_replacement(F.col("same_path"), F.col("there"), *keys).alias("decision"))


_ALBUMS = "select p_partkey, p_name, p_brand, p_type, count(distinct l_suppkey) as artists from part join lineitem on l_partkey = p_partkey group by all"


@query(f"""
select p_partkey, artists::bigint as artists, least(1.0, case when p_brand = 'Brand#1' then 0.6 else 0 end + case when p_type = 'SMALL' then 0.4 else 0 end + case when p_name like 'red %' then 0.5 else 0 end
   + case when artists >= 3 then 0.5 else 0 end)::double as score from ({_ALBUMS})
""")
def compilation_suspicion(spark, d):
    """Albums that look like compilations."""
    artists = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("artists"))
    score = scoring.compilation_suspicion(F.col("p_brand") == "Brand#1", F.col("p_type") == "SMALL", F.col("p_name").startswith("red "), F.col("artists"))
    return read(spark, d, "part").join(artists, "p_partkey").select("p_partkey", "artists", score.alias("score"))


@query("select p_name, count(distinct l_suppkey)::bigint as artists from part join lineitem on l_partkey = p_partkey group by 1 having count(distinct l_suppkey) >= 3")
def shared_by_three(spark, d):
    """Albums of one name under three artists or more."""
    parts = read(spark, d, "part").join(read(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    return parts.groupBy("p_name").agg(F.count_distinct("l_suppkey").alias("artists")).where("artists >= 3")


@query("""
with c as (select source, lang, count(*) as n from documents group by all), g as (select source, sum(n) as files, count(lang) as artists, max(n) as top from c group by 1)
select source, case when artists = 1 then 'ARTIST' when artists <= 3 and top / files >= 0.7 then 'ARTIST' when top / files >= 0.6 then 'ARTIST' when artists >= 20 and top / files < 0.2 then 'COMPILATION'
  when artists >= 8 and top / files < 0.4 then 'COMPILATION' else 'REVIEW' end as category from g
""")
def folder_category(spark, d):
    counts = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    folders = counts.groupBy("source").agg(F.sum("n").alias("files"), F.count("lang").alias("artists"), F.max("n").alias("top"))
    return folders.select("source", scoring.folder_category(F.col("files"), F.col("files"), F.col("artists"), F.col("top") / F.col("files")).alias("category"))


@query("""
select o_orderkey, case when o_orderkey % 2 = 0 then 'artist_too_short' when o_orderkey % 3 = 0 then 'many_changes_(sim=0.4)' else '' end as reasons from orders
""")
def reason_pruning(spark, d):
    """Review reasons that are left once those that need no review are dropped."""
    k = F.col("o_orderkey")
    notes = F.concat_ws("; ", F.lit("tag-disagree_(sim=0.2)"), F.when(k % 2 == 0, "artist_too_short"), F.when((k % 3 == 0) & (k % 2 != 0), "many_changes_(sim=0.4)"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(scoring.pruned_reasons(notes, ("tag-disagree",)), "; ").alias("reasons"))


@query("""
with c as (select conv_id, turn, case conv_id % 11 when 0 then 'error' when 1 then 'no_match' else 'match' end as status, (85 + turn % 16) / 100.0::double as s, conv_id % 9 > 0 as named, (conv_id % 11) / 10.0::double as tw, (turn % 7) / 6.0::double as aw,
  (conv_id % 13) / 12.0::double as t, ((conv_id + turn) % 5) / 4.0::double as a, conv_id % 4 > 0 as hint from conversations), b as (select *, greatest(t, tw) as bt, greatest(a, aw) as ba from c)
select conv_id, turn, case when status <> 'match' then 'SKIP_' || status when not named then 'SKIP_empty_match' when s >= 0.9 and tw >= 0.7 and aw >= 0.5 then 'AUTO_APPLY' when s >= 0.9 and tw >= 0.7 then 'AUTO_APPLY_OK'
  when s >= 0.9 and aw >= 0.7 and bt >= 0.4 then 'AUTO_APPLY_OK' when s >= 0.95 and bt >= 0.7 and ba >= 0.5 then 'AUTO_APPLY' when s >= 0.95 and bt >= 0.6 then 'AUTO_APPLY_OK' when s >= 0.95 and not hint then 'REVIEW_NO_HINT'
  when s >= 0.9 and (bt >= 0.4 or ba >= 0.5) then 'REVIEW_PARTIAL' when s >= 0.9 then 'REVIEW_HIGH' else 'REVIEW_LOW' end as class from b
""")
def acoustid_class(spark, d):
    """Classes of fingerprint matches; similarities are columns here, so that the rules have an SQL form."""
    k, t = F.col("conv_id"), F.col("turn")
    status = F.when(k % 11 == 0, "error").when(k % 11 == 1, "no_match").otherwise("match")
    kind = scoring.acoustid_class(status, (85 + t % 16) / 100.0, k % 9 > 0, (k % 11) / 10.0, (t % 7) / 6.0, (k % 13) / 12.0, ((k + t) % 5) / 4.0, k % 4 > 0)
    return read(spark, d, "conversations").select("conv_id", "turn", kind.alias("class"))


@query()
def title_similarity_best(spark, d):
    """For each kind of part the other kind whose name is most like it, and the margin to the next. Distinct names meet in blocks,
    where only those are scored whose letters and words leave enough possible."""
    kinds = [read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").cast("long").alias(i)).select(F.lit(0).alias("key"), i, fuzzy.plain(F.col("p_name")).alias("name")) for i in ("id", "other")]
    best = titles.with_gap(titles.two_best_in_group(*kinds))
    score, margin = F.round("score", 6), F.round(F.col("gap"), 6)
    sure = F.when((score >= 0.85) & (margin >= 0.2), "HIGH").when(score >= 0.55, "MEDIUM").otherwise("NONE")
    return best.select(F.col("id").alias("ia"), F.col("other").alias("ib"), score.alias("score"), margin.alias("margin"), sure.alias("sure"))


def _named_parts(spark, d):
    """Titles of some length out of parts: (p_partkey, p_brand, p_size, title)."""
    letters = F.translate(F.col("p_partkey").cast("string"), "0123456789", "aeioudntrs")
    return read(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.concat_ws(" ", F.lit("The"), "p_name", letters, F.lower("p_type")).alias("title"))


def _mistaken(title, k):
    """A title as somebody typed it: with dots, a letter too many, without its first words, with more at its end, or another."""
    cut = F.regexp_replace(title, r"^\S+ \S+ ", "")
    return F.when(k % 6 == 0, F.upper(F.replace(title, F.lit(" "), F.lit(".")))).when(k % 6 == 1, F.regexp_replace(title, "([aeiou])([^aeiou]*)$", "$1$1$2")).when(k % 6 == 2, cut).when(k % 6 == 3, F.concat(title, F.lit(" uncut"))).when(k % 6 == 4, F.reverse(title)).otherwise(F.concat(F.lit("Thé "), F.substring(title, 5, 100)))


@query()
def series_plan_match(spark, d):
    """The row of a plan that each new name means: one of the same plain name, else the most like it if it is like enough."""
    plan = _named_parts(spark, d)
    k = F.col("o_orderkey")
    named = read(spark, d, "orders").join(plan.select("p_partkey", "title"), F.col("o_custkey") == F.col("p_partkey"))
    guesses = named.select(k.alias("id"), _mistaken(F.col("title"), k).alias("name"))
    found = titles.best_in_plan(guesses, plan.select(F.col("p_partkey").alias("row"), F.col("title").alias("name")))
    return found.select(F.col("id").alias("o_orderkey"), F.col("row").alias("p_partkey"), F.round("score", 6).alias("score"))


@query()
def episode_title_match(spark, d):
    """Which episode of its series a file's title means, and how sure that is, out of all titles of a brand."""
    plan = _named_parts(spark, d)
    k = F.col("o_orderkey")
    named = read(spark, d, "orders").join(plan, F.col("o_custkey") == F.col("p_partkey"))
    file = F.concat(F.lpad((k % 40).cast("string"), 2, "0"), F.lit(" - "), _mistaken(F.col("title"), k), F.lit(" [720p].mkv"))
    files = named.select(F.col("p_brand").alias("key"), k.alias("id"), names.title_hint(file).alias("hint"))
    found = titles.episode_of_hint(files, plan.select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("other"), "title"))
    return found.select(F.col("id").alias("o_orderkey"), F.col("other").alias("p_partkey"), F.round("score", 6).alias("score"), "verdict")


@query()
def name_similarity_top5(spark, d):
    """The five nations whose names are most like each nation's, of all others; nations are a list of bounded size."""
    nations = read(spark, d, "nation").select("n_nationkey", "n_name")
    pairs = nations.join(nations.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("o_name")), F.col("n_nationkey") != F.col("other"))
    scored = pairs.withColumn("score", F.round(fuzzy.name_similarity(F.col("n_name"), F.col("o_name")), 6))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "other"))), 1, 5)
    return scored.groupBy("n_nationkey").agg(F.transform(top, lambda x: x["other"]).alias("others"))


@query()
def intake_stream(spark, d):
    """New files taken in by a stream that stops when it has seen what is there; statuses by the batch operators."""
    from shelfwise.streaming.intake import take_in

    return take_in(spark, f"{d}/events.parquet")
