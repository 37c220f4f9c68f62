"""Queries of single rules: winners, groups, membership and labels that the other catalogue modules do not show."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import names
from shelfwise.operators import collisions, keepers, ordering
from shelfwise.plans import scoring
from shelfwise.registry import query, read


@query("select event_id, least(greatest(30.0::double, value * 0.2::double), greatest(0.0::double, value - 91)) as start from events")
def sample_windows(spark, d):
    """Where a sample of 90 seconds starts: a fifth into the file, 30 seconds at least, inside the file if it is long enough."""
    start = F.least(F.greatest(F.lit(30.0), F.col("value") * 0.2), F.greatest(F.lit(0.0), F.col("value") - 91))
    return read(spark, d, "events").select("event_id", start.alias("start"))


@query("select o_orderkey, case when o_orderkey >= 3600 then printf('%dh%02dm', o_orderkey // 3600, o_orderkey % 3600 // 60) else printf('%dm%02ds', o_orderkey // 60, o_orderkey % 60) end as eta from orders")
def eta_labels(spark, d):
    """Seconds as hours and minutes, or minutes and seconds."""
    s = F.col("o_orderkey")
    part = lambda form, a, b: F.format_string(form, F.floor(a), F.floor(b))
    eta = F.when(s >= 3600, part("%dh%02dm", s / 3600, s % 3600 / 60)).otherwise(part("%dm%02ds", s / 60, s % 60))
    return read(spark, d, "orders").select("o_orderkey", eta.alias("eta"))


@query("""
select l_partkey, l_orderkey, l_linenumber from lineitem
qualify row_number() over (partition by l_partkey order by case l_returnflag when 'R' then 0 when 'N' then 1 else 2 end, l_quantity desc, l_orderkey, l_linenumber) = 1
""")
def best_image(spark, d):
    """One image for each title: by the rank of its language, then votes."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return keepers.best(read(spark, d, "lineitem"), ["l_partkey"], F.struct(rank, -F.col("l_quantity"), "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


_IMAGES = """select l_partkey, l_orderkey, l_linenumber, l_suppkey, case l_suppkey % 4 when 0 then 'en' when 1 then null when 2 then '' else 'de' end as lang, case when l_partkey % 5 > 0 then cast(l_linenumber % 3 as double) end as vote, case when l_orderkey % 6 > 0 then l_orderkey % 9 * 100 end as width,
  l_suppkey % 3 * 150 as height, l_orderkey % 7 as likes from lineitem"""
_IMAGE_TIES = "l_orderkey, l_linenumber, l_suppkey"
_IMAGE_SQL = {
    "poster": "case coalesce(lang, '') when 'en' then 0 when '' then 1 else 2 end, coalesce(vote, 0) desc, trunc(coalesce(width, 0) / greatest(case when height = 0 then 1 else height end, 1) * 1000)",
    "wide": "case coalesce(lang, '') when 'en' then 0 when '' then 1 else 2 end, coalesce(vote, 0) desc, trunc(-(coalesce(width, 0) / greatest(case when height = 0 then 1 else height end, 1)) * 1000)",
    "logo": "case lower(coalesce(lang, '')) when 'en' then 0 when '' then 1 when '00' then 1 else 2 end, likes desc",
    "series": "case when lang = 'en' then 0 when lang is null then 1 else 2 end, coalesce(vote, 0) desc, coalesce(width, 0) desc",
}


def _image_query(kind: str):
    def best(spark, d):
        read(spark, d, "lineitem").createOrReplaceTempView("_images_lineitem")
        rows = spark.sql(_IMAGES.replace("from lineitem", "from _images_lineitem"))
        placed = keepers.best_first(rows, ["l_partkey"], [*keepers.image_order(kind), *_IMAGE_TIES.split(", ")])
        return placed.where("place = 1").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")

    best.__name__ = f"best_{kind}_image"
    best.__doc__ = f"The {kind} image of each title that its ranking puts first."
    query(f"with i as ({_IMAGES}) select l_partkey, l_orderkey, l_linenumber, l_suppkey from i qualify row_number() over (partition by l_partkey order by {_IMAGE_SQL[kind]}, {_IMAGE_TIES}) = 1")(best)


for _kind in _IMAGE_SQL:
    _image_query(_kind)


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by value desc nulls last, event_id) = 1")
def most_downloaded(spark, d):
    """The most downloaded subtitle of each episode; the first of equals."""
    return keepers.best(read(spark, d, "events"), ["user_id", "event_type"], F.struct(F.col("value").isNull(), -F.col("value"), "event_id"), "event_id")


@query("""
with o as (select *, nullif(o_orderkey % 5, 0) as id from orders)
select o_custkey, count(*)::bigint as n, min(o_orderkey) as primary_id,
       case when count(distinct id) = 1 and count(id) = count(*) then 'merge' else 'conflict' end as verdict
from o group by 1 having count(*) > 1
""")
def merge_groups(spark, d):
    """Plan rows with one target: merged if all have the same known id, else in conflict."""
    rows = read(spark, d, "orders").withColumn("id", F.nullif(F.col("o_orderkey") % 5, F.lit(0)))
    same = (F.min("id") == F.max("id")) & (F.count("id") == F.count("*"))
    verdict = F.when(same, "merge").otherwise("conflict").alias("verdict")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("primary_id"), verdict).where("n > 1")


@query("""
with f as (select user_id, event_type, count(*)::bigint as files from events group by all)
select user_id, count(*)::bigint as folders, first(event_type order by files desc, event_type) as keeper, sum(files)::bigint as files from f group by 1 having count(*) > 1
""")
def folders_of_one_id(spark, d):
    """Ids that several folders claim; the folder with most files keeps it."""
    folders = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("files"))
    keeper = F.min_by("event_type", F.struct(-F.col("files"), "event_type")).alias("keeper")
    return folders.groupBy("user_id").agg(F.count("*").alias("folders"), keeper, F.sum("files").alias("files")).where("folders > 1")


@query("""
select source as drive, sum(n_chars)::bigint as need, sum(n_chars) * 105 <= 100 * 1000000 as fits from documents where lang <> 'en' group by 1
""")
def drive_needs(spark, d):
    """Bytes that move to each drive from others, and whether they fit with a twentieth to spare."""
    moved = read(spark, d, "documents").where("lang <> 'en'").groupBy(F.col("source").alias("drive")).agg(F.sum("n_chars").cast("long").alias("need"))
    return moved.withColumn("fits", F.col("need") * 105 <= 100 * 1_000_000)


@query("select l_partkey, l_suppkey, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) = 1")
def first_wins(spark, d):
    """Of rows with equal keys, the first inserted."""
    return keepers.best(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], F.struct("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""
with p as (select p_partkey, p_name, row_number() over (partition by lower(p_name) order by p_partkey) as n from part)
select p_partkey, p_name || case when n > 1 then '.' || n else '' end as name from p
""")
def collision_suffixes(spark, d):
    """Names made distinct: the second of equal ones gets .2, the third .3."""
    wants = read(spark, d, "part").select(F.lit("").alias("folder"), F.col("p_partkey").alias("place"), F.col("p_name").alias("name"))
    return collisions.distinct_names(wants).select(F.col("place").alias("p_partkey"), F.col("final").alias("name"))


_WANTED = "case l_suppkey % 7 when 0 then 'film.en.srt' when 1 then 'Film.en.srt' when 2 then 'film.en.2.srt' when 3 then 'film.en.3.srt' when 4 then 'film.en.2.2.srt' when 5 then 'film.nfo' else 'film.en.srt' end"


@query(rf"""
with recursive w as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as place, {_WANTED} as name from lineitem),
r as (select l_orderkey, 1 as place, name, case when lower(name) = 'film.nfo' then 'film.2.nfo' else name end as final, ['film.nfo', case when lower(name) = 'film.nfo' then 'film.2.nfo' else lower(name) end] as seen from w where place = 1
  union all select l_orderkey, place, name, final, list_append(seen, lower(final)) from (
    select w.l_orderkey, w.place, w.name, seen, case when not list_contains(seen, lower(w.name)) then w.name
      else regexp_replace(w.name, '\.[^.]*$', '') || '.' || list_min([i for i in range(2, 60) if not list_contains(seen, lower(regexp_replace(w.name, '\.[^.]*$', '') || '.' || i || regexp_extract(w.name, '\.[^.]*$')))]) || regexp_extract(w.name, '\.[^.]*$') end as final
    from r join w on w.l_orderkey = r.l_orderkey and w.place = r.place + 1))
select l_orderkey, cast(place as bigint) as place, name, final from r
""")
def collision_chains(spark, d):
    """Names of an order's files beside a film.nfo that is there: numbered ones never meet files that bear such a name."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.expr(_WANTED).alias("name"))
    placed = ordering.running(lines, [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")], ("l_orderkey",))
    wants = placed.select(F.col("l_orderkey").alias("folder"), "place", "name")
    there = wants.select("folder", F.lit("film.nfo").alias("name")).distinct()
    return collisions.distinct_names(wants, there).select(F.col("folder").alias("l_orderkey"), "place", "name", "final")


@query("""
with l as (select *, row_number() over (partition by l_orderkey order by l_returnflag = 'R', l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) = 1 as main from lineitem)
select l_orderkey, l_linenumber, l_partkey, case when main then 'main' when l_extendedprice >= 50000 then 'extra_large' else 'extra' end as kind from l
""")
def main_video(spark, d):
    """A folder's main video: the largest that isn't an extra, else the largest; the others are extras, large ones marked."""
    files = read(spark, d, "lineitem")
    order = [F.col("l_returnflag") == "R", F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"]
    placed = keepers.best_first(files, ["l_orderkey"], order)
    kind = F.when(F.col("place") == 1, "main").when(F.col("l_extendedprice") >= 50_000, "extra_large").otherwise("extra")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"))


@query("""
with h as (select doc_id, source, n_chars, sha256(text) as hash from documents where n_chars > 0),
g as (select n_chars, hash from h group by all having count(*) > 1 and bool_or(source <> 'src3'))
select doc_id, h.hash from h join g using (n_chars, hash) where source = 'src3'
""")
def safe_deletes(spark, d):
    """Copies inside one folder that may go, as some copy outside it stays."""
    copies = keepers.same_content(read(spark, d, "documents"), "n_chars", "text")
    inside = F.col("source") == "src3"
    kept = copies.where(~inside).select("n_chars", "hash").distinct()
    return copies.where(inside).join(kept, ["n_chars", "hash"], "left_semi").select("doc_id", "hash")


@query("""
with h as (select doc_id, n_chars, sha256(text) as hash from documents where n_chars > 0),
g as (select n_chars, hash, min(doc_id) as keeper from h group by all having count(*) > 1),
l as (select h.doc_id as loser, g.keeper from h join g using (n_chars, hash) where h.doc_id <> g.keeper)
select loser, keeper, case when a.doc_id is null then 'loser_not_in_plan' when b.doc_id is null then 'keeper_not_in_plan'
  when a.quality = 1 then 'loser_role_differs' when b.quality = 0 then 'keeper_role_differs' else 'agrees' end as verdict
from l left join labels a on a.doc_id = loser left join labels b on b.doc_id = keeper
""")
def duplicate_agreement(spark, d):
    """A list of duplicates held against the roles in the plan; only rows that agree may act."""
    copies = keepers.same_content(read(spark, d, "documents"), "n_chars", "text")
    keeper = copies.groupBy("n_chars", "hash").agg(F.min("doc_id").alias("keeper"))
    losers = copies.join(keeper, ["n_chars", "hash"]).where("doc_id <> keeper").select(F.col("doc_id").alias("loser"), "keeper")
    plan = read(spark, d, "labels").select("doc_id", "quality")
    named = lambda who: plan.select(F.col("doc_id").alias(who), F.col("quality").alias(f"{who}_role"), F.lit(True).alias(f"{who}_known"))
    both = losers.join(named("loser"), "loser", "left").join(named("keeper"), "keeper", "left")
    verdict = (
        F.when(F.col("loser_known").isNull(), "loser_not_in_plan")
        .when(F.col("keeper_known").isNull(), "keeper_not_in_plan")
        .when(F.col("loser_role") == 1, "loser_role_differs")
        .when(F.col("keeper_role") == 0, "keeper_role_differs")
        .otherwise("agrees")
    )
    return both.select("loser", "keeper", verdict.alias("verdict"))


@query("""
with t as (select p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 3) as a,
                  list_filter(string_split(lower(p_type), ' '), lambda x: length(x) > 3) as b from part)
select p_partkey, len(a) = 0 or list_has_any(a, b) as passes from t
""")
def distinctive_gate(spark, d):
    """Whether a source's telling words meet the target's; a source without any passes."""
    telling = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) > 3)
    return read(spark, d, "part").select("p_partkey", ((F.size(telling("p_name")) == 0) | F.arrays_overlap(telling("p_name"), telling("p_type"))).alias("passes"))


@query("""
select l_orderkey, sum(30 * (l_returnflag = 'R')::int + 8 * (l_linenumber % 3)
  + case when l_quantity >= 10 and l_quantity < 50 then 25 when l_quantity >= 50 and l_quantity < 75 then 5 else 0 end
  + case when l_linestatus = 'O' then 40 else 0 end)::bigint as points
from lineitem group by 1
""")
def tv_in_films(spark, d):
    """Points of folders whose films look like episodes."""
    points = scoring.tv_suspicion((F.col("l_returnflag") == "R").cast("int"), F.col("l_linenumber") % 3, scoring.duration_class(F.col("l_quantity")), F.col("l_linestatus") == "O")
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(points).alias("points"))


@query("""
with c as (select o_custkey, o_orderkey, 0.6::double * ((50 + o_orderkey % 51) / 100.0::double)
             + 0.2::double * greatest(0.0::double, 1 - (o_orderkey % 7) / 5.0::double)
             + 0.2::double * least(1.0::double, (o_orderkey % 60) / 50.0::double) as score, o_orderkey % 50 as votes from orders),
r as (select *, row_number() over w as place, score - coalesce(lead(score) over w, 0) as margin, count(*) over (partition by o_custkey) as n from c window w as (partition by o_custkey order by score desc, o_orderkey))
select o_custkey, o_orderkey, score, case when score >= 0.85 and votes > 20 and margin >= 0.2 then 'HIGH' when n = 1 and score >= 0.75 then 'HIGH' when score >= 0.5 then 'MEDIUM' else 'NONE' end as verdict from r where place = 1
""")
def candidate_verdicts(spark, d):
    """The best candidate of each title; sure if it is good, known and well ahead of the next, or good and alone."""
    key = F.col("o_orderkey")
    score = scoring.candidate_score((50 + key % 51) / 100.0, (key % 7).cast("double"), (key % 60).cast("double"))
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", score.alias("score"), (key % 50).alias("votes"))
    two = keepers.best_first(rows, ["o_custkey"], [F.desc("score"), F.asc("o_orderkey")]).where("place <= 2")
    best = two.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "score", "votes"), "place").alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("next"), F.max("place").alias("n"))
    margin = F.col("best.score") - F.coalesce("next", F.lit(0.0))
    return best.select("o_custkey", "best.o_orderkey", "best.score", scoring.candidate_verdict(F.col("best.score"), F.col("best.votes"), margin, F.col("n")).alias("verdict"))


@query("""
with s as (select doc_id, doc_id::varchar || case when doc_id % 3 = 0 then '.en' when doc_id % 3 = 1 then '.de.forced' else '' end || '.srt' as name from labels)
select s.name as sidecar, d.source || '/Title ' || d.doc_id || case when d.doc_id % 3 = 0 then '.en' when d.doc_id % 3 = 1 then '.de.forced' else '' end || '.srt' as target
from s join documents d on d.doc_id = s.doc_id
""")
def sidecar_targets(spark, d):
    """Where subtitles go with their videos: the stem changes, language and flags stay."""
    ending = F.when(F.col("doc_id") % 3 == 0, ".en").when(F.col("doc_id") % 3 == 1, ".de.forced").otherwise("")
    sidecars = read(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), ending, F.lit(".srt")).alias("sidecar"))
    decoration = F.regexp_extract("sidecar", r"((?:\.[a-z]{2,3})?(?:\.forced)?\.srt)$", 1)
    stem = F.substring_index("sidecar", ".", 1)
    videos = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.concat("source", F.lit("/Title "), "doc_id").alias("new"))
    return sidecars.withColumn("stem", stem).join(videos, "stem").select("sidecar", F.concat("new", decoration).alias("target"))


@query("""
with h as (select doc_id, source, sha256(text) as hash from documents),
n as (select distinct hash from h where source <> 'src2')
select doc_id, hash in (select hash from n) as already_there, doc_id in (select doc_id from labels) as target_taken from h where source = 'src2'
""")
def leftover_membership(spark, d):
    """What is left in an old folder: whether the new tree has the content, and whether the place is taken."""
    files = read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    there = files.where("source <> 'src2'").select("hash").distinct().withColumn("there", F.lit(True))
    taken = read(spark, d, "labels").select("doc_id").distinct().withColumn("taken", F.lit(True))
    left = files.where("source = 'src2'").join(there, "hash", "left").join(taken, "doc_id", "left")
    return left.select("doc_id", F.coalesce("there", F.lit(False)).alias("already_there"), F.coalesce("taken", F.lit(False)).alias("target_taken"))
