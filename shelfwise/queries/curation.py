"""Winners, filters, lookups and reports of a curator, over tables whose columns stand for tags, files and folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import fuzzy, names
from shelfwise.operators import keepers, trees
from shelfwise.operators.staging import spread
from shelfwise.registry import query, read


@query("""
select l_partkey as cluster, l_orderkey, l_linenumber, (row_number() over (partition by l_partkey order by l_quantity desc, l_extendedprice desc, l_tax desc, l_orderkey, l_linenumber) - 1)::int as rank,
  case when row_number() over (partition by l_partkey order by l_quantity desc, l_extendedprice desc, l_tax desc, l_orderkey, l_linenumber) = 1 then 'KEEP' else 'dup' end as keep
from lineitem where l_partkey in (select l_partkey from lineitem group by 1 having count(*) > 1)
""")
def video_cluster_rank(spark, d):
    """The copies of each cluster by height, bitrate and size (quantity, price and tax), the best first and kept."""
    rows = spread(read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), "l_partkey")
    several = rows.groupBy("l_partkey").count().where("count > 1").select("l_partkey")
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), F.desc("l_tax"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    ranked = keepers.best_first(rows.join(several, "l_partkey"), ["l_partkey"], order)
    return ranked.select(F.col("l_partkey").alias("cluster"), "l_orderkey", "l_linenumber", (F.col("place") - 1).alias("rank"), F.when(F.col("place") == 1, "KEEP").otherwise("dup").alias("keep"))


_SUBTITLE = """concat(case when l_partkey % 3 = 0 then 'Season 0' || cast(l_linenumber as string) || '/' when l_partkey % 3 = 1 then 'extra/sub/' else '' end,
  cast(l_orderkey % 40 as string), case when l_linenumber % 3 = 0 then '.en' when l_linenumber % 3 = 1 then '.spa' else '' end, '.srt')"""


@query(f"""
with s as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice, {_SUBTITLE} as path from lineitem),
v as (select distinct l_orderkey % 40 as stem, l_suppkey from lineitem where l_returnflag = 'R'),
t as (select *, regexp_replace(regexp_replace(path, '^.*/', ''), '(?i)(\\.[a-z]{{2,3}})?\\.srt$', '') as base from s),
r as (select t.*, v.stem is not null as sibling from t left join v on base = v.stem::varchar and t.l_suppkey = v.l_suppkey)
select l_suppkey, first(path order by not sibling, not regexp_matches(path, '(^|/)[Ss]eason +[0-9]+/[^/]*$'), -len(string_split(path, '/')), -l_extendedprice, path, l_orderkey, l_linenumber) as keep,
  count(*)::bigint as n from r group by 1
""")
def subtitle_plex_position(spark, d):
    """Of each group's subtitles the one that a player uses: beside a video of its stem (a language apart), then in a season's
    folder, then deeper, then larger, then by name."""
    rows = read(spark, d, "lineitem").withColumn("path", F.expr(_SUBTITLE))
    videos = rows.where("l_returnflag = 'R'").select((F.col("l_orderkey") % 40).cast("string").alias("base"), "l_suppkey").distinct().withColumn("sibling", F.lit(True))
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)(\.[a-z]{2,3})?\.srt$", "")
    found = rows.withColumn("base", base).join(videos, ["base", "l_suppkey"], "left")
    order = F.struct(F.col("sibling").isNull(), ~F.col("path").rlike("(^|/)[Ss]eason +[0-9]+/[^/]*$"), -F.size(F.split("path", "/")), -F.col("l_extendedprice"), "path", "l_orderkey", "l_linenumber")
    return found.groupBy("l_suppkey").agg(F.min_by("path", order).alias("keep"), F.count("*").alias("n"))


_KINDS = "case l_linenumber % 5 when 0 then 'Trailer' when 1 then 'Teaser' when 2 then 'Clip' when 3 then 'Featurette' else 'Other' end"


@query(f"""
with v as (select l_orderkey, {_KINDS} as kind, case when l_suppkey % 3 > 0 then 'YouTube' else 'Vimeo' end as site, l_returnflag = 'N' as official, l_quantity as size, l_linenumber, 'v' || (l_partkey % 7) as key from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by case lower(kind) when 'trailer' then 0 when 'teaser' then 1 when 'clip' then 2 when 'featurette' then 3 else 4 end,
  not official, size desc, l_linenumber, key) as place from v where lower(site) = 'youtube'),
f as (select l_orderkey, key, min(place) as place from r group by all)
select l_orderkey, string_agg(key, ' ' order by place) as keys from f group by 1
""")
def trailer_candidates(spark, d):
    """The trailers to try for each title, in order: by kind, official ones, size; each key once."""
    rows = read(spark, d, "lineitem").withColumn("site", F.when(F.col("l_suppkey") % 3 > 0, "youtube").otherwise("vimeo")).where("site = 'youtube'").withColumn("kind", F.lower(F.expr(_KINDS))).withColumn("key", F.concat(F.lit("v"), (F.col("l_partkey") % 7).cast("string")))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("trailer", "teaser", "clip", "featurette"))), F.col("kind")), F.lit(0)).cast("int")
    order = F.struct(F.when(rank == 0, 5).otherwise(rank).alias("r"), (F.col("l_returnflag") != "N").alias("o"), (-F.col("l_quantity")).alias("s"), "l_linenumber", "key")
    best = rows.groupBy("l_orderkey", "key").agg(F.min(order).alias("place"))
    return best.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda p: p["key"]), " ").alias("keys"))


@query("""
select o_orderkey, case when status = 'AUTO' and not executed then 'execute' when status = 'SKIP' and flags not like '%attempted%' and (flags like '%no_tmdb_results%' or flags like '%multi_result%') then 'ask_again'
  when status in ('AUTO', 'SKIP') and executed then 'verify' end as step from (select o_orderkey, case o_orderkey % 4 when 0 then 'SKIP' when 1 then 'REVIEW' else 'AUTO' end as status, o_orderstatus = 'F' as executed,
  case o_orderkey % 16 when 0 then 'no_tmdb_results' when 4 then 'multi_result;x' when 8 then 'no_tmdb_results;retmdb_attempted' else '' end as flags from orders)
where (status = 'AUTO') or (status = 'SKIP' and flags not like '%attempted%' and (flags like '%no_tmdb_results%' or flags like '%multi_result%')) or (status = 'SKIP' and executed)
""")
def eligible_titles(spark, d):
    """Titles that a step may take, and which: carry out, ask the catalogue again, or verify."""
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(
        k,
        F.when(k % 4 == 0, "SKIP").when(k % 4 == 1, "REVIEW").otherwise("AUTO").alias("status"),
        (F.col("o_orderstatus") == "F").alias("executed"),
        F.when(k % 16 == 0, "no_tmdb_results").when(k % 16 == 4, "multi_result;x").when(k % 16 == 8, "no_tmdb_results;retmdb_attempted").otherwise("").alias("flags"),
    )
    again = (F.col("status") == "SKIP") & ~F.col("flags").contains("attempted") & (F.col("flags").contains("no_tmdb_results") | F.col("flags").contains("multi_result"))
    step = F.when((F.col("status") == "AUTO") & ~F.col("executed"), "execute").when(again, "ask_again").when(F.col("status").isin("AUTO", "SKIP") & F.col("executed"), "verify")
    return rows.select("o_orderkey", step.alias("step")).where("step is not null")


_ARTIST = "case p_partkey % 7 when 0 then 'U2' when 1 then 'A' when 2 then ' ' when 3 then 'R&B-x' when 4 then p_name when 5 then '9' end"


@query(f"""
select p_partkey, trim(coalesce(a, '')) = '' or p_size % 5 = 0 as weak, length(trim(coalesce(a, ''))) >= 2 and regexp_full_match(trim(a), '[a-zA-Z0-9&+-]+') as plausible,
  coalesce(a, '') = '' or length(trim(a)) = 1 as single from (select *, {_ARTIST} as a from part)
""")
def weak_tags(spark, d):
    """Which tags are too weak to go by: no artist or title; plausible short artists; single letters."""
    artist, title = F.expr(_ARTIST), F.when(F.col("p_size") % 5 > 0, F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", names.weakly_tagged(artist, title).alias("weak"), names.plausible_artist(artist).alias("plausible"), names.single_letter(artist).alias("single"))


@query("select o_custkey, count(*)::bigint as total, count(*) filter (where o_orderdate <= date '1998-01-01')::bigint as released from orders group by 1 having count(*) filter (where o_orderdate <= date '1998-01-01') > 0")
def released_parts(spark, d, today: str = "1998-01-01"):
    """Parts of each collection that are out by a day; parts without a date or with a later one are none yet."""
    out = F.count_if(F.to_date("o_orderdate") <= F.lit(today).cast("date"))
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), out.alias("released")).where("released > 0")


@query("""
select doc_id, coalesce(c.category, 'ARTIST') as category from documents left join (select source as folder, case when count(*) % 2 = 0 then 'SOUNDTRACK' else 'COMPILATION' end as category from documents group by 1 having max(n_chars) > 8000) c on folder = source
""")
def category_lookup(spark, d):
    """Each file's category by its top folder; folders that nobody has put anywhere are an artist's."""
    files = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    known = files.groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("most")).where("most > 8000")
    known = known.select("source", F.when(F.col("n") % 2 == 0, "SOUNDTRACK").otherwise("COMPILATION").alias("category"))
    return files.join(known, "source", "left").select("doc_id", F.coalesce("category", F.lit("ARTIST")).alias("category"))


_SHOW = "case when s_suppkey % 4 = 0 then 'The Show ' || cast(s_suppkey % 20 as string) when s_suppkey % 4 = 1 then 'Show ' || cast(s_suppkey % 20 as string) || ' extra' else 'show ' || cast(s_suppkey % 13 as string) end"
_FOLDER = "case when c_custkey % 3 = 0 then 'Show ' || cast(c_custkey % 20 as string) || ' {tmdb-' || cast(c_custkey as string) || '}' when c_custkey % 3 = 1 then 'Show ' || cast(c_custkey % 23 as string) || ' (2001)' else 'show-' || cast(c_custkey % 13 as string) end"
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[{{(][^)}}]*[)}}]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '^ *the ', ''))"


@query(f"""
with s as (select s_suppkey, {_SHOW} as label, case when s_suppkey % 5 = 0 then s_suppkey::varchar end as tmdb from supplier),
k as (select *, {_KEY.format("label")} as key from s), f as (select c_custkey, {_FOLDER} as folder from customer),
g as (select *, nullif(regexp_extract(folder, '[{{]tmdb-([0-9]+)[}}]', 1), '') as tmdb, {_KEY.format("folder")} as key from f),
a as (select s_suppkey, label, folder, c_custkey, 1 as tier from k join g using (tmdb) union all select s_suppkey, label, folder, c_custkey, 2 from k join g using (key)
  union all select s_suppkey, label, folder, c_custkey, 3 from k join g on starts_with(k.key, g.key) or starts_with(g.key, k.key))
select s_suppkey, first(folder order by tier, abs(length(folder) - length(label)), c_custkey) as folder, min(tier)::int as tier from a group by 1
""")
def show_folder_lookup(spark, d):
    """Each show's folder: by id, else by its plain name, else by one name beginning the other; of several, the one
    whose length is nearest."""
    shows = read(spark, d, "supplier").select("s_suppkey", F.expr(_SHOW).alias("name"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey").cast("string")).alias("tmdb"))
    folders = read(spark, d, "customer").select("c_custkey", F.expr(_FOLDER).alias("folder"))
    return trees.folder_of_each(shows, folders, "s_suppkey", "name", "tmdb", "folder", "c_custkey").select("s_suppkey", "folder", "tier")


@query("""
with t as (select p_partkey, p_brand as top, case when p_size % 4 > 0 then p_name end as artist, case when p_size % 3 > 0 then p_type end as genre from part)
select top, count(*)::bigint as files, round(100.0 * count(artist) / count(*), 4)::double as artist_pct, round(100.0 * count(genre) / count(*), 4)::double as genre_pct, count(distinct artist)::bigint as artists,
  count(*) filter (where artist is not null and not contains(artist, 'red') and top like '%1')::bigint as disagreements from t group by 1
""")
def tag_coverage(spark, d):
    """Of each top folder: how many files have tags, how many artists there are, and tags that disagree with the folder."""
    artist, genre = F.when(F.col("p_size") % 4 > 0, F.col("p_name")), F.when(F.col("p_size") % 3 > 0, F.col("p_type"))
    rows = read(spark, d, "part").select(F.col("p_brand").alias("top"), artist.alias("artist"), genre.alias("genre"))
    pct = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 4)
    odd = F.count_if(F.col("artist").isNotNull() & ~F.col("artist").contains("red") & F.col("top").endswith("1"))
    return rows.groupBy("top").agg(F.count("*").alias("files"), pct("artist").alias("artist_pct"), pct("genre").alias("genre_pct"), F.count_distinct("artist").alias("artists"), odd.alias("disagreements"))


@query("""
select p_name as artist, count(distinct p_brand)::bigint as folders from part group by 1 having count(distinct p_brand) >= 3
""")
def scattered_artists(spark, d):
    """Artists whose files lie in three top folders or more."""
    return read(spark, d, "part").groupBy(F.col("p_name").alias("artist")).agg(F.count_distinct("p_brand").alias("folders")).where("folders >= 3")


_PATH = "concat('root/', case when p_size % 3 = 0 then '[HD] ' else '' end, p_type, '/', p_brand, case when p_partkey % 2 = 0 then '/disc' || cast(p_partkey % 3 as string) else '' end, '/f', cast(p_partkey as string))"


@query(f"""
with f as (select distinct regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) as folder from part),
a as (select distinct array_to_string(string_split(folder, '/')[1:k], '/') as parent from (select folder, unnest(range(1, len(string_split(folder, '/')))) as k from f))
select folder, regexp_extract(folder, '\\[([A-Z]+)\\]', 1) as tag from f where folder not in (select parent from a) and contains(folder, '[HD]')
""")
def leaf_folders(spark, d):
    """Folders without folders in them whose path bears a tag."""
    files = read(spark, d, "part").select(F.expr(_PATH).alias("path"))
    return trees.leaves(files, "path").where(F.col("folder").contains("[HD]")).select("folder", F.regexp_extract("folder", r"\[([A-Z]+)\]", 1).alias("tag"))


@query()
def seeded_sample(spark, d, n: int = 100, seed: int = 7):
    """So many matches at random, to be looked at; a seed and the id decide, not where rows lie."""
    return read(spark, d, "events").orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id").limit(n).select("event_id", "value")


@query()
def lyric_best(spark, d):
    """The best lyrics for each track: the mean likeness of artist and title, three tenths of it if the lengths differ by
    more than the tolerance; none under 0.65."""
    tracks = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("artist"), F.min("p_size").alias("length"))
    found = tracks.select(F.col("id").alias("hit"), F.concat("p_name", F.lit(" (live)")).alias("hit_title"), F.upper("artist").alias("hit_artist"), (F.col("length") + F.col("id") % 3).alias("hit_length"), F.substring_index("p_name", " ", 1).alias("word"))
    pairs = tracks.withColumn("word", F.substring_index("p_name", " ", 1)).join(found, "word")
    mean = (fuzzy.sequence_ratio(F.lower("artist"), F.lower("hit_artist")) + fuzzy.sequence_ratio(F.lower("p_name"), F.lower("hit_title"))) / 2
    scored = pairs.withColumn("score", F.round(mean * F.when(F.abs(F.col("length") - F.col("hit_length")) <= 1, 1.0).otherwise(0.3), 6)).where("score >= 0.65")
    return keepers.best(scored, ["id"], F.struct(-F.col("score"), F.col("hit")), "hit", "score")

