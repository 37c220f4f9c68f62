"""Completeness queries; an order stands for a show, its line numbers for episodes, of which an order expects
1 to 7 less its key modulo 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import completeness, lookups
from shelfwise.registry import query, read

_EXPECTED = "sequence(1, cast(7 - o_orderkey % 3 as int))"


def _shows(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.expr(_EXPECTED).alias("expected"))


def _owned(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("episode")).distinct()


_SQL = """
with x as (select o_orderkey, range(1, (8 - o_orderkey % 3)::int) as expected from orders),
owned as (select distinct l_orderkey as o_orderkey, l_linenumber::int as episode from lineitem),
wanted as (select o_orderkey, unnest(expected)::int as episode from x),
"""
_RANGES = """
d as ({rows}),
r as (select *, episode - row_number() over (partition by o_orderkey order by episode) as run from d),
i as (select o_orderkey, run, min(episode) as lo, max(episode) as hi from r group by all)
select o_orderkey, string_agg(case when lo = hi then lo::varchar else lo || '-' || hi end, ', ' order by lo) as ranges from i group by 1
"""


@query(_SQL + _RANGES.format(rows="select * from wanted except select * from owned"))
def missing_ranges(spark, d):
    """Expected episodes that no file holds."""
    wanted = _shows(spark, d).select("o_orderkey", F.explode("expected").alias("episode"))
    return completeness.compacted(completeness.lacking(wanted, _owned(spark, d), ["o_orderkey"], "episode", read(spark, d, "lineitem")), ["o_orderkey"], "episode")


@query(_SQL + _RANGES.format(rows="select * from owned where o_orderkey in (select o_orderkey from x) except select * from wanted"))
def extra_ranges(spark, d):
    """Owned episodes that a known show does not have."""
    known = _owned(spark, d).join(_shows(spark, d), "o_orderkey").where("not array_contains(expected, episode)")
    return completeness.compacted(known, ["o_orderkey"], "episode")


@query(_SQL + """
a as (select o_orderkey, list(episode) as have from owned group by 1)
select o_orderkey, len(expected)::int as n_expected, len(have)::int as n_have,
  case when expected is null then 'unexpected' when have is null then 'missing'
       when len(list_intersect(expected, have)) < len(expected) then 'incomplete'
       when len(list_intersect(expected, have)) < len(have) then 'extra' else 'complete' end as status
from x full join a using (o_orderkey)
""")
def season_status(spark, d):
    """Expected against owned seasons, both sides kept."""
    have = _owned(spark, d).groupBy("o_orderkey").agg(F.collect_set("episode").alias("have"))
    both = _shows(spark, d).join(have, "o_orderkey", "full_outer")
    sizes = [F.when(F.col(c).isNotNull(), F.size(c)).alias(n) for c, n in (("expected", "n_expected"), ("have", "n_have"))]
    return both.select("o_orderkey", *sizes, completeness.season_status(F.col("expected"), F.col("have")).alias("status"))


_COMPLETE = _SQL + """
t as (select o_orderkey, o_custkey, len(expected)::bigint as n from x join orders using (o_orderkey)),
h as (select o_orderkey, count(*)::bigint as have from owned group by 1),
s as (select o_custkey, sum(n)::bigint as expected, sum(least(coalesce(have, 0), n))::bigint as have from t left join h using (o_orderkey) group by 1)
"""


def _completeness(spark, d):
    shows = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.size(F.expr(_EXPECTED)).cast("long").alias("n"))
    have = _owned(spark, d).groupBy("o_orderkey").agg(F.count("*").alias("have"))
    capped = F.least(F.coalesce("have", F.lit(0)), F.col("n"))
    return shows.join(have, "o_orderkey", "left").groupBy("o_custkey").agg(F.sum("n").alias("expected"), F.sum(capped).alias("have"))


@query(_COMPLETE + "select o_custkey, expected, have, have / expected as share from s")
def show_completeness(spark, d):
    """Owned, at most what is expected of each season, against expected."""
    return _completeness(spark, d).withColumn("share", F.try_divide("have", "expected"))


@query(_COMPLETE + """
select o_custkey, case when expected = 0 then 'no_expected' when have = 0 then 'missing' when have / expected >= 1 then 'complete'
  when have / expected >= 0.9 then 'near_complete' when have / expected >= 0.1 then 'partial' else 'barely_started' end as place from s
""")
def completeness_ladder(spark, d):
    return _completeness(spark, d).select("o_custkey", completeness.ladder(F.col("have"), F.col("expected")).alias("place"))


_MISSING = """
with o as (select distinct c_nationkey from customer where c_acctbal > 8000),
p as (select r_name, n_name, n_nationkey, n_nationkey in (select c_nationkey from o) as owned from nation join region on n_regionkey = r_regionkey),
g as (select r_name as collection, count(*) filter (where owned)::bigint as owned, count(*)::bigint as total,
      coalesce(string_agg(n_name, '; ' order by n_nationkey) filter (where not owned), '') as missing from p group by 1 having bool_or(owned))
"""


def _collections(spark, d):
    owned = read(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("owned", F.lit(True))
    parts = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(owned, "n_nationkey", "left")
    have = F.coalesce("owned", F.lit(False))
    listed = F.transform(F.array_sort(F.collect_list(F.when(~have, F.struct("n_nationkey", "n_name")))), lambda x: x["n_name"])
    rolled = parts.groupBy(F.col("r_name").alias("collection")).agg(F.count_if(have).alias("owned"), F.count("*").alias("total"), F.array_join(listed, "; ").alias("missing"))
    return rolled.where("owned > 0")


@query(_MISSING + "select *, owned / total as share from g")
def collection_missing_pieces(spark, d):
    """Collections of which something is owned: how much, and what is missing."""
    return _collections(spark, d).withColumn("share", F.try_divide("owned", "total"))


@query(_MISSING + """
select collection, owned, total from g
order by case when owned > 0 and owned < total then 0 else 1 end, owned / total desc, total desc, collection limit 15
""")
def near_miss_top15(spark, d):
    """The fifteen collections nearest to complete."""
    order = F.when((F.col("owned") > 0) & (F.col("owned") < F.col("total")), 0).otherwise(1)
    return _collections(spark, d).orderBy(order, F.desc(F.try_divide("owned", "total")), F.desc("total"), "collection").limit(15).select("collection", "owned", "total")


#: Films out of parts: every size is a collection, some films are in none, some answers are refusals and some are not kept.
_DATE = "case p_partkey % 12 when 0 then '' when 1 then '2031-05-01' else concat(cast(1950 + p_partkey % 70 as string), '-01-15') end"
_ANSWERS = f"""
select concat('/find/tt', cast(p_partkey as string), '?{{"external_source": "imdb_id", "language": "en-US"}}') as key, 1 as asked, case when p_partkey % 9 = 0 then 404 when p_partkey % 10 = 1 then 500 else 200 end as status,
  concat('{{"movie_results": [', case when p_partkey % 14 > 0 then concat('{{"id": ', cast(p_partkey as string), ', "title": "', p_name, '"}}') else '' end, ']}}') as body from part
union all select concat('/movie/', cast(p_partkey as string), '?{{"language": "en-US"}}'), 1, case when p_partkey % 8 = 3 then 503 else 200 end,
  case when p_partkey % 5 > 0 then concat('{{"belongs_to_collection": {{"id": ', cast(p_size as string), ', "name": "Size ', cast(p_size as string), '"}}}}') else '{{"belongs_to_collection": null}}' end from part
union all select concat('/collection/', cast(p_size as string), '?{{"language": "en-US"}}'), 1, case when p_size % 10 = 7 then 404 else 200 end,
  concat('{{"parts": [', array_join(collect_list(concat('{{"id": ', cast(p_partkey as string), ', "title": "', case when p_partkey % 6 > 0 then p_name else '' end, '", "original_title": "', p_brand, '", "release_date": "', {_DATE}, '"}}')), ', '), ']}}') from part where p_partkey % 5 > 0 group by p_size
union all select concat('/movie/', cast(p_partkey as string), '/external_ids?{{"language": "en-US"}}'), 1, case when p_partkey % 13 = 0 then 500 else 200 end, concat('{{"imdb_id": ', case when p_partkey % 16 > 0 then concat('"TT', cast(p_partkey as string), '"') else 'null' end, '}}') from part"""
_CLOSED = f"""
with s as (select distinct c_mktsegment as folder, c_custkey as film from customer join part on p_partkey = c_custkey where p_partkey % 9 > 0 and p_partkey % 10 <> 1 and p_partkey % 14 > 0),
m as (select s.*, p_size as collection from s join part on p_partkey = film where p_partkey % 8 <> 3 and p_partkey % 5 > 0),
c as (select collection, string_agg(distinct folder, ' | ' order by folder) as folders from m group by 1),
p as (select p_size as collection, p_partkey as film, case when p_partkey % 6 > 0 then p_name else p_brand end as title, {_DATE.replace("as string)", "as varchar)")} as release_date, case when p_partkey % 13 > 0 and p_partkey % 16 > 0 then concat('tt', cast(p_partkey as varchar)) end as imdb
  from part join c on collection = p_size where p_partkey % 5 > 0 and p_size % 10 <> 7),
h as (select collection, film from m union select collection, film from p where imdb in (select concat('tt', cast(s_suppkey * 3 as varchar)) from supplier))"""


def _closed(spark, d):
    for t in ("part", "customer", "supplier"):
        read(spark, d, t).createOrReplaceTempView(f"_films_{t}")
    cache = lookups.kept(spark.sql(_ANSWERS.replace("from part", "from _films_part")))
    series = spark.sql("select c_mktsegment as folder, concat('tt', cast(c_custkey as string)) as imdb from _films_customer")
    alone = spark.sql("select concat('tt', cast(s_suppkey * 3 as string)) as imdb from _films_supplier")
    return lookups.collections(series, alone, cache, "2024-01-01")


@query(_CLOSED + """
select p.collection as collection_id, 'Size ' || p.collection as name, folders, p.film as film_id, title, imdb, release_date from p join c on c.collection = p.collection
where (p.collection, p.film) not in (select (collection, film) from h) and release_date <> '' and release_date <= '2024-01-01'
""")
def collection_closure(spark, d):
    """Parts that the library lacks of collections its series folders open, through kept answers of the film service."""
    return _closed(spark, d)[0]


@query(_CLOSED + """
select concat('/find/tt', cast(c_custkey as varchar), '?{"external_source": "imdb_id", "language": "en-US"}') as key from customer left join part on p_partkey = c_custkey where p_partkey is null or p_partkey % 10 = 1 and p_partkey % 9 > 0
union select concat('/movie/', cast(film as varchar), '?{"language": "en-US"}') from s where film % 8 = 3
union select concat('/movie/', cast(film as varchar), '/external_ids?{"language": "en-US"}') from p where film % 13 = 0
""")
def answers_to_fetch(spark, d):
    """What that closure asked for and no kept answer says."""
    return _closed(spark, d)[1]


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def not_in_plan(spark, d):
    """Shows without a file."""
    held = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(held, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""
with n as (select doc_id, source, lang from documents where n_chars > 1000),
o as (select doc_id, 'old' as source, quality::varchar as lang from labels)
select doc_id, source, lang, 'kept' as origin from o where doc_id in (select doc_id from n)
union all select doc_id, source, lang, 'added' from n where doc_id not in (select doc_id from o)
""")
def wanted_list_upsert(spark, d):
    """A sheet brought up to date: rows that are gone go, rows that stay keep what a user wrote, new rows follow."""
    new = read(spark, d, "documents").where("n_chars > 1000").select("doc_id", "source", "lang")
    old = read(spark, d, "labels").select("doc_id", F.lit("old").alias("source"), F.col("quality").cast("string").alias("lang"))
    return completeness.upserted(old, new, ["doc_id"])


@query("""
select d.doc_id, coalesce(nullif(trim(case when l.quality = 1 then ' AUTO ' when l.quality = 0 then '  ' end), ''), 'REVIEW') as action,
       coalesce(nullif(trim(case when l.toxic = 1 then 'hold' end), ''), d.lang) as notes
from documents d left join labels l using (doc_id)
""")
def edit_preservation(spark, d):
    """A plan made anew, with the actions and notes that a user had set before."""
    rows = read(spark, d, "documents").select("doc_id", F.lit("REVIEW").alias("action"), F.col("lang").alias("notes"))
    action = F.when(F.col("quality") == 1, " AUTO ").when(F.col("quality") == 0, "  ")
    edits = read(spark, d, "labels").select("doc_id", action.alias("action"), F.when(F.col("toxic") == 1, "hold").alias("notes"))
    return completeness.with_edits(rows, edits, ["doc_id"], ["action", "notes"])


@query("""
select o_orderkey, coalesce(case when o_orderstatus = 'F' then o_orderdate end, max(l_shipdate)) as executed_at
from orders left join lineitem on l_orderkey = o_orderkey and l_linestatus = 'F' group by o_orderkey, o_orderstatus, o_orderdate
""")
def stamp_executed(spark, d):
    """When each plan row was carried out: what is stamped already stays, else the last step that succeeded."""
    done = read(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    stamped = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return read(spark, d, "orders").join(done, "o_orderkey", "left").select("o_orderkey", F.coalesce(stamped, "last").alias("executed_at"))


_DISK = """select l_suppkey as series, case l_partkey % 5 when 0 then 'Specials' when 1 then 'Season 01 (2001)' when 2 then 'season 2' when 3 then 'Extras' else 'Season03' end as season_folder,
  case when l_linenumber % 4 = 0 then concat('x s', cast(l_partkey % 5 as string), 'e', cast(l_orderkey % 30 as string), '-E', cast(l_orderkey % 37 as string), '.mkv') when l_linenumber % 4 = 1 then 'trailer.mkv'
    else concat('Show S0', cast(l_partkey % 4 as string), 'E', lpad(cast(l_orderkey % 40 as string), 2, '0'), ' - t.mkv') end as name from lineitem"""


@query(f"""
with f as (select l_suppkey as series, case l_partkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end as folder, case when l_linenumber % 4 = 0 then l_partkey % 5 when l_linenumber % 4 > 1 then l_partkey % 4 end as season,
    case when l_linenumber % 4 = 0 then least(l_orderkey % 30, l_orderkey % 37) else l_orderkey % 40 end as lo, case when l_linenumber % 4 = 0 then greatest(l_orderkey % 30, l_orderkey % 37) else l_orderkey % 40 end as hi from lineitem where l_partkey % 5 <> 3),
e as (select series, season, count(distinct episode) as episodes from (select series, season, unnest(range(lo, hi + 1)) as episode from f where season is not null) group by 1, 2),
v as (select series, folder as season, count(*) as videos from f group by 1, 2)
select coalesce(e.series, v.series) as series, cast(coalesce(e.season, v.season) as integer) as season, coalesce(episodes, 0) as episodes, videos from e full join v on e.series = v.series and e.season = v.season
""")
def episodes_on_disk(spark, d):
    """Distinct episodes of each season that files hold, several in one name included, and the videos in its folders."""
    read(spark, d, "lineitem").createOrReplaceTempView("_disk_lineitem")
    return completeness.episodes_on_disk(spark.sql(_DISK.replace("from lineitem", "from _disk_lineitem")))


_SEASONS = """select o_custkey, o_orderkey % 5 as season, max(case when o_orderkey % 7 > 0 then o_orderkey % 10 end) as expected, max(case when o_orderkey % 3 > 0 then o_orderkey % 12 end) as have from orders group by 1, 2"""


@query(f"""
with s as ({_SEASONS}), t as (select *, coalesce(expected, 0) as e, coalesce(have, 0) as h from s),
r as (select o_custkey, count(*) filter (where season > 0 and e > 0) as seasons_expected, count(*) filter (where season > 0 and h > 0) as seasons_have, coalesce(sum(e) filter (where season > 0), 0) as episodes_expected,
  coalesce(sum(least(h, e)) filter (where season > 0 and e > 0), 0) as episodes_have, coalesce(sum(e) filter (where season = 0), 0) as specials_expected, coalesce(sum(h) filter (where season = 0), 0) as specials_have,
  coalesce(string_agg(season::varchar, ', ' order by season) filter (where season > 0 and e > 0 and h = 0), '') as missing,
  coalesce(string_agg('S0' || season || '(' || h || '/' || e || ')', ', ' order by season) filter (where season > 0 and h > 0 and h < e), '') as incomplete,
  coalesce(string_agg(season::varchar, ', ' order by season) filter (where season > 0 and expected is null and h > 0), '') as unexpected from t group by 1)
select o_custkey, seasons_expected, seasons_have, cast(episodes_expected as bigint) as episodes_expected, cast(episodes_have as bigint) as episodes_have, cast(specials_expected as bigint) as specials_expected, cast(specials_have as bigint) as specials_have, missing, incomplete, unexpected,
  case when episodes_expected > 0 then round(100.0::double * episodes_have / episodes_expected, 1) else 0 end as percent from r
""")
def show_summaries(spark, d):
    """Each show's seasons and episodes against what is expected, specials apart, with lists of seasons."""
    read(spark, d, "orders").createOrReplaceTempView("_seasons_orders")
    rows = spark.sql(_SEASONS.replace("from orders", "from _seasons_orders")).withColumnRenamed("o_custkey", "show")
    return completeness.show_summaries(rows).withColumnRenamed("show", "o_custkey")
