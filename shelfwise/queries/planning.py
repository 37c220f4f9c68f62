"""Identification, stage plans, verification and routing of music."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans import identify, music, proposals, series, stages
from shelfwise.registry import query, read


@query("""
with f as (select p_partkey as film_id, p_name as name, 1990 + p_size % 12 as year, case when p_partkey % 3 > 0 then 'tt' || p_partkey end as imdb from part),
t as (select o_orderkey as title_id, case when o_orderkey % 4 = 0 then 'tt' || (o_orderkey % 3000) end as nfo_imdb, case when o_orderkey % 5 = 0 then o_orderkey % 2500 end as nfo_tmdb,
  case when o_orderkey % 7 > 0 then p_name || case when o_orderkey % 11 = 0 then ' x' else '' end end as name, case when o_orderkey % 6 > 0 then 1986 + o_orderkey % 20 end as year from orders left join part on p_partkey = o_custkey % 64),
s as (select title_id, count(*) as n, min(film_id) as first, count(*) filter (where f.year = t.year) as year_n, min(film_id) filter (where f.year = t.year) as year_first from t join f on f.name = t.name and abs(f.year - t.year) <= 1 group by 1),
a as (select name, count(*) as n, min(film_id) as first from f group by 1),
x as (select t.*, i.film_id as imdb_film, g.film_id as tmdb_film, case when t.year is null then a.first else coalesce(s.year_first, s.first) end as found, case when t.year is null then a.n else s.n end as n, s.year_n, a.first as any_film
  from t left join f i on i.imdb = nfo_imdb left join f g on g.film_id = nfo_tmdb left join s using (title_id) left join a on a.name = t.name),
v as (select *, case when imdb_film is not null then 'nfo_imdb' when tmdb_film is not null then 'nfo_tmdb' when found is not null then 'search' when year is not null and any_film is not null then 'search_without_year' else 'no-tmdb-match' end as via from x)
select title_id, case via when 'nfo_imdb' then imdb_film when 'nfo_tmdb' then tmdb_film when 'search' then found when 'search_without_year' then any_film end as film_id, via,
  case via when 'search' then case when n = 1 then 'single-tmdb-match' when year is null then 'multi-match-no-year' when year_n = 1 then 'multi-match-year-disambiguated' else 'multi-match-year-filter-failed' end
    when 'search_without_year' then 'year-not-matched' else '' end as flags from v
""")
def identify_cascade(spark, d):
    """Which film each title is, by ids and searches, and how sure that was."""
    k = F.col("o_orderkey")
    films = read(spark, d, "part").select(F.col("p_partkey").alias("film_id"), F.col("p_name").alias("name"), (1990 + F.col("p_size") % 12).alias("year"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("tt"), F.col("p_partkey").cast("string"))).alias("imdb"))
    named = films.where("film_id < 64").select(F.col("film_id").alias("of"), F.col("name").alias("n"))
    orders = read(spark, d, "orders").join(named, F.col("o_custkey") % 64 == F.col("of"), "left")
    titles = orders.select(
        k.alias("title_id"),
        F.when(k % 4 == 0, F.concat(F.lit("tt"), (k % 3000).cast("string"))).alias("nfo_imdb"),
        F.when(k % 5 == 0, k % 2500).alias("nfo_tmdb"),
        F.when(k % 7 > 0, F.concat("n", F.when(k % 11 == 0, " x").otherwise(""))).alias("name"),
        F.when(k % 6 > 0, 1986 + k % 20).alias("year"),
    )
    return identify.identified(titles, films)


_PLAN_FILES = """select l_partkey as title_id, 'old/' || l_returnflag || '/' || cast(l_partkey as string) || '/f' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || case l_linenumber when 2 then '.en.srt' when 3 then '.nfo' when 5 then '.en.forced.ass' else '.mkv' end as path,
  'f' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || case l_linenumber when 2 then '.en.srt' when 3 then '.nfo' when 5 then '.en.forced.ass' else '.mkv' end as name,
  case l_linenumber when 2 then 'srt' when 3 then 'nfo' when 5 then 'ass' else 'mkv' end as ext, case when l_linenumber = 1 and l_partkey % 4 > 0 then 'main_video' when l_linenumber in (2, 5) then 'sidecar' when l_linenumber = 3 then 'nfo' else 'extra' end as role from lineitem"""


@query(f"""
with f as ({_PLAN_FILES}), t as (select p_partkey as title_id, 'Films/' || p_name || ' (' || p_partkey || ')' as target, p_name || ' (' || p_partkey || ')' as stem from part),
m as (select title_id, min(path) as path, 'mkv' as ext from f where role = 'main_video' group by 1), r as (select * from t join m using (title_id)),
w as (select f.*, r.target, r.stem from f join r using (title_id))
select title_id, 'A' as stage, 'fail' as op, null as source, null as target from t where title_id not in (select title_id from m)
union all select title_id, 'B', 'mkdir', null, target from r
union all select title_id, 'C', 'move', path, target || '/' || stem || '.mkv' from r
union all select title_id, 'D', 'move', path, target || '/' || stem || case ext when 'srt' then '.en.srt' else '.en.forced.ass' end from w where role = 'sidecar'
union all select distinct title_id, 'E', 'backup', target || '/' || stem || '.nfo', target || '/' || stem || '.nfo.bak' from w where role = 'nfo'
union all select title_id, 'E', 'write_file', null, target || '/' || stem || '.nfo' from r
union all select distinct title_id, 'F', 'mkdir', null, target || '/Extras' from w where role = 'extra'
union all select title_id, 'F', 'move', path, target || '/Extras/' || name from w where role = 'extra'
union all select distinct title_id, 'G', 'rmdir', regexp_extract(path, '^(.*)/[^/]*$', 1), null from w
""")
def stage_actions(spark, d):
    """Everything that carrying out the plan of each title would do, stage by stage."""
    read(spark, d, "lineitem").createOrReplaceTempView("_plan_lineitem")
    files = spark.sql(_PLAN_FILES.replace("from lineitem", "from _plan_lineitem"))
    name = F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    titles = read(spark, d, "part").select(F.col("p_partkey").alias("title_id"), F.concat(F.lit("Films/"), name).alias("target"), name.alias("stem"))
    return stages.actions(titles, files)


_STATE = """select o_orderkey, case o_orderkey % 41 when 0 then '' when 1 then null when 2 then '.' else 'Films/x' end as target, o_orderkey % 37 > 0 as target_exists, o_orderkey % 31 > 0 as readable,
  case o_orderkey % 29 when 0 then null when 1 then 'other.mkv' else 'x.mkv' end as video, 'x.mkv' as expected, case o_orderkey % 23 when 0 then null else o_orderkey % 5 end as size, case o_orderkey % 3 when 0 then o_orderkey % 5 when 1 then 3 else 0 end as planned_size,
  o_orderkey % 19 > 0 as nfo, case o_orderkey % 6 when 0 then null else cast(o_orderkey % 4 as string) end as nfo_tmdb, case o_orderkey % 9 when 0 then 'tt1' when 1 then 'tt2' end as nfo_imdb,
  case o_orderkey % 7 when 0 then null else cast(o_orderkey % 5 as string) end as tmdb, case o_orderkey % 5 when 0 then 'tt1' when 1 then 'tt2' end as imdb, case o_orderkey % 8 when 0 then null else cast(o_orderkey % 2 as string) end as hash,
  case o_orderkey % 10 when 0 then null else '1' end as planned_hash, case o_orderkey % 13 when 0 then 'X' when 1 then 'X {{tmdb-1}}' else 'X {{imdb-tt1}}' end as folder, case o_orderkey % 2 when 0 then 'P' else 'P {{tmdb-2}}' end as parent from orders""".replace("{{", "{").replace("}}", "}")
_CODES = (
    ("coalesce(target, '') in ('', '.')", "target_folder_missing_field", "error"),
    ("ok1 and not target_exists", "target_folder_missing", "error"),
    ("ok1 and target_exists and not readable", "target_folder_unreadable", "error"),
    ("ok1 and target_exists and readable and video is null", "video_missing", "error"),
    ("ok and video <> expected", "video_name_mismatch", "warn"),
    ("ok and planned_size > 0 and size <> planned_size", "size_drift", "error"),
    ("ok and planned_size > 0 and size is null", "video_unreadable", "error"),
    ("ok and not nfo", "nfo_missing", "warn"),
    ("ok and nfo and nfo_tmdb is null and nfo_imdb is null", "nfo_unparseable", "error"),
    ("ok and nfo and nfo_tmdb <> tmdb", "nfo_tmdb_mismatch", "error"),
    ("ok and nfo and nfo_imdb <> imdb", "nfo_imdb_mismatch", "error"),
    ("ok and planned_size > 0 and hash <> planned_hash", "hash_mismatch", "error"),
    ("ok and planned_size > 0 and planned_hash is not null and hash is null", "hash_failed", "warn"),
    ("ok and not contains(folder || parent, '{imdb-tt') and not contains(folder || parent, '{tmdb-')", "folder_name_pattern", "warn"),
)


@query(f"with s as ({_STATE}), t as (select *, coalesce(target, '') not in ('', '.') as ok1, ok1 and target_exists and readable and video is not null as ok from s) " + " union all ".join(f"select o_orderkey, '{code}' as code, '{severity}' as severity from t where {rule}" for rule, code, severity in _CODES))
def verify_titles(spark, d):
    """What is wrong with titles that were carried out, a row for each code."""
    read(spark, d, "orders").createOrReplaceTempView("_state_orders")
    rows = spark.sql(_STATE.replace("from orders", "from _state_orders"))
    issues = stages.verified({c: F.col(c) for c in rows.columns})
    return rows.select("o_orderkey", F.explode(issues).alias("i")).select("o_orderkey", "i.code", "i.severity")


_TRACKS = """select l_orderkey, l_linenumber, case l_partkey % 10 when 0 then 'DISSOLVE' when 1 then 'SOUNDTRACK' when 2 then 'COMPILATION' when 3 then 'RADIO' when 4 then 'AUDIOBOOK' when 5 then 'COMEDY' when 6 then 'SOUNDEFFECTS' when 7 then 'VIDEOGAME' when 8 then 'ODD' else 'ARTIST' end as bucket,
  case when l_suppkey % 6 = 0 then '' else 'Top' || cast(l_suppkey % 9 as string) || '/' end || case when l_suppkey % 6 in (2, 3) then 'Artist ' || cast(l_suppkey % 4 as string) || '/' else '' end || case l_suppkey % 5 when 0 then 'CD 2/' when 1 then '1999 - Blue/' when 2 then 'Red: One/' else '' end
    || case l_orderkey % 4 when 0 then '07 - Song.MP3' when 1 then 'Tune.flac' when 2 then '12.ogg' else '3_.mp3' end as path,
  case when l_orderkey % 3 = 0 then 'The Band' when l_orderkey % 3 = 1 then ' ' end as artist, case when l_orderkey % 5 = 0 then '2001 - Gold' when l_orderkey % 5 = 1 then 'Gold/Old' end as album, case when l_orderkey % 7 = 0 then 'Name?' end as title,
  case when l_orderkey % 6 = 0 then '4/12' end as track, case when l_orderkey % 4 = 1 then '1987-05-01' end as date from lineitem"""
_SAFE = "(case when {0} = '' then '_' else {0} end)"


def _safe(text: str) -> str:
    out = f"replace(replace(replace({text}, ':', ' - '), '/', ' '), '?', '')"
    out = f"regexp_replace(trim(regexp_replace({out}, ' +', ' ', 'g')), '[. ]+$', '')"
    return _SAFE.format(out)


def _letter(text: str) -> str:
    rest = f"regexp_replace({text}, '^(?:the|a|an|el|la|los|las|les) +', '', 'i')"
    return f"case when {rest} = '' then '_Unknown' when regexp_matches(upper({rest}[1]), '[A-Z]') then upper({rest}[1]) when regexp_matches({rest}[1], '[0-9]') then '0-9' else '_Other' end"


@query(rf"""
with t as ({_TRACKS}), s as (select *, string_split(path, '/') as segs, len(segs) as n, regexp_replace(segs[-1], '\.[^.]*$', '') as stem, lower(regexp_extract(path, '(\.[^./]+)$', 1)) as ext, nullif(trim(coalesce(artist, '')), '') as ta,
  regexp_matches(segs[-2], '(?i)^(cd *[0-9]+|disc *[0-9]+)$') as disc from t),
u as (select *, coalesce(ta, case when bucket = 'ARTIST' and n > 1 then segs[1] when bucket = 'DISSOLVE' and n > 2 then segs[2] when bucket = 'DISSOLVE' then '_Unknown Artist' when bucket = 'COMPILATION' then 'Various Artists' else '' end) as artist_used,
  case when ta is not null then 'tag' when bucket = 'ARTIST' and n > 1 then 'depth1_folder' when bucket = 'DISSOLVE' and n > 2 then 'depth2_folder' when bucket in ('DISSOLVE', 'COMPILATION') then 'fallback' else '' end as artist_source,
  coalesce(album, case when n > 1 and not disc then segs[-2] when n > 2 and disc then segs[-3] end, '_Unknown Album') as al, case when album is not null then 'tag' when n > 1 and not disc then 'parent_folder' when n > 2 and disc then 'grandparent_folder' else 'fallback' end as album_source from s),
v as (select *, coalesce(nullif(regexp_extract(al, '^(?:19|20)[0-9]{{2}} *[-_] *(.+)$', 1), ''), al) as album_used, try_cast(regexp_extract(al, '^((?:19|20)[0-9]{{2}}) *[-_] *.+$', 1) as int) as inner_year, try_cast(date[1:4] as int) as tag_year,
  try_cast(regexp_extract(stem, '^ *([0-9]{{1,3}})[ _.-]+', 1) as int) as num, trim(regexp_replace(stem, '^ *[0-9]{{1,3}} *[-_.] *', '')) as rest, case when track is not null then '04' end as tt from u),
w as (select *, coalesce(tag_year, inner_year) as year_used, case when tag_year is not null then 'tag' when inner_year is not null then 'album_folder' else 'missing' end as year_source,
  coalesce(tt, case when num between 1 and 999 then lpad(num::varchar, 2, '0') end) as track_used, case when tt is not null then 'tag' when num between 1 and 999 then 'filename' else 'missing' end as track_source,
  coalesce(title, nullif(rest, ''), 'Unknown Title') as title_used, case when title is not null then 'tag' when rest <> '' then 'filename' else 'fallback' end as title_source from v),
x as (select *, {_safe("coalesce(track_used || ' - ', '') || case when bucket = 'COMPILATION' then artist_used || ' - ' else '' end || title_used")} || ext as file, {_safe("coalesce(year_used || ' - ', '') || album_used")} as folder, {_safe("artist_used")} as a from w),
y as (select *, case when bucket in ('ARTIST', 'DISSOLVE') then {_letter("artist_used")} || '/' || a || '/' || folder || '/' || file when bucket = 'SOUNDTRACK' then 'Soundtracks/' || folder || '/' || file when bucket = 'COMPILATION' then 'Compilations/' || folder || '/' || file
  when bucket = 'RADIO' then 'Radio/' || {_safe("coalesce(nullif(artist_used, ''), case when n > 2 then segs[2] end, '_Unknown')")} || '/' || folder || '/' || file when bucket = 'AUDIOBOOK' then 'Audiobooks/' || {_safe("coalesce(nullif(artist_used, ''), '_Unknown Author')")} || '/' || folder || '/' || file
  when bucket = 'COMEDY' then 'Comedy/' || {_letter("artist_used")} || '/' || a || '/' || folder || '/' || file when bucket = 'SOUNDEFFECTS' then 'Sound Effects/' || array_to_string([{_safe("z")} for z in segs[2:n - 1]] || [file], '/')
  when bucket = 'VIDEOGAME' then 'Video Game Soundtracks/' || {_safe("coalesce(case when n > 2 then segs[2] end, '_Unknown Game')")} || '/' || file else '_Review/' || path end as new_path from x)
select l_orderkey, l_linenumber, artist_used, artist_source, album_used, album_source, year_used, year_source, track_used, track_source, title_used, title_source, new_path,
  array_to_string(list_filter([case when bucket = 'DISSOLVE' and artist_source = 'fallback' then 'artist_missing_in_genre_bucket' end, case when artist_used = '' and bucket in ('ARTIST', 'DISSOLVE', 'COMEDY', 'ODD') then 'artist_missing' end,
    case when album_source = 'fallback' then 'album_missing' end, case when title_source = 'fallback' then 'title_missing' end, case when bucket = 'ODD' then 'unknown_bucket:ODD' end, case when contains(new_path, '_Unknown') or contains(new_path, '_Review') then 'unknown_destination_segment' end], lambda r: r is not null), ';') as reasons from y
""".replace("list_filter([case", "[r for r in [case").replace("end], lambda r: r is not null)", "end] if r is not null]"))
def music_routes(spark, d):
    """The new path of each track, where each part of it was taken from, and what has to be reviewed."""
    read(spark, d, "lineitem").createOrReplaceTempView("_route_lineitem")
    out = music.routed(spark.sql(_TRACKS.replace("from lineitem", "from _route_lineitem")))
    fields = [f"{x}_{y}" for x in ("artist", "album", "year", "track", "title") for y in ("used", "source")]
    return out.select("l_orderkey", "l_linenumber", *fields, "new_path", "reasons")


_LEFT = """select doc_id as id, 'old/' || lang || '/' || cast(doc_id as string) || '.mp3' as path, case doc_id % 4 when 0 then 'flac' when 1 then 'wav' else 'mp3' end as ext, case when doc_id % 17 > 0 then md5(text) end as hash, doc_id % 320 as bitrate, doc_id % 6 as tags,
  case when doc_id % 8 > 0 then 'A' else ' ' end as artist, case when doc_id % 9 > 0 then 't' end as title, 'N/' || cast(n_chars % 400 as string) as target from documents where lang <> 'en'"""
_NEW = "select md5(text) as hash, 'n/' || cast(n_chars % 900 as string) as path from documents where lang = 'en'"


@query(f"""
with f as ({_LEFT}), n as ({_NEW}), r as (select *, row_number() over (partition by hash order by ext not in ('flac', 'wav'), -bitrate, -tags, length(path), lower(path), id) as place from f),
d as (select *, case when hash in (select hash from n) then 'HASH_DUPLICATE_OF_NEW' when hash is not null and place > 1 then 'HASH_DUPLICATE_INTERNAL' when trim(artist) = '' or title is null then 'NEEDS_REVIEW'
  when lower(target) in (select lower(path) from n) then 'DESTINATION_COLLISION' else 'NEEDS_RENAME' end as decision from r),
e as (select *, row_number() over (partition by lower(target), decision order by ext not in ('flac', 'wav'), -bitrate, -tags, length(path), lower(path), id) as turn from d)
select id, case when decision = 'NEEDS_RENAME' and turn > 1 then 'NEEDS_RENAME_LOSER' else decision end as decision, case when decision = 'NEEDS_RENAME' then target end as place from e
""")
def leftover_plan(spark, d):
    """What to do with each leftover file: winners for each hash, then for each place."""
    read(spark, d, "documents").createOrReplaceTempView("_left_documents")
    files, tree = (spark.sql(q.replace("from documents", "from _left_documents")) for q in (_LEFT, _NEW))
    return music.leftovers(files, tree)


_REVIEWED = """select o_orderkey, concat_ws('; ', case when o_orderkey % 2 = 1 then 'artist_tag_disagrees_(sim=0.31)' end, case when o_orderkey % 3 = 0 then 'artist_too_short' end, case when o_orderkey % 5 = 0 then 'album_unknown' end,
    case when o_orderkey % 7 = 0 then 'many_changes' end, case when o_orderkey % 11 = 0 then 'odd_one_(sim=0.5)' end) as notes,
  case o_orderkey % 4 when 0 then 'U2' when 1 then 'A' when 2 then null else 'x y' end as artist, case when o_custkey % 2 = 1 then 'A/B/01 - Cher - Song.mp3' else 'A/02 Track one - x.mp3' end as path,
  case when o_orderkey % 13 = 0 then 'x' else cast(o_orderkey % 5 as string) end as changes from orders"""


@query(f"""
with n as ({_REVIEWED.replace("as string)", "as varchar)")}),
r as (select *, o_orderkey % 3 = 0 as short, coalesce(artist, 'A') = 'A' as single, path like '%Cher%' as named, o_orderkey % 7 = 0 and o_orderkey % 2 = 0 and o_orderkey % 3 > 0 and o_orderkey % 5 > 0 and o_orderkey % 11 > 0 as alone,
  case when o_orderkey % 13 = 0 then 0 else o_orderkey % 5 end as n from n),
k as (select *, concat_ws(';', case when short and artist = 'x y' then 'artist_too_short' end, case when o_orderkey % 7 = 0 and not alone then 'many_changes' end, case when o_orderkey % 11 = 0 then 'odd_one_(sim=0.5)' end) as kept from r)
select o_orderkey, case when kept <> '' then 'REVIEW' when o_orderkey % 5 = 0 or (short and single and not named) or n = 0 then 'KEEP_OLD' when n >= 3 then 'IMPROVEMENT' else 'AUTO_APPLY' end as classification, kept as notes,
  case when short and single and named then 'Cher' else artist end as artist, case when short and single and named then 'filename_recovered' end as artist_source from k
""")
def review_outcomes(spark, d):
    """What becomes of rows in review, by folding their reasons over the rules."""
    read(spark, d, "orders").createOrReplaceTempView("_review_orders")
    rows = spark.sql(_REVIEWED.replace("from orders", "from _review_orders"))
    found = music.reviewed(F.col("notes"), F.col("artist"), F.col("path"), F.col("changes"), recover=True)
    return rows.select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


_TV_PLAN = """select s_suppkey as series_id, concat('I:/S', cast(s_suppkey as string)) as source_folder, concat('H:/TV/T', cast(s_suppkey % 40 as string)) as target_folder,
  s_suppkey % 40 + case when s_suppkey % 7 = 3 then 1000 else 0 end as tmdb_series_id, concat('Show ', cast(s_suppkey as string)) as matched_series from supplier"""
_TV_FILES = """select distinct l_suppkey as series_id, concat('I:/S', cast(l_suppkey as string), '/s', cast(l_linenumber % 3 as string), '/f', cast(l_orderkey as string), '_', cast(l_partkey as string), '_', cast(l_linenumber as string), '.mkv') as path, cast(l_quantity as bigint) as size,
  concat('h', cast(l_partkey % 50 as string), '_', cast(l_linenumber % 3 as string), case when l_discount > 0.07 then 'x' else '' end) as hash, l_linenumber % 3 as season, l_partkey % 50 as episode from lineitem where l_linestatus = 'F'"""


@query(f"""
with p as ({_TV_PLAN.replace("as string)", "as varchar)")}), g as (select target_folder, min(series_id) as first, count(distinct tmdb_series_id) as ids from p group by 1),
m as (select p.series_id, source_folder, p.target_folder as target, g.first as head, p.tmdb_series_id as tmdb from p join g on g.target_folder = p.target_folder where ids = 1),
f as (select x.*, target, head, tmdb, 'S' || lpad(season::varchar, 2, '0') || 'E' || lpad(episode::varchar, 2, '0') as key, regexp_extract(path, '[^/]*$') as name from ({_TV_FILES.replace("as string)", "as varchar)")}) x join m on m.series_id = x.series_id),
k as (select head, key, count(distinct hash) = 1 as same from f group by 1, 2),
r as (select f.*, same, row_number() over (partition by f.head, f.key order by case when same then 0 else -size end, series_id, path) as place from f join k on k.head = f.head and k.key = f.key),
kept as (select *, target || '/' || case when season = 0 then 'Specials' else 'Season 0' || season || ' ()' end as dir from r where place = 1)
select m.series_id, 'A' as stage, 'fail' as op, cast(null as varchar) as source, target, 'no parseable episodes' as reason from m where head not in (select head from f)
union all select series_id, 'B', 'quarantine', path, 'duplicates/' || target[7:] || '/sid' || series_id || '_' || key || '_' || name, case when same then 'duplicate_identical' else 'duplicate_smaller_size=' || size end from r where place > 1
union all select distinct head, 'C', 'look_up', null, null, tmdb || ' season ' || season from kept
union all select distinct head, 'E', 'mkdir', null, target, null from kept
union all select distinct head, 'E', 'mkdir', null, dir, null from kept
union all select series_id, 'F', 'move', path, dir || '/Show ' || head || ' ' || key || ' -.mkv', null from kept
union all select distinct series_id, 'J', 'rmdir', 'I:/S' || series_id || '/s' || season, null, '0997' from f
union all select distinct series_id, 'J', 'rmdir', 'I:/S' || series_id, null, '0998' from f
""")
def series_actions(spark, d):
    """What carrying out a plan of series would do, sources that share a target merged."""
    read(spark, d, "supplier").createOrReplaceTempView("_tv_supplier")
    read(spark, d, "lineitem").createOrReplaceTempView("_tv_lineitem")
    plan = spark.sql(_TV_PLAN.replace("from supplier", "from _tv_supplier"))
    files = spark.sql(_TV_FILES.replace("from lineitem", "from _tv_lineitem")).withColumn("episode_end", F.lit(None).cast("int"))
    none = lambda schema: spark.createDataFrame([], schema)
    return series.actions(plan, files, none("tmdb_series_id bigint, season int, year int"), none("tmdb_series_id bigint, season int, episode int, title string"), none("path string, size bigint, hash string"))


_SKIPPED = """select s_suppkey as series_id, concat('I:/', p_name, case when s_suppkey % 3 = 0 then concat(' (', cast(1990 + p_size % 12 as string), ')') else '' end, ' complete') as source_folder, case when s_suppkey % 7 = 6 then 'AUTO' else 'SKIP' end as action,
  case s_suppkey % 4 when 0 then 'no_tmdb_results' when 1 then 'x;multi_result_3' when 2 then 'no_tmdb_results;retmdb_attempted' else 'no_tmdb_results;y' end as flags, case when s_suppkey % 4 = 1 then s_suppkey end as tmdb_series_id,
  cast(null as string) as matched_series, cast(null as int) as matched_year, cast(null as string) as target_folder, '10' as confidence, case when s_suppkey % 5 = 0 then 'seen' end as notes from supplier join part on p_partkey = s_suppkey"""
_HEARD = """select query, year, cast(row_number() over (partition by query, year order by id) as int) as rank, id, name, first_year, votes, popularity from (
  select p_name as query, y as year, min(p_partkey) as id, concat(p_name, case when p_brand like '%1' then '' else concat(' ', p_brand) end) as name, cast(min(1990 + p_size % 12) as int) as first_year, count(*) as votes, cast(count(*) * 3 as double) as popularity
  from part lateral view explode(array(cast(null as int), 1990 + p_size % 12)) t as y where y is null or y = 1990 + p_size % 12 group by p_name, y, p_brand)"""


def _skipped(spark, d):
    for t in ("supplier", "part"):
        read(spark, d, t).createOrReplaceTempView(f"_skipped_{t}")
    return spark.sql(_SKIPPED.replace("from supplier join part", "from _skipped_supplier join _skipped_part"))


@query()
def series_proposals(spark, d):
    """Candidates for series that no search settled, by one search after the other."""
    plan = proposals.eligible(_skipped(spark, d), several=True)
    hints = plan.where("series_id % 5 = 1").select("series_id", F.reverse(F.regexp_extract("source_folder", "^I:/(.*?)( [(].*)? complete$", 1)).alias("hint"))
    found = proposals.proposed(plan, hints, spark.sql(_HEARD.replace("from part", "from _skipped_part")))
    return found.select("series_id", "verdict", "strategy", "query", "year", F.to_json("candidates").alias("candidates"), "pick")


@query(f"""
with p as ({_SKIPPED.replace("as string)", "as varchar)")}),
k as (select *, series_id % 6 < 5 as was_proposed, series_id % 6 as pick, 'n ' || series_id || ': x' as title, 2000 + series_id % 9 as yr from p),
o as (select *, case when not was_proposed then null when pick = 0 then 'rejected' when pick > 2 then 'error' else 'accepted' end as outcome from k)
select series_id, source_folder, case when outcome = 'accepted' then 'AUTO' else action end as action,
  case when outcome = 'rejected' then case series_id % 4 when 0 then 'no_tmdb_results;retmdb_attempted' when 1 then 'x;multi_result_3;disambig_attempted' when 2 then flags else 'no_tmdb_results;y;retmdb_attempted' end
    when outcome = 'accepted' then case series_id % 4 when 0 then 'retmdb_committed' when 1 then 'x;disambig_committed' when 2 then 'retmdb_attempted;retmdb_committed' else 'y;retmdb_committed' end else flags end as flags,
  case when outcome = 'accepted' then series_id * 10 + pick else tmdb_series_id end as tmdb_series_id, case when outcome = 'accepted' then title end as matched_series, case when outcome = 'accepted' and pick = 1 then cast(yr as integer) end as matched_year,
  case when outcome = 'accepted' then 'H:/TV/n ' || series_id || ' - x (' || case when pick = 1 then yr::varchar else '' end || ') {{tmdb-' || (series_id * 10 + pick) || '}}' end as target_folder, case when outcome = 'accepted' then '70' else confidence end as confidence,
  case when outcome = 'accepted' then coalesce(notes || '; ', '') || case when series_id % 4 = 1 then 'disambig' else 'retmdb' end || ': matched via folder_clean (cand=' || pick || ')' else notes end as notes, outcome from o
""".replace("{{", "{").replace("}}", "}"))
def committed_proposals(spark, d):
    """A plan after a user picked among two proposals for most of its rows, and a third that is not there for some."""
    plan = _skipped(spark, d)
    label = lambda n, year: F.concat((F.col("series_id") * 10 + n).cast("string"), F.lit("|n "), F.col("series_id").cast("string"), F.lit(": x"), year)
    first = label(1, F.concat(F.lit(" ("), (2000 + F.col("series_id") % 9).cast("string"), F.lit(")")))
    offered = F.array(F.struct(first.alias("label"), F.lit(0.9).alias("score")), F.struct(label(2, F.lit("")).alias("label"), F.lit(0.8).alias("score")))
    picked = plan.where("series_id % 6 < 5").select("series_id", F.lit("folder_clean").alias("strategy"), offered.alias("candidates"), (F.col("series_id") % 6).cast("string").alias("pick"))
    return proposals.committed(plan, picked, "H:/TV")


_HEARD_FILES = """select o_orderkey, case o_orderkey % 9 when 0 then 'error' else ' match' end as status, (85 + o_orderkey % 16) / 100.0D as score, concat(case o_orderkey % 4 when 0 then 'E:/Music/Top Artist/x/' when 1 then 'F:/other/' when 2 then 'E:/Music/' else '' end,
  case o_orderkey % 3 when 0 then '01 - Some One - A Song - Live.mp3' when 1 then '7. Song.ogg' else 'Song.flac' end) as path, case o_orderkey % 5 when 0 then 'song' when 1 then 'a song - live (demo)' when 2 then 'other' when 3 then '' else 'song' end as title from orders"""


@query("""
with f as (select o_orderkey, o_orderkey % 9 = 0 as failed, (85 + o_orderkey % 16) / 100.0::double as score, case o_orderkey % 3 when 0 then 'Some One' else '' end as artist, case o_orderkey % 3 when 0 then 'A Song - Live' else 'Song' end as hint,
    case o_orderkey % 4 when 0 then 'Top Artist' when 1 then 'other' when 2 then case o_orderkey % 3 when 0 then '01 - Some One - A Song - Live.mp3' when 1 then '7. Song.ogg' else 'Song.flac' end else '' end as folder,
    case o_orderkey % 5 when 1 then 'a song - live (demo)' when 2 then 'other' when 3 then '' else 'song' end as title from orders),
s as (select *, case when title = '' or not (contains(title, lower(hint)) or contains(lower(hint), title)) then 0.0 else least(length(title), length(hint)) / greatest(length(title), length(hint)) end as held from f)
select o_orderkey, artist, hint as title, folder, round(held, 6) as held, case when failed then 'SKIP_error' when score >= 0.95 and held >= 0.7 and artist <> '' then 'AUTO_APPLY' when score >= 0.95 and held >= 0.6 then 'AUTO_APPLY_OK'
  when score >= 0.9 and (held >= 0.4 or artist <> '') then 'REVIEW_PARTIAL' when score >= 0.9 then 'REVIEW_HIGH' else 'REVIEW_LOW' end as class from s
""")
def acoustid_first_class(spark, d):
    """What a file's path says of its artist and title, and what to do with a fingerprint's match by it."""
    read(spark, d, "orders").createOrReplaceTempView("_heard_orders")
    rows = spark.sql(_HEARD_FILES.replace("from orders", "from _heard_orders")).withColumn("h", music.file_hint(F.col("path")))
    held = music.held_share(F.col("title"), F.lower("h.title"))
    hint = (F.col("h.artist") != "") | (F.col("h.title") != "") | (F.col("h.folder") != "")
    kind = music.first_acoustid_class(F.col("status"), F.col("score"), held, F.when(F.col("h.artist") != "", 0.9).otherwise(0.0), hint)
    return rows.select("o_orderkey", F.col("h.artist").alias("artist"), F.col("h.title").alias("title"), F.col("h.folder").alias("folder"), F.round(held, 6).alias("held"), kind.alias("class"))
