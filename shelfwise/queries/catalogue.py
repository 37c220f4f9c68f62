"""Path and folder queries; the URLs of pages stand for paths, their HTML for metadata files."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import paths, records
from shelfwise.operators import trees
from shelfwise.registry import query, read

_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_SQL_PATH = f"rtrim({_PATH}, '/')"


def _pages(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(f"rtrim('/', {_PATH})").alias("path"), F.length("html").cast("long").alias("size"), "html")


@query(f"""
select page_id, nullif(regexp_extract({_SQL_PATH}, '/([0-9]+)(?:\\.html)?$', 1), '') as item_id,
  nullif(regexp_extract({_SQL_PATH}, '/(en|de|fr|es)/', 1), '') as lang,
  nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') as page, nullif(regexp_extract({_SQL_PATH}, '\\.([^./]+)$', 1), '') as ext from pages
""")
def url_ids(spark, d):
    """Ids and tags in names, null where there is none."""
    rows = _pages(spark, d).join(read(spark, d, "pages").select("page_id", "url"), "page_id")
    p = F.col("path")
    return rows.select(
        "page_id",
        paths.found(p, r"/([0-9]+)(?:\.html)?$").alias("item_id"),
        paths.found(p, "/(en|de|fr|es)/").alias("lang"),
        paths.found(F.col("url"), "[?&]page=([0-9]+)").alias("page"),
        paths.found(p, r"\.([^./]+)$").alias("ext"),
    )


@query(f"""
with p as (select page_id, {_SQL_PATH} as path, length(html) as size from pages),
a as (select *, unnest(range(1, len(string_split(path, '/')))) as k from p)
select array_to_string(string_split(path, '/')[1:k], '/') as folder, count(*)::bigint as files, sum(size)::bigint as total,
       count(*) filter (where k = len(string_split(path, '/')) - 1)::bigint as direct_files
from a group by 1
""")
def url_path_rollup(spark, d):
    """Files and bytes of each folder, all levels."""
    return trees.subtree_totals(_pages(spark, d), "path", "size")


@query(f"""
with p as (select page_id, {_SQL_PATH} as path from pages),
a as (select *, unnest(range(1, len(string_split(path, '/')))) as k from p),
f as (select page_id, k, array_to_string(string_split(path, '/')[1:k], '/') as folder from a),
t as (select array_to_string(string_split(path, '/')[1:2], '/') as folder from p group by 1 having count(*) > 1
      union select string_split(path, '/')[1] from p group by 1 having count(*) > 3)
select page_id, arg_max(folder, k) as nearest from f join t using (folder) group by 1
""")
def nearest_title_folder(spark, d):
    """Each file's nearest ancestor that is a title folder."""
    pages = _pages(spark, d).select("page_id", "path")
    both = [pages.groupBy(F.substring_index("path", "/", n).alias("folder")).count().where(f"count > {k}").select("folder") for n, k in ((2, 1), (1, 3))]
    return trees.nearest(pages, both[0].union(both[1]), "path").select("page_id", "nearest")


@query(f"""
with p as (select page_id, {_SQL_PATH} as path from pages),
t as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as title from p union select path from p where path like '%.html'),
u as (select title, page_id from t join p on starts_with(lower(path), lower(title) || '/')),
s as (select title, page_id from t join p on title like '%.html'
      and lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) = lower(regexp_extract(title, '^(.*)/[^/]*$', 1))
      and starts_with(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')), lower(regexp_replace(regexp_extract(title, '[^/]*$'), '\\.[^.]*$', ''))))
select * from u union select * from s
""")
def title_files_prefix(spark, d):
    """Titles with their files; the prefix join as an equality of ancestors."""
    pages = _pages(spark, d).select("page_id", "path")
    folders = pages.select(paths.parent(F.col("path")).alias("title"))
    titles = folders.union(pages.where("path like '%.html'").select("path")).distinct()
    return trees.files_of_titles(titles, pages, "title", "path").select("title", "page_id")


@query("""
select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title,
       nullif(regexp_extract(html, '(tt[0-9]{6,})', 1), '') as imdb_id from pages
""")
def html_title_fallback(spark, d):
    """Title and id of markup by patterns alone."""
    found = paths.nfo_ids(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.nullif(found["title"], F.lit("")).alias("title"), found["imdb_id"].alias("imdb_id"))


_ROLE_NAMES = """case p_partkey % 4 when 0 then p_type || '/' when 1 then 'Extras/' || p_brand || '/' when 2 then 'The Making Of/' else '' end || case floor(p_partkey / 4) % 7 when 0 then p_name || '-Fanart' when 1 then 'poster' when 2 then 'movie-poster-fanart'
  when 3 then 'deleted ' || p_name when 4 then p_name || ' commentary' when 5 then 'banner' else p_name end || case floor(p_partkey / 28) % 9 when 0 then '.MKV' when 1 then '.jpg' when 2 then '.PNG' when 3 then '.srt' when 4 then '.nfo' when 5 then '.mp4' when 6 then '.webp' when 7 then '.txt' else '' end"""
_SETS = {kind: "(" + ", ".join(f"'{x}'" for x in some) + ")" for kind, some in paths.EXTENSIONS.items()}


@query(rf"""
with n as (select p_partkey, {_ROLE_NAMES} as name from part), e as (select *, lower(regexp_extract(name, '\.([^./]+)$', 1)) as ext, lower(regexp_replace(regexp_replace(name, '^.*/', ''), '\.[^.]*$', '')) as stem from n)
select p_partkey, case when ext in {_SETS["video"]} then 'video' when ext in {_SETS["subtitle"]} then 'subtitle' when ext in {_SETS["nfo"]} then 'nfo' when ext not in {_SETS["image"]} then 'other'
    when contains(stem, 'fanart') then 'fanart' when contains(stem, 'poster') then 'poster' else 'image' end as role,
  case when ext in {_SETS["video"]} then 'video' when ext in {_SETS["subtitle"]} then 'subtitle' when ext in {_SETS["nfo"]} then 'nfo' when ext not in {_SETS["image"]} then 'other'
    when stem in ('fanart', 'poster', 'banner') then stem when contains(stem, 'fanart') then 'fanart' when contains(stem, 'poster') then 'poster' when contains(stem, 'banner') then 'banner' else 'image' end as exact_role,
  regexp_matches(lower(regexp_replace(name, '\.[^./]*$', '')), '{"|".join(paths.EXTRA_WORDS)}') as extra from e
""")
def file_roles(spark, d):
    """Roles by extension and name, for films and for series, and whether a file looks like an extra."""
    rows = read(spark, d, "part").select("p_partkey", F.expr(_ROLE_NAMES).alias("name"))
    return rows.select("p_partkey", paths.role(F.col("name")).alias("role"), paths.role(F.col("name"), exact=True).alias("exact_role"), paths.looks_like_extra(F.col("name")).alias("extra"))


@query("""
select o_orderkey, nullif(regexp_extract(n, '\\{imdb-(tt[0-9]{6,})\\}', 1), '') as imdb_id,
  case when n like '%{tmdb-%' then o_orderkey end as tmdb_id, (1990 + o_orderkey % 30)::int as year
from (select *, 'Show (' || (1990 + o_orderkey % 30) || ') ' || case when o_orderkey % 2 = 0 then '{imdb-tt' || lpad(o_orderkey::varchar, 7, '0') || '}'
      else '{tmdb-' || o_orderkey || '}' end as n from orders)
""")
def folder_ids(spark, d):
    """Ids and years in tagged folder names."""
    key = F.col("o_orderkey")
    tag = F.when(key % 2 == 0, F.concat(F.lit("{imdb-tt"), F.lpad(key.cast("string"), 7, "0"), F.lit("}"))).otherwise(F.concat(F.lit("{tmdb-"), key.cast("string"), F.lit("}")))
    name = F.concat(F.lit("Show ("), (1990 + key % 30).cast("string"), F.lit(") "), tag)
    return read(spark, d, "orders").select("o_orderkey", name.alias("n")).select("o_orderkey", paths.ids_in_name(F.col("n")).alias("i")).select("o_orderkey", "i.*")


#: Records of films and metadata files out of parts, as the film service and people write them.
_RECORD = """concat('{"id": ', cast(p_partkey as string), ', "title": "', p_name, ' & co", "release_date": "', case when p_partkey % 4 > 0 then '1999-01-02' else '' end, '", "vote_count": ', cast(p_partkey % 3 as string), ', "vote_average": ', cast(p_partkey % 5 as string), '.5',
  ', "genres": [', case p_partkey % 3 when 0 then '' when 1 then concat('{"name": "', p_type, '"}') else concat('{"name": "', p_type, '"}, {"id": 5, "name": "Two"}') end, '], "belongs_to_collection": ', case when p_partkey % 5 > 1 then concat('{"name": "', p_brand, case when p_partkey % 2 = 0 then ' Collection' else '' end, '"}') else 'null' end,
  ', "credits": {"cast": [', array_join(transform(sequence(1, cast(1 + p_partkey % 13 as int)), n -> concat('{"name": "A', cast(n as string), '", "character": "', case when n % 2 = 0 then '<c>' else '' end, '"}')), ', '), '], "crew": [{"name": "Ed", "job": "Editor"}', case when p_partkey % 7 > 0 then concat(', {"name": "Di', cast(p_partkey % 9 as string), '", "job": "Director"}, {"name": "Second", "job": "Director"}') else '' end, ']}',
  ', "release_dates": {"results": [{"iso_3166_1": "DE", "release_dates": [{"certification": "16"}]}', case p_partkey % 4 when 0 then '' when 1 then ', {"iso_3166_1": "US", "release_dates": [{"certification": " "}, {"certification": " PG "}]}' else ', {"iso_3166_1": "US", "release_dates": [{"certification": ""}]}, {"iso_3166_1": "US", "release_dates": [{"certification": "R"}]}' end, ']}}')"""


@query("""
select p_partkey, case p_partkey % 4 when 0 then null when 1 then 'PG' else 'R' end as certification, case when p_partkey % 4 = 1 then 'PG' end as first_certification, case when p_partkey % 7 > 0 then 'Di' || (p_partkey % 9) end as director,
  case p_partkey % 3 when 0 then null when 1 then p_type else p_type || ', Two' end as genres, case when p_partkey % 5 > 1 then p_brand end as collection,
  '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<movie>' || chr(10) || '  <title>' || p_name || ' &amp; co</title>' || chr(10) || '  <year>1999</year>' || chr(10) || '  <tmdbid>' || p_partkey || '</tmdbid>' || chr(10)
  || case when p_partkey % 5 > 1 then '  <set>' || chr(10) || '    <name>' || p_brand || case when p_partkey % 2 = 0 then ' Collection' else '' end || '</name>' || chr(10) || '  </set>' || chr(10) else '' end
  || case when p_partkey % 4 > 0 then '  <premiered>1999-01-02</premiered>' || chr(10) else '' end || case p_partkey % 3 when 0 then '' when 1 then '  <genre>' || p_type || '</genre>' || chr(10) else '  <genre>' || p_type || '</genre>' || chr(10) || '  <genre>Two</genre>' || chr(10) end
  || '  <rating>' || (p_partkey % 5) || '.5</rating>' || chr(10) || case when p_partkey % 3 > 0 then '  <votes>' || (p_partkey % 3) || '</votes>' || chr(10) else '' end || case p_partkey % 4 when 0 then '' when 1 then '  <mpaa>PG</mpaa>' || chr(10) else '  <mpaa>R</mpaa>' || chr(10) end
  || array_to_string(['  <actor>' || chr(10) || '    <name>A' || n || '</name>' || chr(10) || case when n % 2 = 0 then '    <role>&lt;c&gt;</role>' else '    <role />' end || chr(10) || '  </actor>' || chr(10) for n in range(1, least(11, 2 + p_partkey % 13))], '')
  || case when p_partkey % 7 > 0 then '  <director>Di' || (p_partkey % 9) || '</director>' || chr(10) || '  <director>Second</director>' || chr(10) else '' end || '</movie>' as nfo from part
""")
def film_records(spark, d):
    """What nested records of films say by the rules for their lists, and the metadata file for each."""
    f, none = F.col("f"), F.lit(None).cast("string")
    rows = read(spark, d, "part").select("p_partkey", F.from_json(F.expr(_RECORD), records.FILM).alias("f"))
    return rows.select(
        "p_partkey",
        records.certification(f).alias("certification"),
        records.certification(f, all_entries=False).alias("first_certification"),
        F.get(records.directors(f), F.lit(0)).alias("director"),
        records.genres(f).alias("genres"),
        records.collection(f).alias("collection"),
        records.nfo_file(f["title"], F.lit(1999), f["id"], none, F.lit(None).cast("int"), f["belongs_to_collection"]["name"], f).alias("nfo"),
    )


_XML = """case p_partkey % 5 when 0 then concat('<movie><title> ', p_name, ' </title><year>c. 1999</year><imdbid> </imdbid><id>tt', lpad(cast(p_partkey as string), 7, '0'), '</id><tmdbid>no ', cast(p_partkey as string), '</tmdbid></movie>')
  when 1 then concat('<movie><imdb_id>tt0000001</imdb_id><uniqueid type="IMDB">tt', lpad(cast(p_partkey as string), 8, '0'), '</uniqueid><uniqueid type="tmdb">', cast(p_partkey as string), '</uniqueid><tmdbid>1</tmdbid><runtime>90 min</runtime></movie>')
  when 2 then concat('see https://www.themoviedb.org/movie/', cast(p_partkey as string), '-x or tt', lpad(cast(p_partkey as string), 7, '0')) when 3 then concat('<movie><title>broken ', p_name) else concat('<movie><originaltitle>', p_name, ' &amp; co</originaltitle><title/></movie>') end"""


@query("""
select p_partkey, case p_partkey % 5 when 0 then 'tt' || lpad(p_partkey::varchar, 7, '0') when 1 then 'tt' || lpad(p_partkey::varchar, 8, '0') when 2 then 'tt' || lpad(p_partkey::varchar, 7, '0') end as imdb_id, case when p_partkey % 5 < 3 then p_partkey end as tmdb_id,
  case p_partkey % 5 when 0 then p_name when 4 then p_name || ' & co' end as title, case when p_partkey % 5 = 0 then 1999 end as year, case when p_partkey % 5 = 1 then 90 end as runtime from part
""")
def metadata_files(spark, d):
    """What metadata files say: by tags where they are XML, by patterns where they are not."""
    return read(spark, d, "part").select("p_partkey", records.nfo(F.expr(_XML)).alias("n")).select("p_partkey", "n.*")
