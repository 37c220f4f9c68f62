"""New files: what becomes of them batch by batch, and the statuses of matching."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.operators.staging import shared_dir, staged
from shelfwise.plans import intake as plans
from shelfwise.queries.clusters import _BM25
from shelfwise.registry import query, read
from shelfwise.streaming import intake, matching

#: Films out of parts; files out of customers and, as second copies, suppliers: six shapes of names for each; a library.
_FILMS = """select p_partkey as film_id, case when p_partkey % 3 > 0 then concat('tt', lpad(cast(p_partkey as string), 7, '0')) end as imdb,
  concat(p_name, ' ', lower(p_type), case when p_partkey % 2 = 0 then concat(' ', translate(cast(p_partkey as string), '0123456789', 'abcdefghij')) else '' end) as title,
  cast(1990 + p_size % 12 as int) as year, case when p_partkey % 5 = 0 then p_brand end as collection from part"""
_FILES = f"""with f as ({_FILMS}), d as (select c_custkey as k, concat('c', cast(c_custkey as string)) as who, cast(floor(abs(c_acctbal)) as bigint) as amount from customer
    union all select s_suppkey, concat('s', cast(s_suppkey as string)), cast(floor(abs(s_acctbal)) as bigint) from supplier),
t as (select d.*, f.*, case k % 6 when 0 then concat(title, ' (', cast(year as string), ') {{imdb-tt', lpad(cast(k as string), 7, '0'), '}}') when 1 then concat(replace(title, ' ', '.'), '.', cast(year as string), '.1080p')
    when 2 then title when 3 then concat(title, ' (', cast(year + 1 as string), ')') when 4 then concat(title, ' ', cast(year as string), ' Extended Cut') else concat(title, ' ', cast(year as string), case when k % 4 = 1 then ' 3D HSBS' else ' Extra 2' end) end as stem,
    case when k % 5 < 3 then '.mkv' else '.mp4' end as ext from d join f on f.film_id = d.k)
"""
_ROWS = """select concat('drop/', who, '/', stem, ext) as path, cast(null as string) as content, case when k % 17 > 0 then amount % 40 * 100 end as pixels, cast(k % 50 + 1 as bigint) as bitrate from t
union all select concat('drop/', who, '/', upper(stem), '.en.srt'), null, null, null from t where k % 6 in (0, 3)
union all select concat('drop/', who, '/', stem, '.nfo'), concat('<movie><id>tt', lpad(cast(k as string), 7, '0'), '</id></movie>'), null, null from t where k % 4 = 2"""
_LEAF = "title || ' (' || year || ') ' || case when imdb is null then '{tmdb-' || film_id || '}' else '{imdb-' || imdb || '}' end"
_HOME = f"'Movies/' || case when collection is null then '' else collection || '/' end || {_LEAF}"
_LIBRARY = f"select lower({_HOME} || '/' || {_LEAF} || '.mkv') as key, cast(year as bigint) * 0 + film_id % 30 * 100 as held_pixels, cast(film_id % 60 as double) as held_bitrate from f where film_id % 4 = 1"
#: The same by how each name was made: what it says of the film is known, without patterns.
_OUTCOMES = f"""{_FILES},
lib as (LIBRARY),
yearly as (select title, year, count(*) as n, min(film_id) as first from f group by 1, 2), named as (select title, count(*) as n, min(film_id) as first from f group by 1),
s as (select concat('drop/', who, '/', stem, ext) as path, k, ext, t.film_id as own, t.imdb as own_imdb, case when k % 17 > 0 then amount % 40 * 100 end as pixels, k % 50 + 1 as bitrate,
    case when k % 6 = 2 then null when k % 6 = 3 then t.year + 1 else t.year end as guess_year, y.n as year_n, y.first as year_first, a.n as any_n, a.first as any_first
    from t left join yearly y on y.title = t.title and y.year = case when k % 6 = 2 then null when k % 6 = 3 then t.year + 1 else t.year end join named a on a.title = t.title),
c as (select *, case when k % 6 = 0 then case when own_imdb is null then 'name_imdb_unknown' else 'name_imdb' end when k % 4 = 2 and own_imdb is not null then 'nfo_imdb' when year_n is not null then 'search' else 'search_without_year' end as note from s),
m as (select *, case note when 'name_imdb' then own when 'nfo_imdb' then own when 'search' then year_first when 'search_without_year' then any_first end as found, coalesce(year_n, any_n) as n from c),
x as (select m.*, f.* , case when note in ('name_imdb', 'nfo_imdb') then 95 when found is null then 0 when guess_year is null then case when n = 1 then 80 when n <= 3 then 75 else 60 end
    when guess_year = f.year then case when n <= 3 then 95 else 85 end when abs(guess_year - f.year) = 1 then case when n <= 3 then 85 else 75 end else 60 end as sure,
    case when k % 6 = 5 and k % 4 <> 1 then 'extra' when k % 6 = 5 and ext = '.mkv' then 'archive' else 'film' end as role from m left join f on f.film_id = found),
g as (select *, case role when 'extra' then {_HOME} || '/Extras/' || title || ' (' || year || ') - Extra 2' || ext when 'archive' then '3D MKV/' || {_LEAF} || ' - 3D.HSBS.mkv'
    else {_HOME} || '/' || case when k % 6 = 4 then replace(replace({_LEAF}, '{{imdb-', '{{edition-Extended Cut}} {{imdb-'), '{{tmdb-', '{{edition-Extended Cut}} {{tmdb-') else {_LEAF} end || case when k % 6 = 5 then ' - 3D.HSBS' else '' end || ext end as target from x),
w as (select *, case when target is null then 0 else count(*) over (partition by lower(target)) end as wanted, lower(target) as key from g),
o as (select w.*, held_pixels, held_bitrate, lib.key as held from w left join lib on lib.key = w.key)
select path, found as film_id, cast(case when wanted > 1 then least(sure, 30) else sure end as integer) as confidence, note, target, wanted,
  case when target is null then 'unresolved' when wanted > 1 then 'collision' when sure < 70 then 'review' when held is null then 'install' when role <> 'film' then 'exists' when pixels is null or held_pixels is null then 'undecided'
    when pixels > held_pixels then 'replace' when pixels < held_pixels then 'duplicate' when held_bitrate > 0 and abs(bitrate - held_bitrate) / held_bitrate < 0.05 then 'duplicate' when bitrate > held_bitrate then 'replace' else 'duplicate' end as outcome
from o"""


def _duck(sql: str) -> str:
    return sql.replace("as string)", "as varchar)")


def _tables(spark, d):
    for t in ("part", "customer", "supplier"):
        read(spark, d, t).createOrReplaceTempView(f"_intake_{t}")
    named = lambda sql: spark.sql(sql.replace("from part", "from _intake_part").replace("from customer", "from _intake_customer").replace("from supplier", "from _intake_supplier"))
    return named(_FILMS), named(_FILES.replace("{{", "{").replace("}}", "}").replace("t as (select d.*", "t as (select /*+ MERGE(f) */ d.*") + _ROWS), named(f"with f as ({_FILMS}) {_LIBRARY}")


@query(_duck(_OUTCOMES.replace("{{", "{").replace("}}", "}").replace("LIBRARY", _LIBRARY)))
def intake_outcomes(spark, d):
    """What becomes of each new video: its film and confidence, where it goes, and whether it may."""
    films, files, library = _tables(spark, d)
    held = library.select("key", F.col("key").alias("path"), F.col("held_pixels").alias("pixels"), F.col("held_bitrate").cast("long").alias("bitrate"))
    return plans.planned(files, films, held).select("path", "film_id", F.col("confidence").cast("int").alias("confidence"), "note", "target", "wanted", "outcome")


@query(_duck(_OUTCOMES.replace("{{", "{").replace("}}", "}").replace("LIBRARY", _LIBRARY + " and false")))
def intake_films_stream(spark, d):
    """The same files through the stream, into a library that is empty before; the outcomes that it keeps."""
    films, files, _ = _tables(spark, d)
    folder = f"{shared_dir(spark)}/drop-{uuid.uuid4().hex}"
    files.write.parquet(folder)
    store = intake.take_films(spark, folder, staged(films, "films"))
    return store.read("outcomes").select("path", "film_id", "confidence", "note", "target", "wanted", "outcome")


_ASKED = _BM25.replace("from benchmark)", "from benchmark where item_id not in (3, 8))") + """,
o as (select item_id, doc_id, score from s join documents using (doc_id) where source = 'src' || (item_id % 5)),
i as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place, lead(score, 1, 0) over (partition by item_id order by score desc, doc_id) as follow from o),
x as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place, lead(score, 1, 0) over (partition by item_id order by score desc, doc_id) as follow from s where item_id not in (select item_id from o)),
a2 as (select item_id, doc_id, score, round(score - follow, 6) as margin, case when score < 15 or round(score - follow, 6) < 5 then 'low_confidence' else 'ok' end as status from i where place = 1
  union all select item_id, doc_id, score, round(score - follow, 6), 'cross_show_match' from x where place = 1)"""


def _states(spark, d):
    """Transcripts out of benchmark items, two of them missing, matched in three parts against all documents."""
    store = matching.states(spark, f"{shared_dir(spark)}/states-{uuid.uuid4().hex}")
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string")).alias("show"), F.when(~F.col("item_id").isin(3, 8), F.col("text")).alias("transcript"))
    matching.prepare(store, items, 0)
    matching.identify(store, read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("show"), "text"), "first", 3)
    return store


@query(_ASKED + """
select cast(item_id as varchar) as path, doc_id as doc, round(score, 2) as score, case when item_id in (3, 8) then 'error' else coalesce(status, 'no_match') end as status from benchmark left join a2 using (item_id)
""")
def identify_states(spark, d):
    """The table of statuses after a run."""
    return _states(spark, d).read("states").select("path", "doc", F.round("score", 2).alias("score"), "status")


@query("select cast(item_id as varchar) as path, length(text) as said, cast(null as bigint) as doc, 'prepared' as status from benchmark where item_id not in (3, 8)")
def identify_states_reset(spark, d):
    """The table after a reset that takes errors with it: transcripts stay, results go."""
    store = _states(spark, d)
    matching.reset(store, 0, include_errors=True)
    return store.read("states").select("path", F.length("transcript").cast("long").alias("said"), "doc", "status")
