"""Checks before and after a run; orders stand for titles, and what is wrong with each follows from its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans import preflight
from shelfwise.registry import query, read

_PLAN = """select o_orderkey as title_id, case when o_orderkey % 4 = 3 then 'SKIP' else 'AUTO' end as action, case when o_orderkey % 5 = 0 then '2024-01-01' end as executed_at,
  case when o_orderkey % 17 = 0 then '' when o_orderkey % 19 = 0 then concat('D:/Other/T', cast(o_orderkey as string)) else concat('H:/Movies/T', cast(o_orderkey % 500 as string)) end as target_folder,
  case when o_orderkey % 29 > 0 then o_orderkey end as tmdb_id, concat('tt', cast(o_orderkey % 500 as string)) as imdb_id,
  case when o_orderkey % 23 > 0 then concat('T', cast(o_orderkey % 500 as string), case when o_orderkey % 31 = 0 then repeat('x', 230) else '' end) end as matched_title, 2000 as year,
  case o_orderkey % 13 when 0 then concat('duplicate_of:', cast(o_orderkey - 1 as string)) when 12 then 'keeper' else '' end as duplicate_role, concat('G:/in/T', cast(o_orderkey as string), '.mkv') as main_video_path from orders"""
_INVENTORY = """select o_orderkey as title_id, concat(case when o_orderkey % 6 = 0 then 'H:/in/f' else 'G:/in/f' end, cast(o_orderkey as string), '.mkv') as path, o_custkey + 1 as size_bytes, 'main_video' as role from orders where o_orderkey % 7 > 0"""
_DISK = """select path, case title_id % 11 when 1 then null when 2 then size_bytes + 1 else size_bytes end as size from inventory where title_id % 11 > 0"""
_GROUPS = """select o_orderkey as keeper, array(o_orderkey + 1, o_orderkey + 26) as losers from orders where o_orderkey % 13 = 12 union all select -o_orderkey, array(o_orderkey) from orders where o_orderkey % 997 = 1"""
_FINAL = "target_folder || '/' || coalesce(matched_title || ' ', '') || '(2000) {imdb-' || imdb_id || '}.mkv'"


def _duck(sql):
    return sql.replace("as string)", "as varchar)").replace("array(", "list_value(")


_TABLES = f"with plan as ({_duck(_PLAN)}), inventory as ({_duck(_INVENTORY)}), disk as ({_DISK}), groups as ({_duck(_GROUPS)}),"


def _tables(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("_checks_orders")
    sql = lambda q: spark.sql(q.replace("from orders", "from _checks_orders"))
    inventory = sql(_INVENTORY)
    inventory.createOrReplaceTempView("_checks_inventory")
    return sql(_PLAN), inventory, spark.sql(_DISK.replace("from inventory", "from _checks_inventory")), sql(_GROUPS)


@query(f"""
{_TABLES} auto as (select * from plan where action = 'AUTO' and executed_at is null), placed as (select *, {_FINAL} as final from auto where target_folder <> ''),
l as (select keeper, unnest(losers) as loser from groups where keeper in (select title_id from plan)),
f as (select i.*, target_folder, d.path is not null as there, d.size as now from inventory i join auto a on a.title_id = i.title_id left join disk d on d.path = i.path),
x as (select * from f where target_folder <> '' and path[1:2] <> target_folder[1:2]), needs as (select target_folder[1:2] as drive, sum(size_bytes) as need from x group by 1),
own as (select *, min(title_id) over (partition by lower(final)) as first from placed where duplicate_role not like 'duplicate_of:%')
select keeper as title_id, 'warning' as severity, 'dup_keeper_not_in_plan' as code, cast(null as varchar) as path from groups where keeper not in (select title_id from plan)
union all select keeper, 'warning', 'dup_role_mismatch', null from groups join plan on title_id = keeper where duplicate_role not in ('', 'keeper')
union all select loser, 'warning', 'dup_loser_not_in_plan', null from l where loser not in (select title_id from plan)
union all select loser, 'warning', 'dup_role_mismatch', null from l join plan on title_id = loser where duplicate_role <> 'duplicate_of:' || keeper
union all select title_id, 'error', 'missing_field', 'target_folder' from auto where target_folder = ''
union all select title_id, 'error', 'missing_field', 'tmdb_id' from auto where tmdb_id is null
union all select title_id, 'error', 'missing_field', 'matched_title' from auto where matched_title is null
union all select title_id, 'error', 'target_outside_root', target_folder from placed where target_folder like 'D:%'
union all select title_id, 'error', 'no_inventory_files', null from auto where title_id not in (select title_id from inventory)
union all select title_id, 'error', 'source_missing', path from f where not there
union all select title_id, 'error', 'size_drift', path from f where now <> size_bytes
union all select title_id, 'error', 'stat_failed', path from f where there and now is null
union all select title_id, 'error', 'duplicate_target', lower(final) from own where title_id > first
union all select null, 'warning', 'cross_drive_volume', cast(sum(size_bytes) as varchar) from x having sum(size_bytes) > 0
union all select null, 'error', 'insufficient_space', drive from needs where drive = 'H:' and 1000 < need * 1.05
union all select null, 'warning', 'disk_usage_check_failed', drive from needs where drive = 'D:'
union all select title_id, 'warning', 'long_path', final from placed where matched_title is not null and length(final) > 240
""")
def preflight_issues(spark, d):
    """What stands against the plan's pending titles."""
    plan, inventory, disk, groups = _tables(spark, d)
    drives = spark.sql("select * from values ('H:', 1000L), ('D:', null) as t(drive, free)")
    return preflight.films(plan, inventory, groups, disk, drives, "H:/Movies")


_SERIES = """select p_partkey as series_id, case when p_partkey % 5 = 4 then 'SKIP' else 'AUTO' end as action, cast(null as string) as executed_at, concat('I:/TV/', p_name, case when p_partkey % 3 = 0 then ' (2001)' else ' complete' end) as source_folder,
  case when p_partkey % 17 = 0 then null when p_partkey % 19 = 0 then concat('J:/', p_brand) else concat('H:/TV/', p_brand, ' ', cast(p_size as string)) end as target_folder,
  case when p_partkey % 23 > 0 then p_size + case when p_partkey % 11 = 0 then 1 else 0 end end as tmdb_series_id, case when p_partkey % 29 > 0 then concat(lower(p_name), ' {tmdb-1} x', case when p_partkey % 7 = 0 then 'y' else '' end) end as matched_series from part"""
_SERIES = _SERIES.replace("concat(lower(p_name), ' {tmdb-1} x', case when p_partkey % 7 = 0 then 'y' else '' end)", "case when p_partkey % 7 = 0 then 'Quite Another (1999)' else concat(upper(p_name), ' {tmdb-1}') end")


@query(f"""
with plan as ({_duck(_SERIES)}), auto as (select * from plan where action = 'AUTO'), placed as (select *, lower(target_folder) as target from auto where target_folder is not null),
g as (select target, count(*) as n, count(distinct tmdb_series_id) = 1 and count(tmdb_series_id) = count(*) as agree from placed group by 1),
m as (select p.* from placed p join g on g.target = p.target where n > 1 and agree)
select series_id as title_id, 'error' as severity, 'missing_tmdb_id' as code, source_folder as path from auto where tmdb_series_id is null
union all select series_id, 'error', 'missing_matched_series', source_folder from auto where matched_series is null
union all select series_id, 'error', 'missing_target_folder', source_folder from auto where target_folder is null
union all select series_id, 'error', 'target_outside_tv_root', source_folder from placed where target_folder like 'J:%'
union all select series_id, 'error', 'source_missing', source_folder from auto where source_folder like '%bolt%'
union all select null, 'error', 'duplicate_target', target from g where n > 1 and not agree
union all select series_id, 'error', 'merge_source_mismatch', source_folder from m where matched_series = 'Quite Another (1999)' and len([w for w in string_split(source_folder[7:], ' ') if length(w) > 3 and w not in ('complete', '(2001)')]) > 0
""")
def series_preflight_issues(spark, d):
    """What stands against the plan's pending series, merges included."""
    read(spark, d, "part").createOrReplaceTempView("_checks_part")
    plan = spark.sql(_SERIES.replace("from part", "from _checks_part"))
    disk = plan.where("source_folder not like '%bolt%'").select(F.upper("source_folder").alias("path")).distinct()
    return preflight.series(plan, disk, "H:/TV/")


_AFTER = "case title_id % 4 when 0 then 'H:/duplicates/' || 'f' || title_id || '.mkv' when 1 then path else 'gone' end"


@query(f"""
{_TABLES} lost as (select title_id from plan where duplicate_role like 'duplicate_of:%'),
after as (select title_id, path, size_bytes, {_AFTER} as lies, size_bytes + case when title_id % 8 = 0 then 1 else 0 end as now from inventory),
r as (select l.title_id, path, size_bytes, lies, now, 'H:/duplicates/f' || l.title_id || '.mkv' as expected from lost l left join after a on a.title_id = l.title_id),
done as (select *, {_FINAL} as final from plan where action = 'AUTO' and executed_at is not null),
own as (select *, min(title_id) over (partition by lower(final)) as first from done where target_folder <> '' and duplicate_role not like 'duplicate_of:%'),
folders as (select distinct 'H:/Movies/' || case when title_id % 2 = 0 then 'Set/' else '' end || 'F {{imdb-tt00000' || (title_id % 500) || title_id % 3 || '}}' as path, 'tt00000' || (title_id % 500) || title_id % 3 as imdb from plan)
select title_id, 'warn' as severity, 'dup_loser_no_inventory' as code, cast(null as varchar) as path from r where path is null
union all select title_id, 'warn', 'dup_loser_size_drift', expected from r where lies = expected and now <> size_bytes
union all select title_id, 'info', 'dup_loser_still_at_source', path from r where path is not null and lies <> expected and lies = path
union all select title_id, 'error', 'dup_loser_missing', expected from r where path is not null and lies <> expected and lies <> path
union all select title_id, 'error', 'duplicate_target', lower(final) from own where title_id > first
union all select null, 'error', 'duplicate_imdb_id', string_agg(path, ' | ' order by path) from folders group by imdb having count(*) > 1
union all select null, 'info', 'imdb_folder_not_in_plan', path from folders
""")
def verify_issues(spark, d):
    """What went wrong across titles: duplicates that were to be put aside, and ids and targets that occur twice."""
    plan, inventory, _, _ = _tables(spark, d)
    after = inventory.select(F.expr(_AFTER).alias("path"), F.expr("size_bytes + case when title_id % 8 = 0 then 1 else 0 end").alias("size")).where("path <> 'gone'")
    lost = plan.where("duplicate_role like 'duplicate_of:%'")
    folders = plan.selectExpr("'H:/Movies/' || case when title_id % 2 = 0 then 'Set/' else '' end || 'F {imdb-tt00000' || (title_id % 500) || title_id % 3 || '}' as path").distinct()
    return preflight.losers(lost, inventory, after, "H:/Movies", "H:/duplicates").unionByName(preflight.library(plan, folders))
