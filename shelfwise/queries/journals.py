"""Journal and status queries; events stand for journal lines: user = title, event_type = operation, value = target."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans import journal
from shelfwise.registry import query, read

_OP = "case event_type when 'click' then 'rename' when 'view' then 'copy' when 'signup' then 'mkdir' when 'purchase' then 'verify' else 'write_file' end"
_OK = "case when event_id % 5 = 0 then 'error' else 'ok' end"


def _journal(spark, d):
    return read(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("title_id"), F.expr(_OP).alias("op"), F.expr(_OK).alias("result"), "value")


@query("select user_id as title_id, arg_max(value, (ts, event_id)) as value from events group by 1".replace("arg_max(value, (ts, event_id))", "first(value order by ts desc, event_id desc)"))
def journal_latest_target(spark, d):
    """Where each title went last."""
    return journal.latest(_journal(spark, d), "title_id", "value", "ts", "event_id")


@query(f"""
with j as (select *, {_OP} as op, {_OK} as result from events),
r as (select user_id as title_id, event_id, ts, case op when 'rename' then 'move_back' when 'copy' then 'restore_and_delete' when 'mkdir' then 'rmdir_if_empty' when 'write_file' then 'delete' end as inverse from j where result = 'ok')
select title_id, event_id, inverse, row_number() over (partition by title_id order by ts desc, event_id desc)::int as place from r where inverse is not null
""")
def rollback_plan(spark, d):
    """Inverse steps of each title, the newest first."""
    from shelfwise.operators.keepers import best_first

    steps = journal.rollback(_journal(spark, d))
    return best_first(steps, ["title_id"], [F.desc("ts"), F.desc("event_id")]).select("title_id", "event_id", "inverse", "place")


_LINES = f"""select event_id as line, ts, user_id as title_id, concat('run', cast(event_id % 97 % 5 as string)) as run_id, case event_id % 11 when 10 then 'delete' when 9 then 'rmdir' when 8 then 'backup' else {_OP} end as op, {_OK} as result,
  concat('old/', event_type, '/', cast(user_id as string), '/f', cast(event_id as string)) as from_, concat('new/', cast(user_id % 7 as string), '/', repeat('deep/', cast(event_id % 3 as int)), 'f', cast(event_id as string)) as to_ from events"""


@query(rf"""
with j as ({_LINES.replace("as string)", "as varchar)")}),
l as (select title_id, first(run_id order by line desc) as run_id from j group by 1),
s as (select j.*, case when op = 'rename' then 'move_back' when op = 'copy' then 'restore_and_delete' when op = 'mkdir' then 'rmdir_if_empty' when op = 'write_file' then 'delete' when op = 'backup' then 'restore' when op = 'rmdir' then 'mkdir' end as inverse
  from j join l on j.title_id = l.title_id and j.run_id = l.run_id where result = 'ok'),
p as (select *, case inverse when 'mkdir' then 0 when 'rmdir_if_empty' then 2 else 1 end as phase, len(string_split(from_, '/')) as depth from s where inverse is not null)
select title_id, cast(row_number() over (partition by title_id order by phase, case phase when 0 then depth when 2 then -depth else 0 end, ts desc, line desc) as integer) as place, line, inverse,
  case when inverse <> 'mkdir' then to_ end as source, case when inverse in ('move_back', 'restore_and_delete', 'restore', 'mkdir') then from_ end as target from p
""")
def rollback_latest_runs(spark, d):
    """What undoes the latest run of each title, in an order in which it can be done."""
    read(spark, d, "events").createOrReplaceTempView("_journal_events")
    lines = spark.sql(_LINES.replace("from events", "from _journal_events")).withColumnRenamed("to_", "to")
    return journal.rollback_steps(journal.latest_runs(lines), ("title_id",))


@query("select user_id as title_id, count(*)::bigint as n, max(value) as top from events where ts >= timestamp '2024-01-05' and user_id in (select c_custkey from customer where c_mktsegment <> 'BUILDING') group by 1")
def run_filter(spark, d):
    """Lines of some titles since a time."""
    wanted = read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("title_id"))
    rows = _journal(spark, d).where("ts >= timestamp '2024-01-05'").join(wanted, "title_id", "left_semi")
    return rows.groupBy("title_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"select {_OP} as op, {_OK} as result, count(*)::bigint as n, count(*) filter (where value > 100)::bigint as large from events group by all")
def status_counts(spark, d):
    return _journal(spark, d).groupBy("op", "result").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("large"))


@query("select event_type as reason, count(*)::bigint as n from events group by 1 order by n desc, reason limit 3")
def top_reasons(spark, d):
    """The three most frequent reasons."""
    return read(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(3)


@query("""
with c as (select user_id, event_type, count(*) as n, min(event_id) as seen from events where value > 50 group by all)
select user_id as folder, first(event_type order by n desc, seen) as new_folder from c group by 1
""")
def dominant_new_folder(spark, d):
    """Where most of a folder's files went, the first seen on ties."""
    from shelfwise.operators.graph import dominant

    rows = read(spark, d, "events").where("value > 50")
    return dominant(rows, ["user_id"], "event_type", "event_id").select(F.col("user_id").alias("folder"), F.col("dominant").alias("new_folder"))


@query("""
select doc_id, case when doc_id % 3 = 1 then 'new/' || source || '/' || doc_id else source || '/' || doc_id end as path from documents where doc_id % 7 <> 0
""")
def patched_manifest(spark, d):
    """A manifest after a run of moves and removals."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    files = read(spark, d, "documents").select("doc_id", path.alias("path"))
    moves = files.where("doc_id % 3 = 1").select(F.col("path").alias("from_"), F.concat(F.lit("new/"), "path").alias("to"))
    return journal.patched(files, moves, files.where("doc_id % 7 = 0").select("path"), "path")


@query("""
select conv_id, turn, case when role = 'assistant' and length(text) < 300 then 'prepared' when role = 'assistant' then 'ok' when role = 'user' then 'error' else 'prepared' end as status,
       case when role = 'user' then null else length(text) end::int as transcript from conversations
""")
def status_reset(spark, d):
    """Low results go back to prepared and keep their transcripts; errors lose theirs."""
    size = F.length("text")
    status = F.when((F.col("role") == "assistant") & (size < 300), "prepared").when(F.col("role") == "assistant", "ok").when(F.col("role") == "user", "error").otherwise("prepared")
    return read(spark, d, "conversations").select("conv_id", "turn", status.alias("status"), F.when(F.col("role") != "user", size).alias("transcript"))


@query("""
with m as (select l_orderkey, l_linenumber, l_partkey, max(l_quantity) as src, max(case when l_returnflag = 'N' then l_tax * 500 end) as dst from lineitem group by all)
select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 11 = 0 then 'already_there' when dst is null then 'move' when src = dst then 'drop_source' else 'conflict' end as decision from m
""")
def move_decisions(spark, d):
    """What each planned move comes to."""
    dst = F.max(F.when(F.col("l_returnflag") == "N", F.col("l_tax") * 500)).alias("dst_size")
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("src_size"), dst)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", journal.move_decision("l_partkey % 11 = 0").alias("decision"))


@query("""
select event_id, json_extract_string(props, '$.k')::bigint as k, case when json_extract_string(props, '$.k')::bigint > 50 then 'high' else 'low' end as band from events
""")
def props_nested_json(spark, d):
    """Fields of nested JSON."""
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, d, "events").select("event_id", k.alias("k"), F.when(k > 50, "high").otherwise("low").alias("band"))


_MOVE = """select l_orderkey, l_linenumber, l_quantity as src_size, case when l_linenumber % 4 = 0 then null when l_linenumber % 4 = 1 then l_quantity else l_suppkey end as dst_size, cast(l_partkey % 3 as string) as src_hash, cast(l_suppkey % 3 as string) as dst_hash from lineitem"""


@query(f"""
select l_orderkey, l_linenumber, case when dst_size is null or (src_size = dst_size and src_size > 0) then 'no_conflict' when src_hash = dst_hash then 'use_target' when src_size >= dst_size then 'use_source' else 'use_target' end as decision from ({_MOVE})
""")
def cross_run_conflicts(spark, d):
    """Which file stays where an earlier run has left one."""
    read(spark, d, "lineitem").createOrReplaceTempView("_moves_lineitem")
    return spark.sql(_MOVE.replace("from lineitem", "from _moves_lineitem")).select("l_orderkey", "l_linenumber", journal.across_runs().alias("decision"))


_SWEEP = """select event_id as line, cast(user_id % 5 as bigint) as written, case when event_id % 9 = 0 then 'mkdir' else 'rename' end as op, case when event_id % 7 = 0 then 'error' else 'ok' end as result, case when event_id % 11 > 0 then 'S01E01' end as episode_key,
  concat('I:\\\\in\\\\', event_type, '\\\\Ep', cast(event_id % 400 as string), '.avi') as from_, concat('H:/TV/', event_type, '/Show ', cast(event_id as string), '.avi') as to_ from events"""
_SIDES = """select concat('src', cast(o_custkey % 3 as string)) as source, concat('I:/src', cast(o_custkey % 3 as string), '/eP', cast(o_orderkey % 500 as string), case o_orderkey % 4 when 0 then '.en.srt' when 1 then '-Thumb.jpg' when 2 then '.nfo' else '.avi' end) as path from orders"""


@query(rf"""
with j as ({_SWEEP.replace("as string)", "as varchar)").replace(chr(92) * 4, "/")}), w as (select line % 400 as n, first(to_ order by written desc, line desc) as video from j where op = 'rename' and result = 'ok' and episode_key is not null group by 1),
s as (select concat('src', o_custkey % 3) as source, o_orderkey % 500 as n, o_orderkey % 4 as kind, {_SIDES[_SIDES.index("concat('I:/src'") : _SIDES.index(" as path")].replace("as string)", "as varchar)")} as path from orders),
v as (select distinct source, n from s where kind = 3)
select s.source, path, case when v.n is not null then 'video_present' when video is null then 'no_match' when video like '%view%' and kind = 0 then 'already_there' else 'swept' end as outcome,
  case when v.n is null then replace(video, '.avi', case kind when 0 then '.en.srt' when 1 then '-Thumb.jpg' else '.nfo' end) end as "to" from s left join v on v.source = s.source and v.n = s.n left join w on w.n = s.n where kind < 3
""")
def orphan_sidecars(spark, d):
    """What becomes of sidecars left behind when their videos went."""
    read(spark, d, "events").createOrReplaceTempView("_sweep_events")
    read(spark, d, "orders").createOrReplaceTempView("_sweep_orders")
    lines = spark.sql(_SWEEP.replace("from events", "from _sweep_events")).withColumnRenamed("to_", "to")
    there = lines.where("to like '%view%'").select(F.regexp_replace("to", "[.]avi$", ".en.srt").alias("path"))
    return journal.swept(lines, spark.sql(_SIDES.replace("from orders", "from _sweep_orders")), there)
