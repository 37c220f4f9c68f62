"""Duplicate and keeper queries; documents stand for media files (n_chars: size, source: folder, lang: tag)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import keepers
from shelfwise.operators.staging import staged
from shelfwise.registry import query, read


@query("""
select doc_id, n_chars, sha256(text) as hash from documents
where n_chars > 0 and n_chars in (select n_chars from documents group by n_chars having count(*) > 1)
""")
def size_prefilter_hash(spark, d):
    """Hashes of the files that share their size with another."""
    return keepers.sharing_size(read(spark, d, "documents"), "n_chars").select("doc_id", "n_chars", F.sha2("text", 256).alias("hash"))


@query("""
select n_chars, sha256(text) as hash, count(*)::bigint as copies, min(doc_id)::bigint as first_id, max(doc_id)::bigint as last_id,
       (n_chars * (count(*) - 1))::bigint as redundant
from documents where n_chars > 0 group by n_chars, sha256(text) having count(*) > 1
""")
def dup_groups(spark, d):
    """Groups of equal size and hash, with the bytes that dropping all but one would free."""
    copies = keepers.same_content(read(spark, d, "documents"), "n_chars", "text")
    counts = F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    return copies.groupBy("n_chars", "hash").agg(*counts).withColumn("redundant", F.col("n_chars") * (F.col("copies") - 1))


@query("""
with h as (select *, sha256(text) as hash from documents where n_chars > 0),
g as (select n_chars, hash from h group by all having count(*) > 1)
select h.hash, doc_id, case when row_number() over w = 1 then 'KEEP' else 'DUPLICATE' end as decision,
       first_value(doc_id) over w as keeper_id
from h join g using (n_chars, hash)
window w as (partition by n_chars, hash order by (lang is not null) desc, length(source) desc, source, doc_id
             rows between unbounded preceding and unbounded following)
""".replace("row_number() over w", "row_number() over (partition by n_chars, hash order by (lang is not null) desc, length(source) desc, source, doc_id)"))
def dup_keepers(spark, d):
    """Each copy's decision: tagged copies first, then the longer folder, then names and ids."""
    hashed = keepers.sharing_size(read(spark, d, "documents"), "n_chars").select("doc_id", "n_chars", "lang", "source", F.sha2("text", 256).alias("hash"))
    hashed = staged(hashed, "hashed")  # texts are read and hashed once
    order = F.struct(F.col("lang").isNull(), -F.length("source"), "source", "doc_id")
    best = hashed.groupBy("n_chars", "hash").agg(F.min_by("doc_id", order).alias("keeper_id"), F.count("*").alias("copies")).where("copies > 1")
    decided = hashed.join(best, ["n_chars", "hash"])
    return decided.select("hash", "doc_id", F.when(F.col("doc_id") == F.col("keeper_id"), "KEEP").otherwise("DUPLICATE").alias("decision"), "keeper_id")


@query("""
with h as (select doc_id from documents where n_chars > 0 qualify count(*) over (partition by n_chars, sha256(text)) > 1),
t as (select l.doc_id, d.source, l.quality, l.toxic from labels l join documents d using (doc_id)
      where l.doc_id not in (select doc_id from h))
select source, quality, toxic, count(*)::bigint as n, min(doc_id)::bigint as keeper_id from t group by all having count(*) > 1
""")
def id_dups_excluding_hash_dups(spark, d):
    """Groups by an outside id (here source and labels) among files that no hash group holds."""
    docs = read(spark, d, "documents")
    rest = docs.join(keepers.same_content(docs, "n_chars", "text").select("doc_id"), "doc_id", "left_anti")
    named = read(spark, d, "labels").join(rest.select("doc_id", "source"), "doc_id")
    return named.groupBy("source", "quality", "toxic").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper_id")).where("n > 1")


_AUDIO = """case doc_id % 6 when 0 then 'Rock/' when 1 then 'rock/mix-' when 2 then 'A/www.x.com/' when 3 then 'Hip Hop/Various ' when 4 then 'B/the best of all/' else 'C/' end || lang || '/' || source || '/' || cast(doc_id as string)"""
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""
with f as (select doc_id, {_AUDIO} as path, sha256(text) as hash, doc_id % 9 as tags from documents where n_chars > 0 qualify count(*) over (partition by sha256(text)) > 1),
s as (select *, (case when split_part(path, '/', 1) in {_LIST(keepers.GENRE_BUCKETS)} then 1000 else 0 end
        + case when {' or '.join(f"contains(lower(path), '{t}')" for t in keepers.BAD_TOKENS)} then 200 else 0 end
        + case when contains(lower(path), '.com/') then 200 else 0 end
        + 5 * len(string_split(path, '/')) + length(path) // 20)::int as score from f)
select hash, path, score, row_number() over (partition by hash order by score, tags desc, lower(path))::int as place from s
""")
def audio_keeper_path_score(spark, d):
    """Copies of audio files in the order of their paths' scores, then of how many tags they have."""
    files = read(spark, d, "documents").withColumn("path", F.expr(_AUDIO))
    copies = keepers.same_content(files, "n_chars", "text").withColumn("score", keepers.path_score(F.col("path")))
    return keepers.best_first(copies, ["hash"], [F.col("score"), F.desc(F.col("doc_id") % 9), F.lower("path")]).select("hash", "path", "score", "place")


def _subtitle_keeper(order: str, sql_order: str):
    sql = f"""
select lang, source, doc_id, n_chars from documents
qualify row_number() over (partition by lang, source order by {sql_order}) = 1
"""

    def keep(spark, d):
        docs = read(spark, d, "documents")
        return keepers.best(docs, ["lang", "source"], F.expr(order), "doc_id", "n_chars")

    return sql, keep


#: Rankings of copies of a subtitle, by name.
RANKERS = {
    "largest": ("struct(-n_chars, doc_id)", "n_chars desc, doc_id"),
    "newest": ("struct(-doc_id)", "doc_id desc"),
}
for _name, _orders in RANKERS.items():
    _sql, _keep = _subtitle_keeper(*_orders)
    _keep.__name__ = f"subtitle_keeper_{_name}"
    query(_sql)(_keep)


_SRT = "case when l_partkey % 3 = 0 then concat('s01e', lpad(cast(l_partkey % 90 as string), 2, '0'), '.SRT') when l_partkey % 3 = 1 then concat('Show S01E', lpad(cast(l_partkey % 90 as string), 2, '0'), '.srt') else concat('S1E', cast(l_partkey as string), '.srt') end"


@query(f"""
with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as size, {_SRT.replace("as string)", "as varchar)")} as name from lineitem)
select l_orderkey, name, size, cast(row_number() over (partition by l_orderkey order by l_partkey % 3 > 0, size desc, name, l_linenumber, l_partkey, l_suppkey) as integer) as place from s
qualify place = 1
""".replace("\nqualify place = 1", "\nqualify row_number() over (partition by l_orderkey order by l_partkey % 3 > 0, size desc, name, l_linenumber, l_partkey, l_suppkey) = 1"))
def subtitle_keeper_canonical(spark, d):
    """Of each order's subtitles the one whose name is season and episode alone, then the largest, then the first by name."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("size"), F.expr(_SRT).alias("path"))
    placed = keepers.best_first(rows, ["l_orderkey"], [*keepers.subtitle_order("canonical"), "l_linenumber", "l_partkey", "l_suppkey"])
    return placed.where("place = 1").select("l_orderkey", F.col("path").alias("name"), "size", "place")


_COPY = """select o_orderkey as title_id, o_custkey as film, case when o_orderkey % 6 = 0 then 'no match' end as unresolved, concat('H:/Movies', case o_orderkey % 4 when 0 then '' when 1 then concat('/Film (', cast(1990 + o_custkey % 30 as string), ')') when 2 then '/Film' else concat('/Set/Film ', cast(o_orderkey as string), ' (20)') end, '/f', cast(o_orderkey as string), '.mkv') as path,
  case when o_orderkey % 5 > 0 then o_orderkey % 3 * 360 end as height, o_orderkey % 7 * 1000 as bitrate, cast(floor(o_totalprice) as bigint) as size, o_orderkey % 100 as confidence from orders"""


@query(f"""
with c as ({_COPY.replace("as string)", "as varchar)")})
select title_id, film, cast(row_number() over (partition by film order by unresolved is not null, title_id % 4 <> 1, title_id % 4 = 0, coalesce(height, 0) desc, bitrate desc, size desc, confidence desc, length(path) desc, title_id) as integer) as place from c
""")
def film_keepers(spark, d):
    """A film's copies in the order in which they are kept."""
    read(spark, d, "orders").createOrReplaceTempView("_copies_orders")
    copies = spark.sql(_COPY.replace("from orders", "from _copies_orders"))
    return keepers.best_first(copies, ["film"], keepers.film_order("H:/Movies/")).select("title_id", "film", "place")


@query("""
with e as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice as size,
                  case when l_returnflag = 'R' then null else l_returnflag end as hash from lineitem),
k as (select l_orderkey, l_linenumber, count(*) as n, count(distinct hash) as kinds, bool_and(hash is not null) as sure from e group by all)
select e.l_orderkey, e.l_linenumber, k.n::bigint as n,
  case when kinds = 1 and sure then 'identical' else 'smaller_size' end as reason,
  case when kinds = 1 and sure then min(l_partkey) else arg_max(l_partkey, (size, -l_partkey)) end as kept
from e join k using (l_orderkey, l_linenumber) where k.n > 1
group by e.l_orderkey, e.l_linenumber, k.n, kinds, sure
""".replace("arg_max(l_partkey, (size, -l_partkey))", "first(l_partkey order by size desc, l_partkey)"))
def episode_dedupe_conditional(spark, d):
    """Several files of one episode: one known hash for all keeps the first path, otherwise the largest stays."""
    hashed = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    files = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("size"), hashed.alias("hash"))
    groups = files.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"),
        F.min("hash").alias("low"),
        F.max("hash").alias("high"),
        F.count("hash").alias("known"),
        F.min("l_partkey").alias("first"),
        F.min_by("l_partkey", F.struct(-F.col("size"), "l_partkey")).alias("largest"),
    )
    same = (F.col("known") == F.col("n")) & (F.col("low") == F.col("high"))
    reason = F.when(same, "identical").otherwise("smaller_size").alias("reason")
    return groups.where("n > 1").select("l_orderkey", "l_linenumber", "n", reason, F.when(same, F.col("first")).otherwise(F.col("largest")).alias("kept"))


@query("""
select o_custkey, o_orderkey, row_number() over (partition by o_custkey
  order by (o_orderstatus = 'F') desc, (o_orderpriority in ('1-URGENT', '2-HIGH')) desc, o_totalprice desc, o_orderdate, length(o_orderpriority), o_orderkey)::int as place
from orders
""")
def rename_conflict_winner(spark, d):
    """Files that want one name: moved already, lossless, bitrate, age, shorter path, then the alphabet."""
    order = [
        (F.col("o_orderstatus") == "F").desc(),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").desc(),
        F.desc("o_totalprice"),
        F.asc("o_orderdate"),
        F.length("o_orderpriority"),
        F.asc("o_orderkey"),
    ]
    return keepers.best_first(read(spark, d, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "place")


@query("""
with c as (select lower(p_name) as target_key, count(*)::bigint as n, list_sort(list(p_brand || '/' || p_partkey)) as l from part group by 1 having count(*) > 1)
select target_key, n, array_to_string(l[1:3], ', ') || case when n > 3 then ' (+' || (n - 3) || ' more)' else '' end as note from c
""")
def target_collisions(spark, d):
    """Names that several parts would get."""
    parts = read(spark, d, "part").withColumn("from", F.concat_ws("/", "p_brand", "p_partkey"))
    return keepers.collisions(parts, "p_name", "from")


@query("""
with s as (select doc_id, n_chars, sha256(text) as hash from documents where source = 'src3'),
l as (select sha256(text) as hash, array_to_string(list_sort(list(doc_id::varchar)), ' | ') as matches from documents where source <> 'src3' group by 1)
select doc_id, matches, case when hash is null then 'hash_failed' when matches is not null then 'duplicate' else 'unique' end as status
from s left join l using (hash)
""")
def suspect_vs_library(spark, d):
    """One folder's files against all others."""
    files = read(spark, d, "documents").select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("hash"))
    suspects, library = files.where("source = 'src3'"), files.where("source <> 'src3'")
    return keepers.against_library(suspects, library, "n_chars", "hash", "doc_id").select("doc_id", "matches", "status")
