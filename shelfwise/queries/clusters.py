"""Clustering, content and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import names
from shelfwise.operators import graph, prints, retrieval
from shelfwise.operators.staging import staged
from shelfwise.queries.names import _FOLDERS, tokens_sql
from shelfwise.registry import query, read

_CLUSTERS = rf"""
with recursive s as (select p_partkey as id, {_FOLDERS} as name from part),
t as (select id, name, {tokens_sql("name")} as tokens, regexp_matches(name, '^\s*[0-9]{{1,4}}\s') and not regexp_matches(name, '^\s*(19|20)[0-9]{{2}}\s') as numbered from s),
u as (select *, list_distinct(tokens) as words from t where len(tokens) > 0),
k as (select id, unnest(words) as word from u),
p as (select distinct a.id as a, b.id as b from k a join k b using (word) where a.id < b.id),
q as (select p.a, p.b, x.words as wa, y.words as wb, x.numbered as na, y.numbered as nb, list_intersect(x.words, y.words) as held from p join u x on x.id = p.a join u y on y.id = p.b),
v as (select *, len(held) as n, list_sum([length(w) for w in held]) as chars from q),
h as (select a, b from v where (n = len(wa) and n = len(wb)) or (n = len(wa) and na and chars >= 6) or (n = len(wb) and nb and chars >= 6) or (n >= 2 and n / least(len(wa), len(wb)) >= 0.5 and chars >= 8) or n >= 3
  or n / (len(wa) + len(wb) - n) >= 0.7),
e as (select a, b from h union select b, a from h),
r as (select a as id, a as peer from e union select r.id, e.b from r join e on r.peer = e.a),
g as (select id, min(peer) as component from r group by 1),
z as (select component, count(*) as n, count(*) filter (where numbered) as ahead from g join u using (id) group by 1 having count(*) between 3 and 100),
w as (select component, word, count(*) as held from (select component, unnest(words) as word from g join u using (id)) group by all),
l as (select component, coalesce(list(word) filter (where held = n), []) as every, coalesce(list(word) filter (where held >= ceil(n / 2)), []) as most from w join z using (component) group by 1),
c as (select component, case when len(every) > 0 then every else most end as words from l join z using (component) where len(every) > 0 or ahead * 2 >= n)
"""


def _names(spark, d):
    """Names cut into words, once and in as many tasks as the session asks for: the files are small beside the work on their rows."""
    parts = read(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = parts.select(F.col("p_partkey").alias("id"), F.expr(_FOLDERS).alias("name"))
    leading = F.col("name").rlike(r"^\s*[0-9]{1,4}\s") & ~F.col("name").rlike(r"^\s*(19|20)[0-9]{2}\s")
    return staged(rows.select("id", names.folder_tokens(F.col("name")).alias("tokens"), leading.alias("numbered")).where(F.size("tokens") > 0), "names")


@query(_CLUSTERS + "select id as p_partkey, component from g join c using (component)")
def merge_clusters(spark, d):
    """Folders of one series: pairs by the words of their names, components of 3 to 100, without chains that share nothing."""
    return graph.merge_groups(_names(spark, d)).select(F.col("id").alias("p_partkey"), "component")


@query(_CLUSTERS + """,
m as (select component, first(tokens order by len(tokens) desc, id) as longest from g join u using (id) group by 1),
o as (select component, word, coalesce(nullif(list_position(longest, word), 0), 1000000) as place from (select component, unnest(words) as word from c) join m using (component))
select component, string_agg(upper(word[1]) || word[2:], ' ' order by place, word) as words from o group by 1
""")
def cluster_shared_words(spark, d):
    """A name for each group: the words that all its folders have, or half of them, in the order of the longest."""
    rows = _names(spark, d)
    return graph.shared_words(graph.merge_groups(rows).join(rows, "id"), "component", "id", "tokens")


@query("""
with recursive f as (select vec_id, label, [case when x > 0 then 1 else 0 end for x in embedding] as bits from embeddings),
e as (select a.vec_id as a, b.vec_id as b from f a join f b on a.label = b.label and a.bits[1:6] = b.bits[1:6] and a.vec_id <> b.vec_id
      and list_sum([abs(a.bits[i] - b.bits[i]) for i in range(33, 65)]) / 160 <= 0.05),
r as (select a as id, a as peer from e union select r.id, e.b from r join e on r.peer = e.a)
select id as vec_id, min(peer) as component from r group by 1
""")
def fingerprint_clusters(spark, d):
    """Fingerprints of five 32-bit numbers (signs of embeddings and the label) that share the first four, their bucket, and of
    which up to a twentieth of the bits differ. Equal fingerprints are one from the start."""
    signs = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    number = lambda bits, n: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.get(bits, i) > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    numbers = F.array(number(F.slice(signs, 1, 6), 6), F.col("label").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), number(F.slice(signs, 33, 32), 32))
    found = prints.groups(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), numbers.alias("fp")))
    return found.select(F.col("id").alias("vec_id"), "component")


@query("""
with c as (select user_id, event_type, count(*) as n, min(event_id) as seen from events group by all)
select user_id, arg_min(event_type, (-n, seen)) as dominant, max(n)::bigint as n, (sum(n) - max(n))::bigint as others from c group by 1
""".replace("arg_min(event_type, (-n, seen))", "first(event_type order by n desc, seen)"))
def dominant_value_ties(spark, d):
    """Each user's most frequent event, the first seen on ties."""
    return graph.dominant(read(spark, d, "events"), ["user_id"], "event_type", "event_id")


_SERIES = """case when l_quantity < 6 then '' when l_orderkey % 5 = 0 then 'zed tale' when l_orderkey % 7 = 0 then 'red widget' else p_name || case when l_linenumber % 3 = 0 then ' tale' else '' end end"""
_TITLE = """case p_partkey % 13 when 0 then '' when 1 then 'zed tale' when 2 then p_name || ' (1999) complete' when 3 then 'other words altogether' else p_name end"""


@query(f"""
with f as (select p_partkey, {_TITLE} as folder, {tokens_sql(_TITLE)} as words from part),
e as (select p_partkey, l_orderkey, l_linenumber, case when l_linenumber = 7 then null else {_SERIES} end as series from part left join lineitem on l_partkey = p_partkey and l_linenumber <> 1),
k as (select p_partkey, series, {tokens_sql("series")} as words, count(*) as n, min(l_orderkey * 10 + l_linenumber) as seen from e where series <> '' group by all),
m as (select p_partkey, array_to_string(words, ' ') as key, first(words) as words, sum(n) as n, min(seen) as seen from k where len(words) > 0 group by all),
d as (select p_partkey, first(words order by n desc, seen) as dominant, max(n)::bigint as n, sum(n)::bigint as parseable from m group by 1),
c as (select p_partkey, count(l_orderkey) as files from e group by 1)
select p_partkey, coalesce(n, 0)::bigint as n, (coalesce(parseable, 0) - coalesce(n, 0))::bigint as others, case when len(words) = 0 then 'empty_folder_name' when files = 0 then 'no_episodes' when parseable is null then 'no_parses' when parseable < 2 then 'too_few'
  when greatest(len(list_intersect(words, dominant)) / len(list_distinct(words)), len(list_intersect(words, dominant)) / len(list_distinct(dominant))) < 0.5 then 'mixed' else 'ok' end as verdict
from f join c using (p_partkey) left join d using (p_partkey)
""")
def mixed_content_verdict(spark, d):
    """Whether a folder's episodes agree with its name: the most frequent series of those that can be told, against the
    folder's words."""
    parts = read(spark, d, "part").withColumn("words", names.folder_tokens(F.expr(_TITLE)))
    files = read(spark, d, "lineitem").where("l_linenumber <> 1").join(parts.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    told = files.withColumn("series", names.folder_tokens(F.when(F.col("l_linenumber") != 7, F.expr(_SERIES)))).where(F.size("series") > 0)
    found = graph.dominant(told.withColumn("seen", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["p_partkey"], "series", "seen")
    counted = files.groupBy("p_partkey").agg(F.count("*").alias("files"))
    rows = parts.select("p_partkey", "words").join(counted, "p_partkey", "left").join(found, "p_partkey", "left")
    known = F.col("n") + F.col("others")
    agrees = graph.containment(F.array_distinct("words"), F.array_distinct("dominant")) >= 0.5
    verdict = F.when(F.size("words") == 0, "empty_folder_name").when(F.col("files").isNull(), "no_episodes").when(known.isNull(), "no_parses").when(known < 2, "too_few").when(agrees, "ok").otherwise("mixed")
    return rows.select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("others", F.lit(0)).alias("others"), verdict.alias("verdict"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in retrieval.STOP_WORDS)
_TERMS = f"[t for t in regexp_extract_all(lower(text), '[a-z]+') if length(t) >= 3 and t not in ({_STOP})]"
_BM25 = f"""
with d as (select doc_id, {_TERMS} as ts from documents), l as (select doc_id, len(ts) as dl from d),
a as (select count(*) as n, avg(dl) as avgdl from l),
q0 as (select item_id, {_TERMS} as ts from benchmark),
q1 as (select item_id, unnest(ts) as term, generate_subscripts(ts, 1) as i from q0),
q2 as (select item_id, term, min(i) as i from q1 group by all),
q as (select * from q2 qualify row_number() over (partition by item_id order by i) <= 60),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from d) where term in (select term from q) group by all),
f as (select term, count(*) as df from p group by 1),
s as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
      from q join p using (term) join f using (term) join l using (doc_id) cross join a group by all),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r,
        lead(score, 1, 0) over (partition by item_id order by score desc, doc_id) as next from s)
"""


@query(_BM25 + """
select item_id, doc_id, round(score, 4) as score, round(score - next, 4) as margin, case when score < 15 or round(score - next, 6) < 5 then 'low_confidence' else 'ok' end as status
from k where r = 1
""")
def bm25_top2_margin_status(spark, d):
    """Which document each transcript is from, with the margin over the next."""
    scores = retrieval.bm25(read(spark, d, "documents"), read(spark, d, "benchmark").withColumnRenamed("text", "said"), "doc_id", "text", "item_id", "said")
    found = retrieval.with_margin(scores, 15.0, 5.0)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"), "status")


@query(_BM25.replace("from benchmark)", "from benchmark union all select -1, ['zzzqqq'])") + """,
o as (select item_id, doc_id, score from s join documents using (doc_id) where source = 'src' || (item_id % 5)),
i as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place, lead(score, 1, 0) over (partition by item_id order by score desc, doc_id) as follow from o),
x as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place, lead(score, 1, 0) over (partition by item_id order by score desc, doc_id) as follow from s where item_id not in (select item_id from o)),
a2 as (select item_id, doc_id, score, round(score - follow, 6) as margin, case when score < 15 or round(score - follow, 6) < 5 then 'low_confidence' else 'ok' end as status from i where place = 1
  union all select item_id, doc_id, score, round(score - follow, 6), 'cross_show_match' from x where place = 1)
select item_id, doc_id, round(score, 2) as score, round(margin, 2) as margin, coalesce(status, 'no_match') as status from (select distinct item_id from q) left join a2 using (item_id)
""")
def content_identification(spark, d):
    """Which document each transcript is from: in its own folder first, then in all; some have none."""
    docs = read(spark, d, "documents")
    said = read(spark, d, "benchmark").select("item_id", F.col("text").alias("said"))
    said = said.unionByName(spark.createDataFrame([(-1, "zzzqqq")], "item_id bigint, said string"))
    scores = staged(retrieval.bm25(docs, said, "doc_id", "text", "item_id", "said"), "scores")
    own = scores.join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc").where(F.col("source") == F.concat(F.lit("src"), F.pmod("query", F.lit(5)).cast("string"))).drop("source")
    found = retrieval.in_show_first(own, scores, said.withColumnRenamed("item_id", "query"), 15.0, 5.0)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 2).alias("score"), F.round("margin", 2).alias("margin"), "status")


@query(f"""
with t as (select conv_id, turn, {_TERMS} as ts from conversations),
u as (select conv_id, turn, unnest(ts) as term, generate_subscripts(ts, 1) as i from t),
m as (select conv_id, turn, term, min(i) as i from u group by all),
k as (select * from m qualify row_number() over (partition by conv_id, turn order by i) <= 60)
select t.conv_id, t.turn, coalesce(string_agg(term, ' ' order by i), '') as terms from t left join k using (conv_id, turn) group by t.conv_id, t.turn
""")
def transcript_terms(spark, d):
    """Query terms of transcripts."""
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(retrieval.query_terms(F.col("text")), " ").alias("terms"))


@query(r"""
select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>|\{[^}]*\}|\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '(?m)^[A-Z][A-Z .]+:', ' ', 'g'), '\s+', ' ', 'g'))) as clean
from documents
""")
def dialogue_clean(spark, d):
    """Cleaned dialogue, by digest."""
    return read(spark, d, "documents").select("doc_id", F.md5(retrieval.dialogue(F.col("text"))).alias("clean"))
