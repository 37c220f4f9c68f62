"""Ranked retrieval by BM25 over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.staging import staged

#: Words that say nothing in a query.
STOP_WORDS = tuple(
    """
    a an the and or but if then so as of in on at to for from by with into out off up
    down over under again is are was were be been being have has had do does did will
    would can could should may might must shall i you he she it we they me him her us
    them my your his hers its our their this that these those there here what when
    where why how which who whom no not yes ok okay yeah right just very really so
    oh ah uh um hey hi well now then come go come on let lets let's
    """.split()
)
K1, B = 1.2, 0.75


def terms(text: Column, min_length: int = 3) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda t: (F.length(t) >= min_length) & ~t.isin(*STOP_WORDS))


def query_terms(text: Column, limit: int = 60) -> Column:
    """The first distinct terms of a transcript; `limit` is part of the query's form."""
    return F.slice(F.array_distinct(terms(text)), 1, limit)


def dialogue(text: Column) -> Column:
    """Subtitles without tags, notes in brackets, speakers' labels and spare spaces."""
    out = F.regexp_replace(text, r"<[^>]*>|\{[^}]*\}|\[[^\]]*\]|\([^)]*\)", " ")
    out = F.regexp_replace(out, r"(?m)^[A-Z][A-Z .]+:", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, query_text: str) -> DataFrame:
    """(query, doc, score) of all documents that share a term with a query, scores rounded to six places.

    Only postings of the queries' terms are built; document lengths and their mean are over all documents.
    """
    wanted = asked_terms(queries, query, query_text)
    return bm25_of(postings_of(docs, wanted, doc, text), wanted)


def asked_terms(queries: DataFrame, query: str, query_text: str) -> DataFrame:
    """(query, term), staged."""
    return staged(queries.select(F.col(query).alias("query"), F.explode(query_terms(F.col(query_text))).alias("term")), "wanted")


def postings_of(docs: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, dl, term, tf), staged: postings of the wanted terms, and one of the term '' for each document, so that texts are cut
    into terms once for postings and lengths."""
    tokens = docs.select(F.col(doc).alias("doc"), terms(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    each = tokens.select("doc", "dl", F.explode(F.concat(F.coalesce("ts", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    asked = wanted.select("term").unionByName(wanted.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    return staged(each.join(asked, "term", "left_semi").groupBy("doc", "dl", "term").agg(F.count("*").alias("tf")), "postings")


def bm25_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, doc, score) of wanted terms (query, term) by an index of postings_of, which may hold other terms as well."""
    lengths, postings = index.where("term = ''"), index.where("term <> ''")
    many = F.when(F.col("dl").isNotNull(), F.col("tf"))
    stats = lengths.agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(many)).alias("avgdl"))  # one row
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = postings.join(df, "term").crossJoin(F.broadcast(stats)).select("doc", "term", (idf * tf).alias("w"))
    return wanted.join(weighed, "term").groupBy("query", "doc").agg(F.round(F.sum("w"), 6).alias("score"))


def with_margin(scores: DataFrame, low_score: float, low_margin: float) -> DataFrame:
    """Each query's best document, its margin over the next (0 counts as the next's score where there is none) and a status.
    Only two rows of a query are ranked; Spark keeps no more of them before the shuffle, too."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    two = scores.withColumn("place", place).where("place <= 2").groupBy("query")
    both = two.agg(F.min_by("doc", "place").alias("doc"), F.max("score").alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("next"))
    both = both.withColumn("margin", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6)).drop("next")
    return both.withColumn("status", F.when((F.col("score") < low_score) | (F.col("margin") < low_margin), "low_confidence").otherwise("ok"))


def in_show_first(inside: DataFrame, across: DataFrame, queries: DataFrame, low_score: float, low_margin: float) -> DataFrame:
    """(query, doc, score, margin, status) of every query: the best of its own show, else the best of all shows
    (cross_show_match), else none (no_match). `inside`, `across`: scores (query, doc, score); `queries`: (query)."""
    own = with_margin(inside, low_score, low_margin)
    other = with_margin(across.join(own, "query", "left_anti"), low_score, low_margin).withColumn("status", F.lit("cross_show_match"))
    found = queries.select("query").distinct().join(own.unionByName(other), "query", "left")
    return found.withColumn("status", F.coalesce("status", F.lit("no_match")))
