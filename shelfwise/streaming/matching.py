"""Which indexed text each file's transcript is from, as a table of statuses that a run works off in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import retrieval
from shelfwise.operators.staging import drop, staged
from shelfwise.streaming.versions import Table, VersionedStore

STATES = Table("path string, show string, transcript string, doc bigint, score double, margin double, status string, detail string", ("path",))
#: The statuses that a run leaves alone; one across shows is looked at again every time.
TERMINAL = ("ok", "low_confidence", "no_match", "error")
#: The least score and margin of a sure match.
LEAST_SCORE, LEAST_MARGIN = 15.0, 5.0


def states(spark: SparkSession, folder: str) -> VersionedStore:
    return VersionedStore(spark, folder, {"states": STATES})


def _empty() -> list:
    return [F.lit(None).cast(t).alias(c) for c, t in (("doc", "bigint"), ("score", "double"), ("margin", "double"))]


def prepare(store: VersionedStore, files: DataFrame, number: int, source: str = "prepare") -> bool:
    """Files (path, show, transcript) that the table does not hold yet: "prepared", or "error" where no transcript could be made.
    Of rows of one path the first by show and transcript counts; rows without a path are left out."""
    one = files.where("path is not null").groupBy("path").agg(F.min(F.struct("show", "transcript")).alias("f")).select("path", "f.*")
    new = one.join(store.read("states").select("path"), "path", "left_anti")
    failed = F.col("transcript").isNull()
    status = F.when(failed, "error").otherwise("prepared").alias("status")
    return store.commit(source, number, {"states": new.select("path", "show", "transcript", *_empty(), status, F.when(failed, "no_transcript").alias("detail"))})


def identify(store: VersionedStore, index: DataFrame, run: str, parts: int = 8) -> int:
    """Match what no run has settled against `index` (doc, show, text): in the file's own show first, else across shows. Returns
    the number of parts that this call committed.

    The open files are dealt into parts by a hash of their paths, and each part is a commit of its own. A run that dies and is
    called again by its name goes on with the parts that are not in; scores count over the whole index, so the
    rows are those of a run in one go. The index's texts are read once a call, for the terms of all open parts."""
    done = 0
    part = F.pmod(F.xxhash64("path", F.lit(17)), F.lit(parts))
    left = [k for k in range(parts) if not store.committed(f"identify-{run}", k)]
    if not left:
        return done
    said = lambda rows: rows.select(F.col("path").alias("query"), "show", F.coalesce("transcript", F.lit("")).alias("said"))
    every = retrieval.asked_terms(said(store.read("states").where(~F.col("status").isin(*TERMINAL) & part.isin(left))), "query", "said")
    postings = retrieval.postings_of(index, every, "doc", "text")
    for k in left:
        mine = staged(store.read("states").where(~F.col("status").isin(*TERMINAL) & (part == k)), "open")
        asked = said(mine)
        scores = staged(retrieval.bm25_of(postings, every.join(asked.select("query"), "query", "left_semi")), "scores")
        shows = index.select("doc", F.col("show").alias("doc_show"))
        own = scores.join(asked.select("query", "show"), "query").join(shows, "doc").where("show = doc_show").select("query", "doc", "score")
        found = retrieval.in_show_first(own, scores, asked, LEAST_SCORE, LEAST_MARGIN)
        found = found.select(F.col("query").alias("path"), F.col("doc").cast("long").alias("doc"), "score", "margin", "status")
        detail = F.when(F.col("status") == "cross_show_match", F.concat(F.lit("own show: "), F.coalesce("show", F.lit("")))).alias("detail")
        rows = mine.select("path", "show", "transcript").join(found, "path")
        score = F.coalesce("score", F.when(F.col("status") == "no_match", 0.0)).alias("score")
        done += store.commit(f"identify-{run}", k, {"states": rows.select("path", "show", "transcript", "doc", score, "margin", "status", detail)})
        drop(mine)
        drop(scores)
    drop(postings)
    drop(every)
    return done


def reset(store: VersionedStore, number: int, include_errors: bool = False, source: str = "reset") -> bool:
    """Settled files back to "prepared", with their transcripts and nothing else; those without a transcript go, so that
    they are prepared anew. Errors stay unless they are included, and then go the same ways."""
    kinds = ["ok", "low_confidence", "no_match", "cross_show_match", *(["error"] if include_errors else [])]
    some = store.read("states").where(F.col("status").isin(*kinds))
    back = some.where("transcript is not null").select("path", "show", "transcript", *_empty(), F.lit("prepared").alias("status"), F.lit(None).cast("string").alias("detail"))
    gone = some.where("transcript is null").select("path") if include_errors else None
    return store.commit(source, number, {"states": back}, None if gone is None else {"states": gone})
