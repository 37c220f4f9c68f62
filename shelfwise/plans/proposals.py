"""Series that a search did not settle: candidates proposed by several searches, picked by a user, committed to the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import fuzzy, names
from shelfwise.plans import scoring

#: Candidates of a proposal, what a user's pick is worth, and the flags of rows: open, tried, settled.
CANDIDATES, PICKED = 5, "70"
OPEN, OPEN_MANY = "no_tmdb_results", "multi_result"
TRIED, TRIED_MANY = "retmdb_attempted", "disambig_attempted"


def _tokens(flags: Column) -> Column:
    return F.filter(F.split(F.coalesce(flags, F.lit("")), ";"), lambda t: F.trim(t) != "")


def _many(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.trim(t).startswith(OPEN_MANY))


def eligible(plan: DataFrame, several: bool = False) -> DataFrame:
    """Rows to be skipped so far because no search found them, or with `several` because one found too many, that were not tried."""
    flags = F.coalesce("flags", F.lit(""))
    wanted = flags.contains(OPEN) | (flags.contains(OPEN_MANY) if several else F.lit(False))
    return plan.where((F.upper(F.trim("action")) == "SKIP") & ~flags.contains(TRIED) & ~flags.contains(TRIED_MANY) & wanted)


def searches(plan: DataFrame, hints: DataFrame) -> DataFrame:
    """(series_id, nth, strategy, query, year): the folder's cleaned name with its year, what its episodes' names (series_id, hint) say if
    that is something else, and the cleaned name without a year."""
    leaf = F.substring_index(F.rtrim(F.translate("source_folder", "\\", "/"), F.lit("/")), "/", -1)
    rows = plan.select("series_id", names.clean_folder(leaf).alias("c")).select("series_id", "c.*").join(hints.groupBy("series_id").agg(F.min("hint").alias("hint")), "series_id", "left")
    step = lambda n, name, query, year: F.struct(F.lit(n).alias("nth"), F.lit(name).alias("strategy"), query.alias("query"), year.cast("int").alias("year"))
    clean = F.coalesce("name", F.lit(""))
    steps = F.array(
        F.when(clean != "", step(1, "folder_clean", clean, F.col("year"))),
        F.when((F.coalesce("hint", F.lit("")) != "") & (F.lower("hint") != F.lower(clean)), step(2, "episode_hint", F.col("hint"), F.col("year"))),
        F.when((clean != "") & F.col("year").isNotNull(), step(3, "folder_clean_no_year", clean, F.lit(None))),
    )
    return rows.select("series_id", F.explode(F.array_compact(steps)).alias("s")).select("series_id", "s.*")


def proposed(plan: DataFrame, hints: DataFrame, answers: DataFrame) -> DataFrame:
    """(series_id, verdict, strategy, query, year, candidates, pick) of a plan's rows (series_id, source_folder, tmdb_series_id): the first
    search whose candidates are worth a look, else the first search, else none ("no_query"). candidates: up to CANDIDATES labels
    "id|name (year)" with scores, the best first, ties in the service's order. pick is 1 if the best is sure and the row had no match.

    answers (query, year, rank, id, name, first_year, votes, popularity) is what the service said to a search; a search without
    answers has no candidates."""
    asked = searches(plan, hints)
    said = answers.select(F.col("query").alias("said"), F.col("year").alias("said_year"), "rank", "id", "name", "first_year", "votes", "popularity")
    both = asked.join(said, (F.col("query") == F.col("said")) & F.col("year").eqNullSafe(F.col("said_year")), "left")
    near = F.when(F.col("year").isNull() | F.col("first_year").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("first_year") - F.col("year")) / 5))
    score = 0.6 * fuzzy.name_similarity(F.col("query"), F.col("name")) + 0.2 * near + 0.2 * F.least(F.lit(1.0), F.coalesce("popularity", F.lit(0.0)) / 50)
    label = F.concat(F.col("id").cast("string"), F.lit("|"), "name", F.coalesce(F.concat(F.lit(" ("), F.col("first_year").cast("string"), F.lit(")")), F.lit("")))
    scored = both.withColumn("c", F.when(F.col("id").isNotNull(), F.struct((-score).alias("low"), "rank", label.alias("label"), F.coalesce("votes", F.lit(0)).alias("votes"))))
    found = scored.groupBy("series_id", "nth", "strategy", "query", "year").agg(F.array_sort(F.collect_list("c")).alias("cs"))  # one search's answers
    at = lambda k: F.get("cs", F.lit(k))
    best, following = -at(0)["low"], F.coalesce(-at(1)["low"], F.lit(0.0))
    verdict = F.when(F.size("cs") == 0, "NONE").otherwise(scoring.candidate_verdict(best, at(0)["votes"], best - following, F.size("cs")))
    found = found.withColumn("verdict", verdict)
    order = F.struct(F.col("verdict") == "NONE", F.col("nth"))
    chosen = found.groupBy("series_id").agg(F.min_by(F.struct("verdict", "strategy", "query", "year", "cs"), order).alias("f")).select("series_id", "f.*")
    labels = F.transform(F.slice(F.coalesce("cs", F.array().cast("array<struct<low:double,rank:int,label:string,votes:bigint>>")), 1, CANDIDATES), lambda c: F.struct(c["label"].alias("label"), F.round(-c["low"], 3).alias("score")))
    out = plan.select("series_id", "tmdb_series_id").join(chosen, "series_id", "left")
    fresh = F.col("tmdb_series_id").isNull()
    return out.select("series_id", F.coalesce("verdict", F.lit("NONE")).alias("verdict"), F.coalesce("strategy", F.lit("no_query")).alias("strategy"), F.coalesce("query", F.lit("")).alias("query"), "year", labels.alias("candidates"), F.when((F.col("verdict") == "HIGH") & fresh, 1).alias("pick"))


def committed(plan: DataFrame, proposals: DataFrame, root: str) -> DataFrame:
    """`plan` after a user went through the proposals (series_id, strategy, candidates, pick), with outcome: "accepted" rows are to be done by
    themselves under the candidate picked, "rejected" ones (no pick, or 0) are marked as tried so that they are not proposed again,
    "error" for a pick that names no candidate; null for rows that were not proposed."""
    picked = proposals.select(F.col("series_id").alias("__id"), "strategy", "candidates", F.trim(F.col("pick").cast("string")).alias("pick"))
    rows = plan.join(picked, F.col("series_id") == F.col("__id"), "left")
    tokens, number = _tokens(F.col("flags")), F.col("pick").try_cast("int")
    label = F.when(number.between(1, CANDIDATES), F.get("candidates", number - 1)["label"])
    id_, title = F.regexp_extract(label, r"^([0-9]+)\|", 1).try_cast("bigint"), F.trim(F.regexp_replace(F.regexp_replace(label, r"^[^|]*\|", ""), r"\s*\([0-9]{4}\)\s*$", ""))
    year = F.regexp_extract(label, r"\(([0-9]{4})\)\s*$", 1).try_cast("int")
    rejected = F.coalesce("pick", F.lit("")).isin("", "0")
    outcome = F.when(F.col("__id").isNull(), None).when(rejected, "rejected").when(id_.isNull(), "error").otherwise("accepted")
    tried = F.when(_many(tokens), TRIED_MANY).otherwise(TRIED)
    kept = F.filter(tokens, lambda t: (F.trim(t) != OPEN) & ~F.trim(t).startswith(OPEN_MANY))
    kind = F.when(_many(tokens), "disambig").otherwise("retmdb")
    flags = F.when(outcome == "rejected", F.array_join(F.when(F.array_contains(tokens, tried), tokens).otherwise(F.array_append(tokens, tried)), ";")).when(outcome == "accepted", F.array_join(F.array_append(kept, F.concat(kind, F.lit("_committed"))), ";"))
    note = F.concat(kind, F.lit(": matched via "), F.coalesce("strategy", F.lit("?")), F.lit(" (cand="), number.cast("string"), F.lit(")"))
    notes = F.concat_ws("; ", F.nullif(F.trim(F.coalesce("notes", F.lit(""))), F.lit("")), note)
    target = F.concat(F.lit(root.rstrip("/") + "/"), names.sanitized(title, "plan"), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("")), F.lit(") {tmdb-"), id_.cast("string"), F.lit("}"))
    taken = outcome == "accepted"
    new = {"tmdb_series_id": id_, "matched_series": title, "target_folder": target, "confidence": F.lit(PICKED), "action": F.lit("AUTO"), "notes": notes}
    columns = {c: F.when(taken, value).otherwise(F.col(c)).cast(plan.schema[c].dataType) for c, value in new.items()}
    columns["matched_year"] = F.when(taken, F.coalesce(year, F.col("matched_year").try_cast("int"))).otherwise(F.col("matched_year").try_cast("int"))
    columns["flags"] = F.coalesce(flags, F.col("flags"))
    return rows.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in plan.columns), outcome.alias("outcome"))
