"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, an exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.tables import staged

#: Weights by a source's place in code point order, null last; they repeat.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is read at most so many times.
MAX_EPOCHS = 3.0
#: Rows of one source that share a bin of hash keys, about; each bin is one window partition.
BIN_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Of (source, source_size, ...), the words that each source gets.

    All targets sum to all sizes. A source's share is by weight among those below `max_epochs` times their size;
    the others get that cap. With the sources in order of cap by weight, those capped come first, and a source is
    capped if its cap by weight is under the share that the rest would get. The table has a row for each source.
    """
    if len(weights) < 1 or min(weights) <= 0:
        raise ValueError("weights must be positive")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    up_to, all_rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    ranked = (
        ranked.withColumn("below_cap", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("w_left", F.sum("w").over(all_rows) - F.sum("w").over(up_to) + F.col("w"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("share", (F.col("total") - F.col("below_cap")) / F.col("w_left"))
    )
    level = F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "share"))).over(all_rows)["share"]
    ranked = ranked.withColumn("level", level)
    target = F.when(F.col("ratio") < F.col("share"), F.col("cap")).otherwise(F.coalesce(F.col("level") * F.col("w"), F.lit(0.0)))
    return ranked.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each row of `docs`.

    Each document gets a key by hash of its id and the seed, so reruns agree. A source's documents are cut in key
    order: all are taken for each whole epoch, then those before the cut once more, and the document at the cut in
    part, so that a source's words sum to its target rounded down. Prefix sums run in two steps: over the hash bins
    of each source, then inside each bin, so that no task holds a whole source.

    Columns other than doc_id, text and source are left alone. A null text has no words; a null source is a source,
    the last one; rows with equal ids are ordered by size and, if equal in that too, share the order at will. With no words
    at all, every target is 0. An empty table gives an empty table.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    sized = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / bin_rows))
    goal = staged(
        targets(by_source.select("source", "source_size"), weights, max_epochs)
        .join(by_source.select(F.col("source").alias("s"), bins.alias("bins")), F.col("source").eqNullSafe(F.col("s")))
        .drop("s"),
        "mix-targets",
    )
    g = goal.withColumnRenamed("source", "s")
    placed = sized.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("bin", (F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("bins")).cast("int"))
    totals = placed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select(F.col("source").alias("s"), F.col("bin").alias("b"), (F.sum("bin_size").over(before) - F.col("bin_size")).alias("before_bin"))
    placed = placed.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    inside = Window.partitionBy("source", "bin").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("before", F.col("before_bin") + F.sum("size").over(inside) - F.col("size"))
    goal_words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(0)
    rest = goal_words - epochs * F.col("source_size")
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = (epochs * F.col("size") + once_more).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of `docs`: a document for each time that it is taken, in the last of
    them with its first words only if the cut falls inside it. Documents without words come once, as they are.
    If `docs` has n_chars, it counts the characters of the text that is left."""
    plan = mix(docs, **options).select("doc_id", "size", "taken").groupBy("doc_id", "size").agg(F.collect_list("taken").alias("__takes"))
    ids = docs.withColumn("__size", n_words(F.col("text")))
    ids = ids.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__size").orderBy(F.xxhash64("text"))))
    p = plan.select(F.col("doc_id").alias("__id"), F.col("size").alias("__s"), "__takes")
    joined = ids.join(p, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__s")))
    taken = F.element_at("__takes", F.col("__nth"))
    whole = F.when(F.col("__size") > 0, F.floor(taken / F.col("__size"))).otherwise(1)
    left = F.when(F.col("__size") > 0, taken - F.floor(taken / F.col("__size")) * F.col("__size")).otherwise(0)
    parts = F.concat(F.array_repeat(F.col("__size"), whole.cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    taken_rows = joined.withColumn("__words", F.explode(parts))
    heads = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(heads, F.lit(1), F.col("__words").cast("int")), "")
    out = taken_rows.withColumn("text", F.when(F.col("__words") < F.col("__size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__words") < F.col("__size"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


#: DuckDB's form of op9: the same hash order, targets by water-filling, prefix sums over each whole source.
SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(concat(coalesce(doc_id::varchar, 'null'), ':17')) as key
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         list_extract([5.0, 2.0, 1.0], ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int)::double as w
  from sized group by source),
ranked as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / w as ratio from sources),
level as (
  select *, (sum(source_size) over () - (sum(cap) over up - cap)) / (sum(w) over () - sum(w) over up + w) as share
  from ranked window up as (order by ratio, source nulls last rows unbounded preceding)),
goal as (
  select source, source_size,
         least(cap, case when ratio < share then cap
                    else coalesce(arg_min(share, ratio) filter (where ratio >= share) over (), 0) * w end)::double as target
  from (select source, source_size, w, cap, ratio,
          share, row_number() over (order by ratio, source nulls last) as r from level)),
placed as (
  select d.doc_id, d.size, g.source_size, g.target,
         sum(d.size) over (partition by d.source order by d.key, d.size rows unbounded preceding) - d.size as before
  from sized d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then floor(floor(target) / source_size) else 0 end * size
   + greatest(0, least(size, floor(target)
       - (case when source_size > 0 then floor(floor(target) / source_size) else 0 end) * source_size - before)))::bigint as taken
from placed
"""
