"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long string of hash symbols. A tree is its sorted array of strings, cut into blocks that share a
beginning. A query descends to the longest beginnings of its own strings that occur, and ascends in all trees at once, a
symbol at a time and tree after tree, until it has met enough candidates; each beginning is one run of a sorted array.

A symbol is the axis, with its sign, that a random rotation to SYMBOL dimensions brings a vector nearest to. For inner
products a vector gets one more component that makes all of equal length; a query gets 0 there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.neighbours import usable
from shelfwise.llm.tables import drop, staged

NEAREST = 20
TREES = 20
#: Dimensions of a symbol's rotation; a symbol is one of twice as many.
SYMBOL = 16
BITS = (2 * SYMBOL - 1).bit_length()
#: Vectors to a block of a sorted array, queries that meet it at once, and products that a task holds at once.
BLOCK, QUERIES, PRODUCTS = 4096, 8192, 2 << 20
#: Queries, the first by hash, that meet all vectors by brute force; the number of candidates that every query gathers is
#: the smallest with which their mean recall is RECALL, and LEAST at least.
AUDIT, RECALL, LEAST = 200, 0.94, 1000

_FOUND = "query bigint, rep bigint, score double"


class Search(NamedTuple):
    found: DataFrame
    #: The recall over the audited queries, and the candidates that each query gathers, for each length of vector.
    audits: list[tuple[int, float, int]]


def _matrix(vectors, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def _packed(embeddings: DataFrame, asked: Column) -> tuple[DataFrame, str]:
    """(vec_id, vec, size, norm, asked), a row for each id with a usable vector; vec holds its components as `kind`."""
    element = embeddings.schema["embedding"].dataType.elementType
    kind, name = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")

    @F.pandas_udf("vec binary, size int, norm double")
    def packed(vs: pd.Series) -> pd.DataFrame:
        out = []
        for v in vs:
            x = np.asarray(v, np.float64)
            top = np.abs(x).max()
            out.append((np.asarray(v, kind).tobytes(), len(x), float(min(np.finfo(np.float64).max, top * math.sqrt(((x / top) ** 2).sum())))))
        return pd.DataFrame(out, columns=["vec", "size", "norm"])

    rows = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{name}>").alias("embedding"))
    rows = rows.where(usable()).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    rows = rows.select("vec_id", packed("embedding").alias("p")).select("vec_id", "p.*")
    return rows.withColumn("asked", F.coalesce(asked, F.lit(False))).withColumn("key", F.md5("vec")), kind


def _planes(size: int, levels: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(TREES, size, levels * SYMBOL))


def _strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, trees): each row's string in each tree, its symbols as the digits of a number."""
    out = np.zeros((len(x), len(planes)), np.int64)
    for t, p in enumerate(planes):
        y = (x @ p).reshape(len(x), -1, SYMBOL)
        axis = np.abs(y).argmax(2)
        symbols = 2 * axis + (np.take_along_axis(y, axis[:, :, None], 2)[:, :, 0] > 0)
        for k in range(symbols.shape[1]):
            out[:, t] = (out[:, t] << BITS) | symbols[:, k]
    return out


def _coded(vectors: DataFrame, kind: str, size: int, longest: float, levels: int, seed: int) -> DataFrame:
    """`vectors` with their strings, and of those that are asked the strings they have as queries."""
    planes = _planes(size + 1, levels, seed)

    @F.pandas_udf("strings array<bigint>, own array<bigint>")
    def coded(vs: pd.Series, asked: pd.Series) -> pd.DataFrame:
        x = _matrix(vs, kind) / longest
        last = np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
        q = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
        strings = _strings(np.hstack([x, last]), planes)
        own = _strings(np.hstack([q, 0 * last]), planes)
        return pd.DataFrame({"strings": list(strings), "own": [o if a else None for o, a in zip(own, asked, strict=True)]})

    return vectors.withColumn("c", coded("vec", "asked")).select("vec_id", "vec", "asked", "c.*")


def _top(sims: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of `sims`, the ids and inner products of the k greatest, ties to smaller ids. The products of the first
    are summed anew, one pair like another, so that a pair has the same product in every tree."""
    wide = min(k + 4, sims.shape[1])
    near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
    slack = 1e-11 * np.sqrt((q * q).sum(1)) * math.sqrt((x * x).sum(1).max())
    for i in range(len(sims)):
        at = near[i]
        if wide < sims.shape[1]:
            floor = np.partition(sims[i, at], wide - min(k, wide))[wide - min(k, wide)] - slack[i]
            if (sims[i, at] >= floor).all():  # more may tie than were taken
                at = np.flatnonzero(sims[i] >= floor)
        exact = (q[i] * x[at]).sum(1)
        order = np.lexsort((ids[at], -exact))[:k]
        yield ids[at][order], exact[order]


def _scored(left: pd.DataFrame, right: pd.DataFrame, kind: str, k: int) -> pd.DataFrame:
    """One block of a sorted array and queries: each query's best in its run of the array."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
    left = left.sort_values(["string", "vec_id"], ignore_index=True)
    strings, ids, x = left.string.to_numpy(), left.vec_id.to_numpy(), _matrix(left.vec, kind)
    shift = right["shift"].to_numpy()
    low = np.searchsorted(strings, right.prefix.to_numpy() << shift)
    high = np.searchsorted(strings, (right.prefix.to_numpy() + 1) << shift)
    runs = right.assign(low=low, high=high)
    out = []
    for (a, b), some in runs[runs.low < runs.high].groupby(["low", "high"]):
        step = max(1, PRODUCTS // (b - a))
        for at in range(0, len(some), step):
            part = some.iloc[at : at + step]
            q = _matrix(part.vec, kind)
            for query, (near, score) in zip(part["query"].to_numpy(), _top(q @ x[a:b].T, q, x[a:b], ids[a:b], k), strict=True):
                out.append((np.full(len(near), query), near, score))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pd.DataFrame(dict(zip(("query", "rep", "score"), columns, strict=True)))


def _by_brute_force(coded: DataFrame, some: pd.DataFrame, kind: str, k: int) -> pd.DataFrame:
    """(query, rep, strings) of the k nearest of a few queries, by all vectors; a task keeps its best only."""
    q, ids = _matrix(some.vec, kind), some.vec_id.to_numpy()

    def met(batches):
        best: list[list] = [[] for _ in ids]
        for rows in batches:
            v, strings = rows.vec_id.to_numpy(), rows.strings.to_numpy()
            x = _matrix(rows.vec, kind)
            at = {int(i): n for n, i in enumerate(v)}
            for i, (near, score) in enumerate(_top(q @ x.T, q, x, v, k + 1)):
                found = [(-s, w, strings[at[w]]) for w, s in zip(near.tolist(), score.tolist(), strict=True) if w != ids[i]]
                best[i] = sorted([*best[i], *found], key=lambda e: e[:2])[:k]
        yield pd.DataFrame([(int(ids[i]), w, -s, list(c)) for i, b in enumerate(best) for s, w, c in b], columns=["query", "rep", "score", "strings"])

    found = coded.select("vec_id", "vec", "strings").mapInPandas(met, f"{_FOUND}, strings array<bigint>")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return found.withColumn("place", place).where(F.col("place") <= k).toPandas()  # AUDIT x k rows at most


def _prefix(string: str, level: str, levels: int) -> Column:
    return F.expr(f"shiftright({string}, cast({BITS} * ({levels} - {level}) as int))")


def _candidates_needed(steps: DataFrame, coded: DataFrame, kind: str, k: int, levels: int, recall: float) -> tuple[int, float]:
    """(candidates that each query has to gather, recall of the audited queries with them)."""
    some = coded.where("asked").orderBy(F.xxhash64("vec_id")).limit(AUDIT).select("vec_id", "vec", "own").toPandas()
    truth = _by_brute_force(coded, some, kind, k) if len(some) else some
    if not len(truth):
        return LEAST, 1.0
    own = dict(zip(some.vec_id, some.own, strict=True))
    last = levels * TREES
    shifts = [BITS * n for n in range(levels)]

    def step_of(query, strings) -> int:
        """The step of the ascent at which the query meets the vector: n symbols given up, in tree t."""
        return min((n * TREES + t for t, (a, b) in enumerate(zip(own[query], strings, strict=True)) for n, s in enumerate(shifts) if a >> s == b >> s), default=last)

    truth["step"] = [step_of(q, s) for q, s in zip(truth["query"], truth.strings, strict=True)]
    mine = steps.join(F.broadcast(coded.sparkSession.createDataFrame([(int(i),) for i in some.vec_id], "query bigint")), "query")
    mine = mine.select("query", "step", "n").toPandas().sort_values(["query", "step"])  # AUDIT x TREES x levels rows
    mine["before"] = mine.groupby("query").n.cumsum() - mine.n
    at = truth.merge(mine, on=["query", "step"])  # a vector is met if the ascent is not over before its step
    due = truth.groupby("query").size()

    def reached(m: int) -> float:
        return float((at[at.before < m].groupby("query").size().reindex(due.index, fill_value=0) / due).mean())

    options = np.unique(np.maximum(LEAST, at.before.to_numpy() + 1))
    low, high = 0, len(options) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reached(options[mid]) >= recall else (mid + 1, high)
    return int(options[low]), reached(options[low])


def _searched(vectors: DataFrame, kind: str, size: int, k: int, recall: float, seed: int) -> tuple[DataFrame, float, int]:
    """(query, rep, score, rank) of the k nearest vectors found for each that is asked, itself included."""
    n, longest = vectors.agg(F.count("*"), F.max("norm")).first()
    top = max(0, math.ceil(math.log(max(1, n / BLOCK), 1 << BITS)))  # symbols that a block shares
    levels = min(60 // BITS, top + 2)
    coded = staged(_coded(vectors, kind, size, longest, levels, seed), "forest")
    strings = coded.select("vec_id", F.posexplode("strings").alias("tree", "string"))
    sizes = staged(strings.groupBy("tree", "string").agg(F.count("*").alias("n")), "forest-sizes", n * TREES)
    below = sizes.select("tree", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), "string", "n")
    below = below.groupBy("tree", "level", _prefix("string", "level", levels).alias("prefix")).agg(F.sum("n").alias("n"))
    asked = coded.where("asked").select(F.col("vec_id").alias("query"), F.posexplode("own").alias("tree", "string"))
    spread = asked.select("query", "tree", "string", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")).withColumn("prefix", _prefix("string", "level", levels))
    step = ((F.lit(levels) - F.col("level")) * TREES + F.col("tree")).alias("step")
    steps = spread.join(below, ["tree", "level", "prefix"], "left").select("query", "tree", "level", "prefix", step, F.coalesce("n", F.lit(0)).alias("n"))
    whole = coded.where("asked").select(F.col("vec_id").alias("query"), F.lit(0).alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("prefix"), F.lit(levels * TREES).alias("step"), F.lit(n).alias("n"))
    steps = staged(steps.unionByName(whole), "forest-steps", n * TREES * levels)
    need, reached = _candidates_needed(steps, coded, kind, k, levels, recall)

    # the ascent of a query ends with the step at which it has met `need` candidates; within a tree, the shortest beginning
    # holds the others, and the whole of one tree holds all
    before = F.sum("n").over(Window.partitionBy("query").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    taken = steps.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < need)
    runs = taken.groupBy("query", "tree").agg(F.min_by(F.struct("level", "prefix"), "level").alias("run")).select("query", "tree", "run.*")
    runs = runs.withColumn("least", F.min("level").over(Window.partitionBy("query"))).where("least > 0 or level = 0").drop("least")
    runs = runs.withColumn("shift", (F.lit(BITS) * (levels - F.col("level"))).cast("long"))

    blocks = sizes.groupBy("tree", _prefix("string", str(top), levels).alias("block")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("deals"))
    blocks = staged(blocks, "forest-blocks", n)
    met = None
    for level in range(top + 1):  # a run of fewer symbols than a block shares meets several blocks, a longer one is inside one
        mine = runs.where(F.col("level") == level if level < top else F.col("level") >= level)
        key = F.expr(f"shiftright(block, {BITS * (top - level)})").alias("head")
        head = F.when(F.col("level") <= top, F.col("prefix")).otherwise(F.expr(f"shiftright(prefix, cast({BITS} * (level - {top}) as int))"))
        one = mine.withColumn("head", head).join(blocks.withColumn("head", key), ["tree", "head"]).drop("head")
        met = one if met is None else met.unionByName(one)
    met = staged(met, "forest-runs")
    busy = staged(met.groupBy("tree", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"), F.first("deals").alias("deals")), "forest-busy")
    left = strings.withColumn("block", _prefix("string", str(top), levels)).join(busy, ["tree", "block"])
    left = left.select("vec_id", "tree", "block", "string", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("deals").cast("long")).alias("deal"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns").cast("long") - 1)).alias("turn"))
    left = left.join(coded.select("vec_id", "vec"), "vec_id")
    right = met.join(busy.drop("deals"), ["tree", "block"]).withColumn("turn", F.pmod(F.xxhash64("query", F.lit(3)), F.col("turns").cast("long"))).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals").cast("long") - 1)))
    right = right.join(coded.select(F.col("vec_id").alias("query"), "vec"), "query").select("query", "vec", "tree", "block", "deal", "turn", "prefix", "shift")
    keys = ["tree", "block", "deal", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _scored(a, b, kind, k), _FOUND)
    rank = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))  # one that several trees find has one rank
    best = staged(found.withColumn("rank", rank).where(F.col("rank") <= k).distinct(), "forest-found", n * k)
    for table in (coded, sizes, steps, blocks, met, busy):
        drop(table)
    return best, reached, need


def search(embeddings: DataFrame, asked: Column, k: int = NEAREST, recall: float = RECALL, seed: int = 11) -> Search:
    """(query_id, rank, vec_id, score): of each row that `asked` (over vec_id) names, the k rows with the greatest inner
    product found, its own left out, the greatest first and ties to smaller ids. Scores are in double precision.

    Equal vectors are one in the forest and all come back by their ids. How far queries ascend is set by an audit: AUDIT
    queries meet all vectors, and every query gathers as many candidates as those need for a mean recall of `recall`;
    nothing is left out of the runs that an ascent reaches. Where LEAST candidates are all there are, the result is exact.
    Vectors that are null, empty, all zero or hold null or non-finite components take no part; vectors meet those of their
    own length only. Rows without an id are left out; rows that share an id count once, by the greatest vector. Without
    usable rows the result is empty. Other columns are left out.
    """
    rows, kind = _packed(embeddings, asked)
    members = staged(rows, "vectors")
    out, audits = None, []
    for (size,) in members.select("size").distinct().orderBy("size").collect():
        mine = members.where(F.col("size") == size)
        # equal vectors are one from here on, under their smallest id
        one = mine.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec"), F.first("norm").alias("norm"), F.max("asked").alias("asked"), F.count("*").alias("copies"))
        vectors = staged(one, "reps")
        best, reached, need = _searched(vectors, kind, size, k + 1, recall, seed)
        audits.append((size, reached, need))
        reps = vectors.select("key", F.col("vec_id").alias("rep"), "copies", "asked")
        twins = mine.select("key", "vec_id").join(reps.where("copies > 1"), "key").select("rep", "vec_id")
        twins = twins.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("nth") <= k + 1).select("rep", "vec_id")
        each = best.select(F.col("query").alias("own"), "rep", "score").join(twins, "rep", "left").select("own", F.coalesce("vec_id", "rep").alias("vec_id"), "score")
        nearest = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
        each = each.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).drop("nth")
        queries = mine.where("asked").select("key", F.col("vec_id").alias("query_id")).join(reps.where("asked"), "key").select("query_id", F.col("rep").alias("own"))
        each = queries.join(each, "own").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        each = each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = each if out is None else out.unionByName(each)
    if out is None:
        out = embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return Search(out, audits)
