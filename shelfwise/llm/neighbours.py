"""Near-duplicate vectors by NN-descent: a neighbour graph refined by local joins, then threshold links."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.tables import drop, staged

THRESHOLD = 0.95
#: Length of a neighbour list; lists whose last entry reaches the threshold are doubled, up to the greatest length.
LIST, LONGEST_LIST = 12, 48
#: Random-projection forests that the first lists come from, and vectors to a leaf, about.
TREES, LEAF = 6, 160
#: Rounds of the descent after each forest, and forests; if the audit still fails then, the lists are made by brute force.
ROUNDS, LEAST_ROUNDS, FORESTS = 8, 2, 3
#: The descent ends when a round changes under this share of all entries.
STILL = 0.002
#: Vectors of the recall audit, as many again out of those with links, which all meet all others by brute force; and the
#: mean of their recalls that ends the descent.
AUDIT, RECALL = 200, 0.99
#: Vectors to a block of the exact count.
BLOCK = 512

_LISTS = "vec_id bigint, near array<struct<sim:double,id:bigint>>"


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True, initial=0)  # squares of the largest and smallest numbers are not finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(embedding: str = "embedding"):
    """Neither null nor empty, no null or non-finite component, not all zero."""
    bad = f"exists({embedding}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return F.expr(f"{embedding} is not null and size({embedding}) > 0 and not {bad} and exists({embedding}, x -> x <> 0)")


def _leaves(vectors: DataFrame, n: int, size: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(tree, code, vec_id, embedding): the vectors in leaves of random hyperplanes; a leaf with more than `leaf` vectors
    is dealt into several at random."""
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    planes = np.random.default_rng(seed).normal(size=(trees, depth, size))

    @F.pandas_udf("array<bigint>")
    def codes(vs: pd.Series) -> pd.Series:
        x = _unit(vs)
        bits = np.einsum("td,kjd->tkj", x, planes) > 0
        return pd.Series(list((bits << np.arange(depth)).sum(2).astype(np.int64))) if depth else pd.Series([np.zeros(trees, np.int64)] * len(vs))

    coded = vectors.select("vec_id", "embedding", F.posexplode(codes("embedding")).alias("tree", "code"))
    full = coded.groupBy("tree", "code").agg(F.ceil(F.count("*") / leaf).alias("deals")).where("deals > 1")
    dealt = coded.join(full, ["tree", "code"], "left")
    return dealt.withColumn("deal", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.coalesce("deals", F.lit(1)))).drop("deals")


def _best(ids: np.ndarray, sims: np.ndarray, others: np.ndarray, k: int) -> pd.DataFrame:
    """The k most alike of `others` for each row of `sims`."""
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = [[{"sim": float(sims[i, j]), "id": int(others[j])} for j in t if np.isfinite(sims[i, j])] for i, t in enumerate(top)]
    return pd.DataFrame({"vec_id": ids, "near": rows})


def _in_leaf(rows: pd.DataFrame) -> pd.DataFrame:
    x, ids = _unit(rows.embedding), rows.vec_id.to_numpy()
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    return _best(ids, sims, ids, LIST)


def _merged(lists: DataFrame, k) -> DataFrame:
    """The best k distinct entries of each vector's lists."""
    joined = lists.groupBy("vec_id").agg(F.flatten(F.collect_list("near")).alias("near"))
    return joined.withColumn("near", F.slice(F.sort_array(F.array_distinct("near"), asc=False), 1, k))


def _local_join(key, lists: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """All pairs among each vector's neighbours; what beats the last entry of either's list is proposed to it."""
    if not len(lists) or not len(vectors):
        return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "near": []})
    vectors = vectors.drop_duplicates("vec_id")
    ids = np.sort(vectors.vec_id.to_numpy())
    order = np.argsort(vectors.vec_id.to_numpy())
    x, floors = _unit(vectors.embedding)[order], vectors.floor.to_numpy()[order]
    out: dict[int, dict[int, float]] = {}
    for around in lists.around:
        at = np.unique(np.searchsorted(ids, np.asarray(around)))
        sims = x[at] @ x[at].T
        np.fill_diagonal(sims, -np.inf)
        good = np.argwhere(sims > floors[at][:, None])
        for i, j in good.tolist():
            out.setdefault(int(at[i]), {})[int(at[j])] = float(sims[i, j])
    found = [(int(ids[v]), [{"sim": s, "id": int(ids[w])} for w, s in sorted(ws.items(), key=lambda e: -e[1])[:LONGEST_LIST]]) for v, ws in out.items()]
    return pd.DataFrame(found, columns=["vec_id", "near"])


def _descend(vectors: DataFrame, lists: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """One round: each vector's list and a sample of those that list it are joined among themselves. (what that proposes, the
    staged table that it is made of)"""
    k = F.size("near")
    floor = F.when(k >= F.col("k"), F.element_at("near", -1)["sim"]).otherwise(-2.0)
    heads = lists.select("vec_id", F.col("near")[0]["id"].alias("first"), floor.alias("floor"), "k")
    edges = lists.select(F.col("vec_id").alias("u"), F.explode("near.id").alias("v"))
    # of those that list v, about LIST: each stays with the chance that makes so many
    many = edges.groupBy("v").agg(F.count("*").alias("n"))
    back = edges.join(many, "v").where((F.pmod(F.xxhash64("u", "v"), F.lit(1000)) / 1000) < LIST / F.col("n")).select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(back).distinct()
    # vectors that share a first neighbour go to one block, so that a block needs few vectors from outside
    block = heads.select(F.col("vec_id").alias("u"), F.pmod(F.xxhash64(F.least("first", "vec_id")), F.lit(blocks)).alias("block"))
    around = staged(around.join(block, "u").select("block", "u", "v"), "around")  # both sides of the join are made of it
    left = around.groupBy("block", "u").agg(F.collect_list("v").alias("around"))
    wanted = around.select("block", F.col("v").alias("vec_id")).distinct()
    right = wanted.join(vectors, "vec_id").join(heads.select("vec_id", "floor"), "vec_id")
    right = right.select(F.col("block").alias("to"), F.col("vec_id").alias("vec_id"), "embedding", "floor")
    return left.groupBy("block").cogroup(right.groupBy("to")).applyInPandas(_local_join, _LISTS), around


def neighbour_lists(vectors: DataFrame, n: int, threshold: float = THRESHOLD, seed: int = 5, rounds: int = ROUNDS, forests: int = FORESTS) -> DataFrame:
    """(vec_id, near, k): each vector's list, the most alike first, found by NN-descent from random-projection leaves.

    After each round the vectors of the audit are held against brute force: of their links at the threshold, so many
    as fit their lists have to be there. The descent goes on until little changes, no list was doubled and the recall is
    reached. A list that is full of links is doubled, up to LONGEST_LIST. If `rounds` are not enough, leaves of another
    forest come in; if `forests` are not, every vector meets all others in blocks.
    """
    size = len(vectors.select("embedding").first()[0])
    blocks = max(4, n // 1500)
    lists = truth = None
    for forest in range(forests):
        leaves = _leaves(vectors, n, size, TREES, LEAF, seed + forest)
        first = leaves.groupBy("tree", "code", "deal").applyInPandas(_in_leaf, _LISTS)
        if lists is None:
            lists = staged(_merged(first, F.lit(LIST)).withColumn("k", F.lit(LIST)), "lists")
            truth = _truth(vectors, lists, threshold, seed)
        else:
            lists, _, _ = _with_proposals(lists, first, threshold)
        for turn in range(rounds):
            found, around = _descend(vectors, lists, blocks)
            lists, changed, doubled = _with_proposals(lists, found, threshold)
            drop(around)
            if turn + 1 >= LEAST_ROUNDS and not doubled and changed < STILL * n * LIST and audited_recall(lists, truth, threshold) >= RECALL:
                drop(truth)
                return lists
    drop(truth)
    drop(lists)
    return staged(_lists_of_all(vectors, BLOCK), "lists")


def _with_proposals(lists: DataFrame, proposals: DataFrame, threshold: float) -> tuple[DataFrame, int, int]:
    """(the best of lists and proposals, entries that changed, lists that were doubled). The old lists are deleted."""
    found = proposals.groupBy("vec_id").agg(F.flatten(F.collect_list("near")).alias("found"))
    merged = lists.select("vec_id", F.col("near").alias("was"), F.col("k").alias("k_was")).join(found, "vec_id", "left")
    merged = merged.withColumn("near", F.sort_array(F.array_distinct(F.concat("was", F.coalesce("found", F.slice("was", 1, 0)))), asc=False))
    full = (F.size("near") >= F.col("k_was")) & (F.try_element_at("near", F.col("k_was"))["sim"] >= threshold)
    merged = merged.withColumn("k", F.when(full, F.least(F.lit(LONGEST_LIST), F.col("k_was") * 2)).otherwise(F.col("k_was")))
    merged = merged.withColumn("near", F.slice("near", F.lit(1), F.col("k")))
    # what changed is told as the lists are made, so the old and the new ones need not meet again
    merged = merged.withColumns({"changed": F.size(F.array_except("near.id", "was.id")), "doubled": F.col("k") > F.col("k_was")})
    new = staged(merged.select("vec_id", "near", "k", "changed", "doubled"), "lists")
    changed, doubled = new.agg(F.sum("changed"), F.count_if("doubled")).first()
    drop(lists)
    return new.select("vec_id", "near", "k"), changed or 0, doubled


def _truth(vectors: DataFrame, lists: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(a, b): by brute force, the links of AUDIT vectors and of AUDIT of those that have links as far as `lists` say, so
    that sparse links are audited too."""
    by_hash = F.xxhash64("vec_id", F.lit(seed))
    linked = lists.where(F.try_element_at("near", F.lit(1))["sim"] >= threshold).select("vec_id").orderBy(by_hash).limit(AUDIT)
    some = vectors.select("vec_id").orderBy(by_hash).limit(AUDIT).unionByName(linked).distinct()
    audit = vectors.join(F.broadcast(some), "vec_id").toPandas()  # 2 x AUDIT rows at most
    ids, x = audit.vec_id.to_numpy(), _unit(audit.embedding)

    def met(batches):
        for rows in batches:
            a, b = np.nonzero(_unit(rows.embedding) @ x.T >= threshold)
            v, w = ids[b], rows.vec_id.to_numpy()[a]
            keep = np.flatnonzero(v != w)
            yield pd.DataFrame({"a": v[keep], "b": w[keep]})

    return staged(vectors.mapInPandas(met, "a bigint, b bigint"), "truth")


def audited_recall(lists: DataFrame, truth: DataFrame, threshold: float) -> float:
    """The mean over the audited vectors with links of the share of them that their lists hold; of more than fit a list,
    as many as fit are due. 1 without links."""
    audited = lists.join(F.broadcast(truth.select(F.col("a").alias("vec_id")).distinct()), "vec_id")  # 2 x AUDIT ids
    held = audited.select(F.col("vec_id").alias("a"), F.explode("near").alias("e")).where(F.col("e.sim") >= threshold).select("a", F.col("e.id").alias("b"), F.lit(1).alias("hit"))
    each = truth.join(held, ["a", "b"], "left").groupBy("a").agg(F.count("*").alias("due"), F.count("hit").alias("hits"))
    share = F.least(F.col("hits"), F.lit(LONGEST_LIST)) / F.least(F.col("due"), F.lit(LONGEST_LIST))
    recall = each.agg(F.avg(share)).first()[0]
    return 1.0 if recall is None else recall


def _lists_of_all(vectors: DataFrame, block: int) -> DataFrame:
    """(vec_id, near, k) by brute force: every block of vectors meets every other; LONGEST_LIST entries each."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        a, b = rows[rows.own == i], rows[rows.own == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "near": []})
        sims = _unit(a.embedding) @ _unit(b.embedding).T
        if i == j:
            np.fill_diagonal(sims, -np.inf)
            return _best(a.vec_id.to_numpy(), sims, b.vec_id.to_numpy(), LONGEST_LIST)
        return pd.concat([_best(a.vec_id.to_numpy(), sims, b.vec_id.to_numpy(), LONGEST_LIST), _best(b.vec_id.to_numpy(), sims.T, a.vec_id.to_numpy(), LONGEST_LIST)])

    pairs = _pairs_of_blocks(vectors.select("vec_id", "embedding", F.lit(0).alias("part")), block)
    return _merged(pairs.groupBy("part", "i", "j").applyInPandas(best, _LISTS), F.lit(LONGEST_LIST)).withColumn("k", F.lit(LONGEST_LIST))


def _pairs_of_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members (part, ...) dealt to blocks of about `block`, a row for each pair of blocks (i <= j) that a block is in."""
    sizes = members.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(vec_id, linked): for each member (part, vec_id, embedding, copies) the copies of all others in its part at the
    threshold, by blocks of the similarity matrix; no pair becomes a row."""

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        a, b = rows[rows.own == i], rows[rows.own == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "linked": np.zeros(0, np.int64)})
        hit = _unit(a.embedding) @ _unit(b.embedding).T >= threshold
        if i == j:
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"vec_id": a.vec_id, "linked": hit @ b.copies.to_numpy()})
        return pd.DataFrame({"vec_id": [*a.vec_id, *b.vec_id], "linked": [*(hit @ b.copies.to_numpy()), *(a.copies.to_numpy() @ hit)]})

    parts = _pairs_of_blocks(members, block).groupBy("part", "i", "j").applyInPandas(counted, "vec_id bigint, linked bigint")
    return parts.groupBy("vec_id").agg(F.sum("linked").alias("linked"))


def saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """The lists that hold links only, so that there may be more: of any length, as a list that was doubled last may not
    have filled yet."""
    return lists.where((F.size("near") > 0) & (F.try_element_at("near", F.lit(-1))["sim"] >= threshold))


def _across(full: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between vectors whose lists are saturated, in different components. Both ends of a
    link that no list holds must be such, so this makes the links complete as far as the lists are. Blocks are made of
    one component's vectors, and two blocks meet if their centres are near enough for a link; each pair of components
    gives one link at most for each pair of its blocks."""
    cuts = full.groupBy("component").agg(F.ceil(F.count("*") / block).alias("cuts"))
    dealt = full.join(cuts, "component").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))

    def summed(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(rows.embedding)
        centre = x.sum(0)
        centre /= max(1e-300, math.sqrt(centre @ centre))
        angle = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        return pd.DataFrame({"component": [key[0]], "cut": [key[1]], "centre": [centre], "radius": [angle]})

    dealt = staged(dealt.select("component", "cut", "vec_id", "embedding"), "dealt")
    centres = staged(dealt.groupBy("component", "cut").applyInPandas(summed, "component bigint, cut bigint, centre array<double>, radius double"), "centres")
    met = staged(_near_centres(centres, threshold, block), "met")
    a, b = (met.select(F.monotonically_increasing_id().alias("pair"), F.col(f"component_{x}").alias("component"), F.col(f"cut_{x}").alias("cut"), F.lit(x == "b").alias("second")) for x in "ab")
    spread = a.unionByName(b).join(dealt, ["component", "cut"])

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[~rows.second], rows[rows.second]
        out = []
        if len(a) and len(b):
            s = _unit(a.embedding) @ _unit(b.embedding).T
            i, j = np.unravel_index(s.argmax(), s.shape)
            if s[i, j] >= threshold:
                out.append((a.vec_id.iat[i], b.vec_id.iat[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return spread.groupBy("pair").applyInPandas(linked, "a bigint, b bigint")


def _near_centres(centres: DataFrame, threshold: float, block: int) -> DataFrame:
    """(component_a, cut_a, component_b, cut_b): blocks of different components whose centres are near enough for a link.
    Only centres meet here, a block of them against a block."""
    numbered = centres.select("component", "cut", "centre", "radius", F.lit(0).alias("part"), F.xxhash64("component", "cut").alias("vec_id"))

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        a, b = rows[rows.own == i], rows[rows.own == j]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        angle = np.arccos(np.clip(np.stack(list(a.centre)) @ np.stack(list(b.centre)).T, -1, 1))
        ca, cb = a.component.to_numpy(), b.component.to_numpy()
        apart = ca[:, None] < cb[None, :] if i == j else ca[:, None] != cb[None, :]
        x, y = np.nonzero((angle <= a.radius.to_numpy()[:, None] + b.radius.to_numpy()[None, :] + math.acos(threshold) + 1e-9) & apart)
        return pd.DataFrame(dict(zip(names, (ca[x], a.cut.to_numpy()[x], cb[y], b.cut.to_numpy()[y]), strict=True)))

    names = ["component_a", "cut_a", "component_b", "cut_b"]
    return _pairs_of_blocks(numbered, block).groupBy("part", "i", "j").applyInPandas(near, ", ".join(f"{x} bigint" for x in names))


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row with an id: how many other vectors have a cosine of
    `threshold` or more with it, the smallest id reachable by such links, and whether that is its own.

    Equal vectors are one from the start and count as often as they occur. The lists of NN-descent give the links
    that components are made of; inside a component every pair is then counted in double precision, in blocks.
    Vectors that are null, empty, all zero or hold null or non-finite components link with nothing; vectors link with
    those of their own length only. Rows without an id are left
    out; rows that share an id count once, by the greatest vector. Other columns are left out.
    """
    rows = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.expr("transform(embedding, x -> double(x))").alias("embedding"))
    usable_rows = rows.where(usable()).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    ids = rows.select("vec_id").distinct()
    members = staged(usable_rows.withColumn("key", F.md5(F.to_json("embedding"))).select("vec_id", "key", "embedding", F.size("embedding").alias("size")), "vectors")
    firsts = members.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    sizes = [r[0] for r in members.select("size").distinct().orderBy("size").collect()]
    found = None
    for size in sizes:
        mine = members.where(F.col("size") == size)
        vectors = staged(mine.join(firsts, "key").where("vec_id = rep").select("vec_id", "embedding", "copies"), "reps")
        one = _linked(vectors, vectors.count(), threshold)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    mapped = members.join(firsts, "key").select("vec_id", "rep", "copies")
    out = mapped.join(found.withColumnRenamed("vec_id", "rep"), "rep", "left")
    links = F.coalesce("linked", F.lit(0)) + F.col("copies") - 1
    out = out.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = ids.join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """(vec_id, component, linked) of distinct vectors of one length."""
    lists = neighbour_lists(vectors.select("vec_id", "embedding"), n, threshold)
    entries = lists.select(F.col("vec_id").alias("a"), F.explode("near").alias("e")).where(F.col("e.sim") >= threshold)
    links = staged(entries.select("a", F.col("e.id").alias("b")), "links")
    parts = components(links)
    full = saturated(lists, threshold).select(F.col("vec_id").alias("id"))
    full = full.join(parts, "id").join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id").withColumnRenamed("id", "vec_id")
    more = staged(_across(full, threshold, BLOCK), "across")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    named = parts.select(F.col("id").alias("vec_id"), F.col("component").alias("part"))
    counted = _count_links(named.join(vectors, "vec_id"), threshold, BLOCK)
    return named.join(counted, "vec_id", "left").select("vec_id", F.col("part").alias("component"), F.coalesce("linked", F.lit(0)).alias("linked"))
