"""Near-duplicate documents by BagMinHash signatures of their word shingles, banded and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.memory import give_back, slices
from shelfwise.llm.tables import drop, staged

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares a band but for a chance of (1 - 0.8^5)^28, one in seventy thousand.
BANDS, BAND_ROWS = 28, 5
#: Documents to a block where what is left is compared in blocks.
FAMILY_BLOCK = 512
#: Rows of numbers that a pair of bags weighs as much as.
PAIR_ROWS = 20
#: The filter of ids whose texts are read again has two to this power bits: 2 MB.
FILTER_BITS = 24
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words whose hashes a worker remembers.
MEMO = 60_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


_hash_of = _WordHashes()


def words(text: str) -> list[str]:
    return text.lower().split()


def shingle_bag(ws: list[str], n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the runs of `n` words; a shorter text is one run, an empty one has none."""
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_hash_of.__getitem__, ws), np.uint64, len(ws))
    size = max(1, len(ws) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(min(n, len(ws))):
        out = out * _GOLD + h[k : k + size]
    return np.unique(_mixed(out), return_counts=True)


def bag_minhash(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """A signature of `m` numbers; two bags agree in each with the chance of their weighted Jaccard similarity.

    Every element and unit of weight has a Poisson process of points in time, each at a random place of the signature; a
    place takes the first point of all. The units of an element are not run one by one: units [0, 1), [1, 2), [2, 4),
    [4, 8) ... are blocks with one process each, of the sum of the rates, and a point of a block goes down to one of its
    units by hash. It counts if the bag's weight reaches over that unit, so bags of different weight see the same
    points, less what lies above their weight. Processes run in time until every place is taken and the next points
    come too late everywhere.
    """
    levels = [np.flatnonzero(weights > (1 << (j - 1) if j else 0)) for j in range(int(weights.max()).bit_length() + 1)]
    levels = [(j, at) for j, at in enumerate(levels) if len(at)]
    block = np.concatenate([np.full(len(at), j, np.int64) for j, at in levels])
    at = np.concatenate([at for _, at in levels])
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1)
    seed, weight = _mixed(elements[at] + block.astype(np.uint64) * _GOLD), weights[at]
    time, drawn = np.zeros(len(at)), 0
    best, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    draws = max(2, math.ceil(1.2 * m * (math.log(m) + 1) / len(at)))
    while len(seed):
        k = np.arange(drawn + 1, drawn + draws + 1, dtype=np.uint64) * _GOLD
        bits = _mixed(seed[:, None] + k)
        gaps = -np.log(((bits >> np.uint64(11)).astype(float) + 1.0) / 9007199254740993.0) / (m * width[:, None])
        times = time[:, None] + np.cumsum(gaps, 1)
        more = _mixed(bits ^ _GOLD)
        place = (more % np.uint64(m)).astype(np.int64)
        unit = low[:, None] + ((more >> np.uint64(40)).astype(np.int64) & (width[:, None] - 1))
        ok = (unit < weight[:, None]) & (times < best[place])
        t, p, who = times[ok], place[ok], bits[ok]
        order = np.argsort(-t, kind="stable")  # the first point comes last and stays
        best[p[order]], owner[p[order]] = t[order], who[order]
        drawn += draws
        time = times[:, -1]
        live = time < best.max()
        seed, time, low, width, weight = seed[live], time[live], low[live], width[live], weight[live]
        draws = 4 if len(seed) > 8 else 64
    return owner


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band."""
    s = signature.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out * _GOLD + s[:, k])
    return out.view(np.int64)


def bag_set(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bag as a set: (element, nth time) as one number, so that sets overlap as their bags do."""
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return _mixed(np.repeat(elements, counts) + nth.astype(np.uint64) * _GOLD).view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, same, size, bands): what equal word sequences share, the number of shingles, the bands' hashes."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                ws = words(text)
                bag = shingle_bag(ws)
                keys = band_hashes(bag_minhash(*bag, bands * rows), bands, rows) if ws else np.zeros(0, np.int64)
                out.append((xxhash.xxh128_digest(" ".join(ws).encode("utf-8", "replace")), int(bag[1].sum()), keys))
            same, sizes, keys = zip(*out, strict=True)
            yield pa.record_batch([batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "size", "bands"])
        _hash_of.clear()
        give_back()

    return docs.mapInArrow(signed, "doc_id bigint, same binary, size bigint, bands array<bigint>")


def _bags(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, bag) of the texts whose id may be among `wanted`, by a Bloom filter of 2^FILTER_BITS bits, so that of the others
    nothing is made or shuffled. Its size is fixed: for so many ids that it fills up it lets more rows through, and the join
    after it is right all the same."""
    places = F.expr(f"array(xxhash64(doc_id) & {(1 << FILTER_BITS) - 1}, shiftrightunsigned(xxhash64(doc_id), 32) & {(1 << FILTER_BITS) - 1})")
    bits = wanted.select(F.explode(places).alias("p")).groupBy(F.expr("p >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("bits"))
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for batch in bits.toArrow().to_batches():  # 2^(FILTER_BITS - 6) rows at most
        filled[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    known = texts.sparkSession.sparkContext.broadcast(filled.view(np.uint8))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [(known.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in (batch.column(k).to_numpy() for k in ("one", "other"))]
            some = batch.filter(pa.array((held[0] & held[1]).astype(bool)))
            made = [bag_set(*shingle_bag(words(t))) for t in some.column("text").to_pylist()]
            yield pa.record_batch([some.column("doc_id"), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "bag"])
        _hash_of.clear()
        give_back()

    return texts.select("doc_id", "text", places[0].alias("one"), places[1].alias("other")).mapInArrow(bags, "doc_id bigint, bag array<bigint>").join(wanted, "doc_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, class_id, kept), one row for each id: class_id is the smallest id reachable by links between texts whose
    bags of five-word shingles have a weighted Jaccard similarity of `threshold` or more; kept is doc_id = class_id.

    Texts of equal words (lower case, split at white space) are one document from the start, so copies meet no pairs.
    The others are banded. Each document is first compared with one other: of the most central documents of its buckets,
    the one whose buckets hold the most. Only buckets that still hold several components after that are compared with
    their own most central document, and those that hold several even then across these, in blocks (_links_across). So
    documents in one component need no more comparing, no link that a shared band shows is lost, and no list of all
    pairs of a group is made.

    A null text is empty; documents without words are one class. Rows with a null id are left out, since a class is named
    by ids; rows that share an id count once, by the text that sorts first. Other columns are left out.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = staged(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    signed = staged(_signed(texts, bands, rows), "signed")
    n = signed.count()  # bounds what follows; a pair with its bags counts as PAIR_ROWS
    copied = signed.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    copied = staged(copied, "copied", n)  # a table of its own, so that Spark can split the join at a group of very many copies
    reps = staged(signed.join(copied, "same", "left").select("doc_id", F.coalesce("first", "doc_id").alias("rep")), "reps", n)
    drop(copied)
    keys = signed.join(reps.where("doc_id = rep").select("doc_id"), "doc_id").select("doc_id", "size", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared_keys = staged(keys.join(shared, "bucket"), "keys", n * bands)
    drop(signed)
    weights = shared_keys.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    members = staged(shared_keys.join(weights, "doc_id").select("bucket", "doc_id", "size", "weight"), "members", n * bands)
    drop(shared_keys)
    wanted = staged(members.select("doc_id").distinct(), "wanted", n)
    bags = staged(_bags(texts, wanted), "bags")
    drop(wanted)

    # each document against the heaviest of the most central documents of its buckets
    most = F.max_by(F.struct(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("weight").alias("weight_a")), F.struct("weight", -F.col("doc_id")))
    fits = F.least("size_a", "size") >= threshold * F.greatest("size_a", "size")
    centres = members.groupBy("bucket").agg(most.alias("c")).select("bucket", "c.*")
    met = members.join(centres, "bucket").where((F.col("doc_id") != F.col("a")) & fits)
    tried = staged(met.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("a", F.struct("weight_a", -F.col("a"))).alias("a")), "pairs", n)
    links = staged(_alike(tried, bags, threshold), "links", n * PAIR_ROWS)
    parts = components(links, n)

    # what is left of the buckets that hold several components, against the most central document of each
    named = _named(members, parts)
    here = F.max_by(F.struct(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("component").alias("component_a")), F.struct("weight", -F.col("doc_id")))
    centres = named.groupBy("bucket").agg(here.alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket", "c.*")
    met = named.join(centres, "bucket").where((F.col("component") != F.col("component_a")) & fits)
    again = staged(met.select(F.col("doc_id").alias("b"), "a").distinct().join(tried, ["b", "a"], "left_anti"), "pairs", n * bands)
    links = links.unionByName(staged(_alike(again, bags, threshold), "links", n * PAIR_ROWS))
    drop(tried)
    drop(again)
    drop(parts)
    parts = components(links, 2 * n)

    links = links.unionByName(_links_across(members, bags, parts, threshold, n))
    drop(members)
    drop(bags)
    drop(parts)
    parts = components(links, 3 * n).select(F.col("id").alias("rep"), "component")
    out = reps.join(parts, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def _named(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with the component of each; one without links is its own."""
    return members.join(parts.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _alike(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags have a weighted Jaccard similarity of `threshold` or more."""
    bag_a, bag_b = (bags.select(F.col("doc_id").alias(x), F.col("bag").alias(f"bag_{x}")) for x in "ab")
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    alike = both >= threshold * (F.size("bag_a") + F.size("bag_b") - both)
    return pairs.join(bag_b, "b").join(bag_a, "a").where(alike).select("a", "b")


def _links_across(members: DataFrame, bags: DataFrame, parts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links between documents of a bucket that are still in different components.

    Buckets that share documents make up families. In a family, the documents outside its largest component are
    asked against all others, a block of them against a block at a time: overlaps of all pairs of two blocks come
    out of products of matrices that say which document holds which shingle, and of the pairs found only those that
    join two components become rows.
    """
    named = staged(_named(members, parts).select("bucket", "doc_id", "component"), "named", n * BANDS)
    several = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("first")).where("lo < hi").select("bucket", "first")
    open_docs = named.join(several, "bucket")
    families = components(open_docs.select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), n)
    docs = open_docs.select("doc_id", "component").distinct().join(families.select(F.col("id").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    docs = staged(docs, "families", n)
    drop(named)
    counts = docs.groupBy("family", "component").agg(F.count("*").alias("n"))
    sized = counts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("in_main")).where("n > in_main")
    blocks = sized.select("family", "main", F.ceil(F.col("n") / FAMILY_BLOCK).cast("int").alias("n_to"), F.ceil((F.col("n") - F.col("in_main")) / FAMILY_BLOCK).cast("int").alias("n_from"))
    blocks = staged(blocks, "sized", n)
    asked = F.col("component") != F.col("main")
    dealt = docs.join(blocks, "family").join(bags, "doc_id")
    spread = F.xxhash64("doc_id", F.lit(11))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    to = dealt.withColumn("to", F.pmod(spread, F.col("n_to")).cast("int")).withColumn("from", each("n_from")).withColumn("asks", F.lit(False))
    from_ = dealt.where(asked).withColumn("from", F.pmod(spread, F.col("n_from")).cast("int")).withColumn("to", each("n_to")).withColumn("asks", F.lit(True))
    columns = ["family", "from", "to", "asks", "doc_id", "component", "bag"]
    found = staged(to.select(columns).unionByName(from_.select(columns)).groupBy("family", "from", "to").applyInPandas(_block_links(threshold), "a bigint, b bigint"), "across")
    drop(docs)
    drop(blocks)
    return found


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of `a` with all of `b`."""
    codes, where = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    col_a, col_b = where[: len(rows_a)], where[len(rows_a) :]
    common = np.zeros(len(codes), np.int8)
    common[col_a] |= 1
    common[col_b] |= 2
    place = np.cumsum(common == 3) - 1
    keep_a, keep_b = common[col_a] == 3, common[col_b] == 3
    rows_a, col_a, rows_b, col_b = rows_a[keep_a], place[col_a[keep_a]], rows_b[keep_b], place[col_b[keep_b]]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4_096):
        has = []
        for rows, cols, n in ((rows_a, col_a, len(a)), (rows_b, col_b, len(b))):
            some = (cols >= low) & (cols < low + 4_096)
            m = np.zeros((n, 4_096), np.float32)
            m[rows[some], cols[some] - low] = 1
            has.append(m)
        out += has[0] @ has[1].T
    return out


def _block_links(threshold: float):
    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.asks], rows[~rows.asks]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        both = _overlaps(a.bag.tolist(), b.bag.tolist())
        sizes_a, sizes_b = (np.array([len(s) for s in x.bag], np.float32) for x in (a, b))
        other = a.component.to_numpy()[:, None] != b.component.to_numpy()[None, :]
        found = np.argwhere((both >= threshold * (sizes_a[:, None] + sizes_b[None, :] - both).astype(float)) & other)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in found.tolist():
            x, y = top(int(a.component.iat[i])), top(int(b.component.iat[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a.doc_id.iat[i], b.doc_id.iat[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return linked


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose id names their class, and those without an id, as they are; of rows that share an id all
    stay."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
