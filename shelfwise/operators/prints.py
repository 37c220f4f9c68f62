"""Groups of like fingerprints: a few bits apart, inside buckets of an equal beginning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.graph import bit_error_rate, components
from shelfwise.operators.staging import drop, staged

#: Numbers that a bucket shares, bits to a number, and the greatest share of differing bits in a group.
HEAD, BITS, RATE = 4, 32, 0.05
#: Fingerprints to a block.
BLOCK = 512


def groups(prints: DataFrame, rate: float = RATE) -> DataFrame:
    """(id, component) of prints (id, fp) that links join: equal first HEAD numbers (0 where a print is shorter), and of the bits of
    the shorter print `rate` or less that differ. component is the smallest id; prints without a partner are left out.

    Equal prints are one from the start. Each other one meets the first of its bucket; what is near to that is done with as far as
    those are concerned, and only the rest meets all of its bucket, a block of them against a block at a time. Of a pair of
    blocks only links that join something new become rows, so a bucket of very many prints gives few. Null and empty
    prints are left out; a print's null numbers are 0."""
    numbers = F.transform("fp", lambda x: F.coalesce(x, F.lit(0)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("long"))
    rows = prints.where("id is not null and size(fp) > 0").select("id", numbers.alias("fp"))
    head = F.transform(F.sequence(F.lit(0), F.lit(HEAD - 1)), lambda k: F.coalesce(F.get("fp", k), F.lit(0).cast("long")))
    firsts = staged(rows.groupBy("fp").agg(F.min("id").alias("first")).withColumn("bucket", head), "prints")
    same = rows.join(firsts.select("fp", "first"), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    centres = firsts.groupBy("bucket").agg(F.min(F.struct("first", "fp")).alias("c"), F.count("*").alias("n")).where("n > 1").select("bucket", "n", F.col("c.first").alias("centre"), F.col("c.fp").alias("centre_fp"))
    met = firsts.join(centres, "bucket").withColumn("near", bit_error_rate(F.col("fp"), F.col("centre_fp")) <= rate)
    met = staged(met.select("bucket", "first", "fp", "centre", "near", "n"), "met-prints")
    to_centre = met.where("near and first <> centre").select(F.col("centre").alias("a"), F.col("first").alias("b"))
    open_ = met.groupBy("bucket").agg(F.count_if(~F.col("near")).alias("rest"), F.first("n").alias("n")).where("rest > 0")
    blocks = staged(open_.select("bucket", F.ceil(F.col("rest") / BLOCK).cast("int").alias("asks"), F.ceil(F.col("n") / BLOCK).cast("int").alias("holds")), "print-blocks")
    deal = lambda n: F.pmod(F.xxhash64("first", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = met.join(blocks, "bucket")
    asked = dealt.where(~F.col("near")).withColumn("i", deal("asks")).withColumn("j", each("holds")).withColumn("asks_now", F.lit(True))
    others = dealt.withColumn("j", deal("holds")).withColumn("i", each("asks")).withColumn("asks_now", F.lit(False))
    both = asked.unionByName(others).select("bucket", "i", "j", "asks_now", "first", "fp")

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        return _joins(rows[rows.asks_now], rows[~rows.asks_now], rate)

    across = both.groupBy("bucket", "i", "j").applyInPandas(linked, "a bigint, b bigint")
    links = same.unionByName(to_centre).unionByName(staged(across, "print-links"))
    out = components(links.select(F.col("a").cast("long"), F.col("b").cast("long")))
    for table in (met, blocks):
        drop(table)
    return out


def _joins(a: pd.DataFrame, b: pd.DataFrame, rate: float) -> pd.DataFrame:
    """Pairs of near prints of two blocks, those that join what the pairs before have not."""
    out: list[tuple[int, int]] = []
    if len(a) and len(b):
        width = max(len(x) for x in b.fp)
        words = [np.array([np.pad(np.asarray(x[:width], np.uint32), (0, max(0, width - len(x)))) for x in side.fp]) for side in (a, b)]
        sizes = [np.array([len(x) for x in side.fp]) for side in (a, b)]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        ids = b["first"].tolist()
        places = np.arange(width)
        for word, size, one in zip(words[0], sizes[0], a["first"].tolist(), strict=True):
            shorter = np.minimum(sizes[1], size)
            differ = np.bitwise_count(words[1] ^ word) * (places < shorter[:, None])
            for k in np.flatnonzero(differ.sum(1) / (shorter * BITS) <= rate).tolist():
                x, y = top(one), top(ids[k])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((one, ids[k]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
