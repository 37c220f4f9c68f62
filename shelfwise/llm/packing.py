"""Best-fit packing with certified bin counts: partitions that miss their lower bound exchange documents."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.memory import give_back, slices
from shelfwise.llm.tables import staged
from shelfwise.llm.tokens import CHUNK_CHARS, OVERLAP_CHARS, encoder, forget

CAPACITY = 4_096
#: The id that ends every document.
END_ID = 1
#: Pieces to a partition of the packing, about.
GROUP_ROWS = 50_000
ROUNDS = 6
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
FIELDS = PACKED + ", salt bigint, released boolean"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, memo: int | None = None) -> DataFrame:
    """PIECES rows: each text's ids and `end_id`, cut into pieces of `capacity`, the last may be shorter. A null text has
    the end alone; null and repeated ids stay. `memo`: distinct pieces of text that a worker remembers until its task ends;
    by default it remembers tokens.MEMO of them, and from task to task."""
    end = np.array([end_id], "<u4").tobytes()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(path, sys.maxsize, CHUNK_CHARS, OVERLAP_CHARS, memo).encoded
        for rows in slices(batches, 1024):
            docs = rows.column("doc_id").to_pylist()
            for first, ids, ends in encoded([t or "" for t in rows.column("text").to_pylist()]):
                out, blob, at = [], ids.tobytes(), 0
                for doc, to in zip(docs[first:], (4 * ends).tolist(), strict=False):
                    own, at = blob[at:to] + end, to
                    for k in range(0, len(own), 4 * capacity):
                        part = own[k : k + 4 * capacity]
                        out.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if memo is not None:  # other stages use this worker next
            del encoded
            forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of bins that any packing needs, by dual-feasible functions: each maps lengths so that what fits
    a bin still sums to one bin at most, so the sum over all, rounded up, is a bound. Tried are the identity, the
    thresholds (lengths over capacity - t count as full bins, those under t as nothing) and the rounding functions
    u_k for k up to 32."""
    if not len(lengths):
        return 0
    order = np.argsort(lengths)
    x, n = lengths[order].astype("int64"), counts[order].astype("int64")
    best = -(-int((x * n).sum()) // capacity)
    many, mass = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(x * n)))
    t = np.unique(x[x <= capacity // 2])
    if len(t):
        low, high = np.searchsorted(x, t, side="left"), np.searchsorted(x, capacity - t, side="right")
        best = max(best, int((-(-(mass[high] - mass[low]) // capacity) + many[-1] - many[high]).max()))
    for k in range(1, 33):
        whole = x * (k + 1) % capacity == 0
        parts = np.where(whole, x * k, (x * (k + 1) // capacity) * capacity)  # in 1 / k of a unit
        best = max(best, -(-int((parts * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the fullest bin that it fits. Bins with equal room are
    interchangeable, so they are kept in one stack for each room, and one integer's bits tell which stacks hold any."""
    bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    stacks: dict[int, list[int]] = {}
    open_rooms = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                open_rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            stacks.setdefault(left, []).append(b)
            open_rooms |= 1 << left
    return bins, offsets


def _packer(turn: int, last: bool, capacity: int):
    """Packs one partition and marks the pieces of the bins that it gives up."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "salt"], ascending=False, kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy("int64")
        bins, rows["offset"] = best_fit_decreasing(sizes, capacity)
        made = int(bins.max()) + 1
        gap = made - lower_bound(*np.unique(sizes, return_counts=True), capacity)
        rows["sequence_id"] = (turn << 56) + (int(rows.pop("group").iloc[0]) << 24) + bins
        gives = np.zeros(made, bool)
        if not last:
            fill = np.bincount(bins, sizes, made)
            gives[np.argsort(fill, kind="stable")[: 1 + 4 * gap]] = True
            gives &= fill < capacity
        rows["released"] = gives[bins]
        return rows[[c.split()[0] for c in FIELDS.split(", ")]]

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """PACKED rows of PIECES rows: whole bins by themselves, the others best-fit decreasing in partitions of about
    `group_rows` pieces, dealt at random, so that no key can fill one.

    Each partition's bin count is held against its lower bound. While the bins of all partitions are more than the
    lower bound of all pieces together, partitions give up bins with room: one each, and four more for each bin above
    their own bound. What they hold is dealt to fewer partitions and packed again, until the count is certified, one
    partition is left and does no better, or after `rounds`.
    """
    salted = staged(pieces.withColumn("salt", F.xxhash64(F.monotonically_increasing_id(), "doc_id", "piece")), "pack-pieces")
    whole = salted.where(F.col("length") >= capacity).select(*[c.split()[0] for c in PIECES.split(", ")], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_rows = salted.where(F.col("length") < capacity)
    histogram = open_rows.groupBy("length").count().toPandas()  # a row for each length: under `capacity` rows
    bound = lower_bound(histogram["length"].to_numpy("int64"), histogram["count"].to_numpy("int64"), capacity)
    n, closed_bins, done = int(histogram["count"].sum()), 0, [whole]

    for turn in range(rounds if n else 0):
        groups = max(1, -(-n // group_rows))

        group = F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(groups)).alias("group")
        named = open_rows.select(*[c.split()[0] for c in PIECES.split(", ")], "salt", group)
        result = staged(named.groupBy("group").applyInPandas(_packer(turn, groups == 1, capacity), FIELDS), "pack-round")
        bins = result.select("sequence_id", "released").distinct().groupBy("released").count().toPandas().set_index("released")["count"]
        kept, free = int(bins.get(False, 0)), int(bins.get(True, 0))
        done.append(result.where(~F.col("released")).select(*whole.columns))
        open_rows, closed_bins = result.where("released"), closed_bins + kept
        if not free:
            break
        n = open_rows.count()
        if closed_bins + free <= bound or groups == 1 or turn == rounds - 1:
            done.append(open_rows.select(*whole.columns))
            break
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, memo: int | None = None, **options) -> DataFrame:
    """PACKED rows of whole documents; the texts are read once and only the pieces' numbers are shuffled. An empty table
    gives an empty one; columns other than doc_id and text are left out."""
    return pack(cut_pieces(docs, path, capacity, end_id, memo), capacity, **options)
