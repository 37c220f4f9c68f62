"""Context-triggered piecewise hashing: fingerprints that stay alike when a text is edited in part."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A signature's characters, one for each chunk; more chunks than that end up in the last character.
LENGTH = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHARS = np.frombuffer(ALPHABET.encode(), np.uint8)
_VALUE = np.zeros(256, np.uint8)
_VALUE[_CHARS] = np.arange(64)
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Rows to a slice of the doc_id range, about, and slices at most.
PART_ROWS, MAX_PARTS = 2_000, 8_192


def _windows(data: bytes) -> np.ndarray:
    """A hash of the last eight bytes at each position; zero bytes stand before the text."""
    b = np.frombuffer(b"\0" * 7 + data, np.uint8)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    h = eight * _ODD
    return (h ^ (h >> np.uint64(29))) * _ODD2


def _signature(h: np.ndarray, ends: np.ndarray) -> str:
    """One character for each chunk: the sum of its windows' hashes, mixed."""
    starts = np.concatenate(([0], ends[: LENGTH - 1] + 1)) if len(ends) else np.zeros(1, np.int64)
    starts = starts[starts < len(h)]
    sums = np.add.reduceat(h, starts) * _ODD
    return _CHARS[(sums >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """"k:signature:signature": chunks of 2^k bytes on average, then of 2^(k+1). A chunk ends where the k top bits of
    the rolling hash are zero. k is the largest for 32 to 64 chunks on average by length that does give 32 chunks or
    more, so that texts that repeat themselves get more chunks too; an empty text has "0::"."""
    data = text.encode("utf-8", "replace")
    if not data:
        return "0::"
    h = _windows(data)
    k = max(1, math.ceil(math.log2(len(data) / LENGTH)) + 1)
    ends = np.flatnonzero(h < np.uint64(1 << (64 - k)))
    while k > 1 and len(ends) < LENGTH // 2:
        k -= 1
        ends = np.flatnonzero(h < np.uint64(1 << (64 - k)))
    coarse = ends[h[ends] < np.uint64(1 << (63 - k))]
    return f"{k}:{_signature(h, ends)}:{_signature(h, coarse)}"


def _edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures, all pairs at once, a column of the matrix in one 64-bit word."""
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    grid = lambda xs, w: _VALUE[np.frombuffer("".join(x.ljust(w, "A") for x in xs).encode(), np.uint8)].reshape(n, w)
    out = np.maximum(la, lb)
    if not n or not la.max() or not lb.max():
        return out
    ga, gb, rows = grid(a, la.max()), grid(b, lb.max()), np.arange(n)
    one = np.uint64(1)
    peq = np.zeros((n, 64), np.uint64)
    for j in range(la.max()):
        live = rows[j < la]
        peq[live, ga[live, j]] |= one << np.uint64(j)
    pv, mv, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.copy()
    top = (np.maximum(la, 1) - 1).astype(np.uint64)
    for j in range(lb.max()):
        eq = peq[rows, gb[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        step = ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        score += np.where(j < lb, step, 0)
        ph = (ph << one) | one
        mh = mh << one
        pv = mh | ~(xv | ph)
        mv = ph & xv
    both = (la > 0) & (lb > 0)
    out[both] = score[both]
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 less the edit distance by the longer signature's length, the better of
    the comparable signatures. Block sizes more than a factor of two apart are not comparable: 0. Equal: 1."""
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    fa, fb = [x.split(":") for x in a], [y.split(":") for y in b]
    for shift in (-1, 0, 1):
        at = [i for i, (x, y) in enumerate(zip(fa, fb, strict=True)) if out[i] < 1 and int(x[0]) - int(y[0]) == shift]
        for u, v in {-1: [(2, 1)], 0: [(1, 1), (2, 2)], 1: [(1, 2)]}[shift]:
            xs, ys = [fa[i][u] for i in at], [fb[i][v] for i in at]
            longest = np.maximum(1, [max(len(x), len(y)) for x, y in zip(xs, ys, strict=True)])
            # a shorter signature says less: it counts for as much as half of LENGTH characters would
            sure = np.minimum(1.0, longest / (LENGTH / 2)) if u == v == 2 else 1.0
            out[at] = np.maximum(out[at], (1 - _edit_distances(xs, ys) / longest) * sure) if at else out[at]
    return out


def _boundaries(docs: DataFrame) -> np.ndarray:
    """Ids that cut the rows into slices of about PART_ROWS, at most MAX_PARTS of them."""
    n = docs.count()
    parts = min(MAX_PARTS, math.ceil(n / PART_ROWS))
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    return np.unique(np.array(cuts, "int64"))


_NULL_ID = (1 << 63) - 1


def _with_next(docs: DataFrame) -> DataFrame:
    """(part, ghost, id, nameless, text): every row once in its slice of the doc_id range, and the first of each slice again
    at the end of the slice before (of the last, after the first), as a ghost. The texts are shuffled once."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(_NULL_ID)))
    cuts = _boundaries(docs)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype("int32"))

    heads = sorted((r[0], r[1]) for r in docs.groupBy(part_of("id").alias("part")).agg(F.min("id")).collect())  # MAX_PARTS rows + 1 at most
    first = np.array([h for _, h in heads], "int64")
    place = np.array([p for p, _ in heads], "int32")

    @F.pandas_udf("array<int>")
    def parts_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(), side="right")
        at = np.searchsorted(place, own)
        return pd.Series([[int(p), int(place[k - 1])] if i == first[k] else [int(p)] for i, p, k in zip(ids, own, at, strict=True)])

    spread = docs.withColumn("parts", parts_of("id")).select("id", F.col("doc_id").isNull().alias("nameless"), "text", F.posexplode("parts").alias("ghost", "part"))
    return spread.repartition("part").sortWithinPartitions("part", "ghost", "id", "nameless", "text")


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by the first as many (or all) of `following`."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FINGERPRINTS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint), a row for each row, without a shuffle. A null text is empty; null ids stay."""

    def made(batches):
        for rows in batches:
            rows["fingerprint"] = [fingerprint(t) for t in rows.pop("text")]
            yield rows

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("n_chars"), text.alias("text")).mapInPandas(made, "doc_id bigint, n_chars bigint, fingerprint string")


def compared_with_edits(docs: DataFrame, block: int = 1_000) -> DataFrame:
    """FINGERPRINTS rows: every whole text against its edit and against the next document in ascending doc_id, null ids
    last and rows of equal id by text; the first follows the last. A single document follows itself. Other columns
    are left out; an empty table gives an empty one."""
    names = [c.split()[0] for c in FINGERPRINTS.split(", ")]

    def finish(rows: list[tuple]) -> pd.DataFrame:
        """rows: (doc_id, text, fingerprint, next text, next fingerprint)"""
        edits = [edited_text(t, following) for _, t, _, following, _ in rows]
        own, after, new = [r[2] for r in rows], [r[4] for r in rows], [fingerprint(e) for e in edits]
        out = {
            "doc_id": pd.array([r[0] for r in rows], "Int64"),
            "n_chars": [len(r[1]) for r in rows],
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edits],
            "fingerprint": own,
            "edited_fingerprint": new,
            "near_edited": likeness(own, new),
            "near_next": likeness(own, after),
        }
        return pd.DataFrame(out, columns=names)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], None  # held: the row before, which waits for its next
        for batch in batches:
            for part, ghost, i, nameless, text in zip(batch.part, batch.ghost, batch.id, batch.nameless, batch.text, strict=True):
                if held and held[4] and (ghost or part != held[0]):
                    if part == held[0]:
                        continue  # further rows of a ghost's id
                now = (part, None if nameless else i, text, fingerprint(text), ghost)
                if held and held[0] == part and not held[4]:
                    rows.append((*held[1:4], text, now[3]))
                held = now
                if len(rows) >= block:
                    yield finish(rows)
                    rows = []
        if rows:
            yield finish(rows)

    return _with_next(docs).mapInPandas(compared, FINGERPRINTS)
