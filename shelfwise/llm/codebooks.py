"""Product codes of vectors by delta-maintained Lloyd rounds, in whole numbers.

A round assigns every part of a vector to its nearest entry, beside the assignment of the round before, and shuffles
only what changed: of each part whose entry is another one, a plus to the new entry's sum and a minus to the old one's.
Tasks add up what they have, so a round moves at most a row for each task and entry. The sums run on from round to round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import drop, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def whole_numbers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, of the vectors that neither are null or empty nor hold a
    null or non-finite component."""
    bad = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = embeddings.where(f"embedding is not null and size(embedding) > 0 and not {bad}")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.expr(f"transform(embedding, x -> cast(floor({scale} * double(x)) as bigint))").alias("v"))


def _exact(width: int, top: int) -> type:
    """The numbers in which squared distances of `width` components up to `top` are exact."""
    need = 4 * width * (top + 1) ** 2
    if need >= 2**63:
        raise ValueError(f"components up to {top} are too large for distances in 64 bits")
    return np.float64 if need < 2**53 else np.int64


def nearest_entries(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): the nearest entry of each part and its squared distance; the lower index on a tie."""
    kind = _exact(v.shape[2], max(int(np.abs(v).max(initial=0)), int(np.abs(books).max(initial=0))))
    code, error = np.zeros(v.shape[:2], np.uint8), np.zeros(v.shape[:2], np.int64)
    for p, book in enumerate(books.astype(kind)):
        x = v[:, p].astype(kind)
        d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
        code[:, p] = d.argmin(1)
        error[:, p] = np.take_along_axis(d, code[:, p, None].astype(np.int64), 1)[:, 0]
    return code, error


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """`rows` with code, a byte for each part, the code of the round before as `was`, and error."""
    parts, _, width = books.shape

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, width)
            code, error = nearest_entries(v, books)
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            was = b.column("code") if "code" in b.schema.names else pa.nulls(b.num_rows, pa.binary())
            yield pa.record_batch([b.column("vec_id"), b.column("label"), b.column("v"), was, codes, pa.array(error.sum(1), pa.int64())], ["vec_id", "label", "v", "was", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    picked = rows.select("vec_id", "label", "v", *(["code"] if "code" in rows.columns else []))
    return picked.mapInArrow(assigned, f"vec_id bigint, label {label}, v array<bigint>, was binary, code binary, error bigint")


def _changes(assigned: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): what the parts whose assignment changed add to each entry's count and sums."""

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, 1 + width), np.int64)
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, width)
            new = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            before = b.column("was").to_pylist()
            old = np.array([np.full(parts, -1) if w is None else np.frombuffer(w, np.uint8) for w in before], np.int64).reshape(-1, parts)
            moved = new != old
            ones = np.concatenate([np.ones((*v.shape[:2], 1), np.int64), v], axis=2)
            at = np.arange(parts) * entries
            np.add.at(total, (at + new)[moved], ones[moved])
            left = moved & (old >= 0)
            np.subtract.at(total, (at + old)[left], ones[left])
        hit = np.flatnonzero(total.any(1))
        yield pa.record_batch([pa.array(hit // entries, pa.int32()), pa.array(hit % entries, pa.int32()), *(pa.array(total[hit, k], pa.int64()) for k in range(1 + width))], names)

    names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]
    schema = "part int, entry int, " + ", ".join(f"{x} bigint" for x in names[2:])
    return assigned.select("v", "was", "code").mapInArrow(changed, schema)


def _replaced(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The entries as the floors of their parts' means; an unused one stays."""
    books = books.copy()
    for row in sums.where("n > 0").collect():  # an entry of a codebook each
        books[row.part, row.entry] = [s // row.n for s in row[3:]]
    return books


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each kept row: its entries in part order, two hex
    digits each; its squared distances summed; the errors summed over rows of equal label; and a digest of all entries.

    Components are floor(scale * x). Rows whose vector is null or empty or holds null or non-finite components are left
    out, and so are vectors of another length than that of the smallest id's. A codebook starts with the parts of the first
    rows by id, then by components, null ids last; repeated rows are rows. Null labels are one label. Vectors whose length is no
    multiple of `parts`, and components whose squares 64 bits cannot add up, raise an error. Without kept rows the
    result is empty. Other columns are left out.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is a byte")
    rows = whole_numbers(embeddings, scale)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()  # ENTRIES rows at most
    if not first:
        label = embeddings.schema["label"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id bigint, label {label}").select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(x) for x in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    size = len(first[0].v)
    if size % parts:
        raise ValueError(f"{size} components do not make {parts} equal parts")
    width = size // parts
    start = np.array([r.v for r in first if len(r.v) == size], np.int64)
    books = start.reshape(-1, parts, width).transpose(1, 0, 2)
    rows, sums = rows.where(F.size("v") == size), None
    for _ in range(rounds):
        assigned = staged(_assigned(rows, books), "codes")
        if sums is not None:
            drop(rows)
        change = _changes(assigned, parts, books.shape[1], width)
        named = [c for c in change.columns if c not in ("part", "entry")]
        both = change if sums is None else change.unionByName(sums)
        running = staged(both.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in named)), "code-sums", parts * entries)
        if sums is not None:
            drop(sums)
        rows, sums = assigned, running
        books = _replaced(books, sums)
    final = staged(_assigned(rows, books).select("vec_id", "label", "code", "error"), "codes")
    if sums is not None:
        drop(rows)
        drop(sums)
    by_label = staged(final.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-labels")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = final.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignment by the entries of round n, and the entries of round n + 1."""
    squares = " + ".join(f"(x.a[{k}] - b.a[{k}]) * (x.a[{k}] - b.a[{k}])" for k in range(1, 5))
    floors = ", ".join(f"(sum(x.a[{k}]) - ((sum(x.a[{k}]) % count(*)) + count(*)) % count(*)) // count(*)" for k in range(1, 5))
    near = f"near{n} as (select x.rid, x.p, min(({squares}) * {ENTRIES} + b.e) m from parts x join book{n} b on x.p = b.p group by 1, 2)"
    book = f"""book{n + 1} as (
        select b.p, b.e, coalesce(c.a, b.a) a from book{n} b left join (
            select x.p, n.m % {ENTRIES} e, [{floors}] a from parts x join near{n} n on x.rid = n.rid and x.p = n.p group by 1, 2) c
        on b.p = c.p and b.e = c.e)"""
    return f"{near},\n    {book}"


#: For vectors of 64 components.
SQL = f"""
with rows_ as (
    select vec_id, label, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] v from embeddings
    where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    kept as (select *, row_number() over (order by vec_id, v) rid from rows_),
    parts as (select rid, p, v[4 * p + 1 : 4 * p + 4] a from kept, range({PARTS}) t(p)),
    book0 as (select p, rid - 1 e, [cast(y as hugeint) for y in a] a from parts where rid <= {ENTRIES}),
    {", ".join(_round_sql(n) for n in range(ROUNDS + 1))},
    errors as (select rid, string_agg(printf('%02x', cast(m % {ENTRIES} as integer)), '' order by p) code, cast(sum(m // {ENTRIES}) as bigint) error from near{ROUNDS} group by 1),
    digest as (select sha256(string_agg(array_to_string(a, ','), ',' order by p, e)) d from book{ROUNDS})
select k.vec_id, r.code, r.error, cast(sum(r.error) over (partition by k.label) as bigint) label_error, (select d from digest) codebooks_sha256
from kept k join errors r on k.rid = r.rid"""
