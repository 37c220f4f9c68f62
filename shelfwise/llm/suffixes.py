"""Repeated passages by a distributed sort of suffixes: front-coded sorted runs, merged by loser trees over common prefixes.

The question for each 50-byte string of a document is whether it also starts in a document with a smaller id. Not every
suffix has to be sorted for that:

1. Anchors. Of the 20-byte grams inside a 50-byte string, the one with the least hash is its anchor, so equal strings have
   equal anchors at equal places. Neighbouring strings mostly share an anchor; they make up a span.
2. Fingerprints. Each chunk of documents sends one hash for each distinct gram that is an anchor, and learns which occur
   in other documents too: alone in one context ("pure": all spans around it are equal), in several ("mixed"), or in
   several and very often ("hot"). All other suffixes have no partner and go no further.
3. Runs. Each chunk sorts its spans as suffixes that start at the gram (then the bytes before it, backwards), equal
   ones once, and writes the run front-coded: each string's common prefix with the one before it, and the rest. Spans of
   hot grams are taken apart into their 50-byte strings, which sort apart from each other, so that no gram gathers in one task.
4. Merge. Ranges of the runs meet and are merged by a loser tree that knows each contender's common prefix with the last
   string out and compares bytes after it only. Equal strings come out next to each other, all strings of a gram in a row.
5. Answers go back to the chunks that sent the strings: which of their windows some smaller id holds.

Hashes only decide which suffixes are sorted and how documents are spread; strings are compared by their bytes. (Two exceptions,
at odds of one in 2^50 and less for each pair: a gram's contexts seem equal by a 32-bit hash beside the gram's 50 bits, and
whole documents are equal by 128 bits.)
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.llm.memory import give_back
from shelfwise.llm.tables import drop, remove, shared_dir, staged

LENGTH, GRAM = 50, 20
#: Bytes of text to a chunk, about; spans of a gram in several contexts from which it is hot; strings to a block of a run and
#: to a range of the merge, about.
CHUNK_BYTES, HOT, BLOCK, RANGE = 8 << 20, 2_000, 128, 150_000
#: Starts of strings whose anchors are found at once.
STEP = 1 << 20
_NULL_ID = (1 << 63) - 1
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_PURE, _MIXED, _HOT = 1, 2, 3
#: Occurrences of a gram in a chunk are counted up to this, which is far over HOT.
_MANY = 32_767


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(x: np.ndarray) -> bytes:
    """A numeric array, its bytes by place value, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def released(result: pd.DataFrame) -> pd.DataFrame:
    """`result`, after memory was given back."""
    give_back()
    return result


# --- chunks


def _chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, n_bytes, rows): the rows of `docs` as Arrow streams of about `chunk_bytes` of text each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def out():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for b in held:
                    writer.write_batch(b)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([base + made], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column("text").cast(pa.large_string()).buffers()[1], np.int64, len(batch) + 1, 0 if not batch.column("text").offset else 8 * batch.column("text").offset)) if len(batch) else np.zeros(0, np.int64)
            at = 0
            while at < len(batch):
                fits = int(np.searchsorted(np.cumsum(sizes[at:]), chunk_bytes - size)) + 1
                part = batch.slice(at, fits)
                held.append(part)
                size += int(sizes[at : at + fits].sum())
                at += fits
                if size >= chunk_bytes:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()

    return docs.mapInArrow(pack, "chunk bigint, n_bytes bigint, rows binary")


class Chunk:
    """A chunk's rows, their bytes in one array, and its anchors."""

    def __init__(self, rows: bytes):
        self.table = pa.ipc.open_stream(rows).read_all()
        flat = self.table.column("text").cast(pa.large_string()).combine_chunks()
        flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).fill_null("")
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        self.data = bytes(memoryview(flat.buffers()[2])[offsets[0] : offsets[-1]]) if flat.buffers()[2] is not None else b""
        self.starts = offsets - offsets[0]
        self.ids = self.table.column("doc_id").cast(pa.int64()).fill_null(_NULL_ID).to_numpy()

    def text_hashes(self) -> np.ndarray:
        """128 bits of each whole text, as two columns."""
        s = self.starts
        digests = b"".join(xxhash.xxh128_digest(self.data[a:b]) for a, b in zip(s[:-1], s[1:], strict=True))
        return np.frombuffer(digests, "<u8").reshape(-1, 2)

    def anchors(self) -> None:
        """gram: hash of each anchor's gram; at: where it stands; low, high: the first and last start of the strings with
        this anchor; span: a hash of the bytes from low to high + LENGTH; row: the document."""
        b = np.frombuffer(self.data, np.uint8)
        parts = [self._anchors(b, low, min(low + STEP, len(b) - LENGTH + 1)) for low in range(0, len(b) - LENGTH + 1, STEP)]
        none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
        self.gram, self.at, self.low, self.high, self.span = (np.concatenate(x) for x in zip(*(parts or [none]), strict=True))
        self.row = np.searchsorted(self.starts, self.low, side="right") - 1

    def _anchors(self, all_bytes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
        """The anchors of the strings that start from `low` up to `high`. Where a step ends inside a span, the span is two; that
        costs a comparison of windows later and changes no result."""
        b = all_bytes[low : high + LENGTH - 1]
        k, stop = np.searchsorted(self.starts, low, side="right") - 1, np.searchsorted(self.starts, high, side="left")
        inside = np.clip(self.starts[k : stop + 1], low, high)
        last = np.repeat(self.starts[k + 1 : stop + 1], np.diff(inside)) - LENGTH  # the last start in the document of each byte
        grams = _mixed(_rolled(b, GRAM))
        where = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(where, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = np.flatnonzero(np.arange(low, high) <= last)
        if not len(valid):
            valid = valid.astype(np.int64)
            return np.zeros(0, np.uint64), valid, valid, valid, np.zeros(0, np.uint64)
        anchor = anchor[valid]
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))))
        start, end, at = valid[first], valid[np.concatenate((first[1:], [len(valid)])) - 1], anchor[first]
        whole = _rolled(b, LENGTH)
        shape = ((at - start) * 64 + (end - start)).astype(np.uint64)
        span = _mixed(whole[start] * np.uint64(3) + whole[end] * np.uint64(7) + shape)
        # mixed once more: the least of many hashes are small numbers, which would all go to the first buckets
        return _mixed(grams[at] * _A), at + low, start + low, end + low, span

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(grams, spans, many, group): each distinct gram, in order; a hash of its one span (0: several); how often it
        occurs, with the highest bit set if in several documents; and the number of each anchor's gram in this order."""
        grams, group, count = np.unique(self.gram, return_inverse=True, return_counts=True)
        order = np.argsort(group, kind="stable")
        heads = np.cumsum(count) - count
        if not len(grams):
            return grams, np.zeros(0, np.uint32), np.zeros(0, np.uint16), group
        span = self.span[order]
        lo, hi = np.minimum.reduceat(span, heads), np.maximum.reduceat(span, heads)
        ids = self.ids[self.row[order]]
        apart = np.minimum.reduceat(ids, heads) < np.maximum.reduceat(ids, heads)
        one = ((lo >> np.uint64(32)).astype(np.uint32)) | np.uint32(1)
        return grams, np.where(lo == hi, one, 0).astype(np.uint32), (np.minimum(count, _MANY) | (apart * (_MANY + 1))).astype(np.uint16), group


def _rolled(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position, put together from those of halves."""
    h, have = (b.astype(np.uint64) + np.uint64(1)) * _B, 1
    while have < k:
        step = min(have, k - have)
        h = h[:-step] * _A + h[step:]
        h ^= h >> np.uint64(32)
        have += step
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


# --- fingerprints


def _bucket_bits(n_bytes: int, partitions: int) -> int:
    return min(16, max(2, (max(partitions, n_bytes // (16 * 1_000_000)) - 1).bit_length()))


def _sent(chunks: DataFrame, bits: int) -> DataFrame:
    """(bucket, chunk, grams, spans, many, texts, ids): a chunk's fingerprints, a row for each bucket."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, rows in zip(batch.chunk, batch.rows, strict=True):
                c = Chunk(rows)
                c.anchors()
                grams, spans, many, _ = c.fingerprints()
                texts, ids = _first_ids(c)
                shift, low = np.uint64(64 - bits), np.uint64((1 << 40) - 1)
                cuts = np.searchsorted(grams >> shift, np.arange((1 << bits) + 1))
                t_cuts = np.searchsorted(texts[:, 0] >> shift, np.arange((1 << bits) + 1))
                out = []
                for k in range(1 << bits):
                    g, t = slice(cuts[k], cuts[k + 1]), slice(t_cuts[k], t_cuts[k + 1])
                    if g.stop > g.start or t.stop > t.start:
                        out.append((k, number, _pack((grams[g] >> np.uint64(24 - bits)) & low), _pack(spans[g]), _pack(many[g]), _pack(texts[t].ravel()), _pack(ids[t])))
                del c, grams, spans, many, texts, ids
                yield released(pd.DataFrame(out, columns=["bucket", "chunk", "grams", "spans", "many", "texts", "ids"]))

    return chunks.select("chunk", "rows").mapInPandas(send, "bucket int, chunk bigint, grams binary, spans binary, many binary, texts binary, ids binary")


def _first_ids(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, smallest ids) of the chunk's distinct texts, in order of the hashes."""
    h = c.text_hashes()
    order = np.lexsort((c.ids, h[:, 1], h[:, 0]))
    h, ids = h[order], c.ids[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]).any(1))) if len(h) else np.zeros(0, bool)
    return h[new], ids[new]


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, what its grams are (0: no partner) and the smallest id of each of its texts, in the order sent."""
    grams = [_unpack(b, "<u8") for b in rows.grams]
    spans, many = np.concatenate([_unpack(b, "<u4") for b in rows.spans]), np.concatenate([_unpack(b, "<u2") for b in rows.many])
    sizes = [len(g) for g in grams]
    distinct, group, chunks = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    kinds = np.zeros(len(group), np.uint8)
    if len(distinct):
        order = np.argsort(group, kind="stable")
        heads = np.cumsum(chunks) - chunks
        s, m = spans[order], many[order]
        partner = (chunks > 1) | (np.maximum.reduceat(m, heads) > _MANY)
        lo, hi = np.minimum.reduceat(s, heads), np.maximum.reduceat(s, heads)
        total = np.add.reduceat((m & _MANY).astype(np.int64), heads)
        kind = np.where(~partner, 0, np.where((lo == hi) & (lo > 0), _PURE, np.where(total > HOT, _HOT, _MIXED))).astype(np.uint8)
        kinds = kind[group]
    texts = [_unpack(b, "<u8").reshape(-1, 2) for b in rows.texts]
    ids = np.concatenate([_unpack(b, "<i8") for b in rows.ids])
    hashes = np.concatenate(texts)
    first = ids
    if len(ids):
        order = np.lexsort((ids, hashes[:, 1], hashes[:, 0]))
        new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]).any(1)))
        first = np.empty_like(ids)
        first[order] = ids[order][new][np.cumsum(new) - 1]
    g_cuts, t_cuts = np.cumsum([0, *sizes]), np.cumsum([0, *map(len, texts)])
    out = [(c, b, _pack(kinds[g_cuts[i] : g_cuts[i + 1]]), _pack(first[t_cuts[i] : t_cuts[i + 1]])) for i, (c, b) in enumerate(zip(rows.chunk, rows.bucket, strict=True))]
    return released(pd.DataFrame(out, columns=["chunk", "bucket", "kinds", "firsts"]))


# --- runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes two strings share, of which the first `known` are not looked at."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


_META = np.dtype([("least", "<i8"), ("most", "<i8"), ("back", "u1"), ("windows", "u1")])
_POSTING = np.dtype([("entry", "<u4"), ("row", "<u4"), ("low", "<u4"), ("windows", "u1")])
_ANSWER = np.dtype([("entry", "<u4"), ("first", "u1"), ("last", "u1"), ("least", "<i8")])
_RUNS = "chunk bigint, base bigint, head binary, tail binary, n int, prefixes binary, sizes binary, rests binary, meta binary, postings binary, copies binary"


def _run(number: int, rows: bytes, kinds: np.ndarray, firsts: np.ndarray) -> pd.DataFrame:
    """A chunk's sorted run in front-coded blocks, and a row that says where each of its strings stands in which text and
    which texts are copies of one with a smaller id."""
    c = Chunk(rows)
    c.anchors()
    *_, group = c.fingerprints()
    hashes, _ = _first_ids(c)
    own = c.text_hashes()
    # firsts came in the order of the hashes
    key = {h: int(f) for h, f in zip(map(tuple, hashes.tolist()), firsts.tolist(), strict=True)}
    copies = np.array([key[tuple(h)] for h in own.tolist()], np.int64) < c.ids
    kind = kinds[group] if len(group) else np.zeros(0, np.uint8)
    kind = np.where(copies[c.row], 0, kind) if len(kind) else kind
    spans = np.flatnonzero((kind == _PURE) | (kind == _MIXED))
    hot = np.flatnonzero(kind == _HOT)
    # spans, equal ones together: their gram and span hashes say which; a hash collision would only part equal bytes, never join
    data, strings, where = c.data, {}, []
    for i, at, lo, hi in zip(spans.tolist(), c.at[spans].tolist(), c.low[spans].tolist(), c.high[spans].tolist(), strict=True):
        s = b"\0" + data[at : hi + LENGTH] + data[lo:at][::-1] + bytes((hi - at + LENGTH,))
        where.append((strings.setdefault(s, len(strings)), i))
    at_span = np.array([e for e, _ in where], np.int64)
    posts = [(at_span, c.row[spans], c.low[spans], (c.high - c.low)[spans] + 1)]
    shape = {}
    for e, i in where:
        shape[e] = (int(c.at[i] - c.low[i]), int(c.high[i] - c.low[i] + 1))
    if len(hot):
        n = (c.high - c.low)[hot] + 1
        starts = np.repeat(c.low[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entries = np.empty(len(starts), np.int64)
        for k, p in enumerate(starts.tolist()):
            entries[k] = strings.setdefault(b"\1" + data[p : p + LENGTH], len(strings))
        posts.append((entries, np.repeat(c.row[hot], n), starts, np.ones(len(starts), np.int64)))
    entry, row, low, windows = (np.concatenate(x) for x in zip(*posts, strict=True))
    ordered = sorted(strings)
    place = np.empty(len(ordered), np.int64)
    for rank, s in enumerate(ordered):
        place[strings[s]] = rank
    meta = np.zeros(len(ordered), _META)
    meta["least"], meta["most"] = _NULL_ID, -_NULL_ID
    ids = c.ids[row] if len(row) else np.zeros(0, np.int64)
    entry = place[entry] if len(entry) else entry
    np.minimum.at(meta["least"], entry, ids)
    np.maximum.at(meta["most"], entry, ids)
    meta["windows"] = 1
    for e, (back, wide) in shape.items():
        meta["back"][place[e]], meta["windows"][place[e]] = back, wide
    postings = np.zeros(len(entry), _POSTING)
    postings["entry"], postings["row"], postings["low"], postings["windows"] = entry, row, low - c.starts[row] if len(row) else low, windows
    out = [(number, -1, b"", b"", 0, b"", b"", b"", b"", zstandard.compress(postings.tobytes(), 1), _pack(copies.astype(np.uint8)))]
    for base in range(0, len(ordered), BLOCK):
        block = ordered[base : base + BLOCK]
        shared = [0, *(common_prefix(a, b) for a, b in zip(block, block[1:], strict=False))]
        rests = [s[p:] for s, p in zip(block, shared, strict=True)]
        out.append((number, base, block[0], block[-1], len(block), bytes(shared), bytes(map(len, rests)), zstandard.compress(b"".join(rests), 1), meta[base : base + BLOCK].tobytes(), None, None))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _RUNS.split(", ")])


def _sorted_runs(key, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    if not len(chunks):
        return pd.DataFrame(columns=[x.split()[0] for x in _RUNS.split(", ")])
    answers = answers.sort_values("bucket")
    kinds = np.concatenate([_unpack(b, "u1") for b in answers.kinds]) if len(answers) else np.zeros(0, np.uint8)
    firsts = np.concatenate([_unpack(b, "<i8") for b in answers.firsts]) if len(answers) else np.zeros(0, np.int64)
    return released(_run(int(key[0]), chunks.rows.iloc[0], kinds, firsts))


# --- merge


def merged_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(common prefix with the string before, run, place in the run, string) of all strings in order.

    `runs`: sorted strings, and each one's common prefix with the one before it in its run. A contender is known by its
    common prefix with the last string out. Of two, the one with more in common is the smaller, and the loser's number
    holds for the winner too; only if the numbers are equal, bytes are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    place, prefix, loser = [0] * k, [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        p = common_prefix(x, y, p)
        if x[p:] <= y[p:] if p == len(x) or p == len(y) else x[p] < y[p]:
            prefix[b] = p
            return a, b
        prefix[a] = p
        return b, a

    level = list(range(k))
    width = k
    while width > 1:
        width //= 2
        winners = []
        for i in range(width):
            w, loser[width + i] = play(level[2 * i], level[2 * i + 1])
            winners.append(w)
        level = winners
    top = level[0]
    while (s := head[top]) is not None:
        at = place[top]
        yield prefix[top], top, at, s
        strings, prefixes = runs[top]
        at += 1
        place[top] = at
        if at < len(strings):
            head[top], prefix[top] = strings[at], prefixes[at]
        else:
            head[top] = None
        node = (k + top) // 2
        while node:
            other = loser[node]
            x = head[other]
            if x is not None:
                mine = head[top]
                if mine is None:
                    loser[node], top = top, other
                else:
                    p, q = prefix[top], prefix[other]
                    if q > p:
                        loser[node], top = top, other
                    elif p == q:
                        top, loser[node] = play(top, other)
            node //= 2


def _decoded(row) -> list[bytes]:
    out, before, at = [], b"", 0
    rests = zstandard.decompress(row.rests)
    for p, n in zip(row.prefixes, row.sizes, strict=True):
        before = before[:p] + rests[at : at + n]
        at += n
        out.append(before)
    return out


def _merge_range(cuts: list[bytes]):
    """Merges the blocks that reach into one range, and answers each string that a smaller id than one of its own holds."""

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        start, stop = cuts[part - 1] if part else b"", cuts[part] if part < len(cuts) else None
        runs, numbers, entries, metas = [], [], [], []
        for number, blocks in rows.sort_values(["chunk", "base"]).groupby("chunk", sort=False):
            strings, prefixes, place, meta = [], [], [], []
            for row in blocks.itertuples():
                block = _decoded(row)
                first = 0
                for i, s in enumerate(block):
                    if s < start or (stop is not None and s >= stop):
                        first = i + 1 if s < start else first
                        continue
                    if i == first:
                        prefixes.append(common_prefix(strings[-1], s) if strings else 0)
                    else:
                        prefixes.append(row.prefixes[i])
                    strings.append(s)
                    place.append(row.base + i)
                meta.append(np.frombuffer(row.meta, _META)[[p - row.base for p in place if row.base <= p < row.base + row.n]])
            if strings:
                runs.append((strings, prefixes))
                numbers.append(int(number))
                entries.append(place)
                metas.append(np.concatenate(meta))
        leasts = [m["least"].tolist() for m in metas]
        mosts = [m["most"].tolist() for m in metas]
        backs = [m["back"].tolist() for m in metas]
        answers: list[list[tuple]] = [[] for _ in runs]

        def same(equal: list[tuple[int, int]]) -> None:
            least = min(leasts[r][i] for r, i in equal)
            for r, i in equal:
                if least < mosts[r][i]:
                    answers[r].append((entries[r][i], 0, 255, least))

        def close(group: list[list[tuple[int, int]]], strings: list[bytes]) -> None:
            if len(group) == 1:
                if len(group[0]) > 1 or leasts[group[0][0][0]][group[0][0][1]] < mosts[group[0][0][0]][group[0][0][1]]:
                    same(group[0])
                return
            # several contexts of one gram: its windows by their bytes
            held: dict[bytes, int] = {}
            windows = []
            for equal, s in zip(group, strings, strict=True):
                r, i = equal[0]
                least = min(leasts[r][i] for r, i in equal)
                right, back = s[-1], backs[r][i]
                text = s[1 + right : 1 + right + back][::-1] + s[1 : 1 + right]
                mine = [bytes((back - w,)) + text[w : w + LENGTH] for w in range(len(text) - LENGTH + 1)]
                windows.append(mine)
                for w in mine:
                    if held.get(w, _NULL_ID) >= least:
                        held[w] = least
            for equal, mine in zip(group, windows, strict=True):
                found = [held[w] for w in mine]
                most = max(mosts[r][i] for r, i in equal)
                w = 0
                while w < len(found):
                    last = w
                    while last + 1 < len(found) and found[last + 1] == found[w]:
                        last += 1
                    if found[w] < most:
                        for r, i in equal:
                            if found[w] < mosts[r][i]:
                                answers[r].append((entries[r][i], w, last, found[w]))
                    w = last + 1

        group: list[list[tuple[int, int]]] = []
        strings: list[bytes] = []
        for shared, run, place, s in merged_runs(runs):
            if strings and shared == len(s) == len(strings[-1]):
                group[-1].append((run, place))
                continue
            if group and not (shared > GRAM and s[0] == 0):
                close(group, strings)
                group, strings = [], []
            group.append([(run, place)])
            strings.append(s)
        if group:
            close(group, strings)
        out = [(n, zstandard.compress(np.array(a, _ANSWER).tobytes(), 1)) for n, a in zip(numbers, answers, strict=True) if a]
        return released(pd.DataFrame(out, columns=["chunk", "answers"]))

    return merge


# --- results


def _removed(c: Chunk, postings: np.ndarray, answers: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Whether each byte of the chunk is covered by a string that a smaller id holds."""
    cover = np.zeros(len(c.data) + 1, np.int32)
    if len(answers) and len(postings):
        postings = postings[np.argsort(postings["entry"], kind="stable")]
        lo, hi = (np.searchsorted(postings["entry"], answers["entry"], side=s) for s in ("left", "right"))
        n = hi - lo
        which = np.repeat(np.arange(len(answers)), n)
        p = postings[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        a = answers[which]
        row = p["row"].astype(np.int64)
        gone = a["least"] < c.ids[row]
        first = c.starts[row] + p["low"].astype(np.int64) + a["first"]
        last = c.starts[row] + p["low"].astype(np.int64) + np.minimum(a["last"], p["windows"] - 1)
        np.add.at(cover, first[gone], 1)
        np.add.at(cover, last[gone] + LENGTH, -1)
    size = np.diff(c.starts)
    whole = np.flatnonzero(copies.astype(bool) & (size >= LENGTH))
    np.add.at(cover, c.starts[whole], 1)
    np.add.at(cover, c.starts[whole + 1], -1)
    return np.cumsum(cover[:-1]) > 0


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _finish(texts_schema: StructType | None):
    def finish(key, chunks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks):
            return pd.DataFrame()
        c = Chunk(chunks.rows.iloc[0])
        posts = [np.frombuffer(zstandard.decompress(b), _POSTING) for b in found.postings if b is not None]
        answers = [np.frombuffer(zstandard.decompress(b), _ANSWER) for b in found.answers if b is not None]
        copies = [_unpack(b, "u1") for b in found.copies if b is not None]
        gone = _removed(c, np.concatenate(posts) if posts else np.zeros(0, _POSTING), np.concatenate(answers) if answers else np.zeros(0, _ANSWER), copies[0] if copies else np.zeros(len(c.ids), np.uint8))
        data, keep, rows, kept_texts = np.frombuffer(c.data, np.uint8), ~gone, [], []
        null = c.table.column("doc_id").is_null().to_pylist()
        for k in range(len(c.ids)):
            a, b = int(c.starts[k]), int(c.starts[k + 1])
            cut = gone[a:b]
            n = int(cut.sum())
            left = data[a:b][keep[a:b]].tobytes() if n else c.data[a:b]
            if texts_schema is None:
                spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()) if n else 0
                rows.append((None if null[k] else int(c.ids[k]), b - a, n, spans, hashlib.sha256(left).hexdigest()))
            else:
                kept_texts.append(left.decode("utf-8", "ignore") if n else None)
        if texts_schema is None:
            return released(pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")]).astype({"doc_id": "Int64"}))
        table = c.table.to_pandas(integer_object_nulls=True)
        table["text"] = [t if k is None else k for t, k in zip(table["text"], kept_texts, strict=True)]
        if "n_chars" in table:
            table["n_chars"] = [n if k is None else len(k) for n, k in zip(table["n_chars"], kept_texts, strict=True)]
        return released(table)

    return finish


def _deduplicated(docs: DataFrame, texts: bool, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The chunks are a table bucketed by their number, so what is known about them comes to them, and texts are not shuffled.
    name = f"suffix_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    try:
        _chunked(docs, chunk_bytes).write.format("parquet").bucketBy(partitions, "chunk").option("path", path).saveAsTable(name)
        return _without(spark.table(name), docs.schema if texts else None, partitions)
    finally:  # the result stands in a table of its own
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)


def _without(chunks: DataFrame, texts_schema: StructType | None, partitions: int) -> DataFrame:
    """The rows of all chunks without what others hold: with their texts, in the schema given, or the numbers of RESULT."""
    n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = _bucket_bits(n_bytes, partitions)
    answers = staged(_sent(chunks, bits).groupBy("bucket").applyInPandas(_answered, "chunk bigint, bucket int, kinds binary, firsts binary"), "answers")
    runs = staged(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_sorted_runs, _RUNS), "runs")
    drop(answers)
    blocks = runs.where("base >= 0")
    n, rows = blocks.agg(F.sum("n"), F.count("*")).first()
    parts = max(1, min(4 * partitions, (n or 0) // 1_000), (n or 0) // RANGE) if n else 1
    heads = blocks.select("head").where(F.pmod(F.xxhash64("head"), F.lit(1 + rows // 200_000)) == 0)  # some 200,000 at most
    sample = sorted(bytes(r[0]) for r in heads.collect()) if parts > 1 else []
    # a range starts where a gram does, so that all strings of a gram are in one; hot grams' strings are cut anywhere
    cuts = sorted({s[: 1 + GRAM] if s[0] == 0 else s for s in (sample[len(sample) * k // parts] for k in range(1, parts))} - {b""}) if sample else []

    @F.pandas_udf("array<int>")
    def ranges(head: pd.Series, tail: pd.Series) -> pd.Series:
        from bisect import bisect_right

        return pd.Series([list(range(bisect_right(cuts, bytes(a)), bisect_right(cuts, bytes(b)) + 1)) for a, b in zip(head, tail, strict=True)])

    reached = blocks.select("chunk", "base", "n", "prefixes", "sizes", "rests", "meta", F.explode(ranges("head", "tail")).alias("part"))
    found = reached.groupBy("part").applyInPandas(_merge_range(cuts), "chunk bigint, answers binary")
    places = runs.where("base < 0").select("chunk", "postings", "copies", F.lit(None).cast("binary").alias("answers"))
    known = places.unionByName(found.select("chunk", F.lit(None).cast("binary").alias("postings"), F.lit(None).cast("binary").alias("copies"), "answers"))
    out = staged(chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(_finish(texts_schema), texts_schema or RESULT), "deduplicated")
    drop(runs)
    return out


def removed_passages(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """RESULT rows, one for each row of `docs`: the UTF-8 bytes of its text, those covered by a 50-byte string that also
    starts in a document with a smaller id, the maximal runs of them, and the SHA-256 of the others.

    A null text is empty. A null id is greater than all others, and rows of equal id take nothing from each other. Other
    columns are left out; an empty table gives an empty one.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], RESULT)
    return _deduplicated(docs.select(F.col("doc_id").cast("long"), "text"), False, chunk_bytes)


def without_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of `docs` without those bytes, all other columns as they are; n_chars, if there is one, counts again where
    something was removed. A character that loses some of its bytes goes whole."""
    if docs.isEmpty():
        return docs
    return _deduplicated(docs, True, chunk_bytes)
