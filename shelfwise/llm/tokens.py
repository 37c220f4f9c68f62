"""Token ids and counts of whole texts, huge ones by overlap resynchronisation.

A text is cut where the tokenizer is proven to start afresh, and each distinct piece is encoded once for each worker.
Two shapes of tokenizer are known: "spaced" (byte-level BPE whose pre-tokenizer takes one leading space into a word)
and "bare" (white space separates words and is dropped). For both, a position between a character that isn't white
space and a space or line end is a boundary whatever stands further left or right, as no alternative of their patterns
matches on across it, and each match starts where the one before ended. A run of letters that meets plain punctuation or
a digit is one too; apostrophes (contractions), angle brackets (special tokens) and characters outside the Latin
letters and ASCII never bound a piece.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.memory import give_back

#: Texts longer than this many characters are encoded in overlapping chunks.
HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
#: Distinct pieces that a worker remembers, which changes no result.
MEMO = 600_000

#: Without U+0130, whose lower case has a combining mark.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = r"!-&(-;=?@\[-`{-~"
_SPACE = " \n\t\r"
_ANY_SPACE = "\x1c-\x1f\x85\xa0  -     　\x0b\x0c"
_WHOLE = rf"[{_SPACE}]*[^{_SPACE}]+(?:(?<=[{_ANY_SPACE}])[{_SPACE}]+[^{_SPACE}]*)*|[{_SPACE}]+"
#: Pieces of a text; each match but the last ends at a proven boundary.
PIECES = {
    "spaced": re.compile(rf" ?[{_LETTER}]++(?=[{_SPACE}{_PLAIN}]|\Z)| ?[{_PLAIN}]++(?=[{_SPACE}{_LETTER}]|\Z)|{_WHOLE}"),
    "bare": re.compile(rf"[{_LETTER}]++(?=[{_SPACE}{_PLAIN}]|\Z)|[{_PLAIN}]++(?=[{_SPACE}{_LETTER}]|\Z)|[^{_SPACE}]+"),
}
#: A piece that is one pre-token of letters.
_LETTERS = re.compile(rf" ?[{_LETTER}]+")
_STABLE = re.compile(rf"(?<=[^{_SPACE}{_ANY_SPACE}])[{_SPACE}]")


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level tokenizers write for bytes: printable ones stand for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + n) for n, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def _shape(path: str) -> str | None:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
    specials = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or not re.fullmatch(r"<\S*>", t["content"])]
    if specials or spec.get("truncation") or spec.get("padding"):
        return None
    if '"use_regex": true' in before and '"add_prefix_space": false' in before and spec.get("normalizer") is None:
        return "spaced"
    if r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in before and '"Removed"' in before and "NFC" in before:
        return "bare"
    return None


#: Kinds of bytes: white space, letters (also the leading bytes of Latin letters, and continuation bytes, which count as what
#: stands before them), plain punctuation, anything else, and the byte that ends a text, which UTF-8 never has.
_GAP, _WORD, _MARK, _OTHER, _END = range(5)
_KINDS = bytearray([_OTHER]) * 256
for _kind, _bytes in ((_GAP, _SPACE.encode()), (_WORD, (*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9))), (_MARK, [k for k in range(33, 127) if re.match(f"[{_PLAIN}]", chr(k))]), (_END, b"\xff")):
    for _byte in _bytes:
        _KINDS[_byte] = _kind
#: × ÷ İ, which are no letters here.
_NO_LETTERS = tuple(c.encode() for c in "×÷İ")
#: What white space beyond _SPACE begins with in UTF-8.
_ODD_SPACE = re.compile(rb"[\x0b\x0c\x1c-\x1f\xc2\xe1-\xe3]")
#: Characters of text that are cut at once, about; the longest pieces that are compared as numbers; words encoded as one text.
CUT_CHARS, SHORT, TOGETHER = 2 << 20, 24, 2_000
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_texts(data: bytes, shape: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of texts that each end in 0xFF, in order; white space that no token holds is left out.

    A stretch between white space is cut where letters meet plain punctuation; if it holds anything else, it is one
    piece. "spaced": of the white space before it, all but the last character are a piece; the last belongs to what
    follows if it is a space and is a piece of its own if not. White space at a text's end is one piece."""
    b = np.frombuffer(data, np.uint8)
    kinds = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    for c in _NO_LETTERS:
        if c in data:
            kinds[[m.start() for m in re.finditer(c, data)]] = _OTHER
    at = np.append(0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1)
    what, end = kinds[at], np.append(at[1:], len(b))
    solid = (what != _GAP) & (what != _END)
    goes_on = np.append(solid[1:], False)
    first = solid & ~np.append(False, solid[:-1])
    heads, tails = np.flatnonzero(first), np.flatnonzero(solid & ~goes_on)
    mixed = np.add.reduceat(solid & (what == _OTHER), heads) > 0 if len(heads) else np.zeros(0, bool)
    whole = solid & np.append(mixed, False)[np.cumsum(first) - 1]
    start, stop = at.copy(), end.copy()
    stop[heads[mixed]] = end[tails[mixed]]
    keep = solid & (~whole | first)
    if shape == "bare":
        return start[keep], stop[keep]
    gaps = np.flatnonzero(what == _GAP)
    more = goes_on[gaps]
    led = more & (b[end[gaps] - 1] == 32)
    start[gaps[led] + 1] -= 1
    runs, own = gaps[~more | (end[gaps] - at[gaps] > 1)], gaps[more & ~led]
    starts = np.concatenate((start[keep], at[runs], end[own] - 1))
    stops = np.concatenate((stop[keep], end[runs] - goes_on[runs], end[own]))
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order]


def distinct_pieces(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct pieces, each piece's number among them). Short ones meet by a hash, and each is held against one of its
    hash in all its bytes; those that differ meet again by another hash. Long ones are looked up one by one."""
    size = stops - starts
    padded = data + bytes(SHORT + 8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    keys = [eight[starts + 8 * k] & _LOW_BYTES[np.clip(size - 8 * k, 0, 8)] for k in range(SHORT // 8)]
    h = size.astype(np.uint64)
    for k in keys:
        h = (h ^ k) * _MIX
        h ^= h >> np.uint64(29)
    number, out = np.empty(len(size), np.int64), []
    open_ = np.flatnonzero(size <= SHORT)
    bits = max(8, len(open_).bit_length())
    owner = np.zeros(1 << bits, np.int64)
    while len(open_):
        h = h * _MIX
        slot = (h if len(open_) == len(h) else h[open_]) >> np.uint64(64 - bits)
        owner[slot] = open_  # the last one stays
        head = owner[slot]
        same = size[open_] == size[head]
        for k in keys:
            same &= k[open_] == k[head]
        heads = open_[head == open_]
        owner[slot[head == open_]] = np.arange(len(out), len(out) + len(heads))
        number[open_[same]] = owner[slot[same]]
        out += [data[a:b] for a, b in zip(starts[heads].tolist(), stops[heads].tolist(), strict=True)]
        open_ = open_[~same]
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(size > SHORT).tolist():
        piece = data[starts[i] : stops[i]]
        if piece not in known:
            known[piece] = len(out)
            out.append(piece)
        number[i] = known[piece]
    return out, number


class Encoder:
    """Ids of whole texts as the `tokenizers` library gives them without added special tokens."""

    def __init__(self, path: str, huge_chars: int = HUGE_CHARS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, memo: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.shape = _shape(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.huge, self.chunk, self.overlap, self.memo = huge_chars, chunk_chars, overlap_chars, memo
        # the ids of the pieces met lately, and of those met before them
        self.fresh: dict[bytes, bytes] = {}
        self.stale: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end ("bare") or begin a word
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith("</w>") if self.shape == "bare" else token.startswith(_BYTE_LETTERS[32])

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids of some texts in a row, where each text's ids end), for all texts in order. Texts
        are taken together as far as their boundaries are known; those of more than `huge_chars` characters are encoded by
        themselves in overlapping chunks, and whole if the tokenizer is of no known shape."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < CUT_CHARS and not self._alone(texts[stop]):
                size += len(texts[stop])
                stop += 1
            if stop > at:
                yield at, *self._together(texts[at:stop])
                at = stop
            else:
                ids = self._by_itself(texts[at])
                yield at, ids, np.array([len(ids)])
                at += 1

    def _alone(self, text: str) -> bool:
        """Not with others: what cut_texts has no rule for. White space before an added token ends a segment, and stays one
        piece, so texts that hold one are cut by PIECES."""
        if not self.shape or len(text) > min(self.huge, CUT_CHARS):
            return True
        return self.shape == "spaced" and (any(t in text for t in self.added) or _ODD_SPACE.search(text.encode("utf-8", "replace")) is not None)

    def _by_itself(self, text: str) -> np.ndarray:
        if not self.shape or len(text) > self.huge:
            return np.array(self._long(text), "<u4")
        if self.shape == "spaced":
            return np.frombuffer(b"".join(self._values([p.encode("utf-8", "replace") for p in PIECES["spaced"].findall(text)])), "<u4")
        return np.concatenate([self._together([part])[0] for part in _slices(text)])

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one's end)."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = b"\xff".join(raw) + b"\xff"
        if self.shape == "bare" and b"<" not in data:  # it lowers case itself, but only after its special tokens are found
            data = data.lower()
        starts, stops = cut_texts(data, self.shape)
        pieces, number = distinct_pieces(data, starts, stops)
        values = self._values(pieces)
        flat, size = np.frombuffer(b"".join(values), "<u4"), np.array([len(v) // 4 for v in values], np.int64)
        first, n = (np.cumsum(size) - size)[number], size[number]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first - ends + n, n) + np.arange(n.sum())]
        before = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
        return ids, np.append(0, ends)[before]

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(ids.tobytes() for _, ids, _ in self.encoded([text]))

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for at, _, ends in self.encoded(texts):
            out[at : at + len(ends)] = np.diff(ends, prepend=0)
        return out

    def _values(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, learnt if new. Half of MEMO is kept when the other half is forgotten."""
        fresh, stale, new = self.fresh, self.stale, {}
        for p in pieces:
            if p not in fresh:
                if (known := stale.get(p)) is None:
                    new[p] = p.decode("utf-8", "replace")
                else:
                    fresh[p] = known
        self._learn(new)
        out = list(map(fresh.__getitem__, pieces))
        if len(fresh) > (self.memo or MEMO) // 2:
            self.fresh, self.stale = {}, fresh
        return out

    def _learn(self, new: dict[bytes, str]) -> None:
        """Words of letters are encoded many in one text, whose tokens say where words end or begin."""
        lead = " " if self.shape == "spaced" else ""
        words = [p for p, w in new.items() if w.startswith(lead) and _LETTERS.fullmatch(w)]
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        texts = [("" if lead else " ").join(map(new.__getitem__, g)) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            marks = np.flatnonzero(self.marks[ids])
            cuts = [*(4 * marks).tolist(), 4 * len(ids)] if lead else [0, *(4 * marks + 4).tolist()]
            if len(cuts) == len(g) + 1:
                blob = ids.tobytes()
                for p, a, b in zip(g, cuts, cuts[1:], strict=False):
                    self.fresh[p] = blob[a:b]
        rest = [p for p in new if p not in self.fresh]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([new[p] for p in rest], add_special_tokens=False), strict=True):
            self.fresh[p] = array("I", e.ids).tobytes()

    def _long(self, text: str) -> list[int]:
        if self.shape:
            return resynchronised(text, self.offsets, self.chunk, self.overlap)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets


def _slices(text: str) -> Iterator[str]:
    """A long text in parts of about CUT_CHARS characters that end at proven boundaries."""
    at = 0
    while len(text) - at > CUT_CHARS and (m := _STABLE.search(text, at + CUT_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def stable_boundaries(text: str, start: int, end: int) -> set[int]:
    """Positions in (start, end) where encoding starts afresh: a space or line end after no white space."""
    return {m.start() for m in _STABLE.finditer(text, start + 1, end)}


def resynchronised(text: str, encode: Callable, chunk_chars: int, overlap_chars: int) -> list[int]:
    """The ids of `text` out of overlapping chunks.

    `encode` gives ids and character offsets. A chunk and the next share an overlap; they are spliced at the first
    position there that is a stable boundary of the text and where both encodings end and start a token. If there
    is none, the overlap grows to twice its width towards both sides until one is found or the next chunk reaches the
    end of the text; so a text without white space is encoded whole in the end.
    """
    out: list[int] = []
    start, end, n = 0, min(chunk_chars, len(text)), len(text)
    while True:
        ids, offsets = encode(text[start:end])
        width = overlap_chars
        while end < n:
            new_start, new_end = max(start, end - width), min(n, end - width + max(chunk_chars, 2 * width))
            new_ids, new_offsets = encode(text[new_start:new_end])
            common = stable_boundaries(text, new_start, end)
            here, there = (_starts(o, shift, new_start, end) for o, shift in ((offsets, start), (new_offsets, new_start)))
            at = min((b for b in common if b in here and b in there), default=None)
            if at is not None:
                out += ids[: here[at]]
                skip = there[at]
                ids, offsets = new_ids[skip:], new_offsets[skip:]
                offsets = [(a + new_start - at, b + new_start - at) for a, b in offsets]
                start, end, width = at, new_end, overlap_chars
            elif new_start == start:  # the overlap is the whole chunk: widen to the right by a longer chunk
                ids, offsets, end, width = new_ids, new_offsets, new_end, 2 * width
            else:
                width *= 2
        return out + ids


def _starts(offsets: list[tuple[int, int]], shift: int, low: int, high: int) -> dict[int, int]:
    """Positions from `low` to `high` where the text before a token is complete, each with the number of the first token that
    starts at or after it. Characters that a tokenizer drops (white space) belong to the token after them."""
    out: dict[int, int] = {}
    k = bisect_left(offsets, (low - shift,))
    last = offsets[k - 1][1] if k else 0
    while k < len(offsets) and last + shift <= high:
        a, b = offsets[k]
        for p in range(last, a + 1) if a >= last else ():
            out.setdefault(p + shift, k)
        last = max(last, b)
        k += 1
    return out


_encoders: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    """One for each worker process and parameters."""
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def forget() -> None:
    """Drop the encoders of this worker, with what they remember."""
    _encoders.clear()


def count_tokens(docs: DataFrame, path: str, limit: int = 512, huge_chars: int = HUGE_CHARS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row; `path` is a tokenizers .json file that every
    executor has. One pass without a shuffle. A null text is empty and has 0 bytes and tokens; a null doc_id stays."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = encoder(path, huge_chars, chunk_chars, overlap_chars).counts
        for rows in batches:
            rows["n_tokens"] = counts([t or "" for t in rows.pop("text")])
            rows["over_limit"] = rows.n_tokens > limit
            yield rows
        give_back()

    picked = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n_bytes"), "text")
    return picked.mapInPandas(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
