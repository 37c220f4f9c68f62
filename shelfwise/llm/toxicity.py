"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.memory import give_back, slices
from shelfwise.llm.sampling import crc, labelled_sample

#: Labelled documents that the index is made of, at most.
MAX_LABELLED = 4_000
NEIGHBOURS = 25
BLOCK = 16
#: Share of the entries from which a term is a common one.
COMMON = 0.05
#: Texts that meet the common terms at once; texts and words that a worker remembers.
TOGETHER, MEMO = 64, 10_000
THRESHOLD = 0.7
#: Share of a vector's squared length that its telling terms take; all its words take the rest.
TELLING = 0.8
#: Weight among the telling terms of one that every text has, so that texts without any are like each other.
OTHER = 2.0
_WORD = re.compile(r"\w+")


#: Lengths of the beginnings of words that are terms too; the shortest comes first.
STEMS = (4, 5, 7)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(word: str) -> list[str]:
    """A word itself, and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def telling_terms(texts: list[str], labels: list[int]) -> list[str]:
    """Terms whose documents differ in their labels beyond chance: by the G-test, at odds under one in twenty for the
    whole vocabulary. They get more weight; no word is left out for not being one."""
    df: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    n = [0, 0]
    for text, label in zip(texts, labels, strict=True):
        n[label] += 1
        for t in {t for w in set(words(text)) for t in terms(w)}:
            df[t][label] += 1
    if not min(n):
        return []
    share = [x / sum(n) for x in n]
    limit = 2 * math.log(20 * max(1, len(df)))

    def g(a: int, b: int) -> float:
        return 2 * sum(x * math.log(x / ((a + b) * s)) for x, s in ((a, share[0]), (b, share[1])) if x)

    return sorted(w for w, (a, b) in df.items() if a + b >= 5 and g(a, b) > limit)


def _ranges(starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of all positions in ranges, each with its range's value."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(values, n)


class Index:
    """Labelled vectors, equal ones as one entry, in blocks; for each term the entries that hold it and, for each block,
    its greatest weight there.

    A vector has two parts, each of TF-IDF weights: the telling terms, and all words. Terms are numbered so: telling
    terms, words, and last the one that every text has (OTHER, in the first part). Terms that many entries hold also have
    a row with a weight for every entry; what they add is then known for all entries before blocks are chosen."""

    def __init__(self, examples: pd.DataFrame, neighbours: int = NEIGHBOURS, block: int = BLOCK, common: float = COMMON):
        self.neighbours, self.block, self.n_examples = neighbours, block, len(examples)
        texts, labels = examples["text"].tolist(), examples["label"].tolist()
        self.terms = {w: i for i, w in enumerate(telling_terms(texts, labels))}
        self.starts = {t[: STEMS[0]] for t in self.terms}
        self.told: dict[str, tuple[int, ...]] = {}
        self.n_telling = len(self.terms)
        self.words = {w: i for i, w in enumerate(sorted({w for t in texts for w in words(t)}), self.n_telling)}
        self.other = self.n_telling + len(self.words)
        counts = [self.counts(t) for t in texts]
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *(c[0] for c in counts)]), minlength=self.other)
        self.idf = np.log((1 + len(texts)) / (1 + df)) + 1
        # telling terms weigh more the more toxic examples hold them for each clean one
        toxic = np.bincount(np.concatenate([np.zeros(0, np.int64), *(c[0] for c, y in zip(counts, labels, strict=True) if y)]), minlength=self.other)
        k = slice(0, self.n_telling)
        self.idf[k] *= np.log2(2 + toxic[k] / np.maximum(1, df[k] - toxic[k]))
        entries: dict[tuple, list[int]] = defaultdict(list)
        for row, (at, n, strange) in enumerate(counts):
            entries[(tuple(at.tolist()), tuple(n.tolist()), strange)].append(row)
        order = sorted(entries)  # entries that share terms stand together, telling ones first
        ids = examples["doc_id"].tolist()
        self.votes = np.array([[len(entries[c]), sum(labels[r] for r in entries[c])] for c in order], float).reshape(-1, 2)
        self.evidence = [[ids[r] for r in entries[c][:3]] for c in order]
        self.n_blocks = -(-len(order) // block)
        vectors = [self.vector(counts[entries[c][0]]) for c in order]
        at = np.concatenate([np.zeros(0, int), *(i for i, _ in vectors)])
        es = np.repeat(np.arange(len(order)), [len(i) for i, _ in vectors])
        xs = np.concatenate([np.zeros(0), *(x for _, x in vectors)])
        by = np.lexsort((es, at))
        at, self.es, self.xs = at[by], es[by].astype(np.int32), xs[by]
        # runs of one term in one block: where they start in the postings, their block and their peak
        code = at * max(1, self.n_blocks) + self.es // block
        self.runs = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)).astype(np.int32)
        self.run_block = self.es[self.runs[:-1]] // block
        self.peaks = np.maximum.reduceat(self.xs, self.runs[:-1]) if len(code) else np.zeros(0)
        self.runs_of = np.searchsorted(at[self.runs[:-1]], np.arange(self.other + 2))
        held = np.bincount(at, minlength=self.other + 1)
        self.common = np.flatnonzero((held > common * len(order)) | (np.arange(self.other + 1) == self.other))
        self.rows: np.ndarray | None = None  # made where the index is used
        self.cuts, self.levels = np.zeros(0), np.array([labels and sum(labels) / len(labels) or 0.0])
        self.memo: dict[bytes, tuple[float, list[int]]] = {}
        if len(order):
            self._calibrate([counts[entries[c][0]] for c in order])
        self.rows, self.told, self.memo = None, {}, {}

    @property
    def postings(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(entries, weights) of each term."""
        cuts = self.runs[self.runs_of]
        return {i: (self.es[a:b], self.xs[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b}

    def _common_rows(self) -> None:
        cuts = self.runs[self.runs_of]
        self.row_of = np.full(self.other + 1, -1)
        self.row_of[self.common] = np.arange(len(self.common))
        self.rows = np.zeros((len(self.common), self.n_blocks * self.block))
        for row, i in enumerate(self.common.tolist()):
            at = slice(cuts[i], cuts[i + 1])
            self.rows[row, self.es[at]] = self.xs[at]

    def telling(self, word: str) -> tuple[int, ...]:
        found = self.told.get(word)
        if found is None:
            if len(self.told) > MEMO:
                self.told.clear()
            found = self.told[word] = tuple(self.terms[t] for t in terms(word) if t in self.terms)
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """(terms, how often each occurs, strange): a text's telling terms and all its words, in order of the terms. Of words
        that no example has, only the sum of their squared weights matters, to the vector's length: strange."""
        many = Counter(words(text))
        known = list(map(self.words.get, many))
        told: dict[int, int] = {}
        cut = STEMS[0]
        for w in [w for w in many if w[:cut] in self.starts]:
            for i in self.telling(w):
                told[i] = told.get(i, 0) + many[w]
        here = np.array([-1 if i is None else i for i in known], np.int64)
        n = np.fromiter(many.values(), np.int64, len(many))
        unseen = math.log(1 + self.n_examples) + 1  # the IDF of a word that no example has
        strange = float((((1 + np.log(n[here < 0])) * unseen) ** 2).sum())
        at = np.concatenate((np.fromiter(told, np.int64, len(told)), here[here >= 0]))
        n = np.concatenate((np.fromiter(told.values(), np.int64, len(told)), n[here >= 0]))
        order = np.argsort(at)
        return at[order], n[order], strange

    def vector(self, counts: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of the vector: TELLING of its squared length are telling terms, the rest words. A text without
        words has the first part only."""
        at, n, strange = counts
        xs = (1 + np.log(n)) * self.idf[at]
        k = np.searchsorted(at, self.n_telling)
        said = math.sqrt((xs[:k] ** 2).sum() + OTHER**2)
        xs[:k] *= math.sqrt(TELLING) / said
        xs[k:] *= math.sqrt((1 - TELLING) / max(1e-300, (xs[k:] ** 2).sum() + strange))
        return np.append(at, self.other), np.append(xs, math.sqrt(TELLING) * OTHER / said)

    def common_parts(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosines of some vectors with all entries: a row for each vector."""
        if self.rows is None:
            self._common_rows()
        weights = np.zeros((len(vectors), len(self.common)))
        for k, (at, xs) in enumerate(vectors):
            row = self.row_of[at]
            some = row >= 0
            weights[k, row[some]] = xs[some]
        return weights @ self.rows

    def nearest(self, counts: tuple, apart: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As _nearest, of one text."""
        vector = self.vector(counts)
        return self._nearest(vector, self.common_parts([vector])[0], apart)

    def _nearest(self, vector: tuple, cosines: np.ndarray, apart: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the nearest examples, the nearest first: as many entries as hold `neighbours` examples,
        and all that tie with the last. A block's upper bound is the most that common terms give one of its entries, and
        the other terms' greatest weights there. Blocks are read in order of their bounds, the best first, then all whose
        bounds reach what is needed, so the result is exact. `apart`: an entry of which one example is left out."""
        at, xs = vector
        rare = self.row_of[at] < 0
        at, xs = at[rare], xs[rare]
        runs, weight = _ranges(self.runs_of[at], self.runs_of[at + 1], xs)
        blocks = self.run_block[runs]
        bound = np.bincount(blocks, weight * self.peaks[runs], self.n_blocks) + cosines.reshape(-1, self.block).max(1)
        order = np.argsort(-bound, kind="stable")
        have = self.votes[:, 0]
        if apart is not None:
            have = have.copy()
            have[apart] -= 1
        cosines, read = cosines[: len(have)], np.zeros(self.n_blocks, bool)
        need, step, done = -1.0, 8, 0
        while done < len(order) and bound[order[done]] >= need - 1e-9:
            some = np.zeros(self.n_blocks, bool)
            some[order[done : done + step]] = True
            if need >= 0:  # all that are left and may hold one
                some[order[done:]] = bound[order[done:]] >= need - 1e-9
                step = len(order)
            read |= some
            done += step
            inside = np.flatnonzero(some[blocks])
            r = runs[inside]
            spots, w = _ranges(self.runs[r], self.runs[r + 1], weight[inside])
            cosines += np.bincount(self.es[spots], w * self.xs[spots], len(have))
            es = np.flatnonzero(np.repeat(read, self.block)[: len(have)])
            best = -cosines[es]
            few = np.argpartition(best, self.neighbours)[: self.neighbours + 1] if len(es) > self.neighbours + 1 else np.arange(len(es))
            rank = es[few[np.argsort(best[few])]]  # entries hold an example each at least, but for the one left apart
            held = np.cumsum(have[rank])
            last = min(np.searchsorted(held, self.neighbours), len(rank) - 1)
            need = cosines[rank[last]] if held[-1] >= self.neighbours else -1.0
        es = es[(cosines[es] >= need - 1e-9) & (have[es] > 0)]
        rank = np.lexsort((es, -cosines[es]))
        return es[rank], cosines[es[rank]]

    def vote(self, counts: tuple, apart: int | None = None, label: int = 0) -> tuple[float, np.ndarray]:
        """The share of toxic examples among the nearest, each weighted by 1 / (0.05 + distance)."""
        return self._vote(*self.nearest(counts, apart), apart, label)

    def _vote(self, es: np.ndarray, cs: np.ndarray, apart: int | None = None, label: int = 0) -> tuple[float, np.ndarray]:
        n, toxic = self.votes[es, 0].copy(), self.votes[es, 1].copy()
        if apart is not None:
            n[es == apart] -= 1
            toxic[es == apart] -= label
        w = 1 / (0.05 + np.maximum(0, 1 - cs))
        total = (w * n).sum()
        return (float((w * toxic).sum() / total) if total else 0.0), es

    def _calibrate(self, order: list[tuple]) -> None:
        """Isotonic levels of the votes, from each example's vote by all others."""
        pairs = []
        for low in range(0, len(order), TOGETHER):
            vectors = [self.vector(c) for c in order[low : low + TOGETHER]]
            for e, (vector, cosines) in enumerate(zip(vectors, self.common_parts(vectors), strict=True), low):
                n, toxic = self.votes[e]
                nearest = self._nearest(vector, cosines, e)
                for label, many in ((0, n - toxic), (1, toxic)):
                    if many:
                        pairs.append((self._vote(*nearest, e, label)[0], label * many, many))
        pairs.sort()
        pools: list[list[float]] = []  # highest vote, toxic, all
        for vote, toxic, many in pairs:
            pools.append([vote, toxic, many])
            while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
                _, toxic, many = pools.pop()
                pools[-1] = [vote, pools[-1][1] + toxic, pools[-1][2] + many]
        self.cuts = np.array([p[0] for p in pools])
        self.levels = np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])

    def score(self, text: str) -> tuple[float, list[int]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """(probability, ids of the nearest examples) of each text. Between the levels of the calibration it runs straight, and
        a hundredth of the vote itself is mixed in, so that the order of votes is kept inside a level."""
        if not len(self.votes):
            return [(0.0, [])] * len(texts)
        if len(self.memo) > MEMO:
            self.memo.clear()
        keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.memo}
        names = list(new)
        for low in range(0, len(names), TOGETHER):
            some = names[low : low + TOGETHER]
            vectors = [self.vector(self.counts(new[k])) for k in some]
            for k, vector, cosines in zip(some, vectors, self.common_parts(vectors), strict=True):
                vote, es = self._vote(*self._nearest(vector, cosines))
                level = float(np.interp(vote, self.cuts, self.levels))
                self.memo[k] = min(1.0, max(0.0, 0.99 * level + 0.01 * vote)), [i for e in es[:3].tolist() for i in self.evidence[e]][:3]
        return [self.memo[k] for k in keys]


SCORES = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<bigint>"


def learnable(doc_id):
    return crc(doc_id) % 3 != 1


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> Index:
    index = Index(labelled_sample(docs, labels, "toxic", learnable(F.col("doc_id")), max_labelled), **options)
    give_back()
    return index


def _packed(index: Index) -> bytes:
    """Small, as workers keep what is broadcast; each task unpacks it and drops it at its end."""
    return zstandard.compress(pickle.dumps(index, protocol=5), 3)


def _unpacked(data: bytes) -> Index:
    with zstandard.ZstdDecompressor().stream_reader(data) as stream:  # the unpacked bytes are never held whole
        return pickle.load(stream)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """SCORES rows, one for each row of `docs`: the probability that the text is toxic, whether it reaches `threshold`, and
    the ids of its nearest labelled examples. Whole texts count; ids only say what may be learnt from.

    The index of at most `max_labelled` examples goes to every task; scoring is one pass without a shuffle. A null text is
    empty and scored as such; a null id is not held out. Without labels all scores are 0.
    """
    packed = docs.sparkSession.sparkContext.broadcast(_packed(fitted(docs, labels, **options)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _unpacked(packed.value)
        for rows in slices(batches):
            found = index.scores([t or "" for t in rows.column("text").to_pylist()])
            score = np.array([s for s, _ in found])
            evidence = pa.array([e for _, e in found], pa.list_(pa.int64()))
            yield pa.record_batch([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= threshold).astype("int32")), evidence], names)
        del index
        give_back()

    names = [c.split()[0] for c in SCORES.split(", ")]

    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInArrow(scored, SCORES)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of `docs` whose score is under `threshold`, as they are, in one pass. A null or empty text is scored as one
    without words; rows without an id and repeated rows are judged by their text like all others; without labels all stay."""
    packed = docs.sparkSession.sparkContext.broadcast(_packed(fitted(docs, labels, **options)))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _unpacked(packed.value)
        for texts in batches:
            found = []
            for at in range(0, len(texts), TOGETHER):
                found += [s for s, _ in index.scores([t or "" for t in texts.slice(at, TOGETHER).to_pylist()])]
            yield pa.array(found, pa.float64())
        del index
        give_back()

    return docs.where(score("text") < threshold)
