"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.memory import give_back
from shelfwise.llm.sampling import crc, labelled_sample

#: Labelled documents that the field is fitted on, at most.
MAX_LABELLED = 3_000
#: Lines of all these documents together, at most; beyond it there are fewer documents, each with all of its lines.
FIT_LINES = 400_000
THRESHOLD = 0.3
STEPS = 150
#: Characters of text that are scored together, about, and lines whose features are made at once.
CHARS_AT_ONCE, LINES_AT_ONCE = 1 << 20, 20_000

#: What a line's measures are held against; each bound gives one feature.
BOUNDS = {
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.12, 0.25),
    "capitals": (0.04, 0.1, 0.3, 0.6, 0.9),
    "punctuation": (0.005, 0.02, 0.04, 0.08, 0.15),
    "digits": (0.01, 0.05, 0.2),
    "repeats": (0.05, 0.15, 0.3, 0.5, 0.7, 0.9),
    "word_length": (3.0, 4.5, 6.0, 8.0, 11.0),
    "n_words": (1.0, 2.0, 4.0, 8.0, 16.0, 64.0),
    "breaks": (0.02, 0.1, 0.3),
    "again": (0.5,),
}
N_OWN = sum(map(len, BOUNDS.values()))
#: The features of a line, of the lines before and after it, whether there are such, and a constant.
N_FEATURES = 3 * N_OWN + 3

_KIND = np.full(256, 0, np.uint8)  # 0: letter, also each byte of a character outside ASCII
_KIND[[*b" \t\r\x0b\x0c\n"]] = 1
_KIND[[*b".,;:'\"!?()-"]] = 2
_KIND[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 3
_KIND[[*b"0123456789"]] = 4
_KIND[ord("A") : ord("Z") + 1] = 5


def line_measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(length in bytes with its end, measures in the order of BOUNDS) of each line."""
    lines = text.split("\n")
    data = text.encode("utf-8", "replace") + b"\n"
    b = np.frombuffer(data, np.uint8)
    kinds = _KIND[b]
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = ends - starts + 1
    per = [np.add.reduceat(kinds == k, starts, dtype=np.int32) for k in range(6)]
    solid = np.maximum(1, length - per[1])
    letters = np.maximum(1, per[0] + per[5])
    seen: set[str] = set()
    rest = np.empty((len(lines), 5))
    for i, line in enumerate(lines):
        ws = line.split()
        n = len(ws)
        rest[i] = (1 - len(set(ws)) / n if n else 0, len(line) / n - 1 if n else 0, n, line.count(" | ") / n if n else 0, line in seen and n > 0)
        seen.add(line)
    own = np.stack([per[3] / solid, per[5] / letters, per[2] / solid, per[4] / solid, *rest.T])
    return length.astype(float), own.T


def _flags(own: np.ndarray) -> np.ndarray:
    return np.concatenate([own[:, [j]] > np.array(bounds) for j, bounds in enumerate(BOUNDS.values())], axis=1).astype(np.float32)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(length, features) of each line; features are 0 or 1."""
    length, own = line_measures(text)
    flags = _flags(own)
    x = np.zeros((len(flags), N_FEATURES), np.float32)
    x[:, :N_OWN] = flags
    x[1:, N_OWN : 2 * N_OWN] = flags[:-1]
    x[:-1, 2 * N_OWN : 3 * N_OWN] = flags[1:]
    x[0, -3] = x[-1, -2] = x[:, -1] = 1
    return length, x


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), n.max(), *parts[0].shape[1:]), parts[0].dtype)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out, n


def _whole_documents(texts: list[str], most: int) -> np.ndarray:
    """Places of the documents to fit on: all, or so many of a random order as hold `most` lines, one at least."""
    order = np.random.default_rng(1).permutation(len(texts))
    held = np.cumsum([texts[i].count("\n") + 1 for i in order])
    return np.sort(order[: max(1, np.searchsorted(held, most, "right"))])


def marginals(emit: np.ndarray, n: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward over chains of two states, all chains at once: P(bad) of each line, and the expected
    number of each transition over all chains. `emit`: (chains, lines, 2) log potentials; `n`: lines of each chain."""
    chains, lines, _ = emit.shape
    alpha, beta = np.empty((lines, chains, 2)), np.zeros((lines, chains, 2))
    log_sum = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    alpha[0] = emit[:, 0]
    for t in range(1, lines):
        alpha[t] = emit[:, t] + np.stack([log_sum(alpha[t - 1] + move[:, s]) for s in (0, 1)], -1)
    for t in range(lines - 2, -1, -1):
        after = emit[:, t + 1] + beta[t + 1]
        value = np.stack([log_sum(after + move[s]) for s in (0, 1)], -1)
        beta[t] = np.where((t + 1 < n)[:, None], value, 0.0)
    z = log_sum(alpha[n - 1, np.arange(chains)])
    bad = np.exp(alpha[..., 1] + beta[..., 1] - z).T
    pairs = np.zeros((2, 2))
    for t in range(1, lines):
        live = t < n
        joint = alpha[t - 1][:, :, None] + move + (emit[:, t] + beta[t])[:, None, :] - z[:, None, None]
        pairs += np.exp(joint[live]).sum(0)
    return bad, pairs


class Field:
    """Weights of the features for the state "bad", of the transitions, and of the step from a document's share of bad
    text to its probability of quality."""

    def __init__(self, examples: pd.DataFrame):
        """Lines carry their document's label to begin with. After a first fit, lines of bad documents that the field
        thinks good are labelled anew, and the fit goes on."""
        self.w, self.move = np.zeros(N_FEATURES), np.zeros((2, 2))
        self.slope, self.offset = 0.0, 0.0
        good = examples["label"].to_numpy()
        if not len(good):
            return
        if good.min() == good.max():
            self.offset = 4.0 if good[0] else -4.0
            return
        texts = examples["text"].tolist()
        some = _whole_documents(texts, FIT_LINES)
        if good[some].min() < good[some].max():
            texts, good = [texts[i] for i in some], good[some]
        parts = [line_features(t) for t in texts]
        n = np.array([len(x) for _, x in parts])
        order = np.argsort(n, kind="stable")  # documents of like numbers of lines stand together
        parts, good, n = [parts[i] for i in order], good[order], n[order]
        x, chars = np.concatenate([x for _, x in parts]), np.concatenate([c for c, _ in parts])
        bad = np.repeat(1.0 - good, n)
        for turn in range(2):
            self._fit(x, n, bad, np.sqrt(chars / chars.mean()))
            if turn == 0:
                seen, _ = self._marginals(x, n)
                share = np.repeat(np.add.reduceat(seen, np.cumsum(n) - n) / n, n)
                # a bad document keeps at least its worse lines as bad
                bad = np.where(np.repeat(good, n) == 1, 0.0, (seen >= np.minimum(0.5, share)).astype(float))
        self._calibrate(self.bad_shares([(c, self._emit(x)[:, 1]) for c, x in parts]), good)

    def _emit(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.w.astype(np.float32)
        return np.stack([np.zeros_like(score), score], -1).astype(float)

    def _marginals(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of each line and the expected transitions, over documents of `n` lines in ascending order whose lines `x`
        follow each other; those of up to 4 times as many lines as the first are one batch."""
        emit, ends = self._emit(x), np.cumsum(n)
        out, pairs = np.zeros(len(x)), np.zeros((2, 2))
        at = 0
        while at < len(n):
            stop = np.searchsorted(n, 4 * n[at], "right")
            live = np.arange(n[stop - 1]) < n[at:stop, None]
            padded = np.zeros((*live.shape, 2))
            lines = slice(ends[at] - n[at], ends[stop - 1])
            padded[live] = emit[lines]
            bad, moves = marginals(padded, n[at:stop], self.move)
            out[lines] = bad[live]
            pairs += moves
            at = stop
        return out, pairs

    def _fit(self, x, n, bad, weight) -> None:
        """Adam on the log likelihood of the labels, with a small quadratic penalty. The lines' part of the gradient is
        weighted by the root of their lengths, so that short lines do not outvote long ones."""
        total = len(x)
        inside = np.ones(total, bool)
        inside[np.cumsum(n) - n] = False  # a document's first line follows none
        a, b = bad[:-1][inside[1:]], bad[1:][inside[1:]]
        want = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
        theta = np.concatenate((self.w, self.move.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.w, self.move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
            p, pairs = self._marginals(x, n)
            g = np.concatenate(((((bad - p) * weight).astype(np.float32) @ x) / total, ((want - pairs) / total).ravel())) - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)

    def line_scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(length, log odds of being bad by its features alone) of each line. A line's own flags are weighed three times, for
        itself and its neighbours, LINES_AT_ONCE lines at a time, so a text of very many lines needs little memory."""
        length, own = line_measures(text)
        w = self.w[: 3 * N_OWN].reshape(3, N_OWN).T.astype(np.float32)
        parts = [_flags(own[k : k + LINES_AT_ONCE]) @ w for k in range(0, len(own), LINES_AT_ONCE)]
        here, before, after = np.concatenate(parts).T.astype(float)
        score = here + self.w[-1]
        score[1:] += before[:-1]
        score[:-1] += after[1:]
        score[0] += self.w[-3]
        score[-1] += self.w[-2]
        return length, score

    def bad_share(self, text: str) -> float:
        """The marginals of being bad, weighted by the lines' lengths."""
        return float(self.bad_shares([self.line_scores(text)])[0])

    def bad_shares(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of many documents' line_scores, those of like numbers of lines at once."""
        out = np.zeros(len(parts))
        order = np.argsort([len(f) for _, f in parts], kind="stable")
        at = 0
        while at < len(order):
            few = len(parts[order[at]][1])
            stop = at
            while stop < len(order) and len(parts[order[stop]][1]) <= few + few // 4 and (stop - at) * few < 20_000:
                stop += 1
            some = order[at:stop]
            odds, n = _padded([parts[i][1] for i in some])
            p = bad_marginals(odds, n, self.move)
            for k, i in enumerate(some):
                length = parts[i][0]
                out[i] = (p[k, : n[k]] * length).sum() / length.sum()
            at = stop
        return out

    def _calibrate(self, share: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression of the label on the log odds of the share, by Newton's steps."""
        z = self._odds(share)
        x = np.stack([z, np.ones_like(z)], 1)
        t = np.where(good == 1, (good.sum() + 1) / (good.sum() + 2), 1 / ((1 - good).sum() + 2))
        theta = np.array([-1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            theta = theta + np.clip(np.linalg.solve(h, x.T @ (t - p) - 1e-3 * theta), -2, 2)
        self.slope, self.offset = min(theta[0], 0.0), theta[1]

    @staticmethod
    def _odds(share):
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share))

    def quality(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self._odds(share) + self.offset)))


def bad_marginals(e: np.ndarray, n: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(bad) of each line, in terms of log odds `e` (chains, lines): with two states a message is one number, so the pass
    costs a few operations for each line."""
    chains, lines = e.shape
    (a, b), (c, d) = move

    def passed(m, a, b, c, d):
        return np.logaddexp(b, m + d) - np.logaddexp(a, m + c)

    fore, back = np.empty((lines, chains)), np.zeros((lines, chains))
    fore[0] = e[:, 0]
    for t in range(1, lines):
        fore[t] = e[:, t] + passed(fore[t - 1], a, b, c, d)
    for t in range(lines - 2, -1, -1):
        back[t] = np.where(t + 1 < n, passed(e[:, t + 1] + back[t + 1], a, c, b, d), 0.0)
    return (1 / (1 + np.exp(-np.clip(fore + back, -500, 500)))).T


SCORES = "doc_id bigint, held_out boolean, score double, predicted int"


def learnable(doc_id):
    return crc(doc_id) % 5 != 0


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of `docs`: the probability that the text is good.

    Every line of the whole text counts. A null text is empty: one line without words; a null id is not held out; rows of
    equal text score alike, and repeated rows stay. Of an id with several texts the one that sorts first is learnt from;
    ids with null or contradicting labels are not. Other columns are left out. Without usable labels all scores are 0.5. One pass without a shuffle; the weights are a few hundred numbers.
    """
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(Field(labelled_sample(docs, labels, "quality", learnable(F.col("doc_id")), max_labelled)))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chars = np.cumsum([len(t or "") for t in batch.text])
            for some in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(chars // CHARS_AT_ONCE)) + 1):
                rows = batch.iloc[some].copy()
                share = field.value.bad_shares([field.value.line_scores(t or "") for t in rows.pop("text")])
                rows["score"] = field.value.quality(share)
                rows["predicted"] = (rows["score"] >= threshold).astype("int32")
                yield rows
        give_back()

    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInPandas(scored, SCORES)
