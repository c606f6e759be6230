"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its potentials are linear in its own figures (shares
of letter cases, digits, marks and blanks, repetition, length) and in those of
the lines before and after it, and neighbouring states have a weight of their
own.  Forward-backward gives each line's chance to be good; their mean by
length, calibrated, is the document's score.

The field is fitted on a bounded sample of labelled documents, whose lines all
carry the document's label.  Null or empty text has no lines and gets the
labelled share of good documents; without labels every score is 0.5.  Repeated
rows and extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gathered, held_out, sample_texts, text_bytes, tidied

_KIND = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _k = 0 if "a" <= _c <= "z" or _b >= 0x80 else 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() and _b < 0x80 else 3 if _c in " \t\n\r\x0b\x0c" else 4 if _c in ".,;:?'\"-()" else 5 if _c == "!" else 6
    _KIND[_b, _k] = 1
WIDTH = 14


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: their figures (one row each), their lengths in bytes and the first line of each text."""
    words = Words(texts)
    data, base = text_bytes(texts)
    if not len(words.hash):
        return np.zeros((0, WIDTH)), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
    begins = np.zeros(len(data) + 1, bool)
    begins[np.flatnonzero(data == 0x0A) + 1] = True
    begins[base] = True
    start = np.flatnonzero(begins[:-1])
    line = np.searchsorted(start, words.start, "right") - 1
    own, first = np.unique(line, return_index=True)
    end = np.append(start[1:], len(data))
    size = (end - start)[own].astype(float)
    counts = np.stack([np.add.reduceat(_KIND[data, k], start)[own] for k in range(7)], 1)
    n = np.diff(np.append(first, len(line))).astype(float)
    h = words.hash
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.add.reduceat(new[np.argsort(order)].astype(float), first)
    whole = np.add.reduceat(h * (np.arange(len(h)) - np.repeat(first, n.astype(int)) + 1).astype(np.uint64), first)
    text = np.searchsorted(base, start[own], "right") - 1
    order = np.lexsort((whole, text))
    again = np.zeros(len(own), bool)
    again[1:] = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated = np.zeros(len(own))
    repeated[order] = again
    last = data[words.ends()[np.append(first[1:], len(line)) - 1] - 1]
    figures = np.column_stack([counts[:, :3] / size[:, None], counts[:, 4:] / size[:, None], np.add.reduceat(same, first) / n, distinct / n, repeated, np.log1p(n), np.log1p(size / n), np.isin(last, [0x2E, 0x21, 0x3F]), np.ones(len(own)), counts[:, 6] / n])
    return figures, size, np.searchsorted(text, np.arange(len(texts) + 1))


def with_neighbours(figures: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's figures, those before and those after it in its text (0 beyond its ends)."""
    before, after = np.zeros_like(figures), np.zeros_like(figures)
    if len(figures):
        before[1:], after[:-1] = figures[:-1], figures[1:]
        inner = first[(first > 0) & (first < len(figures))]
        before[inner], after[inner - 1] = 0, 0
    return np.hstack([figures, before, after])


def chains(score: np.ndarray, turn: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of all texts at once, longest first.

    score: potential of *good* over *bad* by line; turn: 2x2 weights from a
    line's state to the next one's.  Returns each line's chance to be good, the
    expected 2x2 uses of turn, and each text's log partition.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], first[:-1][order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t lines
    forward = np.zeros((len(score), 2))
    for t in range(steps):
        at = start[: alive[t]] + t
        own = np.column_stack([np.zeros(len(at)), score[at]])
        if t:
            own += np.logaddexp(forward[at - 1, :1] + turn[0], forward[at - 1, 1:] + turn[1])
        forward[at] = own
    partition = np.zeros(len(first) - 1)
    full = size > 0
    ends = forward[start[full] + size[full] - 1]
    partition[order[full]] = np.logaddexp(ends[:, 0], ends[:, 1])
    backward = np.zeros((len(score), 2))
    uses = np.zeros((2, 2))
    line_partition = np.repeat(partition, np.diff(first))
    for t in range(steps - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        after = np.column_stack([np.zeros(len(at)), score[at + 1]]) + backward[at + 1]
        for a in (0, 1):
            backward[at, a] = np.logaddexp(turn[a, 0] + after[:, 0], turn[a, 1] + after[:, 1])
            for b in (0, 1):
                uses[a, b] += np.exp(forward[at, a] + turn[a, b] + after[:, b] - line_partition[at]).sum()
    return np.exp(forward[:, 1] + backward[:, 1] - line_partition), uses, partition


class Field:
    """A fitted field with its calibration."""

    def __init__(self) -> None:
        self.weights, self.turn, self.mean, self.spread = np.zeros(3 * WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH)
        self.slope, self.shift, self.prior = 1.0, 0.0, 0.5

    def _inputs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        figures, size, first = lines_of(texts)
        scaled = (figures - self.mean) / self.spread
        scaled[:, 12] = 1
        return with_neighbours(scaled, first), size, first

    def fit(self, texts: pa.Array, good: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> "Field":
        figures, size, first = lines_of(texts)
        self.prior = float(good.mean()) if len(good) else 0.5
        if not len(figures) or good.min() == good.max():
            return self
        self.mean, self.spread = figures.mean(0), figures.std(0) + 1e-6
        inputs, size, first = self._inputs(texts)
        state = np.repeat(good, np.diff(first)).astype(float)
        pairs = np.zeros((2, 2))
        stays = np.maximum(np.diff(first) - 1, 0)
        pairs[1, 1], pairs[0, 0] = stays[good == 1].sum(), stays[good == 0].sum()
        # Adam on the mean log likelihood of the labelled chains.
        vector = np.zeros(3 * WIDTH + 4)
        m, v = np.zeros_like(vector), np.zeros_like(vector)
        for t in range(1, rounds + 1):
            w, turn = vector[:-4], vector[-4:].reshape(2, 2)
            chance, uses, _ = chains(inputs @ w, turn, first)
            slope = np.append(inputs.T @ (state - chance), (pairs - uses).ravel()) / len(first) - ridge * vector
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            vector = vector + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.weights, self.turn = vector[:-4], vector[-4:].reshape(2, 2)
        x = self.raw(texts)
        known = ~np.isnan(x)
        self.slope, self.shift = _logistic(x[known], good[known].astype(float))
        return self

    def line_chances(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's chance to be good, its length, and the first line of each text."""
        inputs, size, first = self._inputs(texts)
        return chains(inputs @ self.weights, self.turn, first)[0], size, first

    def raw(self, texts: pa.Array) -> np.ndarray:
        """The log odds of each text's mean chance by length; NaN without lines."""
        chance, size, first = self.line_chances(texts)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = np.bincount(owner, size, len(first) - 1)
        mean = np.divide(np.bincount(owner, size * chance, len(first) - 1), whole, out=np.full(len(whole), np.nan), where=whole > 0)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = self.raw(texts)
        return np.where(np.isnan(x), self.prior, 1 / (1 + np.exp(-(self.slope * np.nan_to_num(x) + self.shift))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small ridge."""
    beta = np.array([0.5, 0.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * beta), -2, 2)
    return float(max(beta[0], 1e-3)), float(beta[1])


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000, max_bytes: int = 64_000_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row of docs.

    Learned from the texts of at most ``max_rows`` ids of ``labels`` (doc_id,
    quality: 0, 1 or null), those of the smallest hashes, and of these from at
    most ``max_bytes`` of text; the ids are chosen before any text is read.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marks.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(max_rows)
    rows = sample_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text", "_h"), max_rows, max_bytes)  # max_rows ids
    field = Field()
    if rows.num_rows:
        field.fit(rows.column("text"), (rows.column("quality").to_numpy() == 1).astype(int))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for table in gathered(batches):
            score = shared.value.scores(table.column("text"))
            yield from pa.table({"doc_id": table.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}).to_batches()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidied(run), "doc_id bigint, score double, predicted int")


def classify_held_out(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, **options) -> DataFrame:
    """classify() of all documents, learned from labelled ones that aren't held out, with held_out."""
    got = classify(docs, labels.filter(~held_out("doc_id", mod, rest)), **options)
    return got.withColumn("held_out", held_out("doc_id", mod, rest)).select("doc_id", "held_out", "score", "predicted")
