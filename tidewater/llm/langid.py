"""Language identification by unigram pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary and every single byte; each language
has its own piece probabilities, learned by expectation maximisation from
labelled texts.  A forward pass over a word's bytes sums the probabilities of
all its segmentations; a text's likelihood is the product over its words (each
with a mark for its beginning), lower-cased in A-Z.  Words of up to ``LONGEST``
bytes are worked on together by length, longer ones one by one in steps that
keep as many positions as the longest piece has.

Null text, or one without a letter, is ``und`` with score 0; so is every text
if no labelled text is given.  Ties go to the label that sorts first.  Repeated
rows, very long texts and extra columns don't matter; an empty table gives an
empty result.  Learning reads at most ``max_rows`` labelled texts and
``max_bytes`` of them, those with the smallest hashes of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Index, Words, gathered, held_out, mix, sample_texts, tidied

LONGEST = 32
#: Positions of a longer word that are looked up at once.
_BLOCK = 1 << 15
UNKNOWN = "und"
_MARK = 0x20
_STEP = np.uint64(0x100000001B3)


def vocabulary(path: str) -> list[bytes]:
    """The vocabulary's pieces as bytes, a leading blank for a word's beginning, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            body = piece.removeprefix("▁")
            if "▁" not in body:
                raw = (bytes([_MARK]) if piece != body else b"") + body.encode()
                if raw:
                    found.add(raw)
    return sorted(found)


class Segmenter:
    """Finds all pieces inside words of one length."""

    def __init__(self, pieces: list[bytes]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        keys = np.zeros(len(pieces), np.uint64)
        for k, piece in enumerate(pieces):
            h = np.zeros(1, np.uint64)
            for b in piece:
                h = h * _STEP + np.uint64(b + 1)
            keys[k] = mix(h ^ np.uint64(len(piece) << 56))[0]
        self.index = Index(keys)

    def inside(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """words: rows of equal length.  By (from, to): each word's piece there, or ``size`` for none; only where some word has one."""
        n = words.shape[1]
        found = {}
        for a in range(n):
            h = np.zeros(len(words), np.uint64)
            for b in range(a + 1, min(n, a + self.longest) + 1):
                h = h * _STEP + (words[:, b - 1].astype(np.uint64) + np.uint64(1))
                at = self.index.find(mix(h ^ np.uint64((b - a) << 56)))
                if (at >= 0).any():
                    found[a, b] = np.where(at >= 0, at, self.size)
        return found

    def forward(self, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 of the sum over segmentations, for each word and language; p: a row of probabilities by piece and one of zeros."""
        n = words.shape[1]
        found = self.inside(words)
        alpha = np.zeros((n + 1, len(words), p.shape[1]))
        alpha[0] = 1
        for (a, b), at in sorted(found.items(), key=lambda x: x[0][1]):
            alpha[b] += alpha[a] * p[at]
        return np.log10(np.maximum(alpha[n], 1e-300))

    def expected(self, words: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words of these weights, by language."""
        n = words.shape[1]
        found = self.inside(words)
        alpha, beta = np.zeros((n + 1, len(words), p.shape[1])), np.zeros((n + 1, len(words), p.shape[1]))
        alpha[0] = beta[n] = 1
        for (a, b), at in sorted(found.items(), key=lambda x: x[0][1]):
            alpha[b] += alpha[a] * p[at]
        for (a, b), at in sorted(found.items(), key=lambda x: -x[0][0]):
            beta[a] += beta[b] * p[at]
        uses = np.zeros_like(p)
        scale = weight / np.maximum(alpha[n], 1e-300)
        for (a, b), at in found.items():
            np.add.at(uses, at, alpha[a] * p[at] * beta[b] * scale)
        uses[self.size] = 0
        return uses

    def _starting(self, word: np.ndarray) -> np.ndarray:
        """Each place's pieces that start there, a column for each length."""
        n = len(word)
        out = np.full((n, min(self.longest, n)), self.size, np.int32)
        h = np.zeros(n, np.uint64)
        wide = word.astype(np.uint64) + np.uint64(1)
        for k in range(1, out.shape[1] + 1):
            h = h[: n - k + 1] * _STEP + wide[k - 1 :]
            at = self.index.find(mix(h ^ np.uint64(k << 56)))
            out[: n - k + 1, k - 1] = np.where(at >= 0, at, self.size)
        return out

    def forward_long(self, word: np.ndarray, p: np.ndarray) -> np.ndarray:
        """forward() of one word of any length."""
        held, scale = _beginning(self.longest, p.shape[1])
        for a in range(0, len(word), _BLOCK):
            near = max(0, a - self.longest)
            ends = _ending(self._starting(word[near : a + _BLOCK]), self.size, self.longest)[a - near + 1 :]
            for at in ends:
                held, scale = _step(held, scale, p[at])
        return np.log10(np.maximum(held[0], 1e-300)) + scale

    def expected_long(self, word: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """expected() of one word of any length."""
        starting, n = self._starting(word), len(word)
        sides = []
        for table in (_ending(starting, self.size, self.longest)[1:], _reaching(starting, self.size, self.longest)[1:]):
            held, scale = _beginning(self.longest, p.shape[1])
            value, log = [held[0]], [scale]
            for at in table:
                held, scale = _step(held, scale, p[at])
                value.append(held[0])
                log.append(scale)
            sides.append((np.array(value), np.array(log)))
        (alpha, before), (beta, after) = sides
        beta, after = beta[::-1], after[::-1]
        whole = np.log10(np.maximum(alpha[n], 1e-300)) + before[n]
        uses = np.zeros_like(p)
        for k in range(1, starting.shape[1] + 1):
            at = starting[: n - k + 1, k - 1]
            np.add.at(uses, at, weight * alpha[: n - k + 1] * p[at] * beta[k:] * np.power(10.0, before[: n - k + 1] + after[k:] - whole))
        uses[self.size] = 0
        return uses


def _beginning(longest: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """The last positions' sums, nearest first, and the power of ten that they are to be multiplied with."""
    held = np.zeros((longest, labels))
    held[0] = 1
    return held, np.zeros(labels)


def _step(held: np.ndarray, scale: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = (held * chance).sum(0)
    held = np.vstack([new, held[:-1]])
    if new.max(initial=1.0) < 1e-60 or new.min(initial=1.0) < 1e-60:
        most = np.maximum(held.max(0), 1e-300)
        held, scale = held / most, scale + np.log10(most)
    return held, scale


def _ending(starting: np.ndarray, size: int, longest: int) -> np.ndarray:
    """From pieces by start, those that end at each place, by length."""
    out = np.full((len(starting) + 1, longest), size, np.int32)
    for k in range(1, starting.shape[1] + 1):
        out[k:, k - 1] = starting[: len(starting) - k + 1, k - 1]
    return out


def _reaching(starting: np.ndarray, size: int, longest: int) -> np.ndarray:
    """The same as seen from the word's end."""
    out = np.full((len(starting) + 1, longest), size, np.int32)
    out[1:, : starting.shape[1]] = starting[::-1]
    return out


def _by_length(words: Words, which: np.ndarray):
    """Groups of equal length of these words, marked at their beginning, as (indexes into which, rows); each word of over LONGEST bytes is a group of its own."""
    start, end = words.start[which], words.ends()[which]
    size = end - start
    for n in np.unique(size[size <= LONGEST]):
        own = np.flatnonzero(size == n)
        yield own, np.hstack([np.full((len(own), 1), _MARK, np.uint8), words.data[start[own][:, None] + np.arange(n)]])
    for k in np.flatnonzero(size > LONGEST):
        yield np.array([k]), np.append(np.uint8(_MARK), words.data[start[k] : end[k]])[None, :]


class Model:
    def __init__(self, labels: list[str], p: np.ndarray, prior: np.ndarray):
        self.labels, self.p, self.prior = labels, p, prior

    @staticmethod
    def learn(segmenter: Segmenter, texts: list[tuple[str, str]], rounds: int = 3, smooth: float = 0.05) -> "Model":
        labels = sorted({x for x, _ in texts})
        n = len(labels)
        held = Words(pa.array([t for _, t in texts]), lower=True)
        keys, first, back = np.unique(held.hash, return_index=True, return_inverse=True)
        place = {x: k for k, x in enumerate(labels)}
        lang = np.array([place[x] for x, _ in texts])[held.owner()]
        weight = np.zeros((len(keys), n))
        np.add.at(weight, (back, lang), 1)
        groups = list(_by_length(held, first))
        p = np.full((segmenter.size + 1, n), 1.0 / segmenter.size)
        p[-1] = 0
        for _ in range(rounds):
            uses = np.zeros_like(p)
            for own, rows in groups:
                if rows.shape[1] > LONGEST + 1:
                    uses += segmenter.expected_long(rows[0], weight[own[0]], p)
                    continue
                for at in range(0, len(own), 20_000):
                    uses += segmenter.expected(rows[at : at + 20_000], weight[own[at : at + 20_000]], p)
            uses[:-1] += smooth
            p = uses / uses.sum(0)
        return Model(labels, p, np.log10(np.bincount([place[x] for x, _ in texts], minlength=n) / len(texts)))

    def predict(self, segmenter: Segmenter, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest label's index, and its share of the likelihood, for each text."""
        held = Words(texts, lower=True)
        total = np.tile(self.prior, (len(texts), 1))
        if len(held.hash):
            _, first, back = np.unique(held.hash, return_index=True, return_inverse=True)
            log = np.zeros((len(first), len(self.labels)))
            for own, rows in _by_length(held, first):
                log[own] = segmenter.forward(rows, self.p) if rows.shape[1] <= LONGEST + 1 else segmenter.forward_long(rows[0], self.p)
            owner = held.owner()
            for k in range(len(self.labels)):
                total[:, k] += np.bincount(owner, log[back, k], len(texts))
        best = total.argmax(1)
        share = 1 / np.power(10.0, np.maximum(total - total.max(1, keepdims=True), -300)).sum(1)
        return best, share


_held: dict = {}


def predict(docs: DataFrame, labelled: DataFrame, path: str, max_rows: int = 4_000, max_bytes: int = 64_000_000, rounds: int = 3) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs; learned from labelled's text and non-null lang."""
    spark = docs.sparkSession
    rows = sample_texts(labelled.filter(F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h")), max_rows, max_bytes)
    pieces = vocabulary(path)
    model = Model.learn(Segmenter(pieces), list(zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True)), rounds) if rows.num_rows else None
    shared = spark.sparkContext.broadcast((pieces, model))  # the vocabulary by the labels

    def run(batches):
        pieces, model = shared.value
        if "segmenter" not in _held:
            _held["segmenter"] = Segmenter(pieces)
        for table in gathered(batches, limit=4_000_000):
            n = table.num_rows
            if model is None:
                names, share = [UNKNOWN] * n, np.zeros(n)
            else:
                best, share = model.predict(_held["segmenter"], table.column("text"))
                letter = table.column("letter").to_numpy()
                names = [model.labels[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)]
                share = np.where(letter, share, 0.0)
            yield from pa.table({"doc_id": table.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(share)}).to_batches()

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col("doc_id").cast("bigint"), "text", letter).mapInArrow(tidied(run), "doc_id bigint, lang_pred string, score double")


def predict_held_out(docs: DataFrame, path: str, mod: int = 4, rest: int = 2, **options) -> DataFrame:
    """predict() of all documents, learned from those that aren't held out, with held_out."""
    got = predict(docs, docs.filter(~held_out("doc_id", mod, rest)), path, **options)
    return got.withColumn("held_out", held_out("doc_id", mod, rest)).select("doc_id", "held_out", "lang_pred", "score")
