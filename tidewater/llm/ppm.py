"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order``, kept as counts of
(context, symbol).  A symbol is coded at the longest context that has it; each
longer one charges its escape (method C: distinct symbols over distinct plus
total), and symbols of longer contexts are excluded from the shorter ones.
Texts end with a symbol of their own, 0xFF, which UTF-8 lacks, and begin in a
context of the same.

Counts are taken over all given documents, exchanged packed by the nearest
three bytes of context and kept in those partitions, so that one of them holds
all that contexts of three bytes or more need; shorter ones, of which there are
256 ** 3 symbols at most, are broadcast, counted from everything.  The
probabilities of the ``max_nodes`` most frequent symbols in their longest
contexts are broadcast too; all others, and unseen ones, meet the partitions'
counts in an exchange.  Nothing is pruned.
``score`` uses the trained model; ``adaptive_bits`` starts from an empty trie
and learns from the text itself.

Null text counts as empty: its score is that of the end symbol.  Repeated rows
are rows of their own.  Without training texts every symbol is equally likely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, Index, Tally, Words, checkpointed, exchanged, gathered, heads, held_out, histogram, mix, once, packed, routes, shuffle_partitions, summed, text_bytes, tidied, unpacked

END = 0xFF
#: Bytes of context by which gram counts are dealt to partitions.
NEAR = 3
#: The hash of the end token of the word model.
END_WORD = mix(np.array([0xE0F], np.uint64))[0]


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its ``order`` bytes of context as an integer, and the index of its text."""
    data, base = text_bytes(texts)
    n = len(base) - 1
    size = np.diff(base)
    starts = base[:-1] + np.arange(n) * (order + 1)
    stream = np.full(len(data) + n * (order + 1), END, np.uint8)
    owner = np.repeat(np.arange(n), size)
    stream[np.arange(len(data)) + (owner + 1) * (order + 1) - 1] = data
    keys = np.zeros(len(stream) - order if len(stream) else 0, np.uint64)
    for k in range(order + 1):
        keys <<= np.uint64(8)
        keys |= stream[k : len(stream) - order + k]
    counts = size + 1
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return keys[np.arange(int(counts.sum())) + first], np.repeat(np.arange(n), counts)


def near(keys: np.ndarray, order: int) -> np.ndarray:
    """The bytes of context that name the partition of each gram's counts."""
    return keys >> np.uint64(8) & np.uint64((1 << 8 * min(NEAR, order)) - 1)


class Model:
    """Log10 probabilities from counts of (context, symbol) of the longest contexts.

    ``keys`` may be those of some near() contexts if ``short`` has the counts,
    over everything, of the grams one byte shorter than those.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, short: tuple[np.ndarray, np.ndarray] | None = None):
        self.order = order
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []  # by order: keys, counts
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            own, n = (keys, counts) if short is None or k >= min(NEAR, order) else short
            self.entries.append(summed(own & mask, n))
        self.contexts, self.total, self.kinds = [], [], []
        for k, (e, c) in enumerate(self.entries):
            ctx, first = np.unique(e >> np.uint64(8), return_index=True)
            self.contexts.append(ctx)
            self.total.append(np.add.reduceat(c, first) if len(e) else c)
            self.kinds.append(np.diff(np.append(first, len(e))))
        log = lambda a, b: np.log10(np.where((a > 0) & (b > 0), a, 1) / np.where((a > 0) & (b > 0), b, 1))
        self.plain = [(np.log10(np.maximum(t + d, 1)), log(d.astype(float), (t + d).astype(float))) for t, d in zip(self.total, self.kinds, strict=True)]
        self.after = []  # by order below the longest: log denominator and log escape, by context one longer
        for k in range(order):
            longer, own = self.contexts[k + 1], self.contexts[k]
            mask = np.uint64((1 << 8 * k) - 1)
            at = np.searchsorted(own, longer & mask)
            e, _ = self.entries[k + 1]
            short, counted = self.entries[k]
            gone = counted[np.searchsorted(short, e & np.uint64((1 << 8 * (k + 1)) - 1))]
            first = np.searchsorted(e >> np.uint64(8), longer)
            gone = np.add.reduceat(gone, first) if len(e) else gone
            total, kinds = self.total[k][at] - gone, self.kinds[k][at] - self.kinds[k + 1]
            self.after.append((np.log10(np.maximum(total + kinds, 1)), log(kinds.astype(float), (total + kinds).astype(float))))
        top, c = self.entries[order]
        self.direct = np.log10(c) - self.plain[order][0][np.searchsorted(self.contexts[order], top >> np.uint64(8))] if len(top) else np.zeros(0)
        self.index = Index(top)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Of each symbol in its context."""
        at = self.index.find(keys)
        out = np.zeros(len(keys))
        hit = at >= 0
        out[hit] = self.direct[at[hit]]
        todo = np.flatnonzero(~hit)
        if len(todo):
            left, back = np.unique(keys[todo], return_inverse=True)
            out[todo] = self._descend(left)[back]
        return out

    def _descend(self, keys: np.ndarray) -> np.ndarray:
        out, cost = np.zeros(len(keys)), np.zeros(len(keys))
        longer = np.full(len(keys), -1)
        open_ = np.ones(len(keys), bool)
        for k in range(self.order, -1, -1):
            own = self.contexts[k]
            if not len(own):
                continue
            key = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(own, key >> np.uint64(8)), len(own) - 1)
            seen = own[at] == key >> np.uint64(8)
            shorter = (longer >= 0) & seen
            den, esc = self.plain[k][0][at], self.plain[k][1][at]
            if k < self.order and shorter.any():
                den[shorter], esc[shorter] = self.after[k][0][longer[shorter]], self.after[k][1][longer[shorter]]
            e, c = self.entries[k]
            place = np.minimum(np.searchsorted(e, key), len(e) - 1)
            found = open_ & (e[place] == key)
            out[found] = cost[found] + np.log10(c[place[found]]) - den[found]
            open_ &= ~found
            cost += np.where(open_ & seen, esc, 0)
            longer = np.where(seen, at, -1)
        known = self.kinds[0][0] if len(self.kinds[0]) else 0
        out[open_] = cost[open_] - math.log10(max(1, 256 - known))
        return out


def adaptive_bits(text: bytes, order: int = 4) -> float:
    """Code length in bits of a text from an empty trie that learns as it goes, end symbol included."""
    trie: dict[bytes, dict[int, int]] = {}
    bits, context = 0.0, bytes([END]) * order
    for s in [*text, END]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            held = trie.get(context[order - k :])
            if not held:
                continue
            left = {x: n for x, n in held.items() if x not in excluded}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if s in left:
                bits -= math.log2(left[s] / whole)
                break
            bits -= math.log2(len(left) / whole)
            excluded |= set(left)
        else:
            bits += math.log2(256 - len(excluded))
        for k in range(order + 1):
            held = trie.setdefault(context[order - k :], {})
            held[s] = held.get(s, 0) + 1
        context = (context + bytes([s]))[1:]
    return bits


def _counts(docs: DataFrame, order: int) -> DataFrame:
    """Kind 0: counts of grams and log10 of their share in their longest context, by near(); kind 1: counts of words; of the texts of ``docs``."""
    parts = shuffle_partitions(docs.sparkSession)

    def place(kind: int, keys: np.ndarray) -> np.ndarray:
        return routes(mix(keys if kind else near(keys, order)), parts)

    def count(batches):
        g, w = Tally(), Tally()
        for table in gathered(batches, limit=1_000_000):
            texts = table.column("text")
            g.add(grams(texts, order)[0])
            w.add(Words(texts, lower=True).hash)
            w.add(np.array([END_WORD]), np.array([table.num_rows]))
        for kind, tally in enumerate((g, w)):
            keys, counts = tally.result()
            yield from packed(kind, place(kind, keys), keys, counts)

    def add(batches):
        for kind, (keys, counts) in unpacked(batches, {0: ["u8", "i8"], 1: ["u8", "i8"]}).items():
            keys, counts = summed(keys, counts)
            more = []
            if not kind and len(keys):
                first = np.flatnonzero(np.append(True, keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)))
                kinds = np.diff(np.append(first, len(keys)))
                more = [np.log10(counts) - np.repeat(np.log10(np.add.reduceat(counts, first) + kinds), kinds)]
            yield from packed(kind, place(kind, keys), keys, counts, *more)
            yield from histogram(kind, counts)

    return exchanged(docs.select("text").mapInArrow(tidied(count), PACKED)).mapInArrow(tidied(add), PACKED)


def score(docs: DataFrame, training: DataFrame, order: int = 5, max_nodes: int = 1_500_000, max_words: int = 200_000) -> DataFrame:
    """Each row of docs with its word model's and byte model's figures.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes.
    Words among the ``max_words`` most frequent and grams among the ``max_nodes``
    most frequent are looked up in a broadcast table; all others meet their
    counts in an exchange.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    counts = checkpointed(_counts(training, order))
    keys, chance, _, _ = heads(counts, 0, max_nodes, value="f8")
    words, word_n, kinds, tokens = heads(counts, 1, max_words)
    shared = spark.sparkContext.broadcast((keys, chance, words, word_n))  # at most max_nodes and max_words pairs

    def shorten(batches):
        mask = np.uint64((1 << 8 * min(NEAR, order)) - 1)
        k, n = unpacked(batches, {0: ["u8", "i8"]})[0]
        k, n = summed(k & mask, n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["k", "n"])

    brief = counts.filter("kind = 0").mapInArrow(tidied(shorten), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 256 ** NEAR rows at most
    short = spark.sparkContext.broadcast(tuple(brief.column(c).to_numpy().astype(t) for c, t in (("k", np.uint64), ("n", np.int64))))
    divisor = tokens + 0.5 * (kinds + 1)

    def measure(batches):
        top, index = once(shared.value, lambda x: (Index(x[0]), Index(x[2])))
        _, chance, _, wn = shared.value
        for table in gathered(batches, limit=1_000_000):
            rid, doc = (table.column(c).to_numpy() for c in ("rid", "doc_id"))
            texts = table.column("text")
            g, owner = grams(texts, order)
            at = top.find(g)
            hit = at >= 0
            total = np.bincount(owner[hit], chance[at[hit]] if hit.any() else None, len(rid))
            if not hit.all():
                yield from packed(5, routes(mix(near(g[~hit], order)), parts), g[~hit], rid[owner[~hit]])
            w = Words(texts, lower=True)
            hashes = np.concatenate([w.hash, np.full(len(rid), END_WORD)])
            owner = np.concatenate([w.owner(), np.arange(len(rid))])
            at = index.find(hashes)
            hit = at >= 0
            base = np.bincount(owner[hit], np.log10((wn[at[hit]] + 0.5) / divisor) if hit.any() else None, len(rid))
            known = np.bincount(owner[hit], minlength=len(rid))
            yield from packed(2, (rid % parts).astype(np.int32), rid, doc, w.count + 1, known, base, total)
            if not hit.all():
                yield from packed(3, routes(mix(hashes[~hit]), parts), hashes[~hit], rid[owner[~hit]])

    def meet(batches):
        found = unpacked(batches, {0: ["u8", "i8"], 1: ["u8", "i8"], 2: ["i8", "i8", "i8", "i8", "f8", "f8"], 3: ["u8", "i8"], 5: ["u8", "i8"]})
        yield from packed(2, (found[2][0] % parts).astype(np.int32), *found[2])
        asked, rid = found[5]
        if len(asked):
            ids, back = np.unique(rid, return_inverse=True)
            got = Model(*found[0], order, short.value).log10(asked)
            yield from packed(6, (ids % parts).astype(np.int32), ids, np.bincount(back, got))
        (keys, n), (asked, rid) = found[1], found[3]
        if len(asked):
            ascending = np.argsort(keys)
            keys, n = keys[ascending], n[ascending]
            at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
            c = np.where(keys[at] == asked, n[at], 0) if len(keys) else np.zeros(len(asked), np.int64)
            ids, back = np.unique(rid, return_inverse=True)
            known, base = np.bincount(back, c > 0).astype(np.int64), np.bincount(back, np.log10((c + 0.5) / divisor))
            yield from packed(4, (ids % parts).astype(np.int32), ids, known, base)

    def finish(batches):
        found = unpacked(batches, {2: ["i8", "i8", "i8", "i8", "f8", "f8"], 4: ["i8", "i8", "f8"], 6: ["i8", "f8"]})
        rid, doc, tokens_, known, base, total = found[2]
        order = np.argsort(rid)
        more, k, b = found[4]
        at = order[np.searchsorted(rid[order], more)] if len(more) else np.zeros(0, np.int64)
        known = known + np.bincount(at, k, len(rid)).astype(np.int64)
        base = base + np.bincount(at, b, len(rid))
        more, t = found[6]
        at = order[np.searchsorted(rid[order], more)] if len(more) else np.zeros(0, np.int64)
        total = total + np.bincount(at, t, len(rid))
        absent = doc == np.iinfo(np.int64).min
        yield pa.RecordBatch.from_arrays([pa.array(doc, mask=absent), pa.array(tokens_), pa.array(known), pa.array(np.full(len(rid), tokens, np.int64)), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), "text")
    met = exchanged(rows.mapInArrow(tidied(measure), PACKED).unionByName(counts)).mapInArrow(tidied(meet), PACKED)
    return exchanged(met).mapInArrow(tidied(finish), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_held_out(docs: DataFrame, mod: int = 5, rest: int = 1, **options) -> DataFrame:
    """score() of all documents by a model of those that aren't held out, with held_out."""
    got = score(docs, docs.filter(~held_out("doc_id", mod, rest)), **options)
    return got.withColumn("held_out", held_out("doc_id", mod, rest)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
