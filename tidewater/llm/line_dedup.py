"""Exact set-similarity join of lines; every line that matches an earlier one goes.

A line's set holds the hashes of its distinct words (A-Z lower-cased); lines of
fewer than ``min_words`` words always stay.  Lines match when 100 * overlap >=
percent * union.  A line is removed if any earlier line, in order of (doc_id,
place), matches it, whether that one stays or not; judged on the input.

1. Words are counted and ordered by rarity: the ``max_words`` most frequent by
   their exact counts, broadcast, and the rarer ones before them by hash.
2. Lines are exchanged once, as sets of ranks: three bytes a frequent word.
   Equal lines meet and are one class from there on, at the place of its first.
3. Classes offer the rarest words of their sets, as many as the prefix filter
   needs.  A word of only one line counts in the prefix but isn't offered.
4. Where classes meet at a word, earlier ones pass the length and positional
   filters and a bound on the overlap from parities of the sets.  Each class
   asks for its ``tries`` earliest candidates of each length; if it then has none
   that verifies but more candidates, a second round asks for all of those;
   a bitmap of fixed size tells which words are needed again.
5. Sets of candidates go to the classes that ask, overlaps are counted, and the
   first lines of classes without a match are the lines that stay.

So a line with thousands of variants asks for a few of them, not all pairs.
Texts only move in the last step, where they join the lines that stay.

Null text has one empty line and stays as it is.  Null ids come last, as one id
with 2**63 - 1; lines of one id and place are ordered by their words' hashes, then
their texts'; rows equal in id and text are one document with one result.  Very long texts are worked on whole, one
at a time.  Empty tables give empty results; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, Index, Tally, Words, beside, beside_schema, checkpointed, distinct_per_owner, exchanged, gathered, heads, histogram, mix, need, once, packed, packed_rows, ragged, released, routes, shuffle_partitions, single, summed, text_bytes, tidied, unpacked, word_starts

_NULL = 2**63 - 1
_TAIL = np.uint64(2**63)
_PLACE = np.dtype([("k", "i8"), ("t", "i8"), ("p", "i4")])
_SHAPE = np.dtype([("n", "i4"), ("tails", "i4")])
_MEET = np.dtype([("n", "i4"), ("at", "i4")])

#: Kinds of packed rows.
COUNT, CLASS, FIRST, OFFER, PAIR, WANTED, SET, MORE, SLOT, MATCHED, STAYS = range(11)
_SLOTS = 23


class Lines:
    """The lines of texts that have ``least`` words or more."""

    def __init__(self, texts: pa.Array, least: int):
        self.words = w = Words(texts, lower=True)
        self.first, self.size, self.doc, self.place, _ = worded(w.data, w.base, w.start, least)

    def hashes(self) -> np.ndarray:
        """Of each line's whole sequence of words."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(self.size) - self.size
        within = np.arange(int(self.size.sum())) - np.repeat(begin, self.size)
        value = mix(self.words.hash[ragged(self.first, self.size)] + mix(np.arange(int(self.size.max()), dtype=np.uint64))[within])
        return mix(np.add.reduceat(value, begin) + self.size.astype(np.uint64))


def worded(data: np.ndarray, base: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of texts' bytes and word starts, the lines of ``least`` words or more (one at least): first word, words, text, place in it, first byte."""
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([base[:-1], breaks + 1]), kind="stable")  # two ascending runs
    begin = begin[np.append(begin[1:] != begin[:-1], True) & (begin < len(data))] if len(begin) else begin
    first = np.searchsorted(start, begin)
    size = np.diff(np.append(first, len(start)))
    own = size >= max(least, 1)
    first, size, begin = first[own], size[own], begin[own]
    doc = np.searchsorted(base, begin, "right") - 1
    place = np.searchsorted(breaks, begin) - np.searchsorted(breaks, base)[doc]  # the newlines before it in its text
    return first, size, doc, place.astype(np.int32), begin


class Ranks:
    """Places of words in order of rarity: the most frequent word of each of a few slots, which stay in the cache, is tried first."""

    _SLOT = np.uint64(2**14 - 1)

    def __init__(self, words: np.ndarray):
        """words: their hashes, rarest first."""
        self.rest = Index(words)
        self.at = np.full(int(self._SLOT) + 1, -1, np.int32)
        np.maximum.at(self.at, (words & self._SLOT).astype(np.int64), np.arange(len(words), dtype=np.int32))
        self.word = np.append(words, np.uint64(0))[self.at]  # any word that belongs elsewhere, where a slot has none

    def find(self, words: np.ndarray) -> np.ndarray:
        """Each word's place, or -1."""
        slot = (words & self._SLOT).astype(np.int64)
        out = self.at[slot]
        left = np.flatnonzero(self.word[slot] != words)
        out[left] = self.rest.find(words[left])
        return out


def without(data: np.ndarray, base: np.ndarray, breaks: np.ndarray, doc: np.ndarray, place: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts without some of their lines (of which text, place and first byte are given, ascending), the others joined by newlines: bytes, and where each text begins."""
    if not len(doc):
        return data.tobytes(), base
    new = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    head, last = np.flatnonzero(np.append(True, new)), np.flatnonzero(np.append(new, True))  # of each run of neighbours
    a, end = begin[head], base[doc[last] + 1]
    stop = np.searchsorted(breaks, begin[last])
    b = np.minimum(np.append(breaks, len(data))[stop] + 1, end)  # with the newline that ends the run
    closing = np.searchsorted(breaks, base)[doc[last] + 1] == stop  # no newline ends it: the one before it goes
    a = a - (closing & (a > base[doc[head]]))
    text = memoryview(data)
    out = b"".join([text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)])
    return out, base - np.append(0, np.cumsum(b - a))[np.searchsorted(a, base)]


class Sets:
    """Classes of lines: code, another column, and the set as ranks of frequent words and hashes of others, rarest first."""

    def __init__(self, code, other, shape, low, high, tail):
        self.code, self.other, self.shape, self.low, self.high, self.tail = code, other, shape, low, high, tail
        self.n, self.tails = shape["n"].astype(np.int64), shape["tails"].astype(np.int64)
        self.first, self.first_tail = np.cumsum(self.n - self.tails) - (self.n - self.tails), np.cumsum(self.tails) - self.tails

    @classmethod
    def read(cls, batches, kind: int, other) -> Sets:
        return cls(*unpacked(batches, {kind: cls.types(other)})[kind])

    @staticmethod
    def types(other) -> list:
        return ["u8", other, _SHAPE, "u2", "u1", "u8"]

    def take(self, which: np.ndarray, code: np.ndarray | None = None, other: np.ndarray | None = None) -> Sets:
        heads, tails = ragged(self.first[which], (self.n - self.tails)[which]), ragged(self.first_tail[which], self.tails[which])
        return Sets(self.code[which] if code is None else code, self.other[which] if other is None else other, self.shape[which], self.low[heads], self.high[heads], self.tail[tails])

    def tokens(self) -> np.ndarray:
        """All members, one set after another: ranks, and hashes with the upper bit for words that have none."""
        out = np.empty(int(self.n.sum()), np.uint64)
        first = np.cumsum(self.n) - self.n
        out[ragged(first, self.tails)] = self.tail | _TAIL
        out[ragged(first + self.tails, self.n - self.tails)] = self.low.astype(np.uint64) | self.high.astype(np.uint64) << np.uint64(16)
        return out

    def common(self, other: Sets) -> np.ndarray:
        """How many members each set has in common with the other's set of the same place."""
        pair = np.arange(len(self.n))
        key = np.sort(np.concatenate([np.repeat(pair << 24, s.n - s.tails) | s.low | s.high.astype(np.int64) << 16 for s in (self, other)]), kind="stable")  # two ascending runs
        out = np.bincount(key[1:][key[1:] == key[:-1]] >> 24, minlength=len(pair))
        which = np.flatnonzero((self.tails > 0) & (other.tails > 0))  # words without a rank
        if len(which):
            tail = [s.tail[ragged(s.first_tail[which], s.tails[which])] for s in (self, other)]
            owner = [np.repeat(which, s.tails[which]) for s in (self, other)]
            key, owner = np.concatenate([mix(t + mix(o.astype(np.uint64))) for t, o in zip(tail, owner, strict=True)]), np.concatenate(owner)
            order = np.argsort(key)
            key = key[order]
            out += np.bincount(owner[order[1:][key[1:] == key[:-1]]], minlength=len(pair))
        return out

    def beginnings(self, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """tokens() of only the first ``many`` members of each set, in another order, and the set of each."""
        tails = np.minimum(many, self.tails)
        which = ragged(self.first, many - tails)
        owner = np.append(np.repeat(np.arange(len(many)), tails), np.repeat(np.arange(len(many)), many - tails))
        token = np.append(self.tail[ragged(self.first_tail, tails)] | _TAIL, self.low[which].astype(np.uint64) | self.high[which].astype(np.uint64) << np.uint64(16))
        return token, owner

    def rows(self, kind: int, route: np.ndarray, many: int = 20_000):
        """Packed rows, of ``many`` sets at most."""
        order = np.argsort(route, kind="stable")
        for a in range(0, len(order), many):
            part = self.take(order[a : a + many])
            own = route[order[a : a + many]]
            cut = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
            heads, tails = np.append(part.first, len(part.low)), np.append(part.first_tail, len(part.tail))
            yield packed_rows(kind, own[cut[:-1]], [(part.code, cut), (part.other, cut), (part.shape, cut), (part.low, heads[cut]), (part.high, heads[cut]), (part.tail, tails[cut])])


def parities(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 parities of each set: every member flips one."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (mix(token) & np.uint64(63)), first) if len(first) else np.zeros(0, np.uint64)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (a + b) // (100 + percent))


def buckets(percent: int) -> np.ndarray:
    """Where buckets of set sizes begin: lines that match are in one or in neighbours."""
    out = [1]
    while out[-1] < 2**31:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out)


def candidates(begin, fan, asker, n, at, sketch, percent, tries):
    """(asker, candidate, whether it's one too many) among places begin ... begin + fan, in growing steps until each has its tries (None: all)."""
    done, seen = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    live, width, block = np.flatnonzero(fan > 0), 16, 1_000_000
    rest = n - at
    while len(live):
        step = np.minimum(width, fan[live] - seen[live])
        ends = np.cumsum(step)
        a = 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + block)))
            part, many = live[a:b], step[a:b]
            a = b
            y = ragged(begin[part] + seen[part], many)
            both = np.repeat(n[asker[part]], many) + n[y]
            ok = np.flatnonzero(np.minimum(np.repeat(rest[asker[part]], many), rest[y]) * (100 + percent) >= percent * both)
            who, y, both = np.repeat(part, many)[ok], y[ok], both[ok]
            x = asker[who]
            ok = np.flatnonzero(both - np.bitwise_count(sketch[x] ^ sketch[y]) >= 2 * least_overlap(both, 0, percent))
            x, y, who = x[ok], y[ok], who[ok]
            if tries is None:
                yield x, y, np.zeros(len(x), bool)
            elif len(who):
                first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                many = np.diff(np.append(first, len(who)))
                number = ragged(done[who[first]], many)
                done[who[first]] += many
                own = number <= tries
                yield x[own], y[own], number[own] == tries
        seen[live] += step
        live = live[(seen[live] < fan[live]) & ((done[live] <= tries) if tries is not None else True)]
        width = min(width * 4, 65_536)


def remove_matches(docs: DataFrame, percent: int = 80, min_words: int = 1, max_words: int = 1_000_000, tries: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and kept (the lines left, joined by newlines; null stays null) of every row, then the columns of ``keep``."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)])
    rows = rows.select(F.coalesce("id", F.lit(_NULL)).alias("k"), F.xxhash64(F.coalesce("text", F.lit("\0"))).alias("t"), *rows.columns)

    def count(batches):
        tally = Tally()
        for table in gathered(batches):
            tally.add(Words(table.column("text"), lower=True).hash)
        keys, counts = tally.result()
        yield from packed(COUNT, routes(mix(keys), parts), keys, counts)

    def total(batches):
        keys, counts = summed(*unpacked(batches, {COUNT: ["u8", "i8"]})[COUNT])
        yield from packed(COUNT, np.zeros(len(keys), np.int32), keys, counts)
        yield from histogram(COUNT, counts)

    words, counts, distinct, _ = heads(checkpointed(exchanged(rows.select("text").mapInArrow(tidied(count), PACKED)).mapInArrow(tidied(total), PACKED)), COUNT, max_words)
    alone = distinct == len(words) or (len(words) > 0 and int(counts.min()) <= 2)  # words without a rank have one line each
    own = counts > 1
    words, counts = words[own], counts[own]
    frequent = spark.sparkContext.broadcast(words[np.argsort(counts, kind="stable")])  # max_words hashes at most, rarest first

    def ranks(words: np.ndarray) -> np.ndarray:
        return once(frequent.value, Ranks).find(words)

    def scan(batches):
        for table in gathered(batches):
            lines = Lines(table.column("text"), min_words)
            if not len(lines.first):
                continue
            place = np.empty(len(lines.first), _PLACE)
            place["k"], place["t"] = (table.column(c).to_numpy()[lines.doc] for c in "kt")
            place["p"] = lines.place
            code = lines.hashes()
            own = _firsts(code, place)
            # distinct words of each line, rarest first: those with a rank by one sort of (line, rank), the others by hash
            size = lines.size[own]
            word, line = lines.words.hash[ragged(lines.first[own], size)], np.repeat(np.arange(len(own)), size)
            rank = ranks(word)
            ranked = rank >= 0
            key = np.sort(line[ranked] << 24 | rank[ranked])
            key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
            tail, tail_line = distinct_per_owner(word[~ranked], line[~ranked])
            shape = np.empty(len(own), _SHAPE)
            shape["tails"] = np.bincount(tail_line, minlength=len(own))
            shape["n"] = shape["tails"] + np.bincount(key >> 24, minlength=len(own))
            yield from Sets(code[own], place[own], shape, key.astype(np.uint16), (key >> 16).astype(np.uint8), tail).rows(CLASS, routes(code[own], parts))

    def classes(batches):
        sets = Sets.read(batches, CLASS, _PLACE)
        own = _firsts(sets.code, sets.other)
        if len(own):
            own = own[np.argsort(sets.code[own])]  # neighbours of one text cost more to compress than they save
            yield from sets.take(own).rows(CLASS, routes(sets.code[own], parts))

    lines = checkpointed(exchanged(rows.select("k", "t", "text").mapInArrow(tidied(scan), PACKED)).mapInArrow(tidied(classes), PACKED))

    def offered(sets: Sets, ask: bool, wanted: np.ndarray | None = None):
        """The rarest words of sets (of those, the ones in wanted slots); the place is negative for sets that ask."""
        if wanted is not None:
            token, owner = sets.beginnings(sets.n - need(sets.n, percent) + 1)
            sets = sets.take(np.unique(owner[wanted[_slot(token)]]))
        token, first = sets.tokens(), np.cumsum(sets.n) - sets.n
        line = np.repeat(np.arange(len(sets.n)), sets.n)
        sketch = parities(token, first)
        at = np.arange(len(token)) - first[line]
        sent = at < (sets.n - need(sets.n, percent) + 1)[line]
        if alone:
            sent &= token < _TAIL
        if wanted is not None:
            sent[sent] = wanted[_slot(token[sent])]
        token, line, at = token[sent], line[sent], at[sent]
        shape = np.empty(len(token), _MEET)
        shape["n"], shape["at"] = sets.n[line], ~at if ask else at
        yield from packed(OFFER, routes(mix(token), parts), token, sets.code[line], sets.other["k"][line], sets.other["p"][line], sketch[line], shape)

    def offer(batches):
        for row in single(batches):
            yield from offered(Sets.read([row], CLASS, _PLACE), True)

    def meet(tries: int | None):
        starts = buckets(percent)
        bits = len(starts).bit_length()  # of a bucket's number beside its word's

        def run(batches):
            token, code, k, p, sketch, shape = unpacked(batches, {OFFER: ["u8", "u8", "i8", "i4", "u8", _MEET]})[OFFER]
            order = np.argsort(token)
            same = token[order][1:] == token[order][:-1]
            order = order[np.append(same, False) | np.append(False, same)] if len(order) else order  # words that several lines offer
            if not len(order):
                return
            token, code, k, p, sketch, shape = (c[order] for c in (token, code, k, p, sketch, shape))
            rank = _in_order(k, p, code)
            size = shape["n"].astype(np.int64)
            word = np.cumsum(np.append(True, token[1:] != token[:-1])) << bits
            group = word + np.searchsorted(starts, size, "right") - 1
            wide = int(rank.max()).bit_length()
            key = group << wide | rank
            order = np.argsort(key)
            key, code, rank, size, group, sketch, shape = (c[order] for c in (key, code, rank, size, group, sketch, shape))
            at = shape["at"].astype(np.int64)
            asker = np.flatnonzero(at < 0)
            at = np.where(at < 0, ~at, at)
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))  # of each word and length
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))[asker]
            kind, first = np.concatenate([[-2], group[first], [-2]]), np.append(first, 0)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            earlier = np.repeat(new, np.diff(np.append(new, len(key))))[asker]  # the place of the same line's first offer of the word
            x, y = [], []
            more = []
            for beside in (-1, 0, 1):  # earlier lines of the neighbouring lengths and the same one
                begin, fan = first[own + beside], np.zeros(len(asker), np.int64)
                if beside:
                    there = np.flatnonzero((kind[own + beside + 1] == group[asker] + beside) & ((group[asker] + beside) >> bits == group[asker] >> bits))
                    fan[there] = np.searchsorted(key, key[asker[there]] + (beside << wide)) - begin[there]
                else:
                    fan = earlier - begin
                for a, b, too_many in candidates(begin, fan, asker, size, at, sketch, percent, tries):
                    more.append(code[a[too_many]])
                    x.append(code[a[~too_many]])
                    y.append(code[b[~too_many]])
            x, y, more = (np.concatenate([np.zeros(0, np.uint64), *c]) for c in (x, y, more))
            one = _one_of_each(mix(x + mix(y)))
            x, y = x[one], y[one]
            yield from packed(PAIR, routes(x, parts), x, y)
            both, to = np.concatenate([x, y]), np.tile(routes(x, parts), 2)
            one = _one_of_each(mix(both + mix(to.astype(np.uint64))))
            yield from packed(WANTED, routes(both[one], parts), both[one], to[one])
            more = np.unique(more)
            yield from packed(MORE, routes(more, parts), more)

        return run

    def send(batches):
        """Sets of asking classes and of their candidates, to where the asking ones live."""
        found = unpacked(batches, {CLASS: Sets.types(_PLACE), WANTED: ["u8", "i4"]})
        sets, (code, route) = Sets(*found[CLASS]), found[WANTED]
        which = _find(sets.code, code)
        one = np.unique(which * parts + route)
        yield from sets.take(one // parts).rows(SET, (one % parts).astype(np.int32))

    def verify(batches):
        """Classes that match a candidate, and the offers of those that match none but have more candidates."""
        found = unpacked(batches, {SET: Sets.types(_PLACE), PAIR: ["u8", "u8"], MORE: ["u8"]})
        sets, (x, y) = Sets(*found[SET]), found[PAIR]
        one = _one_of_each(mix(x + mix(y)))
        code, x, y = x[one], _find(sets.code, x[one]), _find(sets.code, y[one])
        order = np.argsort(code)
        code, x, y = code[order], x[order], y[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else order
        rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        good, low, high = [np.zeros(0, np.uint64)], 0, 1
        while len(code):  # a class's first candidate, then the second, the next two, four ... of those that match none so far
            now = np.flatnonzero((rank >= low) & (rank < high))
            for own in np.split(now, np.flatnonzero(np.diff(np.cumsum(sets.n[x[now]] + sets.n[y[now]]) // 1_000_000)) + 1):  # about a million words at once
                mine, other = sets.take(x[own]), sets.take(y[own])
                overlap = mine.common(other)
                good.append(code[own][100 * overlap >= percent * (mine.n + other.n - overlap)])
            left = (rank >= high) & ~np.isin(code, np.concatenate(good))
            code, x, y, rank = code[left], x[left], y[left], rank[left]
            low, high = high, 2 * high
        good = np.unique(np.concatenate(good))
        yield from packed(MATCHED, routes(good, parts), good)
        yield from offered(sets.take(_find(sets.code, np.setdiff1d(found[MORE][0], good))), True)

    def round_of(offers: DataFrame, tries: int | None) -> DataFrame:
        """Classes that match an earlier one, and offers of those with more candidates only."""
        pairs = checkpointed(exchanged(offers).mapInArrow(tidied(meet(tries)), PACKED))
        sets = exchanged(lines.unionByName(pairs.filter(F.col("kind") == WANTED))).mapInArrow(tidied(send), PACKED)
        return checkpointed(exchanged(sets.unionByName(pairs.filter(F.col("kind").isin(PAIR, MORE)))).mapInArrow(tidied(verify), PACKED))

    def slots(batches):
        slot = np.unique(_slot(unpacked(batches, {OFFER: ["u8"]})[OFFER][0]))
        yield from packed(SLOT, (slot * 8 >> _SLOTS).astype(np.int32), slot)

    def bitmap(batches):
        """The wanted ones among the slots of each route, eight in a byte."""
        batches = list(batches)
        for r in {r for b in batches for r in b.column("route").to_pylist()}:
            slot = unpacked([b.filter(pa.array(b.column("route").to_numpy() == r)) for b in batches], {SLOT: ["i8"]})[SLOT][0]
            bits = np.zeros(1 << _SLOTS >> 3, bool)
            bits[slot - r * len(bits)] = True
            yield pa.RecordBatch.from_pydict({"first": [r * len(bits)], "bits": [np.packbits(bits).tobytes()]})

    found = round_of(lines.mapInArrow(tidied(offer), PACKED), tries)
    matched, left = (found.filter(F.col("kind") == kind) for kind in (MATCHED, OFFER))
    if left.limit(1).count():
        wanted = np.zeros(1 << _SLOTS, bool)
        for r in left.mapInArrow(tidied(slots), PACKED).repartitionById(8, F.col("route")).mapInArrow(tidied(bitmap), "first bigint, bits binary").collect():  # 2**23 bits in all
            wanted[r["first"] : r["first"] + 8 * len(r["bits"])] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
        wanted = spark.sparkContext.broadcast(np.packbits(wanted))

        def offer_wanted(batches):
            own = np.unpackbits(wanted.value).astype(bool)
            for row in single(batches):
                yield from offered(Sets.read([row], CLASS, _PLACE), False, own)

        again = round_of(left.unionByName(lines.mapInArrow(tidied(offer_wanted), PACKED)), None)
        matched = matched.unionByName(again)

    def stays(batches):
        found = unpacked(batches, {FIRST: ["u8", _PLACE], MATCHED: ["u8"]})
        code, place = found[FIRST]
        place = place[~np.isin(code, found[MATCHED][0])]
        yield from packed(STAYS, routes(mix(place["k"].view(np.uint64) ^ mix(place["t"].view(np.uint64))), parts), place)

    def by_document(batches):
        place = unpacked(batches, {STAYS: [_PLACE]})[STAYS][0]
        place = place[np.lexsort((place["p"], place["t"], place["k"]))]
        cut = np.flatnonzero(np.append(True, (place["k"][1:] != place["k"][:-1]) | (place["t"][1:] != place["t"][:-1]))) if len(place) else np.zeros(0, np.int64)
        ends, p = np.append(cut, len(place))[1:], np.ascontiguousarray(place["p"])
        for a in range(0, len(cut), 50_000):
            own = slice(a, a + 50_000)
            yield pa.RecordBatch.from_pydict({"k": place["k"][cut[own]], "t": place["t"][cut[own]], "stays": pa.array([p[i:j].tobytes() for i, j in zip(cut[own], ends[own], strict=True)], pa.binary())})

    def rewrite(batches):
        for table in gathered(batches):
            data, base = text_bytes(table.column("text"))
            _, _, doc, place, begin = worded(data, base, word_starts(data, base)[0], min_words)
            kept = [np.frombuffer(x or b"", "i4") for x in table.column("stays").to_pylist()]
            kept = np.repeat(np.arange(len(kept)) << 32, [len(x) for x in kept]) | np.concatenate([np.zeros(0, np.int32), *kept])
            key = doc << 32 | place
            gone = np.append(kept, -1)[np.searchsorted(kept, key)] != key
            removed = np.bincount(doc[gone], minlength=table.num_rows)
            breaks = np.flatnonzero(data == 0x0A)
            total = np.diff(np.searchsorted(breaks, base)) + 1
            text, ends = without(data, base, breaks, doc[gone], place[gone], begin[gone])
            body = memoryview(text)
            valid = pa.array(~np.asarray(table.column("text").is_null())).buffers()[1]
            result = pa.table({
                "doc_id": table.column("id"), "n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(body[i:j]).hexdigest() for i, j in itertools.pairwise(ends.tolist())], pa.string()),
                "kept": pa.LargeStringArray.from_buffers(table.num_rows, pa.py_buffer(ends), pa.py_buffer(text), valid).cast(pa.string()),
            })
            yield from beside(result, table).to_batches()

    firsts = lines.select("route", F.lit(FIRST).alias("kind"), "c0", "c1", *[F.lit(None).cast("binary").alias(f"c{k}") for k in range(2, 6)])  # without their sets
    staying = exchanged(exchanged(firsts.unionByName(matched)).mapInArrow(tidied(stays), PACKED)).mapInArrow(tidied(by_document), "k bigint, t bigint, stays binary")
    released(spark)
    joined = rows.join(staying, ["k", "t"], "left").drop("k", "t")
    return joined.mapInArrow(tidied(rewrite), "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string, kept string" + beside_schema(docs, keep))


def _firsts(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The index of the first line of each code, ascending."""
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    several = np.append(same, False) | np.append(False, same) if len(code) else np.zeros(0, bool)
    again = order[several]
    again = again[np.lexsort((place["t"][again], place["p"][again], place["k"][again], code[again]))]
    return np.sort(np.append(order[~several], again[np.append(True, code[again][1:] != code[again][:-1])] if len(again) else again))


def _in_order(k: np.ndarray, p: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The place of each line in order of (k, p, code), equal for offers of one line."""
    low, wide = int(k.min()), int(p.max()).bit_length()
    near = k - low if (int(k.max()) - low).bit_length() + wide < 64 else np.unique(k, return_inverse=True)[1]
    key = near << wide | p
    order = np.argsort(key)
    new, other = (np.append(True, c[order][1:] != c[order][:-1]) for c in (key, code))
    if (other & ~new).any():  # different lines of one id and place
        order = np.lexsort((code, key))
        other = np.append(True, code[order][1:] != code[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(other)
    return rank


def _one_of_each(key: np.ndarray) -> np.ndarray:
    """The index of one item of each key."""
    order = np.argsort(key)
    return order[np.append(True, key[order][1:] != key[order][:-1])] if len(key) else order


def _slot(token: np.ndarray) -> np.ndarray:
    """One of 2**23 slots of each word."""
    return (mix(token) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The index of each wanted code among all, where it is."""
    order = np.argsort(codes)
    return order[np.searchsorted(codes, wanted, sorter=order)] if len(wanted) else np.zeros(0, np.int64)
