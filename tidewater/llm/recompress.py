"""Removal of repeated passages, revealed by recompression.

Words get 64-bit names; in each round a pair of neighbours is given a name of
its own where the first falls, by a hash, on the left side and the second on
the right.  Equal neighbours fall on one side, so a run is never split by its
own pairs.  Names are hashes of what they stand for, so the rounds name equal
strings equally everywhere without a dictionary, and whether two symbols pair
depends on nothing but them: after ROUNDS rounds, at most 1 + 2 + 4 words at
either end of two equal passages can be named differently.  Two equal windows of
``window`` >= 20 words therefore share a symbol that lies at the same place in
both and has REVEAL words of the window from its beginning on.

Spark then (1) exchanges each document's distinct (symbol, REVEAL words) keys
and finds those held twice, (2) exchanges the windows that contain a shared key
and finds, of each, the earliest place, and (3) removes the words that later
windows cover.  Both exchanges are packed by hash, so a passage that a third of
all documents hold is one item per document there, compared with its earliest
place only; no pairs are made.

Null text has no words.  Null ids come after all others; rows that share an id
are ordered by their texts' hashes, and rows equal in both count as one
document and get the same result.  Texts below ``window`` words keep all.
Empty tables give empty results.  Extra columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, Words, beside, beside_schema, checkpointed, exchanged, gathered, mix, packed, routes, run_hashes, shuffle_partitions, tidied, unpacked

ROUNDS = 3
REVEAL = 6
_NULL = 2**63 - 1


def symbols(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols after the rounds, and the word that each begins with."""
    name, start, owner = words.hash, np.arange(len(words.hash)), words.owner()
    for k in range(rounds):
        right = (mix(name ^ mix(np.array([0xBEEF + k], np.uint64))) >> np.uint64(63)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & (owner[:-1] == owner[1:]))
        fresh = name.copy()
        fresh[pair] = mix(name[pair] * np.uint64(0xA24BAED4963EE407) + name[pair + 1] + np.uint64(k))
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name, start, owner = fresh[keep], start[keep], owner[keep]
    return name, start


def keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, its first REVEAL words) keys of all texts and the word each begins with."""
    name, start = symbols(words)
    last = words.first[1:][words.owner()[start]] if len(start) else start
    full = start + REVEAL <= last
    name, start = name[full], start[full]
    content = run_hashes(words.hash, REVEAL)
    return (mix(name ^ content[start]) if len(start) else name), start


def remove_repeats(docs: DataFrame, window: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of every document without those of windows that start earlier elsewhere.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the words left,
    joined by single spaces), then the columns of ``keep``.  Earlier means a smaller doc_id, or the same
    document and an earlier start.
    """
    if window < 20:
        raise ValueError("recompression reveals windows of 20 words or more")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    groups = 2 * parts
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("k"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)])
    rows = rows.select("k", F.xxhash64("text").alias("t"), *[c for c in rows.columns if c != "k"]).withColumn("g", F.pmod(F.xxhash64("k", "t"), F.lit(groups)).cast("int"))

    def reveal(batches):
        for table in gathered(batches):
            words = Words(table.column("text"))
            key, start = keys(words)
            if not len(key):
                continue
            owner = words.owner()[start]
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            twice = np.add.reduceat(np.ones(len(key), np.int64), np.flatnonzero(new)) > 1
            key, owner = key[new], owner[new]
            k, g = (table.column(c).to_numpy()[owner] for c in ("k", "g"))
            yield from packed(0, routes(key, parts), key, k, g.astype(np.int32), twice.view(np.uint8))

    def shared(batches):
        key, k, g, twice = unpacked(batches, {0: ["u8", "i8", "i4", "u1"]})[0]
        order = np.argsort(key)
        key = key[order]
        many = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        many[1:] |= same
        many[:-1] |= same
        many |= twice[order].astype(bool)
        own = order[many]
        yield from packed(1, g[own], key[many], k[own])

    def sorted_group(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The group's distinct documents in order of (k, t)."""
        k, t = table.column("k").to_numpy(), table.column("t").to_numpy()
        order = np.lexsort((t, k))
        new = np.ones(len(order), bool)
        new[1:] = (k[order][1:] != k[order][:-1]) | (t[order][1:] != t[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return table.take(pa.array(order[new])), place

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            table, _ = sorted_group(left.combine_chunks())
            asked, k = unpacked(right.to_batches(), {1: ["u8", "i8"]})[1]
            wanted = np.unique(mix(asked ^ mix(k.view(np.uint64))))
            own_k = table.column("k").to_numpy()
            g = table.column("g")[0].as_py()
            words = Words(table.column("text"))
            key, start = keys(words)
            owner = words.owner()
            code = mix(key ^ mix(own_k.view(np.uint64)[owner[start]]))
            at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            start = start[wanted[at] == code]
            first, last = words.first[:-1][owner[start]], words.first[1:][owner[start]] - window
            low, high = np.maximum(start + REVEAL - window, first), np.minimum(start, last)
            some = low <= high
            edge = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(edge, low[some], 1)
            np.add.at(edge, high[some] + 1, -1)
            place = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            if len(place):
                content = run_hashes(words.hash, window)[place]
                own = owner[place]
                out = list(packed(2, routes(content, parts), content, own_k[own], own.astype(np.int32), (place - words.first[own]).astype(np.int32), np.full(len(place), g, np.int32)))
        return pa.Table.from_batches(out, schema=_SCHEMA)

    def later(batches):
        content, k, index, place, g = unpacked(batches, {2: ["u8", "i8", "i4", "i4", "i4"]})[2]
        order = np.argsort(content)
        content = content[order]
        many = np.zeros(len(content), bool)
        same = content[1:] == content[:-1]
        many[1:] |= same
        many[:-1] |= same
        order = order[many]  # only windows that occur again are put in order
        order = order[np.lexsort((place[order], index[order], g[order], k[order], content[many]))]
        again = np.zeros(len(order), bool)
        sorted_content = np.sort(content[many])
        again[1:] = sorted_content[1:] == sorted_content[:-1]
        own = order[again]
        yield from packed(3, g[own], index[own], place[own])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return beside(pa.Table.from_batches([], schema=_RESULT), left)
        table, back = sorted_group(left.combine_chunks())
        index, place = unpacked(right.to_batches(), {3: ["i4", "i4"]})[3]
        order = np.argsort(index, kind="stable")
        cuts = np.searchsorted(index[order], np.arange(table.num_rows + 1))
        found = []
        for i, text in enumerate(table.column("text").to_pylist()):
            words = text.encode().split()
            gone = 0
            if cuts[i] < cuts[i + 1]:
                edge = np.zeros(len(words) + 1, np.int64)
                own = place[order[cuts[i] : cuts[i + 1]]]
                np.add.at(edge, own, 1)
                np.add.at(edge, own + window, -1)
                kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                gone = len(words) - len(kept)
                joined = b" ".join([words[j] for j in kept.tolist()])
            else:
                joined = b" ".join(words)
            found.append((len(words) if words else 0, gone, hashlib.sha256(joined).hexdigest(), joined))
        n, gone, digest, joined = zip(*found, strict=True)
        result = pa.table({
            "doc_id": pa.array([None if x == _NULL else x for x in table.column("k").to_pylist()], pa.int64()),
            "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(joined, pa.binary()).cast(pa.string()),
        })
        return beside(result.take(pa.array(back)), left)

    by_doc = rows.groupBy("g")
    revealed = checkpointed(exchanged(rows.select("k", "text", "g").mapInArrow(tidied(reveal), PACKED)).mapInArrow(tidied(shared), PACKED))  # all keys go before texts move
    candidates = by_doc.cogroup(revealed.groupBy("route")).applyInArrow(windows, PACKED)
    repeats = exchanged(candidates).mapInArrow(tidied(later), PACKED)
    return by_doc.cogroup(repeats.groupBy("route")).applyInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string" + beside_schema(docs, keep))


_SCHEMA = pa.schema([("route", pa.int32()), ("kind", pa.int32()), *[(f"c{k}", pa.binary()) for k in range(6)]])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
