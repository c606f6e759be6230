"""Best-fit packing of token pieces by a plan over the histogram of lengths.

``pieces`` tokenises and cuts, ``plan`` runs best-fit decreasing on counts of
lengths (at most ``size`` of them, so the plan doesn't see documents), and
``pack`` gives each piece the slot planned for its rank among pieces of its
length.  Ranks are made in salted parts, so a length that a third of all pieces
have is still ranked by many tasks; the counts of earlier parts join them.

Null text counts as empty and yields one piece: the end id.  Repeated rows are
packed as rows of their own.  An empty table gives an empty result.  Extra
columns aren't read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, checkpointed, gathered, ragged, shuffle_partitions, tidied

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


#: What ends every word when words are encoded many at a time; it is a token of its own, and words with its digit are encoded one by one.
_MARK = "0"
_OTHER = np.zeros(256, bool)
_OTHER[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(0x7F) if chr(b).isalnum()]] = True


def trailing_signs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where signs begin that follow an ASCII letter or digit up to a word's end: no token reaches across."""
    at, left = end.copy(), np.arange(len(start))
    for _ in range(16):
        left = left[(at[left] > start[left]) & _OTHER[data[at[left] - 1]]]
        if not len(left):
            break
        at[left] -= 1
    at = at[(at > start) & (at < end)]
    return at[_ALNUM[data[at - 1]]]


class WordIds:
    """Ids of words by their hashes; a worker keeps those of ``CACHE`` words, and 8 times as many ids, at most, then starts anew."""

    CACHE = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.mark = self._encoded([_MARK])[0]
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has."""
        alone = np.array([_MARK in w for w in words])
        many = [w for w, x in zip(words, alone, strict=True) if not x]
        blank = f" {_MARK} "
        ids = np.concatenate([np.zeros(0, np.uint32), *self._encoded([blank.join([*many[a : a + 200], ""]) for a in range(0, len(many), 200)])])
        marks = np.flatnonzero(ids == self.mark[0])
        size = np.empty(len(words), np.int64)
        size[~alone] = np.diff(marks, prepend=-1) - 1
        ids = np.delete(ids, marks)
        if not alone.any():
            return ids, size
        others = self._encoded([w for w, x in zip(words, alone, strict=True) if x])
        size[alone] = [len(x) for x in others]
        out, which = np.empty(int(size.sum()), np.uint32), np.repeat(alone, size)
        out[~which], out[which] = ids, np.concatenate(others)
        return out, size

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        words = Words(texts, lower=True, split=trailing_signs)
        hashes, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        hashes = hashes.tolist()
        missing = [k for k, x in enumerate(hashes) if x not in self.slot]
        if len(self.slot) + len(missing) > self.CACHE or len(self.ids) > 8 * self.CACHE:
            self.clear()
            missing = range(len(hashes))
        if len(missing):
            own = first[missing]
            start, end, data = words.start[own].tolist(), words.ends()[own].tolist(), words.data.tobytes()
            ids, size = self._fresh([data[a:b].decode() for a, b in zip(start, end, strict=True)])
            self.slot |= {hashes[k]: len(self.slot) + j for j, k in enumerate(missing)}
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        slot = np.fromiter(map(self.slot.__getitem__, hashes), np.int64, len(hashes))[back]
        size = self.ends[slot + 1] - self.ends[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ragged(self.ends[slot], size)], np.diff(total[words.first])


_held: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, asked for, ids.

    The vocabulary of ``path`` must drop white space (its tokens never cross
    it) and lower-case letters, as word-end vocabularies do; texts are then
    encoded word by word.
    """

    def run(batches):
        if path not in _held:
            _held[path] = WordIds(path)
        known = _held[path]
        for table in gathered(batches):
            ids, many = known.of(table.column("text"))
            n = len(many)
            whole = many + 1  # with the end id
            ends = np.cumsum(whole)
            out = np.full(int(ends[-1]), end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(n), many)] = ids
            count = -(-whole // size)
            owner = np.repeat(np.arange(n), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            begin = (ends - whole)[owner] + piece * size
            length = np.minimum(size, ends[owner] - begin)
            view = memoryview(out.view(np.uint8))
            crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
            found = {"doc_id": table.column("doc_id").take(pa.array(owner)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * size, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                found["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(out)), pa.int32()), pa.array(out.astype(np.int32)))
            yield from pa.table(found).to_batches()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(tidied(run), schema)


def plan(counts: dict[int, int], size: int = 4096) -> dict[int, list[tuple[int, int, int]]]:
    """Best-fit decreasing over counts of lengths.

    Returns, by length, slots (first rank, first sequence, offset) in order of
    rank; the ranks from one slot's first to the next one's go to consecutive
    sequences at that offset.  Time and result depend on the number of lengths,
    not on the counts.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, how many)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    opened = 0
    left = np.zeros(size + 1, bool)
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        todo, rank, mine = counts[length], 0, []

        def put(first: int, many: int, space: int) -> None:
            rest = space - length
            if rest > 0:
                room.setdefault(rest, []).append((first, many))
                left[rest] = True

        while todo:
            fits = np.flatnonzero(left[length:])
            if not len(fits):
                break
            space = int(fits[0]) + length
            first, many = room[space].pop()
            if not room[space]:
                left[space] = False
            used = min(many, todo)
            if used < many:
                room.setdefault(space, []).append((first + used, many - used))
                left[space] = True
            mine.append((rank, first, size - space))
            put(first, used, space)
            rank, todo = rank + used, todo - used
        if todo:
            each = size // length
            full, over = divmod(todo, each)
            for j in range(each if full else 0):
                mine.append((rank, opened, j * length))
                rank += full
            if full and size - each * length:
                room.setdefault(size - each * length, []).append((opened, full))
                left[size - each * length] = True
            opened += full
            for j in range(over):
                mine.append((rank, opened, j * length))
                rank += 1
            if over:
                rest = size - over * length
                if rest:
                    room.setdefault(rest, []).append((opened, 1))
                    left[rest] = True
                opened += 1
        slots[length] = mine
    return slots


def pack(cut: DataFrame, size: int = 4096, parts: int | None = None) -> DataFrame:
    """cut with sequence_id and offset: pieces of each sequence follow one another from 0 without gaps."""
    spark = cut.sparkSession
    parts = parts or max(32, shuffle_partitions(spark))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    held = cut.groupBy("length", "_part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    slots = plan(counts, size)
    arrays = {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in slots.items()}
    shared = spark.sparkContext.broadcast(arrays)  # the plan, which depends on lengths alone
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # parts rows a length at most
    before = held.select("length", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))

    def run(batches):
        arrays = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                ranks, firsts, offsets = arrays[int(n)]
                at = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own], offset[own] = firsts[at] + rank[own] - ranks[at], offsets[at]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(own) - 1).join(before, ["length", "_part"])
    names = [c for c in cut.columns if c != "_part"]
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes if c != "_part") + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, (F.col("_rank") + F.col("_before")).alias("_rank")).mapInArrow(tidied(run), schema)


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places; the texts are tokenised once."""
    return pack(checkpointed(pieces(docs, path, size, end_id)), size)
