"""Shared parts of the text operators: reading, vectorised words, packed shuffles.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  All
hashes are 64 bits wide and depend on the bytes alone, so equal words have
equal hashes in every task, attempt and run.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import math
import mmap
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once.
_BLOCK = 1 << 16
#: Bytes of text that one vectorised step works on; one text may be longer.
STEP_BYTES = 2_000_000

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _RADIX) -> np.ndarray:
    """The first n powers of the radix (or of its inverse) modulo 2**64."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        step = np.full(max(n, 4096), base, np.uint64)
        step[0] = 1
        held = np.multiply.accumulate(step)
        if n <= 2 * STEP_BYTES:
            _powers[int(base)] = held
    return held[:n]


#: Memory that an idle worker may keep, its libraries included.
KEPT_BYTES = 180_000_000


_frozen = 0


def settled() -> None:
    """Takes what libraries made when imported out of garbage collection: PySpark's workers collect after each task, which takes 30 ms with it."""
    global _frozen
    if len(sys.modules) > _frozen:
        gc.freeze()
        _frozen = len(sys.modules)


def tidied(function):
    """The same for mapInArrow, giving freed memory back to the system after each partition: workers live on between tasks."""

    @functools.wraps(function)
    def run(batches):
        settled()
        yield from function(batches)
        with contextlib.suppress(OSError, AttributeError):  # not on every system
            with open("/proc/self/statm") as held:
                if int(held.read().split()[1]) * mmap.PAGESIZE > KEPT_BYTES:
                    pa.default_memory_pool().release_unused()
                    ctypes.CDLL(None).malloc_trim(0)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(column: str, mod: int, rest: int) -> Column:
    """True for rows whose crc32 of the id, as text, leaves this rest; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == rest, F.lit(False))


def sample_texts(rows: DataFrame, max_rows: int, max_bytes: int) -> pa.Table:
    """Rows with a text of the smallest ``_h``: at most max_rows, and of them as many as hold max_bytes of text.

    Hashes and sizes are collected first, then only the chosen texts.  Rows of
    one hash are all in or all out; ``_h`` orders the result.  Texts of over an
    eighth of max_bytes are left out.
    """
    rows = rows.filter(F.octet_length("text") <= max_bytes // 8)
    sizes = rows.groupBy("_h").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).orderBy("_h").limit(max_rows).toArrow()
    h, size, n = (sizes.column(c).to_numpy() for c in ("_h", "size", "n"))
    fits = (np.cumsum(size) <= max_bytes) & (np.cumsum(n) <= max_rows)
    if not fits.any():
        return rows.limit(0).toArrow()
    return rows.filter(F.col("_h") <= int(h[fits][-1])).orderBy("_h", "text").toArrow()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as files in the cluster's shared checkpoint folder; its lineage ends there.

    The folder is spark.checkpoint.dir; where that is unset, a temporary one
    serves a local session and a cluster is refused.  Spark removes the files of
    the exchanges that led here at once.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoints-"))
    released(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, for which the setting holds
    finally:
        spark.conf.set(_CLEANUP, before)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the files of exchanges and checkpoints that nothing refers to any more."""
    gc.collect()  # Python's garbage first lets go of the JVM's
    spark.sparkContext._jvm.System.gc()


class Words:
    """The words of a run of texts as arrays.

    ``hash`` has one value per word, ``first`` one index into it per text and
    one more; ``start`` and ``end`` are byte places in ``data``, the texts' bytes
    one after another, which begin at ``base``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, split: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None):
        """split: of bytes, word starts and word ends, more places where words are cut."""
        data, base = text_bytes(texts)
        self.raw, self.base = data, base
        self.data = data = data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32) if lower else data
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
            return
        self.start, self._inside = word_starts(data, base)
        self._end = None
        if split:
            extra = split(data, self.start, self.ends())
            self.start, self._end = np.sort(np.append(self.start, extra)), np.sort(np.append(self.ends(), extra))
        self.hash = np.empty(len(self.start), np.uint64)
        inside, at = self._inside.view(np.uint8), 0
        while at < len(self.start):  # by blocks of whole words, so that arrays of eight bytes a byte stay small
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + _BLOCK)))
            a, b = int(self.start[at]), int(self.start[to]) if to < len(self.start) else n
            value = ((data[a:b] + np.uint8(1)) * inside[a:b]).astype(np.uint64)
            value *= powers(b - a)  # by place in the block; divided by the power of its start, a word's sum depends on its bytes alone
            places = self.start[at:to] - a
            sums = np.cumsum(value, out=value)[np.append(places[1:], b - a) - 1]  # bytes between words add nothing
            sums[1:] -= sums[:-1].copy()
            self.hash[at:to] = mix(sums * powers(b - a, _INVERSE)[places])
            at = to
        self.first = np.searchsorted(self.start, base)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def ends(self) -> np.ndarray:
        """The byte place after each word."""
        if not len(self.data):
            return self.start
        if self._end is None:
            inside = self._inside
            stops = inside.copy()
            stops[:-1] &= ~inside[1:]
            cuts = self.base[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(inside))] - 1
            stops[cuts] |= inside[cuts]
            self._end = np.flatnonzero(stops) + 1
        return self._end

    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_starts(data: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in texts' bytes, and which bytes are parts of words."""
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = base[:-1][base[:-1] < len(data)]
    begins[cuts] |= inside[cuts]
    return np.flatnonzero(begins), inside


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.fill_null("").cast(pa.large_binary())
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    base = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    body = wide.buffers()[2]
    data = np.frombuffer(body, np.uint8)[base[0] : base[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, base - base[0]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    base = text_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(base, base[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.Table]:
    """The stream as tables of at least ``limit`` bytes of text (the last may be less) and little more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in steps(batch, column, limit):
            held.append(part)
            size += len(text_bytes(part.column(column))[0]) + 64 * part.num_rows
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, and the index of each one's text.

    A text with fewer words, but one at least, has its whole sequence as one run.
    """
    n = len(words.hash)
    total = np.zeros(n, np.uint64)
    counts = words.count
    for k in range(width):
        seed = mix(np.array([0xA5A5_0000 + k], np.uint64))[0] | np.uint64(1)
        total[: n - k] += mix(words.hash[k:] ^ seed) if k < n else np.uint64(0)
    owner = words.owner()
    left = words.first[1:][owner] - np.arange(n)
    full = left >= width
    hashes, owners = mix(total[full]), owner[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([sequence_hash(words.hash[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        hashes, owners = np.concatenate([hashes, extra]), np.concatenate([owners, short])
    return hashes, owners


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of word hashes."""
    seeds = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64)) | np.uint64(1)
    return mix(np.sum(mix(hashes ^ seeds), keepdims=True) + np.array([len(hashes)], np.uint64) * _RADIX)[0]


def distinct_per_owner(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values in ascending order; owners ascend.

    Sorted by one integer: the owner's bits, then as many upper bits of the
    value as are left.  Should two values of an owner agree in those, all is
    sorted again by both.
    """
    bits = np.uint64(max(1, int(owners.max()).bit_length() if len(owners) else 1))
    key = owners.astype(np.uint64) << (np.uint64(64) - bits) | values >> bits
    order = np.argsort(key)
    key, sorted_values = key[order], values[order]
    if ((key[1:] == key[:-1]) & (sorted_values[1:] != sorted_values[:-1])).any():
        order = np.lexsort((values, owners))
        sorted_values = values[order]
    values, owners = sorted_values, owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[new], owners[new]


def need(overlap_of: np.ndarray | int, percent: int) -> np.ndarray:
    """The least overlap that a set of this size has with any set of at least this likeness."""
    return -(-np.asarray(overlap_of) * percent // 100)


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)


#: Rows of a packed exchange: columns of many items of one kind as raw arrays, for one partition.
PACKED = "route int, kind int, " + ", ".join(f"c{k} binary" for k in range(6))
_PACKED = pa.schema([("route", pa.int32()), ("kind", pa.int32()), *[(f"c{k}", pa.binary()) for k in range(6)]])


def packed(kind: int, route: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Items as one row per route; items keep their order within a route, and few bytes each."""
    if not len(route):
        return
    order = np.argsort(route.astype(np.uint16) if route.max() < 2**16 else route, kind="stable")  # 16 bits: a radix sort
    route = route[order]
    cuts = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
    ends = np.append(cuts[1:], len(route))
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    blobs = [[c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for c in columns]
    blobs += [[None] * len(cuts)] * (6 - len(blobs))
    yield pa.RecordBatch.from_arrays([pa.array(route[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], schema=_PACKED)


def packed_rows(kind: int, route: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each route: of every column, an array and where each row's share of it begins and ends."""
    blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for c, cut in columns]
    blobs += [pa.nulls(len(route), pa.binary())] * (6 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array(route.astype(np.int32)), pa.array(np.full(len(route), kind, np.int32)), *blobs], schema=_PACKED)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] places), then the same of the next."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[int, list[str]]) -> dict[int, list[np.ndarray]]:
    """All items of a partition: for each kind the columns, of the given numpy types."""
    held: dict[int, list[list[bytes]]] = {k: [[] for _ in types] for k, types in kinds.items()}
    for batch in batches:
        which = batch.column("kind").to_numpy()
        for k, lists in held.items():
            own = np.flatnonzero(which == k)
            if len(own):
                for j, into in enumerate(lists):
                    column = batch.column(f"c{j}").take(pa.array(own))
                    into.extend(x.as_buffer() for x in column)
    return {k: [np.frombuffer(b"".join(x), t) for x, t in zip(lists, kinds[k], strict=True)] for k, lists in held.items()}


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, one by one."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def exchanged(df: DataFrame) -> DataFrame:
    """Packed rows, each in the partition that its route names."""
    return df.repartitionById(shuffle_partitions(df.sparkSession), F.col("route"))


def routes(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partitions of 64-bit hashes."""
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts (1 each if none are given)."""
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(counts, cuts) if len(keys) else counts


class Tally:
    """Counts by key, merged now and then so that a task holds little more than its distinct keys."""

    def __init__(self, limit: int = 1_500_000):
        self.limit, self.size, self.parts = limit, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append(summed(keys, counts))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            merged = self.result()
            self.parts, self.size = [merged], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) == 1:
            return self.parts[0]
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


class Index:
    """Places of 64-bit keys, by open addressing in numpy arrays."""

    _EMPTY = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(2, 4 * n / 3))))))
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        place = np.maximum.accumulate(home[order] - np.arange(n)) + np.arange(n) if n else np.zeros(0, np.int64)
        size = (1 << (64 - int(self.shift))) + (int(place[-1]) + 2 if n else 2)
        self.keys = np.full(size, self._EMPTY, np.uint64)
        self.at = np.full(size, -1, np.int32)
        self.keys[place] = keys[order]
        self.at[place] = order

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the array it was made of, or -1."""
        place = self._home(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.at[place], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != self._EMPTY))
        while len(left):
            place[left] += 1
            there = self.keys[place[left]]
            hit = there == keys[left]
            out[left[hit]] = self.at[place[left[hit]]]
            left = left[~hit & (there != self._EMPTY)]
        return out


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` word hashes from each place on, across texts too; the last places are cut off."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, total, done = hashes, 1, None, 0
    while True:
        if width & size:
            part = power[done : done + n]
            total = part.copy() if total is None else mix(total * np.uint64(0x9FB21C651E98DF25) + part)
            done += size
        if done == width:
            return total
        power = mix(power[:-size] * np.uint64(0x9FB21C651E98DF25) + power[size:])
        size *= 2


_made: list = []


def once(value, make):
    """make(value), kept by the worker for the next task that has the same broadcast value."""
    if not _made or _made[0] is not value:
        _made[:] = [value, make(value)]
    return _made[1]


#: Added to the kind of counted keys: histograms of their counts.
HISTOGRAM = 100


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts as levels: exact below 256, sixteen to a doubling from there."""
    return np.where(counts < 256, counts, 128 + (16 * np.log2(np.maximum(counts, 1))).astype(np.int64))


def histogram(kind: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a partition's distinct keys: how many have each level of counts, and the sum of their counts."""
    if len(counts):
        level, back = np.unique(_level(counts), return_inverse=True)
        yield from packed(HISTOGRAM + kind, np.zeros(len(level), np.int32), level, np.bincount(back).astype(np.int64), np.bincount(back, counts).astype(np.int64))


def heads(counts: DataFrame, kind: int, most: int, value: str = "") -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of packed (key, count) items of one kind, distinct by key, beside their histograms: the keys of the highest counts.

    Returns at most ``most`` keys, ascending (counts of one level are all in or
    all out), their counts (or, if ``value`` is a numpy type, the items' third
    column), the number of all keys and the sum of all counts.
    """

    def head(batches):
        for _, (keys, n, *more) in unpacked(batches, {kind: ["u8", "i8", *([value] if value else [])]}).items():
            own = _level(n) >= least
            if own.any():
                yield pa.RecordBatch.from_pydict({"k": [keys[own].tobytes()], "n": [[n, *more][-1][own].tobytes()]})

    rows = counts.filter(F.col("kind") == HISTOGRAM + kind).toArrow().to_batches()  # a thousand levels a partition at most
    level, many, total = unpacked(iter(rows), {HISTOGRAM + kind: ["i8", "i8", "i8"]})[HISTOGRAM + kind]
    level, many = summed(level, many)
    above = np.cumsum(many[::-1])[::-1]
    least = int(level[above <= most][0]) if (above <= most).any() else int(level[-1]) + 1 if len(level) else 0
    got = counts.filter(F.col("kind") == kind).mapInArrow(tidied(head), "k binary, n binary").toArrow().to_pylist()
    keys = np.frombuffer(b"".join(r["k"] for r in got), "u8")
    n = np.frombuffer(b"".join(r["n"] for r in got), value or "i8")
    order = np.argsort(keys)
    return keys[order], n[order], int(many.sum()), int(total.sum())


def beside(result: pa.Table, rows: pa.Table) -> pa.Table:
    """A result with the columns keep0, keep1, ... of the rows it was made of."""
    for name in rows.column_names:
        if name.startswith("keep"):
            result = result.append_column(name, rows.column(name))
    return result


def beside_schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    kinds = dict(docs.dtypes)
    return "".join(f", keep{i} {kinds[c]}" for i, c in enumerate(keep))
