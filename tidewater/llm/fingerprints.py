"""Document fingerprints by randomised edit embedding.

All texts are walked along the same random walk: at step j the character under
the walk decides, by a hash shared by all texts, whether the walk moves on, so
texts a few edits apart fall back into step and differ in few places of the
embedding.  The fingerprint keeps four bits of the steps that a shared sample
names (all of the first ones, for short texts), one hexadecimal digit each; likeness is the share of equal digits,
corrected for chance.

``fingerprint`` works on every row alone.  ``with_next`` also looks at the next
document in descending order of ids: ids are cut into parts at some of their
own values, a part's first rows go to the part before it as well, and so every
part has all it needs.  ``similar`` bands all digits, compares each document with
the leader of each of its buckets, and with all others where that isn't alike.

Null text counts as empty, whose fingerprint is empty (like another empty one 1,
like any other 0).  Null ids come last; rows of one id follow the order of their
texts.  An empty table gives an empty result.  Extra columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gathered, mix, shuffle_partitions, tidied

#: One step in so many is sampled, from the first step on that isn't below the other number.
SAMPLES = ((1, 0), (2, 32), (4, 64), (8, 128), (16, 256))
_MUL = np.uint64(0xD6E8FEB86659FD93)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Bytes of text in one lockstep walk.
TOGETHER = 8_000_000
_NONE = -(2**63)


def fingerprints(texts: list[str]) -> list[bytes]:
    """The hexadecimal digits of each text's sampled steps."""
    size = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.empty(len(chars), np.uint64)
    for a in range(0, len(chars), 1_000_000):
        code[a : a + 1_000_000] = mix(chars[a : a + 1_000_000].astype(np.uint64) + np.uint64(1))
    del chars
    end = np.cumsum(size)
    who = np.flatnonzero(size > 0).astype(np.int32)
    place, stop = (end - size)[who], end[who]
    owners, digits = [], []
    step = 0
    while len(who):
        seeds = mix(np.arange(step + 1, step + 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for j, seed in enumerate(seeds, step):
            rate = next(r for r, at in reversed(SAMPLES) if j >= at)
            value = (code[place] ^ seed) * _MUL
            if not int(seed) % rate:
                owners.append(who)
                digits.append(((value >> np.uint64(40)) & np.uint64(15)).astype(np.uint8))
            place += (value >> np.uint64(63)).astype(np.int64)
            alive = place < stop
            if not alive.all():
                who, place, stop = who[alive], place[alive], stop[alive]
                if not len(who):
                    break
        step += 1024
    if not owners:
        return [b""] * len(texts)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    line = _DIGITS[np.concatenate(digits)[order]].tobytes()
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1)).tolist()
    return [line[a:b] for a, b in zip(cuts, cuts[1:])]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the share of equal digits beyond chance; digits that one lacks don't agree."""
    most = max(len(a), len(b))
    if not most:
        return 1.0
    least = min(len(a), len(b))
    equal = int(np.count_nonzero(np.frombuffer(a, np.uint8, least) == np.frombuffer(b, np.uint8, least))) if least else 0
    return max(0.0, (equal / most - 1 / 16) / (15 / 16))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, fingerprint of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for table in gathered(batches, limit=TOGETHER):
            texts = table.column("text").fill_null("").to_pylist()
            yield from pa.table({"id": table.column("id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": pa.array([x.decode() for x in fingerprints(texts)], pa.string())}).to_batches()

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(tidied(run), f"id {kind}, n_chars bigint, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is taken from the next document's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts + 1)], 100_000)).first()[0]
    bounds = np.array(sorted(set(cuts or [])), np.int64)  # one value per part at most
    last = max(0, len(bounds) - 1)

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            part = last - np.searchsorted(bounds, ids)
            firsts = np.flatnonzero(bounds[last - part] == ids) if len(bounds) else np.zeros(0, np.int64)
            before = np.where(part[firsts] > 0, part[firsts] - 1, last)
            take = pa.array(np.concatenate([np.arange(len(ids)), firsts]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([part, before]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(ids), bool), np.ones(len(firsts), bool)])),
                batch.column("doc_id").take(take),
                batch.column("text").take(take),
            ], names=["part", "ghost", "doc_id", "text"])

    def walk(ids: list[int], texts: list[str]) -> pa.Table:
        """All but the last text, each with the one after it."""
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
        made = fingerprints(texts + edited)
        own, other = made[: len(texts)], made[len(texts) :]
        return pa.table({
            "doc_id": pa.array([None if x == _NONE else x for x in ids[:-1]], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array([x.decode() for x in own[:-1]], pa.string()),
            "edited_fingerprint": pa.array([x.decode() for x in other], pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        })

    def run(batches):
        held: tuple[list, list] = ([], [])
        for table in gathered(batches, limit=TOGETHER):
            real = table.column("ghost").to_numpy(zero_copy_only=False)
            many = int(np.count_nonzero(~real))
            ids, texts = (table.column(c).slice(0, many + (many < table.num_rows)).to_pylist() for c in ("doc_id", "text"))
            ids, texts = held[0] + ids, held[1] + texts
            if len(ids) > 1:
                yield from walk(ids, texts).to_batches()
            if many < table.num_rows:
                return
            held = (ids[-1:], texts[-1:])

    dealt = rows.mapInArrow(tidied(deal), "part int, ghost boolean, doc_id bigint, text string").repartitionById(parts, F.col("part"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.sortWithinPartitions("ghost", F.desc("doc_id"), "text").mapInArrow(tidied(run), schema)


def band_widths(n: int, share: float) -> list[int]:
    """Widths of the bands of a fingerprint of n digits, for equal digits of at least this share of the longer one.

    If a longer fingerprint of m digits has more whole bands of its width than
    it may have other digits, one band at least is equal in both; a missing
    digit is another digit and spoils no band twice.  So every fingerprint uses
    the widths of all lengths that it may be compared with.
    """
    if not n:
        return []
    other = max(1.0 - share, 1e-6)
    widest = min(32, max(1, int(np.ceil(1 / other - 1e-9)) - 1))
    fits = lambda m, w: m // w > int(other * m + 1e-9)
    return sorted({next((w for w in range(widest, 1, -1) if fits(m, w)), 1) for m in range(n, int(n / max(share, 1e-6) + 1e-9) + 1)})


def similar(found: DataFrame, id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """Links (a, b, likeness), a > b, between alike documents, with the same components as all alike pairs.

    Bands cover the whole fingerprint, and alike ones share a band (see
    band_widths).  Equal fingerprints link to their smallest id, which stands
    for them.  Every bucket's members are compared with its smallest id, and
    those that it isn't alike with all other members, so links grow with the
    documents but for such members.  Rows without an id have no links.
    """
    share = threshold * 15 / 16 + 1 / 16
    rows = found.select(F.col(id_col).alias("a"), F.col("fingerprint").alias("f")).filter("a IS NOT NULL")
    alone = checkpointed(rows.withColumn("h", F.xxhash64("f")).groupBy("h", "f").agg(F.min("a").alias("a")))

    @F.pandas_udf("array<string>")
    def bands(f):
        widths = {n: band_widths(n, share) for n in set(f.str.len())}
        return f.map(lambda x: [f"{w}:{i}:{x[i : i + w]}" for w in widths[len(x)] for i in range(0, len(x) - w + 1, w)])

    @F.pandas_udf("double")
    def alike(f, g):
        import pandas as pd

        return pd.Series([likeness(x.encode(), y.encode()) for x, y in zip(f, g)])

    def compared(pairs: DataFrame) -> DataFrame:
        one = alone.select("h", "a", "f")
        both = pairs.join(one, "h").join(one.select(F.col("h").alias("l"), F.col("a").alias("b"), F.col("f").alias("g")), "l")
        return both.select("h", "l", "a", "b", alike("f", "g").alias("likeness"))

    banded = alone.select("h", "a", F.explode(bands("f")).alias("key"))
    leaders = banded.groupBy("key").agg(F.min(F.struct("a", "h"))["h"].alias("l"))
    led = checkpointed(banded.join(leaders, "key").filter("h != l").select("key", "h", "l"))
    first = checkpointed(compared(led.select("h", "l").distinct()))
    left = led.join(first.filter(F.col("likeness") < threshold).select("h", "l"), ["h", "l"]).select("key", "h")
    more = left.join(banded.select("key", F.col("h").alias("l")), "key").filter("h != l").select(F.greatest("h", "l").alias("h"), F.least("h", "l").alias("l")).distinct()
    equal = rows.join(alone.select("f", F.col("a").alias("b")), "f").select("a", "b", F.lit(1.0).alias("likeness"))
    links = first.unionByName(compared(more)).filter(F.col("likeness") >= threshold).select("a", "b", "likeness").unionByName(equal)
    return links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "likeness").distinct()
