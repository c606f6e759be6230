"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``encode(docs)`` adds ids (and, asked for, character offsets) to every row;
``decode`` turns ids back into bytes by reversing the byte table, and
``decode_text`` joins characters that were split over several ids.

Texts are cut before single spaces, where no token can reach across, and every
distinct piece is encoded once per worker, in batches; a text with other
spacing around its spaces is encoded whole.  Null or empty text: no ids.
Repeated rows, ties and clashing extra columns don't matter: only the id and
text columns are read and every row is worked on alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import gathered, tidied

#: Pieces that a worker keeps ids of, at most; then it starts anew.
CACHE = 1_000_000
#: White space beside a space, where a cut could change tokens.
_UNSAFE = re.compile(r"\s | \s")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def spaced(text: str) -> list[str]:
    """The text cut before each space."""
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def encode_pieces(tokenizer, known: dict[str, bytes], cut: list[list[str]]) -> list[bytes]:
    """Joined ids of each text's pieces; pieces not in ``known`` are encoded in one batch and kept there.

    Pieces of over 200 characters aren't kept.  ``known`` is emptied when it
    would hold more than CACHE pieces besides this batch's.
    """
    missing = {x for pieces in cut for x in pieces if x not in known}
    if len(known) + len(missing) > CACHE:
        known.clear()
        missing = {x for pieces in cut for x in pieces}
    fresh = list(missing)
    for piece, e in zip(fresh, tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
        known[piece] = np.array(e.ids, "<u4").tobytes()
    out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
    for piece in fresh:
        if len(piece) > 200:
            del known[piece]
    return out


def byte_table() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for.

    Printable bytes stand for themselves, the others for the characters from
    256 on, in ascending order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    return table


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        table = byte_table()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.tokenizer.get_added_tokens_decoder()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[i] = token.content.encode()
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [[x] if _UNSAFE.search(x) else spaced(x) for x in texts]
        return encode_pieces(self.tokenizer, self.known, cut)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The characters [from, to) of the text that each id covers, wholly or in part."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text as it becomes complete: a character split over ids appears with its last one."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.bytes_of[i])
        yield decoder.decode(b"", final=True)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of this file, made once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row per document: id_col, ids array<int>, and offsets array<struct<start,end>> if asked for."""
    kind = dict(docs.dtypes)[id_col]
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for table in gathered(batches, "text"):
            texts = table.column("text").fill_null("").to_pylist()
            ids = codec(path).ids(texts)
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            out = {"id": table.column("id"), "ids": lists}
            if offsets:
                out["offsets"] = pa.array([[{"start": a, "end": b} for a, b in codec(path).offsets(t)] for t in texts], pairs)
            yield from pa.table(out).to_batches()

    schema = f"id {kind}, ids array<int>" + ", offsets array<struct<start:int,end:int>>" * offsets
    got = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(tidied(run), schema)
    return got.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id_col, decoded binary (the exact bytes), text string (broken characters replaced)."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            raw = [codec(path).decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield from pa.table({"id": batch.column("id"), "decoded": pa.array(raw, pa.binary()), "text": pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())}).to_batches()

    return encoded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(tidied(run), f"id {kind}, decoded binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, exact (the bytes came back)."""

    def run(batches):
        for table in gathered(batches, "text"):
            texts = table.column("text").fill_null("").to_pylist()
            c = codec(path)
            ids = c.ids(texts)
            back = [c.decode(x) for x in ids]
            yield from pa.table({
                "doc_id": table.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                "exact": pa.array([x == t.encode() for x, t in zip(back, texts, strict=True)], pa.bool_()),
            }).to_batches()

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(tidied(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean")
