"""Token ids of whole texts by a public byte-level BPE vocabulary.

Method: the vocabulary becomes a sentencepiece BPE model, written directly in its wire format: every token is a
piece of byte-mapped characters with its negative rank as score, and normalisation is the identity. Texts are cut
into pre-tokens by the vocabulary's pattern, their bytes mapped to characters and encoded; decoding maps back.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.session import table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Units and pre-tokens that a worker remembers, beyond which the memory starts anew; longer units aren't kept.
REMEMBERED, LONG_UNIT = 400_000, 200


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one in Latin-1, else the next one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; one unknown piece, never used, follows them.

    Field numbers are those of the public sentencepiece model format.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks have to be 0, 1, 2, ...")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a vocabulary has to hold every byte")
    chars = byte_characters()
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    out = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _field(3, 1)) for token, rank in pieces]
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Codec:
    """Encodes and decodes whole texts; one per worker."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.bytes = {c: b for b, c in self.chars.items()}
        self.gap = re.compile(r"\s (?:\s|$)").search
        self.units: dict[str, tuple] = {}
        self.pieces: dict[str, tuple] = {}

    def encode(self, texts: list[str | None]) -> list[array]:
        """The ids of each text; null and empty texts have none.

        A text without white space on both sides of a blank falls into units, a blank with all up to the next one,
        that no pre-token crosses. Units are remembered with their ids; other texts are one unit each, not kept.
        """
        units = []
        for t in texts:
            if not t:
                units.append(())
            elif self.gap(t):
                units.append((t,))
            else:
                first, *rest = t.split(" ")
                units.append([first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest)))
        new = [u for u in set().union(*units) if u not in self.units]
        cut = [self.find(u) for u in new]
        fresh = [p for p in set().union(*cut) if p not in self.pieces]
        mapped = [p.encode().decode("latin-1").translate(self.chars) for p in fresh]
        self.pieces.update(zip(fresh, map(tuple, self.model.encode(mapped, num_threads=1))))
        get = self.pieces.__getitem__
        self.units.update(zip(new, (tuple(chain.from_iterable(map(get, c))) for c in cut)))
        get = self.units.__getitem__
        out = [array("i", chain.from_iterable(map(get, u))) for u in units]
        for u in new:
            if len(u) > LONG_UNIT:
                del self.units[u]
        for p in fresh:  # so what is remembered is bounded in size, not only in number
            if len(p) > LONG_UNIT:
                del self.pieces[p]
        if len(self.units) + len(self.pieces) > REMEMBERED:
            self.units.clear()
            self.pieces.clear()
        return out

    def decode(self, ids) -> str:
        pieces = self.model.id_to_piece([int(i) for i in ids])
        return bytes(self.bytes[c] for p in pieces for c in p).decode()


def encode_column(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", pattern: str = PATTERN, check: bool = False) -> DataFrame:
    """(key, ids) of each row of `df`: the token ids of its whole `text`; with `check`, also n_ids and round_trip.

    Null and empty texts have an empty list. Names of special tokens in a text are plain text. Repeated keys and
    texts stay repeated; other columns are left out, whatever their names. The model, about 1 MB, is made from the
    vocabulary file at `path` and broadcast.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(path)))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = codec.encode(texts)
                ends = [0]
                for x in ids:
                    ends.append(ends[-1] + len(x))
                flat = array("i")
                for x in ids:
                    flat.extend(x)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32()))
                columns, names = [part.column(0), lists], ["key", "ids"]
                if check:
                    columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts)])]
                    names = ["key", "n_ids", "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = f"key {key_type}, n_ids bigint, round_trip boolean" if check else f"key {key_type}, ids array<int>"
    return rows.mapInArrow(run, shape).withColumnRenamed("key", key)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids of each document, and whether they decode to its text."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", check=True)


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL: dict[str, str] = {}
