"""Operator 3: byte-level BPE through a sentencepiece model that is serialised from a rank file.

The rank file's tokens become pieces, each byte written as one printable character, scored by negative rank, so that
sentencepiece's best-score merges are the lowest-rank merges. Texts are cut by the vocabulary's pattern; every match
is encoded by itself, and ids are decoded by mapping pieces back to bytes.

Nulls and empty texts give no tokens and the hash of nothing. Repeated rows give repeated results; other columns are
never read. A match of any length is one call of the library, whose cost is near linear in its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from lodestone.llm.common import map_rows, texts_of

#: Cached pre-tokens of a task; beyond it the cache starts anew.
CACHE = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def byte_alphabet() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, the others count on from U+0100."""
    spare = iter(range(0x100, 0x200))
    shows = lambda b: 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
    return [chr(b) if shows(b) else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    import struct

    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, one unknown piece behind them, identity normalisation.

    Field numbers are those of the published sentencepiece_model.proto.
    """
    letters = byte_alphabet()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [rank for _, rank in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for token, rank in ordered:
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, float(-len(ordered))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ordered) + 1) + _field(40, len(ordered)) + b"".join(_field(i, -1) for i in (41, 42, 43))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteBpe:
    """Encodes and decodes with the serialised model; a cache keeps the ids of pre-tokens seen before."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        letters = byte_alphabet()
        self.to_letters = {b: letters[b] for b in range(256)}
        self.to_byte = {ch: b for b, ch in enumerate(letters)}
        n = self.processor.get_piece_size() - 1
        self.pieces = [bytes(self.to_byte[ch] for ch in self.processor.id_to_piece(i)) for i in range(n)]
        self.cache: dict[str, list[int]] = {}

    def encode_part(self, part: str) -> list[int]:
        ids = self.cache.get(part)
        if ids is None:
            ids = self.processor.encode(part.encode().decode("latin-1").translate(self.to_letters), num_threads=1)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(part) <= 64:
                self.cache[part] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.split(text or ""):
            out += self.encode_part(part)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def coder(path: str, pattern: str) -> Callable[[], ByteBpe]:
    """Makes the coder on an executor. The model travels with the task: its size is that of one vocabulary file."""
    model = serialise(read_ranks(path))
    return lambda: ByteBpe(model, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every whole text."""
    make = coder(path, pattern)

    def start():
        bpe = make()
        return lambda batch: pa.RecordBatch.from_arrays([batch["id"], pa.array([bpe.encode(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    rows = texts_of(df, id_col, text_col)
    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: the bytes of every list of ids; a null list is no bytes."""
    make = coder(path, pattern)

    def start():
        bpe = make()
        return lambda batch: pa.RecordBatch.from_arrays([batch["id"], pa.array([bpe.decode(ids or ()) for ids in batch["ids"].to_pylist()], pa.binary())], ["id", "decoded"])

    rows = df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids")
    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, so that neither is moved."""
    make = coder(path, pattern)

    def start():
        bpe = make()
        return lambda batch: _digests(bpe, batch)

    rows = texts_of(df, id_col, text_col)
    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _digests(bpe: ByteBpe, batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, ids_of, bytes_of = [], [], []
    for text in batch["text"]:
        ids = bpe.encode(text.as_py())
        counts.append(len(ids))
        ids_of.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        bytes_of.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
    return pa.RecordBatch.from_arrays([batch["id"], pa.array(counts, pa.int64()), pa.array(ids_of, pa.string()), pa.array(bytes_of, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
