"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to one printable character, every vocabulary entry becomes a piece of such characters with score
-rank, and the normaliser is the identity, so the model's merges are those of the rank file. Texts are split by the
tokenizer's pattern and each pre-token is encoded by itself; decoding maps ids back to bytes.

Rows: a null text counts as empty (no ids). Empty texts have no ids, repeated rows give equal rows, an empty table gives
an empty one. Texts of any length are encoded whole. Columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm.common import runs, table, texts_of

#: Bytes of pre-tokens whose ids a worker remembers, each counted with ENTRY_BYTES more for its place; past this it starts afresh, so
#: its memory stays bounded, whatever the pre-tokens' number and length. Longer ones than LONG_TOKEN are encoded anew each time.
CACHE_BYTES, ENTRY_BYTES, LONG_TOKEN = 96 << 20, 200, 1 << 12
#: Bytes of text encoded together.
CHUNK_BYTES = 4 << 20


def byte_characters() -> list[str]:
    """One printable character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    found, spare = [], 0x100
    for byte in range(256):
        found.append(chr(byte) if byte in printable else chr(spare))
        spare += byte not in printable
    return found


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank. Ranks must be 0, 1, 2 and so on, and every single byte must occur."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    pieces = [ranked[i] for i in range(len(ranked))]
    if len(set(pieces)) != len(pieces) or len({p for p in pieces if len(p) == 1}) != 256:
        raise ValueError(f"{path}: not a byte-level vocabulary")
    return pieces


def _field(number: int, wire: int, body: bytes) -> bytes:
    return _varint(number << 3 | wire) + body


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _block(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE ModelProto: ids are ranks, scores negative ranks, and one unknown piece follows at the end."""
    names = byte_characters()
    body = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(names[b] for b in piece).encode()
        body += _block(1, _block(1, text) + _field(2, 5, struct.pack("<f", -float(rank))))
    unknown = b"<unknown>"
    body += _block(1, _block(1, unknown) + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    n = len(pieces)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(n + 1)) + _field(40, 0, _varint(n))
    for number in (41, 42, 43):  # no marks for begin, end and padding
        trainer += _field(number, 0, _varint(-1))
    trainer += _block(45, unknown)
    normaliser = _block(1, b"identity") + b"".join(_field(k, 0, _varint(0)) for k in (3, 4, 5))
    return bytes(body + _block(2, trainer) + _block(3, normaliser))


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pieces = pieces
        self.whole = {piece: struct.pack("<I", rank) for rank, piece in enumerate(pieces)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(pieces))
        self.letters = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, tokens: list[str]) -> list[bytes]:
        """A token that is a vocabulary entry has its own id, as merges may not reach it."""
        found = [self.whole.get(t.encode()) for t in tokens]
        rest = [k for k, ids in enumerate(found) if ids is None]
        mapped = [tokens[k].encode().decode("latin-1").translate(self.letters) for k in rest]
        for k, ids in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
            found[k] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        tokens = set().union(*split)
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        fresh = [t for t in tokens if t not in self.known]
        ids = dict(zip(fresh, self._ids(fresh), strict=True))
        short = {t: x for t, x in ids.items() if len(t) <= LONG_TOKEN}
        self.known.update(short)
        self.held += sum(len(t) + len(x) + ENTRY_BYTES for t, x in short.items())
        if len(short) == len(ids):
            known = self.known.__getitem__
            return [b"".join(map(known, parts)) for parts in split]
        return [b"".join([self.known.get(t) or ids[t] for t in parts]) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, pieces: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary) of every row, without a shuffle. The vocabulary (bounded: one file) goes along by broadcast."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(shared.value, pattern)
        for batch in runs(batches, CHUNK_BYTES):
            ids = coder.encode([t.decode("utf-8", "replace") for t in texts_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())], names=["id", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind.simpleString()}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, pieces: list[bytes], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the round trip of every document as digests, made in one pass."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(shared.value, pattern)
        for batch in runs(batches, CHUNK_BYTES):
            ids = coder.encode([t.decode("utf-8", "replace") for t in texts_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> tuple[list[bytes], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), *default_vocabulary())
