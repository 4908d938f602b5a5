"""Byte-level BPE by way of a sentencepiece model that is written out from the ranks.

The ranks of a byte-level vocabulary are put into a sentencepiece model file directly, field by
field: every token becomes a piece whose bytes are mapped to printable characters and whose score
is the negative rank, and normalisation is the identity. Pre-tokens (each match of the pattern) are
encoded one by one by that model, those that are whole tokens as such; decoding reads the ids'
pieces from the model and maps their characters back to bytes. Bytes without a piece are an error.

Null texts count as empty: no ids, empty bytes. No row is dropped, repeated rows stay.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import releasing

#: Pre-tokens whose ids are held in memory at once; a cache, emptied when full.
CACHE = 100_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order."""
    pairs = sorted((int(r), base64.b64decode(t)) for t, r in (x.split() for x in open(path, "rb") if x.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 ...")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece r+1 is the token of rank r."""
    table = byte_characters()
    pieces = [_block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)]
    for rank, token in enumerate(tokens):
        name = "".join(table[b] for b in token).encode()
        pieces.append(_block(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, 1))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, (1 << 64) - 1) + _number(42, (1 << 64) - 1) + _number(43, (1 << 64) - 1)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, normalizer)


class ByteBpe:
    """Encoder and decoder over one rank file and pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        # in the pattern \s is Unicode White_Space, which U+001C to U+001F are not
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.letters = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.letters.items()}
        #: The bytes of the model's own pieces, by the inverse of the characters; piece r + 1 is rank r.
        self.bytes = [bytes(map(back.__getitem__, self.model.id_to_piece(i + 1))) for i in range(len(tokens))]
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.known: dict[str, tuple[int, ...]] = {}

    def _piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        if (rank := self.whole.get(data)) is not None:
            return (rank,)
        ids = self.model.encode(data.decode("latin-1").translate(self.letters))
        if 0 in ids:
            raise ValueError(f"the vocabulary has no pieces for {data!r}")
        return tuple(i - 1 for i in ids)

    def encode(self, text: str | None) -> list[int]:
        found = self.split(text or "")
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for piece in set(found).difference(known):
            known[piece] = self._piece(piece)
        return list(chain.from_iterable(map(known.__getitem__, found)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """keep columns, then n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids of each text.

    ranks_path is read where the task runs, as every machine has the vocabulary's package.
    """
    source = docs.select(*keep, docs[text].alias("__text"))
    fields = [*source.schema.fields][:-1]
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] + [StructField("token_ids", ArrayType(IntegerType()))] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(read_ranks(ranks_path), pattern)
        names = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, decoded, lists = [], [], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    got = bpe.encode(text)
                    counts.append(len(got))
                    digests.append(hashlib.sha256(",".join(map(names.__getitem__, got)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                    if ids:
                        lists.append(got)
                more = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())] + [pa.array(lists, pa.list_(pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[f.name for f in schema.fields])

    return source.mapInArrow(releasing(run), schema)
