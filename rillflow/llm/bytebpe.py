"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from a rank file.

The rank vocabulary is written as a sentencepiece ModelProto: each token's bytes are mapped to
printable characters one to one, its score is the negative rank, and normalisation is the
identity. sentencepiece then merges the best-ranked adjacent pair first, leftmost on ties, as the
rank encoder does. A pre-token that is itself a token is taken whole, as the rank encoder does.

Defined results: null or empty text has no ids, and the hash of the empty string; rows are
independent; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import Memo, small_batches, texts_of

#: Unicode White_Space: what `\s` is to the rank encoder's pattern.
SPACE = "\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """A character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of the protobuf wire format."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE ModelProto; token i is piece i + 1, after the unknown piece."""
    shown = byte_characters()
    unknown = "<unk>".encode()
    pieces = [_field(1, unknown) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(shown[b] for b in t).encode()) + _field(2, float(-i)) for i, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, unknown)
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(ranks_path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        if any(bytes([b]) not in self.whole for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.pattern = regex.compile(pattern)
        #: No match passes from a non-space to a space, so such segments are encoded independently.
        self.cut = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.memo = Memo(self._segment, 60_000_000)

    def pre_token(self, piece: str) -> list[int]:
        raw = piece.encode()
        known = self.whole.get(raw)
        if known is not None:
            return [known]
        return [i - 1 for i in self.sp.encode(raw.decode("latin-1").translate(self.shown))]

    def _segment(self, segment: str) -> tuple[int, str, bytes]:
        ids = [i for piece in self.pattern.findall(segment) for i in self.pre_token(piece)]
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return [int(i) for s in self.cut.findall(text) for i in self.memo[s][1].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        got = list(map(self.memo.__getitem__, self.cut.findall(text)))
        ids = hashlib.sha256(",".join([x[1] for x in got]).encode()).hexdigest()
        return sum([x[0] for x in got]), ids, hashlib.sha256(b"".join([x[2] for x in got])).hexdigest()


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def encode_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of `df`; one scan, no shuffle."""
    small_batches(df.sparkSession)

    def run(batches):
        own = encoder(ranks_path, pattern)
        for b in batches:
            got = [own.digest(t.decode("utf-8", "replace")) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every text."""
    small_batches(df.sparkSession)

    def run(batches):
        own = encoder(ranks_path, pattern)
        for b in batches:
            ids = [own.encode(t.decode("utf-8", "replace")) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, ids array<int>")
