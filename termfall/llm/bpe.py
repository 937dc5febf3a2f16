"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Nothing is trained. Each token of the vocabulary becomes a piece of printable characters, one per byte (the usual
byte-to-character map), scored by its negative rank; normalisation is the identity and no prefix is added. A
sentencepiece BPE encoder then merges the best-scored neighbours first, leftmost first on ties, which is what rank-ordered
byte merges do. Every match of the split pattern is encoded by itself. A piece that is a token as a whole is that token.
Decoding maps ids to pieces, pieces to characters and characters back to bytes.

The model is a few MB whatever the corpus size and is broadcast; the rank file is read by the driver only, from a path
that the caller gives.

Edge cases: a null or empty text has no ids and decodes to no bytes; texts are read whole; control-token strings in a
text are ordinary text; repeated rows each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


#: Characters of encoded pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 4 << 20

#: \s of the split pattern as Unicode's White_Space, spelled out: engines differ on U+001C to U+001F.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, then the unknown piece."""
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int_field(3, 1))
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2))
    trainer = _int_field(3, 2) + _int_field(4, len(tokens) + 1) + _int_field(40, len(tokens)) + _int_field(41, -1) + _int_field(42, -1) + _int_field(43, -1)
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return bytes(out + _bytes_field(2, trainer) + _bytes_field(3, normaliser))


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        import sentencepiece

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"), regex.V0).findall
        self.table = {i: c for i, c in enumerate(byte_chars())}
        back = {c: bytes([i]) for i, c in self.table.items()}
        # The inverse map, from the pieces that the model itself holds.
        self.pieces = [b"".join(back[c] for c in self.processor.id_to_piece(i)) for i in range(len(tokens))]
        self.known: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def learn(self, parts: list[str]) -> None:
        """Encode the pre-tokens that aren't remembered, in one call."""
        new, merged = {p for p in set(parts) if p not in self.known}, []
        for piece in new:
            self.size += len(piece) + 16
            raw = piece.encode()
            whole = self.ids.get(raw)
            if whole is None:
                merged.append((piece, raw.decode("latin-1").translate(self.table)))
            else:
                self.known[piece] = (whole,)
        found = self.processor.encode([x for _, x in merged], num_threads=1) if merged else []
        self.known.update((piece, tuple(ids)) for (piece, _), ids in zip(merged, found, strict=True))

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        parts = self.split(text)
        self.learn(parts)
        return list(chain.from_iterable(map(self.known.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_BUILT: dict[tuple[int, str], Codec] = {}


def _worker_codec(shared, pattern: str) -> Codec:
    key = (id(shared), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Codec(shared.value, pattern)
    return _BUILT[key]


_DDL = "struct<n_tokens: bigint, ids: array<int>, ids_sha256: string, decoded_sha256: string>"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per document: id, number of tokens, ids (on demand), digests of the ids and of the decoded bytes."""
    small_batches(docs.sparkSession)
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    ids_type = pa.list_(pa.int32())
    kind = pa.struct([("n_tokens", pa.int64()), ("ids", ids_type), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf(_DDL)
    def encoded(texts: pa.Array) -> pa.Array:
        codec, rows = _worker_codec(tokens, pattern), []
        names = _names(len(codec.tokens))
        for t in texts:
            ids = codec.encode(t.as_py() or "")
            rows.append((len(ids), ids if with_ids else None, hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    out = docs.select(F.col(id_col), encoded(F.col(text_col)).alias("__bpe"))
    return out.select(id_col, *[F.col(f"__bpe.{n}").alias(n) for n in ("n_tokens", "ids", "ids_sha256", "decoded_sha256") if with_ids or n != "ids"])


@lru_cache(2)
def _names(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def decode_ids(frame: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of frame and the bytes that each list of ids stands for (null ids: null)."""
    small_batches(frame.sparkSession)
    tokens = frame.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        codec = _worker_codec(tokens, pattern)
        return pa.array([None if x.as_py() is None else codec.decode(x.as_py()) for x in lists], type=pa.binary())

    return frame.withColumn(out_col, decoded(F.col(ids_col)))


def production() -> tuple[str, str]:
    """The rank file and split pattern that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
