"""Byte-level BPE encoding and decoding.

The rank file of a public byte-level vocabulary is serialised, without any
training, as a sentencepiece BPE model: one piece a rank, its bytes mapped to
printable characters, its score the negative rank, and an identity
normalisation. Pre-tokens (matches of the splitting pattern) are encoded by
that model one by one; ids are decoded by inverting the byte mapping.

Defined results: null or empty text has no ids; any valid UTF-8 text round-trips
byte for byte; a pre-token that is itself a rank gets that id whole; repeated
rows are encoded alike; a ``keep`` column named like a result comes out as
``kept_`` and its name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import carried, small_batches

#: Pre-tokens whose ids a worker remembers; as many again, the ones before them, are at hand.
MEMO_LIMIT = 350_000
#: White space in the sense of Unicode's White_Space property, written out so
#: that it does not depend on a library's reading of ``\s``.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(1)
def byte_chars() -> str:
    """A printable character for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    own = [chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD else "" for b in range(256)]
    spare = iter(range(0x100, 0x200))
    return "".join(c or chr(next(spare)) for c in own)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a tiktoken rank file in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a length-delimited, varint or 32-bit float value."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece ``ModelProto`` with one BPE piece a rank and <unk> after the last."""
    chars = byte_chars()
    pieces = b"".join(
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
        for rank, token in enumerate(ranks)
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(ranks)
    # trainer: model_type BPE, vocabulary size, ids of unk, bos, eos and pad
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # normaliser: identity, no dummy prefix, white space kept as it is
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder of one vocabulary; built once a worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.whole = {token: i for i, token in enumerate(self.ranks)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.to_chars = str.maketrans({i: c for i, c in enumerate(byte_chars())} | {0xFF: "\n"})
        self.parted = len(self.ranks)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")).findall
        self.digits = [str(i) for i in range(len(self.ranks))]
        self.memo: dict[str, tuple[bytes, str, bytes]] = {}
        self.older: dict[str, tuple[bytes, str, bytes]] = {}

    def _keep(self, token: str, ids: list[int]) -> None:
        self.memo[token] = (array("I", ids).tobytes(), ",".join(map(self.digits.__getitem__, ids)), self.decode(ids))

    def _learn(self, fresh: set[str]) -> None:
        if len(self.memo) + len(fresh) > MEMO_LIMIT:
            self.memo, self.older = {}, self.memo
        rest = []
        for t in fresh:
            known = self.older.get(t)
            if known is not None:
                self.memo[t] = known
            elif (i := self.whole.get(t.encode())) is not None:
                self._keep(t, [i])
            else:
                rest.append(t)
        if not rest:
            return
        # UTF-8 has no byte 0xFF: it parts the pre-tokens, as a character that no
        # piece holds, so one call encodes all of them and merges cross none
        joined = b"\xff".join([t.encode() for t in rest]).decode("latin-1").translate(self.to_chars)
        ids, at = self.model.encode(joined), 0
        for t in rest:
            try:
                end = ids.index(self.parted, at)
            except ValueError:
                end = len(ids)
            self._keep(t, ids[at:end])
            at = end + 1

    def entries(self, text: str) -> list[tuple[bytes, str, bytes]]:
        """(packed ids, decimal ids joined, decoded bytes) of each pre-token of ``text``."""
        tokens = self.split(text)
        try:
            return list(map(self.memo.__getitem__, tokens))
        except KeyError:
            distinct = set(tokens)
            fresh = {t for t in distinct if t not in self.memo}
            if len(self.memo) + len(fresh) > MEMO_LIMIT:
                fresh = distinct
            self._learn(fresh)
            return list(map(self.memo.__getitem__, tokens))

    def encode(self, text: str) -> list[int]:
        return _ids(self.entries(text)).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.__getitem__, ids))


def _ids(entries: list[tuple[bytes, str, bytes]]) -> array:
    packed = array("I")
    packed.frombytes(b"".join(map(itemgetter(0), entries)))
    return packed


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _over(df: DataFrame, per_text: Callable, schema: str, path: str, pattern: str, text: str, keep: Sequence[str]) -> DataFrame:
    small_batches(df.sparkSession)
    target = StructType.fromDDL(schema)
    own = [f.name for f in target.fields]
    into, names, back = carried(keep, own)
    rows = df.select(*into, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            got = [per_text(bpe, t) for t in batch.column("__text").to_pylist()]
            cols = [batch.column(k) for k in names]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array([g[i] for g in got], _arrow(f.dataType.simpleString())) for i, f in enumerate(target.fields)],
                names=names + own,
            )

    full = rows.select(*names).schema
    for f in target.fields:
        full = full.add(f)
    return rows.mapInArrow(run, full).select(*back, *own)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}[kind]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of each whole text (null: empty)."""
    return _over(df, lambda bpe, t: (bpe.encode(t),), "ids array<int>", path, pattern, text, keep)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded binary`` of each id list (null: empty)."""
    small_batches(df.sparkSession)
    into, names, back = carried(keep, ["decoded"])
    schema = df.select(*into).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(x or []) for x in batch.column("__ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), out], names=[*names, "decoded"])

    return df.select(*into, F.col(ids).alias("__ids")).mapInArrow(run, schema).select(*back, "decoded")


def _digest(entries: list[tuple[bytes, str, bytes]]) -> tuple[int, str, str]:
    ids, digits, decoded = zip(*entries, strict=True) if entries else ((), (), ())
    return sum(map(len, ids)) // array("I").itemsize, hashlib.sha256(",".join(digits).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode, decode the ids, and return n_tokens and the SHA-256 of ids and decoded bytes.

    One pass: the ids never leave the worker, so a run moves no token lists.
    """
    return _over(df, lambda bpe, t: _digest(bpe.entries(t)), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, pattern, text, keep)


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids, n_tokens and the SHA-256 of ids and decoded bytes of each whole text (null: empty)."""

    def both(bpe: ByteBPE, t: str) -> tuple:
        entries = bpe.entries(t)
        return (np.frombuffer(_ids(entries), np.uint32).view(np.int32), *_digest(entries))

    return _over(df, both, "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, pattern, text, keep)


def round_trip_text(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``text`` replaced by its decoded encoding (equal for valid UTF-8), ids alongside."""
    small_batches(df.sparkSession)
    cols = df.columns
    schema = df.schema.add("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            ids = [None if t is None else bpe.encode(t) for t in batch.column(at).to_pylist()]
            back = pa.array([None if x is None else bpe.decode(x).decode() for x in ids], batch.schema.field(at).type)
            arrays = [back if i == at else batch.column(i) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32()))], names=[*cols, "ids"])

    return df.mapInArrow(run, schema)
