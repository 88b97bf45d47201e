"""SentencePiece encoding and decoding.

The vocabulary comes from a SentencePiece model file (its path is a parameter).
An Aho-Corasick automaton over the pieces reads a text once; every match that its
output links give at a position relaxes the best score of that position (Viterbi).

Defined results: a null text has null ids; an empty text has no ids; a literal
U+2581 and any character without a piece become byte pieces, so decoding gives
every text back exactly. Ties go to the longer last piece.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow

SPACE = "▁"
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 250_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints, raw 4/8 bytes or byte strings."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def model_bytes(path: str) -> bytes:
    """A model file, which only the driver has to reach."""
    with open(path, "rb") as file:
        return file.read()


def read_model(model: str | bytes) -> tuple[list[tuple[str, float, int]], int]:
    """Pieces as (text, score, type) in id order, and the model's type, of a file or its bytes."""
    pieces, kind = [], UNIGRAM
    for number, value in _fields(model_bytes(model) if isinstance(model, str) else model):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return pieces, kind


def log_probabilities(pieces: list[tuple[str, float, int]], kind: int) -> list[float]:
    """Scores that may be added up. A BPE file holds merge ranks instead of
    log-probabilities; there the rank-frequency law 1 / ((rank + 1) H) stands in."""
    if kind != BPE:
        return [score for _, score, _ in pieces]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return [-math.log(max(-score, 0.0) + 1) - norm for _, score, _ in pieces]


class Codec:
    """Encoder and decoder of one model; made once in each Python worker."""

    def __init__(self, model: str | bytes, dummy_prefix: bool = True):
        pieces, kind = read_model(model)
        scores = log_probabilities(pieces, kind)
        self.dummy_prefix = dummy_prefix
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.unknown = min((s for s, p in zip(scores, pieces) if p[2] == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        crossing = newline = False
        byte_pieces = 0
        for i, ((text, _, type_), score) in enumerate(zip(pieces, scores)):
            self.bytes_of.append(text.replace(SPACE, " ").encode())
            if type_ == BYTE:
                value = int(text[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
                byte_pieces += 1
            elif type_ in (NORMAL, USER_DEFINED) and text:
                self.automaton.add_word(text, (len(text), score, i))
                crossing |= bool(re.search(f"[^{SPACE}]{SPACE}", text))
                newline |= "\n" in text
                if len(text) == 1:
                    self.single.add(text)
            else:
                self.bytes_of[i] = b""
        if byte_pieces != 256:
            raise ValueError("the model has no byte pieces: encoding would lose characters")
        self.automaton.make_automaton()
        # Where no piece holds a space after another character, best paths of a text's
        # runs (spaces, then the rest) are independent: each is found once and kept.
        self.runs = re.compile(r"(?s:.+)" if crossing or newline else r"\n| *[^ \n]+| +").findall
        self.kept = _Kept(self)
        self.space_ids = np.array([self.byte_id[b] for b in SPACE.encode()], np.int32).tobytes()

    def viterbi(self, run: str) -> list[int]:
        """Ids of the best path through one run."""
        n = len(run)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        missing = [i for i, c in enumerate(run) if c not in self.single]
        at = 0

        def bytes_until(position: int) -> None:
            nonlocal at
            while at < len(missing) and missing[at] < position:
                i = missing[at]
                at += 1
                if (score := best[i] + self.unknown) > best[i + 1]:
                    best[i + 1], back[i + 1] = score, (i, -1)

        for end, (length, score, piece) in self.automaton.iter(run):
            if missing:
                bytes_until(end)
            start = end + 1 - length
            if (score := best[start] + score) > best[end + 1]:
                best[end + 1], back[end + 1] = score, (start, piece)
        if missing:
            bytes_until(n)
        ids: list[int] = []
        while n:
            start, piece = back[n]
            ids += [piece] if piece >= 0 else [self.byte_id[b] for b in reversed(run[start:n].encode())]
            n = start
        return ids[::-1]

    def _plain(self, text: str) -> bytes:
        kept = self.kept
        return b"".join([kept[run] for run in self.runs(text)])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if not text:
            return b""
        if self.dummy_prefix:
            text = " " + text
        if SPACE not in text:
            return self._plain(text)
        return self.space_ids.join(self._plain(part) for part in text.split(SPACE))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


class _Kept(dict):
    """Ids of runs already seen, emptied when full: memory stays bounded."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = np.array(self.codec.viterbi(run.replace(" ", SPACE)), np.int32).tobytes()
        if len(run) <= 64:
            self[run] = ids
        return ids


_codecs: dict[tuple[str | bytes, bool], Codec] = {}


def codec(model: str | bytes, dummy_prefix: bool = True) -> Codec:
    if (model, dummy_prefix) not in _codecs:
        _codecs[model, dummy_prefix] = Codec(model, dummy_prefix)
    return _codecs[model, dummy_prefix]


def encode(
    docs: DataFrame,
    model: str,
    text: str = "text",
    ids: str = "ids",
    dummy_prefix: bool = True,
    verify: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) and, if ``verify`` names a column,
    whether decoding gave the text back. ``keep`` lists the columns to carry (all)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids, verify)]  # new columns replace old ones
    source = docs.select(*keep, docs[text].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # of the vocabulary's size
    fields = [docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if verify:
        fields.append(T.StructField(verify, T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, dummy_prefix)
        for batch in batches:
            for part in _parts(batch):
                flat, same = [], []
                texts = part.column("__text").to_pylist()
                for value in texts:
                    flat.append(b"" if value is None else own.encode_bytes(value))
                    if verify:
                        back = own.decode(np.frombuffer(flat[-1], np.int32).tolist())
                        same.append(None if value is None else back == value)
                offsets = np.zeros(len(flat) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in flat], out=offsets[1:])
                nulls = pa.array([*(x is None for x in texts), False])
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, mask=nulls.to_numpy(zero_copy_only=False)),
                    pa.array(np.frombuffer(b"".join(flat), np.int32)),
                )
                columns = [part.column(c) for c in keep] + [lists] + [pa.array(same, pa.bool_())] * bool(verify)
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, ids] + [verify] * bool(verify))

    return arrow(source).mapInArrow(run, T.StructType(fields))


def decode(table: DataFrame, model: str, ids: str = "ids", text: str = "decoded", dummy_prefix: bool = True) -> DataFrame:
    """``table`` with the texts of ``ids`` in the column ``text``; null ids give null."""
    table = table.select(*(f"`{c}`" for c in table.columns if c != text))
    schema = T.StructType([*table.schema.fields, T.StructField(text, T.StringType())])
    shared = table.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, dummy_prefix)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return arrow(table).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)
