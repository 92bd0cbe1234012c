"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here (wire format only, no generated code),
and its parts are rebuilt as a tokenizers pipeline: normaliser (precompiled
character map, extra white space, dummy prefix), white space escaped by the
metaspace marker, a Unigram model from the pieces' scores or a BPE model whose
merges follow from them, byte fallback, and the matching decoder. ``parity``
compares it with the sentencepiece library.

Scale: one narrow pass over the texts, no shuffle; memory is a chunk of about
1 MB of text and the worker's table of distinct words. Texts that the units of
``units.py`` cannot represent exactly go through the library whole.

Defined cases: null and empty text has no ids and decodes to the empty string;
null ids and repeated rows pass row by row; an empty table gives no rows; other
columns of the input are kept as they are, whatever their names, unless their
name is one of the outputs, which replaces it. The model file is read where the
driver runs; tasks get its bytes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.units import UnitEncoder
from docweft.llm.words import Texts, slices, views

MARK = "▁"
#: Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message: ints, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file holds of use here."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True  # runs of spaces become one, those at the ends none
    escape: bool = True


def read_model(data: bytes) -> Model:
    """The model of a file's bytes."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.one_space = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    ids = {text: i for i, (text, _, _) in enumerate(model.pieces)}
    unk = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces], unk, model.byte_fallback)
    elif model.kind == BPE:
        ranked = []
        for i, (text, score, kind) in enumerate(model.pieces):
            if kind in (NORMAL, USER_DEFINED):
                for cut in range(1, len(text)):
                    left, right = ids.get(text[:cut]), ids.get(text[cut:])
                    if left is not None and right is not None:
                        ranked.append((-score, i, left, right))
        ranked.sort()
        merges = [(model.pieces[x][0], model.pieces[y][0]) for _, _, x, y in ranked]
        core = models.BPE(ids, merges, unk_token=None if unk is None else model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram (1) nor BPE (2)")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.one_space:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """A model's encoder and decoder over Texts."""

    def __init__(self, data: bytes, threads: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads else "false")
        self.model = read_model(data)
        self.tokenizer = build(self.model)
        opens = np.array([text.startswith(MARK) for text, _, _ in self.model.pieces])
        # A unit's end is safe if no piece goes on from a non-space into a space, and nothing else rewrites the text.
        self.divisible = self.model.escape and not self.model.one_space and not self.model.charsmap and not any(MARK in text.lstrip(MARK) for text, _, _ in self.model.pieces)
        bare = build(Model(**(self.model.__dict__ | {"dummy_prefix": False})))
        prefix = " " if self.model.dummy_prefix else ""
        self.encoder = UnitEncoder(
            lambda strings: [x.ids for x in bare.encode_batch_fast(strings, add_special_tokens=False)],
            self.whole,
            b" ",
            self._odd,
            spell=lambda unit, first: (prefix if first else "") + unit.decode("utf-8", "replace"),
            opens=opens,
        )
        raw = [bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL,) else (" ⁇ " if kind == UNKNOWN else t.replace(MARK, " ")).encode() for t, _, kind in self.model.pieces]
        self.piece_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def whole(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids if raw else []

    def _odd(self, texts: Texts) -> np.ndarray:
        if not self.divisible:
            return np.ones(len(texts), bool)
        # The marker itself in a text (fixed UTF-8 form E2 96 81) reads as a space.
        d, out = texts.data, np.zeros(len(texts), bool)
        if len(d) > 2:
            hit = np.flatnonzero((d[:-2] == 0xE2) & (d[1:-1] == 0x96) & (d[2:] == 0x81))
            out[np.searchsorted(texts.at, hit, "right") - 1] = True
        return out

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each sequence and its bounds; byte pieces are raw bytes, the dummy prefix goes."""
        lengths = self.piece_at[ids.astype(np.int64) + 1] - self.piece_at[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        data = self.piece_bytes[np.repeat(self.piece_at[ids] - ends[:-1], lengths) + np.arange(ends[-1])]
        at = ends[bounds]
        if not self.model.dummy_prefix:
            return data, at
        live = at[:-1] < at[1:]
        drop = at[:-1][live]
        drop = drop[data[drop] == 0x20]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return data[keep], at - np.searchsorted(drop, at)

    def normal(self, raw: bytes) -> bytes:
        """The text that decoding gives back: the text as normalised, spaces unescaped."""
        if not raw or self.divisible and b"\xe2\x96\x81" not in raw:
            return raw
        text = self.tokenizer.normalizer.normalize_str(raw.decode("utf-8", "replace")) if self.tokenizer.normalizer else raw.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return (text[1:] if self.model.dummy_prefix and text.startswith(" ") else text).encode()


def parity(path: str, texts: list[str]) -> list[int]:
    """Places of the texts that the sentencepiece library encodes or decodes otherwise."""
    import sentencepiece

    codec, other = Codec(Path(path).read_bytes()), sentencepiece.SentencePieceProcessor(model_file=path)
    ids, at = codec.encode(views(pa.array(texts, pa.large_string())))
    data, bounds = codec.decode(ids, at)
    bad = []
    for i, theirs in enumerate(other.encode(texts, num_threads=1)):
        if theirs != ids[at[i] : at[i + 1]].tolist() or other.decode(theirs) != data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"):
            bad.append(i)
    return bad


_CODECS: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    if data not in _CODECS:
        _CODECS[data] = Codec(data)
    return _CODECS[data]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """``docs`` with input_ids array<int>, n_tokens, ids_crc32, decodes (and decoded string).

    input_ids: the ids of the whole text (left out where ``with_ids`` is false).
    n_tokens long. ids_crc32 long: unsigned crc32 of the ids as little-endian
    unsigned 32-bit integers. decodes boolean: decoding the ids gives the
    normalised text back. decoded string: the decoded text, if ``with_text``.
    """
    added = [T.StructField("input_ids", T.ArrayType(T.IntegerType(), False))] * with_ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decodes", T.BooleanType())] + [T.StructField("decoded", T.StringType())] * with_text
    names = {f.name for f in added}
    kept = [f for f in docs.schema.fields if f.name not in names and f.name != text]
    # Columns travel under their places, so no name of theirs can clash.
    source = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), *added])
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in slices(batches, "text"):
            texts = views(batch.column("text"))
            ids, at = codec.encode(texts)
            data, bounds = codec.decode(ids, at)
            raw = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(raw[at[i] : at[i + 1]]) for i in range(len(texts))]
            same = [data[bounds[i] : bounds[i + 1]].tobytes() == codec.normal(texts.text(i)) for i in range(len(texts))]
            out = batch.columns[: len(kept)]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
            out += [pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if with_text:
                out.append(pa.array([data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(texts))], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], *[f.name for f in added])
