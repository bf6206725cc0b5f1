"""SentencePiece encoding and decoding, every piece with the bytes of the source it stands for.

The model file's compiled character map (a double-array trie and the texts that its keys
turn into) is walked from every character of a text at once, a byte a step; the longest
key from where the last one ended wins. The text so normalised keeps, for each of its
bytes, the byte of the source it comes from. The library encodes; a piece's bytes in the
normalised text then give its span in the source, as those of consecutive pieces follow
one another without a gap.

Null text counts as empty: begin and end alone, no characters. Very long texts are taken
whole. Repeated rows are encoded each; an empty table gives an empty result; columns that
aren't carried are ignored, and carried ones may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the model file's format: field numbers, piece types, the visible blank.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE, SUFFIX_BLANK = 1, 3, 24
MAP, DUMMY_PREFIX, STRIP, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
BLANK = "▁".encode()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: numbers as int, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Normalizer:
    """A normaliser specification: ``aligned`` gives a text's normal form and where it comes from."""

    def __init__(self, spec: bytes, kept: list[bytes] = (), suffix: bool = False):
        own = dict(fields(spec))
        blob = own.get(MAP, b"")
        self.prefix, self.strip, self.escape = (bool(own.get(k, 1)) for k in (DUMMY_PREFIX, STRIP, ESCAPE))
        self.suffix, self.units, self.texts = suffix, np.zeros(0, "u4"), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
        # symbols of the model's author stay as they are, the longest first
        self.kept = re.compile(b"|".join(re.escape(x) for x in sorted(kept, key=len, reverse=True))) if kept else None

    def _longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the length of the longest key there (0: none) and its text's place."""
        length, value = np.zeros(len(starts), "i8"), np.zeros(len(starts), "i8")
        if not len(self.units):
            return length, value
        units = self.units.astype("i8")
        jump = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        live, node, step = np.arange(len(starts)), np.full(len(starts), jump(units[0])), 0
        while True:
            inside = starts[live] + step < len(data)
            live, node = live[inside], node[inside]
            if not len(live):
                return length, value
            byte = data[starts[live] + step].astype("i8")
            node = node ^ byte
            unit = units[node]
            goes = (unit & 0x800000FF) == byte
            live, node, unit, step = live[goes], node[goes] ^ jump(unit[goes]), unit[goes], step + 1
            ends = (unit >> 8 & 1) == 1
            length[live[ends]] = step
            value[live[ends]] = units[node[ends]] & 0x7FFFFFFF

    def _changes(self, raw: bytes, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(begin, end, text) of what the map replaces, from left to right."""
        length, value = self._longest(data, starts)
        found = {int(starts[i]): (int(length[i]), int(value[i])) for i in np.flatnonzero(length)}
        kept = {m.start(): len(m[0]) for m in self.kept.finditer(raw)} if self.kept else {}
        out, done = [], 0
        for at in sorted({*found, *kept}):
            if at < done:
                continue
            size = kept.get(at) or found[at][0]
            if at in kept:
                text = raw[at : at + size]
            else:
                place = found[at][1]
                text = self.texts[place : self.texts.index(b"\x00", place)]
            out.append((at, at + size, text))
            done = at + size
        return out

    def aligned(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form, and for each of its bytes and its end the place in raw (UTF-8)."""
        data = np.frombuffer(raw, "u1")
        first = (data & 0xC0) != 0x80
        source = np.maximum.accumulate(np.where(first, np.arange(len(data)), 0)) if len(data) else np.zeros(0, "i8")
        changes = self._changes(raw, data, np.flatnonzero(first)) if len(self.units) or self.kept else []
        if changes or self.strip:
            parts, repeats, begins, done = [], np.ones(len(data), "i8"), first.copy(), 0
            for a, b, text in changes:
                parts += (raw[done:a], text)
                repeats[a:b], begins[a:b] = 0, False
                repeats[a], begins[a] = len(text), True
                source[a] = a
                done = b
            parts.append(raw[done:])
            normal = np.frombuffer(b"".join(parts), "u1")
            unit = np.repeat(np.cumsum(begins) - 1, repeats)
            source = np.repeat(source, repeats)
            if self.strip and len(normal):
                keep = self._inner(normal == 32, unit)
                normal, source = normal[keep], source[keep]
        else:
            normal = data
        if not len(normal):
            return b"", np.zeros(1, "i8")
        text, mark = normal.tobytes(), b" "
        if self.escape:
            source = np.repeat(source, np.where(normal == 32, len(BLANK), 1))
            text, mark = text.replace(b" ", BLANK), BLANK
        if self.prefix and not self.suffix:
            text, source = mark + text, np.append(np.full(len(mark), source[0] if self.strip else 0), source)
        size = len(text)
        while self.strip and text.endswith(mark, 0, size):
            size -= len(mark)
        end = source[size] if size < len(text) else len(data)
        text, source = text[:size], np.append(source[:size], end)
        return (text + mark, np.append(source, np.full(len(mark), end))) if self.prefix and self.suffix else (text, source)

    @staticmethod
    def _inner(blank: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """What stays: all but the blanks at the begin of a unit, where it follows a blank or nothing."""
        first = np.append(True, unit[1:] != unit[:-1])
        own = np.cumsum(first) - 1  # the unit's place among those that have text
        at = np.flatnonzero(first)
        inked = np.cumsum(~blank)
        leading = inked == (inked - ~blank)[at[own]]
        return ~(leading & np.append(True, blank[:-1])[at[own]])


class Model:
    """A model file: the library's processor, the normaliser, and each id's length in bytes."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        own = list(fields(data))
        pieces = [dict(fields(v)) for k, v in own if k == PIECES]
        trainer = dict(fields(next((v for k, v in own if k == TRAINER), b"")))
        kinds = [p.get(PIECE_TYPE, NORMAL) for p in pieces]
        kept = [p[PIECE_TEXT] for p, k in zip(pieces, kinds, strict=True) if k == USER_DEFINED]
        self.normalizer = Normalizer(next((v for k, v in own if k == NORMALIZER), b""), kept, bool(trainer.get(SUFFIX_BLANK, 0)))
        #: -1: an unknown piece, whose length its text alone tells.
        self.size = np.array([{CONTROL: 0, BYTE: 1, UNKNOWN: -1}.get(k, len(p[PIECE_TEXT])) for p, k in zip(pieces, kinds, strict=True)], "i8")

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text (ids, begins, ends): spans in the bytes of its UTF-8 form. Begin and
        end marks, and a blank that the normaliser adds, have empty spans."""
        out = []
        for text, ids in zip(texts, self.library.encode(texts, out_type=int, add_bos=begin, add_eos=end, enable_sampling=False, num_threads=1), strict=True):
            ids = np.array(ids, "i4")
            size = self.size[ids]
            if (size < 0).any():
                inner = slice(int(begin), len(ids) - int(end))
                size[inner] = [len(x.encode()) if n < 0 else n for x, n in zip(self.library.encode(text, out_type=str, enable_sampling=False), size[inner], strict=True)]
            normal, source = self.normalizer.aligned(text.encode())
            stops = np.cumsum(size)
            if (stops[-1] if len(stops) else 0) != len(normal):
                raise ValueError(f"pieces of {stops[-1]} bytes for a normal form of {len(normal)}")
            out.append((ids, source[stops - size].astype("i4"), source[stops].astype("i4")))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


@lru_cache(2)
def model(path: str) -> Model:
    """One for each worker process and file."""
    with open(path, "rb") as f:
        return Model(f.read())


def encoded(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), begin: bool = True, end: bool = True, text: str = "text") -> DataFrame:
    """The carried columns, and pieces<ids, begins, ends> and decoded of every row.

    path: the model's file, on every worker. The pieces' spans are bytes of the text;
    decoded is what the library makes of the ids again.
    """
    lists = pa.list_(pa.int32())

    def apply(batches):
        own = model(path)
        for part, texts in slices(batches, "text"):
            found = own.encode(texts, begin, end)
            cuts = pa.array(np.cumsum([0, *[len(x[0]) for x in found]]), pa.int32())
            made = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[i] for x in found]), pa.int32())) for i in range(3)]
            pieces = pa.StructArray.from_arrays(made, fields=[pa.field(n, lists) for n in ("ids", "begins", "ends")])
            decoded = pa.array(own.decode([x[0].tolist() for x in found]), pa.string())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in held], pieces, decoded], [*held, "pieces", "decoded"])

    held = [f"c{i}" for i in range(len(carry))]
    plain = docs.select(*[docs[c].alias(h) for c, h in zip(carry, held, strict=True)], docs[text].cast("string").alias("text"))
    shape = "".join(f"{h} {plain.schema[h].dataType.simpleString()}, " for h in held)
    made = plain.mapInArrow(apply, f"{shape}pieces struct<ids: array<int>, begins: array<int>, ends: array<int>>, decoded string")
    return made.toDF(*carry, "pieces", "decoded")


def ids_digest(ids: Column) -> Column:
    """The SHA-256 of an array of ids as little-endian unsigned 32-bit integers, in hexadecimal."""
    import hashlib

    @F.arrow_udf("string")
    def digest(a: pa.Array) -> pa.Array:
        flat, cuts = a.values.to_numpy().astype("<u4"), a.offsets.to_numpy()
        return pa.array([hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)], pa.string())

    return digest(ids)


def digests(found: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded rows, beside the columns carried."""
    rest = [F.col(f"`{c}`") for c in found.columns[:-2]]
    return found.select(*rest, F.size("pieces.ids").cast("long").alias("n_tokens"), ids_digest(F.col("pieces.ids")).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
