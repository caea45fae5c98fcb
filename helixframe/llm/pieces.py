"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

Texts are normalised here: the longest prefix that the model's compiled character map knows is replaced, and each byte
of the result records the byte of the source that it comes from. The library encodes the normalised text with its own
normalisation switched off; lengths of pieces, added up, are places in the normalised text, and the record projects them
to bytes of the source.

Edge cases: a null text is the empty text, which has the end id only; repeated rows are encoded alike; an empty table
gives an empty result; other columns are ignored. A text of any length is given to the library whole, whose time grows
with its length times the logarithm of it.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

SPACE = "▁"  # stands for a blank in pieces


def wire_fields(message: bytes):
    """(number, value) of a protobuf message: bytes, integers, or the raw bytes of floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, message[at : at + size]
        at += size


def _wire_bytes(number: int, value: bytes) -> bytes:
    out, n = bytearray([number << 3 | 2]), len(value)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n]) + value


class CharMap:
    """A compiled map of strings: a double array of 32-bit units, whose leaves point at strings that end with a zero."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]
        self.known: dict[bytes, tuple[int, bytes] | None] = {}
        first = [b for b in range(1, 256) if self.units and self._step(self._below(0, self.units[0]), b) is not None]
        self.may_start = np.zeros(256, bool)
        self.may_start[first] = True

    @staticmethod
    def _below(place: int, unit: int) -> int:
        return place ^ ((unit >> 10) << (8 if unit & 512 else 0))

    def _step(self, place: int, byte: int) -> tuple[int, bytes | None] | None:
        """Where a byte leads, and the string of the leaf there if there is one."""
        place ^= byte
        unit = self.units[place] if place < len(self.units) else 0
        if unit & 0x800000FF != byte:
            return None
        below = self._below(place, unit)
        if not unit & 256:
            return below, None
        start = self.units[below] & 0x7FFFFFFF
        return below, self.strings[start : self.strings.index(b"\0", start)]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of text[at:] in the map."""
        place, found = self._below(0, self.units[0]), None
        for i in range(at, len(text)):
            step = self._step(place, text[i])
            if step is None:
                break
            place = step[0]
            if step[1] is not None:
                found = i + 1 - at, step[1]
        return found

    def replace(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after replacement, and the place in ``text`` of each: its own, or that of the replaced prefix."""
        raw = np.frombuffer(text, np.uint8)
        place = np.arange(len(raw))
        if not self.units or not len(raw):
            return raw, place
        out, src, done = [], [], 0
        for at in np.flatnonzero(self.may_start[raw] & ((raw & 0xC0) != 0x80)).tolist():
            if at < done or (hit := self.longest(text, at)) is None:
                continue
            out += raw[done:at], np.frombuffer(hit[1], np.uint8)
            src += place[done:at], np.full(len(hit[1]), at)
            done = at + hit[0]
        return np.concatenate([*out, raw[done:]]), np.concatenate([*src, place[done:]])


class Normaliser:
    """A model's normalisation, with the source of each byte."""

    def __init__(self, spec: bytes, suffix: bool = False):
        found = dict(wire_fields(spec))
        self.map = CharMap(found.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(found.get(i, 1)) for i in (3, 4, 5))
        self.suffix = suffix
        self.mark = np.frombuffer((SPACE if self.escape else " ").encode(), np.uint8)
        self.simple = self.dummy and self.escape and not (self.suffix or self.squeeze or self.map.units)

    def __call__(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its bytes and for their end, the byte of the source; none where marks
        for blanks, one of them in front, are all that changes."""
        if self.simple and text and SPACE not in text:
            return SPACE + text.replace(" ", SPACE), None
        normal, src = self.with_source(text.encode())
        return normal.decode(), src

    def with_source(self, source: bytes) -> tuple[bytes, np.ndarray]:
        raw, src = self.map.replace(source)
        begin = 0
        if self.squeeze and len(raw):
            blank = raw == 32
            solid = np.flatnonzero(~blank)
            if not len(solid):
                return b"", np.zeros(1, np.int64)
            begin = int(src[solid[0]])
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            raw, src = raw[keep], src[keep]
        if not len(source):
            return b"", np.zeros(1, np.int64)
        if self.escape:
            blank = raw == 32
            times = np.where(blank, len(self.mark), 1)
            first = (np.cumsum(times) - times)[blank]
            src, raw = np.repeat(src, times), np.repeat(raw, times)
            for i, byte in enumerate(self.mark):
                raw[first + i] = byte
        if self.dummy and not self.suffix:
            raw, src = np.concatenate((self.mark, raw)), np.concatenate((np.full(len(self.mark), begin), src))
        normal, src = raw.tobytes(), np.append(src, len(source))
        if self.squeeze:  # marks of the source's own go, too
            normal = normal.decode().rstrip(self.mark.tobytes().decode()).encode()
            src = src[: len(normal) + 1]
        if self.dummy and self.suffix:
            normal, src = normal + self.mark.tobytes(), np.append(src, np.full(len(self.mark), src[-1]))
        return normal, src


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str, spec: bytes | None = None):
        """``spec``: a normaliser's message that holds in place of the model's own."""
        import sentencepiece

        with open(model_file, "rb") as f:
            model = f.read()
        if spec is not None:
            model += _wire_bytes(3, spec)
        own, trainer, pieces = b"", {}, []
        for number, value in wire_fields(model):
            if number == 3:
                own += value  # messages given twice are merged
            elif number == 2:
                trainer |= dict(wire_fields(value))
            elif number == 1:
                pieces.append(dict(wire_fields(value)))
        self.normalise = Normaliser(own, bool(trainer.get(24, 0)))
        #: The library with the model's rules: for the tests and for decoding.
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: The library for texts that are normal already: no map, no prefix, no squeezing, no escaping.
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + _wire_bytes(3, b"\x12\x00\x18\x00\x20\x00\x28\x00"))
        self.end, self.unknown = self.lib.eos_id(), self.lib.unk_id()
        # byte pieces (type 6) stand for one byte; control pieces (3) for none
        self.length = np.array([{6: 1, 3: 0}.get(p.get(3, 1), len(p.get(1, b""))) for p in pieces], np.int64)
        #: The same in a source of which only blanks became marks.
        self.source_length = self.length - np.array([(len(SPACE.encode()) - 1) * p.get(1, b"").count(SPACE.encode()) for p in pieces], np.int64)
        self.names = [str(i) for i in range(len(pieces))]

    def encode_normal(self, normal: str) -> np.ndarray:
        """Ids of a normalised text, with the end id."""
        return np.append(self.plain.encode(normal, return_type="numpy"), np.int32(self.end))

    def spans(self, ids: np.ndarray, normal: str, src: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each id in the bytes of the source; the end id's span is empty."""
        length = self.length[ids[:-1]]
        known = not (ids == self.unknown).any()
        if not known:  # unknown pieces have the length of what they cover
            length = np.array([len(p.surface.encode()) for p in self.plain.encode(normal, return_type="proto").pieces], np.int64)
        if src is None and known:
            place = np.maximum(np.cumsum(np.append(0, self.source_length[ids[:-1]])) - 1, 0)  # the mark in front covers nothing
        else:
            src = self.normalise.with_source(self.source_of(normal))[1] if src is None else src
            place = src[np.cumsum(np.append(0, length))]
        return place, np.append(place[1:], place[-1])

    @staticmethod
    def source_of(normal: str) -> bytes:
        """The source of a text that was normalised by marks alone."""
        return normal[1:].replace(SPACE, " ").encode()

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and where each begins and ends in the bytes of the text."""
        normal, src = self.normalise(text)
        ids = self.encode_normal(normal)
        return ids.tolist(), *self.spans(ids, normal, src)

    def decode(self, ids: np.ndarray) -> str:
        return self.lib.decode(ids)


@functools.cache
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode_documents(docs: DataFrame, model_file: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 (of the pieces' begins and ends in the source, as
    little-endian 64-bit integers) and, if asked for, ids, begins, ends and the decoded text."""
    fields = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string()), ("spans_crc32", "long", pa.int64())]
    fields += [("ids", "array<int>", pa.list_(pa.int32())), ("begins", "array<long>", pa.list_(pa.int64())), ("ends", "array<long>", pa.list_(pa.int64())), ("decoded", "string", pa.string())] * ids

    def run(batches):
        code = codec(model_file)
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                normal, src = code.normalise(text.as_py() or "")
                found = code.encode_normal(normal)
                begins, ends = code.spans(found, normal, src)
                back = code.decode(found)
                crc = zlib.crc32(np.concatenate((begins, ends)).astype("<i8").tobytes())
                row = (doc, len(found), hashlib.sha256(" ".join([code.names[i] for i in found.tolist()]).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), crc, found, begins, ends, back)
                for col, x in zip(cols, row):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f[2]) for c, f in zip(cols, fields)], names=[f[0] for f in fields])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_files

    return encode_documents(documents(spark, sf_dir), tokenizers_files.path("piece_bpe_32k.model"), ids=False)
