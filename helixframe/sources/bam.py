"""Alignments in BAM: a data source that reads runs of compressed blocks as partitions and uses an index for regions.

A file is a chain of gzip members of at most 64 KB, and a place in it is the offset of a member and of a byte in its
content (shifted left by 16, and added). Records may span members. A partition that begins inside a file looks for the
first member, and in it for the first byte from which a chain of records makes sense; the partition before it, which is
right by induction from the file's head, must arrive at the same place, or the read fails.

The index is CSI: records are filed in a tree of bins, each half a power of eight as wide as its parent, with the places
where runs of them begin and end, and for each bin the first place of what overlaps its beginning.

Paths are those that Arrow's file systems know (local, hdfs, s3, gs).
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "helixframe_bam"
SCHEMA = "qname string, flag int, rname string, start0 int, end0 int, mapq int, cigar array<struct<op: string, len: int>>, seq string, zn int"
SPLIT = 32 << 20  # bytes of a partition
CONTENT = 65280  # bytes of a member's content
MIN_SHIFT, DEPTH = 14, 5  # of the index: the smallest bins hold 2^14 positions, the largest 8^5 times as many

# fixed values of the format
BASES = b"=ACMGRSVTWYHKDBN"
OPS = b"MIDNSHP=X"
ON_REFERENCE = [op in b"MDN=X" for op in OPS]
FIELDS = np.dtype([("size", "<i4"), ("tid", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_tid", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
TAG_SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
TAG_INTS = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I"}
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


# ---------------------------------------------------------------- blocks


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub("^file:/*", "/", path))


def bam_files(path: str) -> list[str]:
    """A file, or the files of a folder in the order of their names."""
    fs, at = open_path(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.base_name.endswith(".bam")]
    return [f"{path.rstrip('/')}/{name}" for name in sorted(found)]


def block_size(data: bytes, at: int) -> int:
    """Bytes of the member that begins there; 0 if none does, or its head is not whole."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return 0
    end = at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    at += 12
    while at + 6 <= min(end, len(data)):
        size = int.from_bytes(data[at + 2 : at + 4], "little")
        if data[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(data[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def inflate(block: bytes) -> bytes:
    return zlib.decompress(block[12 + int.from_bytes(block[10:12], "little") : -8], -15)


def deflate(content: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


class Blocks:
    """Members of a file from one of them on, read a megabyte at a time; counts those that were opened."""

    def __init__(self, path: str, window: int = 1 << 20):
        fs, at = open_path(path)
        self.file, self.window, self.opened = fs.open_input_file(at), window, 0
        self.size = self.file.size()

    def first(self, at: int) -> int | None:
        """The first member at ``at`` or behind it: its head, and one that follows it or the end of the file."""
        if at == 0:
            return 0 if self.size else None
        data = self.file.read_at(min(4 << 16, self.size - at), at) if at < self.size else b""
        i = -1
        while (i := data.find(b"\x1f\x8b\x08\x04", i + 1)) >= 0:
            n = block_size(data, i)
            if n and (at + i + n == self.size or block_size(data, i + n)):
                return at + i
        return None

    def __call__(self, at: int):
        """(offset, content) of each member from ``at`` on; what is empty is left out."""
        data, base = b"", at
        while True:
            n = block_size(data, at - base)
            if not n or at - base + n > len(data):
                data, base = self.file.read_at(min(max(self.window, n), self.size - at), at) if at < self.size else b"", at
                n = block_size(data, 0)
                if not n or n > len(data):
                    if at < self.size:
                        raise ValueError(f"no block at byte {at}")
                    return
            self.opened += 1
            content = inflate(data[at - base : at - base + n])
            if content:
                yield at, content
            at += n


@dataclass(frozen=True)
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    first: int  # the place of the first record

    @classmethod
    def read(cls, path: str) -> Header:
        blocks, data, starts = Blocks(path)(0), b"", []

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                got = next(blocks, None)
                if got is None:
                    raise ValueError(f"{path}: the head is not whole")
                starts.append((len(data), got[0]))
                data += got[1]

        need(12)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        at = 8 + int.from_bytes(data[4:8], "little")
        need(at + 4)
        text, n = data[8:at].rstrip(b"\0").decode(), int.from_bytes(data[at : at + 4], "little")
        at += 4
        names, lengths = [], []
        for _ in range(n):
            need(at + 4)
            size = int.from_bytes(data[at : at + 4], "little")
            need(at + size + 8)
            names.append(data[at + 4 : at + 3 + size].decode())
            lengths.append(int.from_bytes(data[at + 4 + size : at + 8 + size], "little"))
            at += size + 8
        if at == len(data):
            got = next(blocks, None)
            return cls(text, names, lengths, got[0] << 16 if got else Blocks(path).size << 16)
        base, offset = [s for s in starts if s[0] <= at][-1]
        return cls(text, names, lengths, offset << 16 | at - base)


# ---------------------------------------------------------------- records


def plausible(data: bytes, at: int, header: Header) -> int:
    """Where the record at ``at`` ends if it may be one, else 0; a record whose fields are not all there is one at -1."""
    if at + 36 > len(data):
        return -1
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, next_tid, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    n = len(header.names)
    if not (32 < size < 1 << 28 and -1 <= tid < n and -1 <= next_tid < n and pos >= -1 and next_pos >= -1 and l_name > 1 and 0 <= l_seq < 1 << 28):
        return 0
    if tid >= 0 and pos > header.lengths[tid] or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(32 < c < 127 for c in name[:-1])):
        return 0
    return at + 4 + size


def first_record(blocks: Blocks, at: int, header: Header, context: int = 1 << 17) -> int | None:
    """The place of the first record in the members at ``at`` and behind it. What follows in ``context`` bytes must be
    records, too."""
    start = blocks.first(at)
    if start is None:
        return None
    chain, offsets, begins, data = blocks(start), [], [], b""
    u = 0
    while True:
        while len(data) < u + context and (got := next(chain, None)) is not None:
            offsets.append(got[0])
            begins.append(len(data))
            data += got[1]
        if u + FIELDS.itemsize > len(data):
            return None
        stop = len(data) - FIELDS.itemsize if len(data) < u + context else u + context // 2
        for v in range(u, stop + 1):
            end = plausible(data, v, header)
            while 0 < end < len(data):
                end = plausible(data, end, header)
            if end:
                i = bisect.bisect_right(begins, v) - 1
                return offsets[i] << 16 | v - begins[i]
        u = stop + 1


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of runs, one behind the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def _tag(aux: bytes, name: bytes) -> int | None:
    """An integer tag among a record's tags."""
    at = 0
    while at + 3 <= len(aux):
        own, kind = aux[at : at + 2], aux[at + 2 : at + 3]
        at += 3
        if own == name and kind in TAG_INTS:
            return struct.unpack_from(TAG_INTS[kind], aux, at)[0]
        if kind in (b"Z", b"H"):
            at = aux.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + TAG_SIZES[aux[at : at + 1]] * int.from_bytes(aux[at + 1 : at + 5], "little")
        else:
            at += TAG_SIZES[kind]
    return None


def decode(data: bytes, starts: list[int], names: list[str]) -> pa.RecordBatch:
    """Records that begin at ``starts``, as SCHEMA has them."""
    raw, at = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
    head = raw[at[:, None] + np.arange(FIELDS.itemsize)].reshape(-1).view(FIELDS)
    l_name, n_cigar, l_seq = (head[k].astype(np.int64) for k in ("l_name", "n_cigar", "l_seq"))
    name_at = at + FIELDS.itemsize
    cigar_at, seq_at = name_at + l_name, name_at + l_name + 4 * n_cigar

    def strings(chars: np.ndarray, length: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
        return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(chars), bits)

    qname = strings(raw[gather(name_at, l_name - 1)], l_name - 1)
    words = raw[gather(cigar_at, 4 * n_cigar)].view("<u4").astype(np.int64)
    op, size = words & 15, words >> 4
    moved = np.append(0, np.cumsum(size * np.array([*ON_REFERENCE, *[False] * 7])[op]))
    ends = np.cumsum(n_cigar)
    span = moved[ends] - moved[ends - n_cigar]
    cigar = pa.StructArray.from_arrays([pa.array([chr(c) for c in OPS]).take(pa.array(op)), pa.array(size.astype(np.int32))], names=["op", "len"])
    offsets = np.append(0, ends).astype(np.int32)
    cigar = pa.ListArray.from_arrays(pa.array(offsets), cigar, mask=pa.array(n_cigar == 0))
    inside = gather(np.zeros(len(at), np.int64), l_seq)
    packed = raw[np.repeat(seq_at, l_seq) + (inside >> 1)]
    seq = strings(np.frombuffer(BASES, np.uint8)[np.where(inside & 1, packed & 15, packed >> 4)], l_seq, l_seq > 0)
    zn: list[int | None] = [None] * len(at)
    if b"ZN" in data:
        begin, end = seq_at + (l_seq + 1) // 2 + l_seq, at + 4 + head["size"]
        for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
            if data.find(b"ZN", b, e) >= 0:
                zn[i] = _tag(data[b:e], b"ZN")
    rname = pa.array([*names, "*"]).take(pa.array(np.where(head["tid"] < 0, len(names), head["tid"]).astype(np.int64)))
    start0 = head["pos"].astype(np.int32)
    arrays = [qname, pa.array(head["flag"].astype(np.int32)), rname, pa.array(start0), pa.array(start0 + span.astype(np.int32)), pa.array(head["mapq"].astype(np.int32)), cigar, seq, pa.array(zn, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["qname", "flag", "rname", "start0", "end0", "mapq", "cigar", "seq", "zn"])


def record_runs(blocks: Blocks, place: int, last: int, batch: int = 2 << 20):
    """(content, starts, places) of runs of whole records from ``place`` on, up to the record at ``last`` or behind it;
    then (None, None, its place), or None for the end of the file."""
    data, chain = b"", blocks(place >> 16)
    at, begins, offsets = place & 0xFFFF, [], []
    while True:
        got = next(chain, None)
        if got is not None:
            begins.append(len(data))
            offsets.append(got[0])
            data += got[1]
            if len(data) < batch and got[0] < last >> 16:
                continue
        starts, n = [], len(data)
        while at + 4 <= n and (end := at + 4 + int.from_bytes(data[at : at + 4], "little")) <= n:
            starts.append(at)
            at = end
        begin, offset = np.array(begins, np.int64), np.array(offsets, np.int64)
        member = lambda x: np.searchsorted(begin, x, "right") - 1  # noqa: E731, B023
        own = member(np.array(starts, np.int64)) if starts else np.zeros(0, np.int64)
        places = offset[own] << 16 | (np.array(starts, np.int64) - begin[own])
        stop = int(np.searchsorted(places, last))
        if stop:
            yield data, starts[:stop], places[:stop]
        if stop < len(starts):
            yield None, None, int(places[stop])
            return
        if got is None:
            if at < n:
                raise ValueError("the last record is not whole")
            yield None, None, None
            return
        if at < n:  # a record goes on behind what is there
            m = int(member(np.array([at]))[0])
            place_here = offsets[m] << 16 | at - begins[m]
            if place_here >= last:
                yield None, None, place_here
                return
            begins, offsets = [b - at for b in begins[m:]], offsets[m:]
            data = data[at:]
        else:
            begins, offsets, data = [], [], b""
        at = 0


# ---------------------------------------------------------------- the index


def bin_of(begin: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    """The smallest bin that holds [begin, end). Bins are numbered from the root, level by level."""
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        if begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def bins_over(begin: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH):
    """All bins that overlap [begin, end)."""
    for level in range(depth + 1):
        shift, first = min_shift + 3 * (depth - level), ((1 << 3 * level) - 1) // 7
        yield from range(first + (begin >> shift), first + ((end - 1) >> shift) + 1)


def _bin_start(number: int, min_shift: int, depth: int) -> int:
    level = 0
    while ((1 << 3 * (level + 1)) - 1) // 7 <= number:
        level += 1
    return (number - ((1 << 3 * level) - 1) // 7) << min_shift + 3 * (depth - level)


@dataclass
class Index:
    """For each contig, runs of places by bin, and the first place of what overlaps each of the smallest windows."""

    n: int
    min_shift: int = MIN_SHIFT
    depth: int = DEPTH
    bins: list[dict[int, list[list[int]]]] = field(default_factory=list)
    first: list[dict[int, int]] = field(default_factory=list)
    unplaced: int = 0

    def __post_init__(self):
        self.bins = self.bins or [{} for _ in range(self.n)]
        self.first = self.first or [{} for _ in range(self.n)]

    @classmethod
    def for_lengths(cls, lengths: list[int]) -> Index:
        """Deep enough for the longest contig."""
        depth = DEPTH
        while max(lengths, default=0) > 1 << MIN_SHIFT + 3 * depth:
            depth += 1
        return cls(len(lengths), depth=depth)

    def add(self, tid: int, begin: int, end: int, place: int, after: int) -> None:
        """A record that ends where ``after`` is; records come in the order of contig and begin."""
        if tid < 0:
            self.unplaced += 1
            return
        begin, end = max(begin, 0), max(end, begin + 1, 1)
        runs = self.bins[tid].setdefault(bin_of(begin, end, self.min_shift, self.depth), [])
        if runs and runs[-1][1] == place:
            runs[-1][1] = after
        else:
            runs.append([place, after])
        for w in range(begin >> self.min_shift, (end - 1 >> self.min_shift) + 1):
            self.first[tid].setdefault(w, place)

    def to_bytes(self) -> bytes:
        out = [b"CSI\1", struct.pack("<iiii", self.min_shift, self.depth, 0, self.n)]
        for tid, bins in enumerate(self.bins):
            out.append(struct.pack("<i", len(bins)))
            windows = sorted(self.first[tid])
            for number, runs in sorted(bins.items()):
                # the first place of what overlaps the bin's beginning, or else of what comes behind it
                i = bisect.bisect_left(windows, _bin_start(number, self.min_shift, self.depth) >> self.min_shift)
                out.append(struct.pack("<IQi", number, self.first[tid][windows[i]] if i < len(windows) else 0, len(runs)))
                out += [struct.pack("<QQ", *r) for r in runs]
        content = b"".join([*out, struct.pack("<Q", self.unplaced)])
        return b"".join(deflate(content[i : i + CONTENT]) for i in range(0, len(content), CONTENT)) + END_BLOCK

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        """An index that answers ``runs``; the windows are those where its bins begin."""
        parts, at = [], 0
        while n := block_size(data, at):
            parts.append(inflate(data[at : at + n]))
            at += n
        raw = b"".join(parts)
        if raw[:4] != b"CSI\1":
            raise ValueError("no CSI index")
        min_shift, depth, more = struct.unpack_from("<iii", raw, 4)
        at = 16 + more
        (n,) = struct.unpack_from("<i", raw, at)
        own, at = cls(n, min_shift, depth), at + 4
        for tid in range(n):
            (count,) = struct.unpack_from("<i", raw, at)
            at += 4
            for _ in range(count):
                number, least, runs = struct.unpack_from("<IQi", raw, at)
                at += 16
                pairs = np.frombuffer(raw, "<u8", 2 * runs, at).reshape(-1, 2).tolist()
                at += 16 * runs
                if number < ((1 << 3 * (depth + 1)) - 1) // 7:  # the bin behind the last holds counts
                    own.bins[tid][number] = pairs
                    start = _bin_start(number, min_shift, depth) >> min_shift
                    own.first[tid][start] = min(least, own.first[tid].get(start, least))
        return own

    def runs(self, tid: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Places to read, in order, for what overlaps [begin, end)."""
        bins = self.bins[tid]
        end = min(end, 1 << self.min_shift + 3 * self.depth)
        if begin >= end:
            return []
        over = [b for b in bins_over(begin, end, self.min_shift, self.depth) if b in bins]
        window = begin >> self.min_shift
        # what overlaps the begin lies no earlier than what overlaps the last window before it that is known
        least = max((p for w, p in self.first[tid].items() if w <= window), default=0)
        found = sorted((max(a, least), b) for n in over for a, b in bins[n] if b > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out


# ---------------------------------------------------------------- reading


@dataclass
class Part(InputPartition):
    """A part of a file: the records that begin in members from byte ``begin`` to ``end``, or those of ``runs``."""

    path: str
    begin: int = 0
    end: int = 0
    runs: tuple[tuple[int, int], ...] = ()


@dataclass
class Region:
    """What filters ask for: contigs (all if none), and reads that end behind ``begin`` and start before ``end``."""

    names: set[str] | None = None
    begin: int = 0
    end: int = 1 << 62

    def narrow(self, f) -> None:
        """Takes what a filter (column and value) says."""
        column = f.attribute[0] if len(f.attribute) == 1 else ""
        if column == "rname" and isinstance(f, (EqualTo, In)):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.names = own if self.names is None else self.names & own
        elif column == "end0" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.begin = max(self.begin, f.value - isinstance(f, GreaterThanOrEqual))
        elif column == "start0" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
        elif column == "start0" and isinstance(f, EqualTo):
            self.begin, self.end = max(self.begin, f.value), min(self.end, f.value + 1)
        elif column == "start0" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.begin = max(self.begin, f.value)  # reads have one base of the reference at least, or count as if

    @property
    def given(self) -> bool:
        return self.names is not None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.region = Region()
        if options.get("region"):
            name, begin, end = json.loads(options["region"])
            self.region = Region({name}, begin, end)

    def partitions(self):
        out: list[Part] = []
        for path in bam_files(self.path):
            fs, at = open_path(path)
            if self.region.given and fs.get_file_info(f"{at}.csi").type == pafs.FileType.File:
                out += self._by_index(path, Index.from_bytes(fs.open_input_file(f"{at}.csi").read()))
                continue
            size = fs.get_file_info(at).size
            out += [Part(path, i, min(i + self.split, size)) for i in range(0, size, self.split)]
        return out or [Part("")]

    def _by_index(self, path: str, index: Index) -> list[Part]:
        header = Header.read(path)
        runs: list[tuple[int, int]] = []
        for tid, name in enumerate(header.names):
            if name in self.region.names:
                runs += index.runs(tid, self.region.begin, min(self.region.end, max(header.lengths[tid], 1)))
        parts, own, size = [], [], 0
        for a, b in runs:  # in the order of the file
            own.append((a, b))
            size += (b >> 16) - (a >> 16)
            if size >= self.split:
                parts.append(Part(path, runs=tuple(own)))
                own, size = [], 0
        return parts + ([Part(path, runs=tuple(own))] if own else [])

    def read(self, partition):
        if not partition.path:
            return
        header, blocks = Header.read(partition.path), Blocks(partition.path)
        if partition.runs:
            for a, b in partition.runs:
                for data, starts, _ in record_runs(blocks, a, b):
                    if data is not None:
                        yield decode(data, starts, header.names)
            return
        place = header.first if partition.begin <= header.first >> 16 else first_record(blocks, partition.begin, header)
        last = max(partition.end << 16, header.first)
        if place is None or place >= last:
            return
        for data, starts, there in record_runs(blocks, place, last):
            if data is not None:
                yield decode(data, starts, header.names)
            elif there != (expected := first_record(blocks, partition.end, header)) and partition.end < blocks.size:
                raise ValueError(f"{partition.path}: records from {place} lead to {there}, not to {expected}; take larger parts")


class PushedReader(Reader):
    """A reader that filters narrow, for sessions that push them."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.region.narrow(f)
        yield from filters  # they say which blocks are read; rows are still tested


# ---------------------------------------------------------------- writing


def encode(row: dict, tid: int) -> bytes:
    """A record."""
    cigar, seq, name = row["cigar"] or [], row["seq"] or "", row["qname"].encode() + b"\0"
    words = b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"].encode())) for c in cigar)
    packed = bytes.fromhex(seq.upper().translate(_NIBBLES) + "0" * (len(seq) % 2))
    tags = b"" if row["zn"] is None else b"ZNi" + struct.pack("<i", row["zn"])
    begin, span = row["start0"], sum(c["len"] for c in cigar if ON_REFERENCE[OPS.index(c["op"].encode())])
    number = bin_of(max(begin, 0), max(begin, 0) + max(span, 1)) & 0xFFFF
    head = struct.pack("<iiBBHHHiiii", tid, begin, len(name), row["mapq"], number, len(cigar), row["flag"], len(seq), -1, -1, 0)
    body = head + name + words + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


_NIBBLES = str.maketrans({chr(c): f"{BASES.index(c) if c in BASES else 15:x}" for c in range(33, 127)})


def header_bytes(names: list[str], lengths: list[int], order: str = "coordinate") -> bytes:
    text = "".join([f"@HD\tVN:1.6\tSO:{order}\n", *(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in zip(names, lengths))]).encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in zip(names, lengths))
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names)) + refs


class BlockWriter:
    """Members of a file, with places of what is written. A record goes into a member of its own rather than over its
    end, unless it is longer than one."""

    def __init__(self, out):
        self.out, self.held, self.offset = out, bytearray(), 0

    @property
    def place(self) -> int:
        return self.offset << 16 | len(self.held)

    def flush(self) -> None:
        while self.held:
            block = deflate(bytes(self.held[:CONTENT]))
            self.out.write(block)
            self.offset += len(block)
            del self.held[:CONTENT]

    def write(self, data: bytes) -> None:
        if self.held and len(self.held) + len(data) > CONTENT:
            self.flush()
        self.held += data
        if len(self.held) >= CONTENT:
            self.flush()

    def close(self) -> None:
        self.flush()
        self.out.write(END_BLOCK)
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    """A BAM file and its index for each partition, made under another name and put in place when all are there."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.names, self.lengths = json.loads(options["contigs"])
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        fs, at = open_path(self.path)
        tid_of = {n: i for i, n in enumerate(self.names)}
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job[:8]}"
        folder = f"{at}/_temporary/{self.job}"
        own = f"{folder}/{name}-{task.taskAttemptId()}.bam"
        out, index, last = None, Index.for_lengths(self.lengths), (0, -1)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(folder)
                    out = BlockWriter(fs.open_output_stream(own))
                    out.write(header_bytes(self.names, self.lengths))
                    out.flush()
                tid = tid_of.get(row["rname"], -1)
                key = (tid if tid >= 0 else len(self.names), row["start0"])
                if key < last:
                    raise ValueError("records are not in the order of contig and position")
                last = key
                record = encode(row, tid)
                if len(out.held) + len(record) > CONTENT:
                    out.flush()
                place = out.place
                out.write(record)
                index.add(tid, row["start0"], row["end0"], place, out.place)
        if out is None:
            return Written(None)
        out.close()
        with fs.open_output_stream(f"{own}.csi") as f:
            f.write(index.to_bytes())
        return Written(f"{name}-{task.taskAttemptId()}.bam")

    def commit(self, messages):
        fs, at = open_path(self.path)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type == pafs.FileType.File] if self.overwrite else []
        fs.create_dir(at)
        names = [m.name for m in messages if m is not None and m.name]
        for name in names:
            for end in (".csi", ""):  # a file never stands without its index
                fs.move(f"{at}/_temporary/{self.job}/{name}{end}", f"{at}/{name}{end}")
        if not names:
            with fs.open_output_stream(f"{at}/part-00000-{self.job[:8]}.bam") as f:
                f.write(deflate(header_bytes(self.names, self.lengths)) + END_BLOCK)
        for path in old:
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages):
        fs, at = open_path(self.path)
        if fs.get_file_info(f"{at}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/_temporary")


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushedReader if self.options.get("push") == "true" else Reader)(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def bam(spark: SparkSession, path: str, species: str = "", region: tuple[str, int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments of a BAM file or a folder of them, as ``readers.sam`` gives them. ``region``: a contig and 0-based
    positions [begin, end); only blocks with reads that overlap it are opened where there is an index. With
    spark.sql.python.filterPushdown.enabled, filters on rname, start0 and end0 do the same."""
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.read.format(FORMAT).option("path", path).option("split", split).option("push", push)
    rows = read.option("region", json.dumps(region)).load() if region else read.load()
    if region:
        name, begin, end = region
        rows = rows.where((F.col("rname") == name) & (F.col("start0") < end) & (F.greatest("end0", F.col("start0") + 1) > begin))
    return rows.select(F.lit(species).alias("species"), F.monotonically_increasing_id().alias("ord"), "qname", "flag", "rname", "start0", "mapq", "cigar", "seq", "zn", "end0")


def write_bam(alignments: DataFrame, path: str, contigs: DataFrame) -> None:
    """A folder of sorted BAM files with an index each. ``contigs``: chrom and length, in the order of the file if it
    has contig_ord; one row each, as a file's head names them all."""
    spark = alignments.sparkSession
    register(spark)
    rows = contigs.orderBy("contig_ord" if "contig_ord" in contigs.columns else "chrom").select("chrom", "length").collect()
    names, lengths = [r.chrom for r in rows], [int(r.length) for r in rows]
    place = contigs.select(F.col("chrom").alias("rname"), F.col("chrom")).distinct()  # which names the head has
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "rname string, _tid int") if names else place.select("rname", F.lit(0).alias("_tid"))
    rows = alignments.join(F.broadcast(order), "rname", "left").withColumn("_tid", F.coalesce("_tid", F.lit(len(names))))
    cols = [F.col(c).cast(t) for c, t in (("qname", "string"), ("flag", "int"), ("rname", "string"), ("start0", "int"), ("end0", "int"), ("mapq", "int"))]
    zn = (F.col("zn") if "zn" in alignments.columns else F.lit(None)).cast("int").alias("zn")
    rows = rows.repartitionByRange("_tid", "start0").sortWithinPartitions("_tid", "start0", "qname").select(*cols, "cigar", "seq", zn)
    rows.write.format(FORMAT).option("path", path).option("contigs", json.dumps([names, lengths])).mode("overwrite").save()
