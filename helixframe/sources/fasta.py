"""FASTA by byte ranges: an index of records made in parallel, and pieces of records cut by its arithmetic.

The lines of a record hold equally many bases, but for the last, so the byte of any base follows from where the record's
bases begin, from the bases of a line and from its bytes. A task reads the bytes of its pieces only, and no row
holds a contig. Lines of unequal length are an error here; ``readers.fasta`` takes them.

Paths are those that Arrow's file systems know (local, hdfs, s3, gs).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import open_path

INDEX = "helixframe_fasta_index"
INDEX_SCHEMA = "path string, chrom string, length long, offset long, linebases long, linewidth long"
SPLIT = 32 << 20  # bytes of a partition
WINDOW = 1 << 20  # bytes looked at together for heads
SIZE = 1 << 16  # bases of a piece
OPEN_FILES = 64  # of a task


def fasta_files(path: str) -> list[str]:
    """A file, or the files of a folder in the order of their names, without hidden ones and indexes."""
    fs, at = open_path(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if n[0] not in "._" and not n.endswith(".fai")]


def _find(file: pafs.NativeFile, size: int, what: bytes, at: int, stop: int) -> int:
    """The first place of ``what`` that begins at ``at`` or behind it and before ``stop``, or -1."""
    while at < stop:
        data = file.read_at(min(WINDOW + len(what), size - at), at)
        found = data.find(what)
        if found >= 0:
            return at + found if at + found < stop else -1
        at += max(1, len(data) - len(what) + 1)
        if len(data) < len(what):
            return -1
    return -1


def heads(file: pafs.NativeFile, size: int, begin: int, end: int):
    """Where records begin: bytes ``>`` at the beginning of a line, from ``begin`` to ``end``."""
    if begin == 0 and size and file.read_at(1, 0) == b">":
        yield 0
    at = max(begin - 1, 0)
    while (at := _find(file, size, b"\n>", at, end - 1)) >= 0:
        yield at + 1
        at += 1


def entry(file: pafs.NativeFile, size: int, head: int) -> tuple[str, int, int, int, int]:
    """Name, length, offset, linebases and linewidth of the record that begins at ``head``."""
    line = _find(file, size, b"\n", head, size)
    name = file.read_at((size if line < 0 else line) - head - 1, head + 1).decode().split(None, 1)
    name = name[0] if name else ""
    if line < 0:
        return name, 0, size, 0, 0
    offset = line + 1
    following = _find(file, size, b"\n>", line, size)
    stop = size if following < 0 else following
    while stop > offset:  # blank lines at the end
        tail = file.read_at(min(64, stop - offset), max(stop - 64, offset))
        kept = len(tail.rstrip())
        stop -= len(tail) - kept
        if kept:
            break
    if stop <= offset:
        return name, 0, offset, 0, 0
    first = _find(file, size, b"\n", offset, stop)
    if first < 0:  # one line
        return name, stop - offset, offset, stop - offset, stop - offset + 1
    width = first + 1 - offset
    bases = width - 1 - (file.read_at(1, first - 1) == b"\r")
    lines, rest = divmod(stop - offset, width)
    if not bases or rest > bases:
        raise ValueError(f"{name}: lines of unequal length")
    return name, lines * bases + rest, offset, bases, width


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class IndexReader(DataSourceReader):
    """A row for each record, by ranges of bytes."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options["split"])

    def partitions(self):
        out = []
        for path in fasta_files(self.path):
            fs, at = open_path(path)
            size = fs.get_file_info(at).size
            out += [Range(path, i, min(i + self.split, size)) for i in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, at = open_path(partition.path)
        file = fs.open_input_file(at)
        size = file.size()
        for head in heads(file, size, partition.begin, partition.end):
            yield (partition.path, *entry(file, size, head))


class IndexSource(DataSource):
    @classmethod
    def name(cls):
        return INDEX

    def schema(self):
        return INDEX_SCHEMA

    def reader(self, schema):
        return IndexReader(self.options)


def index(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """A row for each record of a file, or of a folder's files: path, chrom, length, offset, linebases, linewidth, and
    contig_ord, which grows in the order of the files."""
    spark.dataSource.register(IndexSource)
    rows = spark.read.format(INDEX).option("path", path).option("split", split).load()
    return rows.withColumn("contig_ord", F.monotonically_increasing_id())


def read_fai(spark: SparkSession, path: str, fai: str) -> DataFrame:
    """``index`` of one file from its index file."""
    rows = spark.read.option("sep", "\t").schema("chrom string, length long, offset long, linebases long, linewidth long").csv(fai)
    return rows.withColumn("path", F.lit(path)).withColumn("contig_ord", F.monotonically_increasing_id())


def write_fai(index: DataFrame, path: str) -> None:
    """An index file: one line a record, in the order of the file."""
    index.orderBy("contig_ord").select("chrom", "length", "offset", "linebases", "linewidth").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def pieces(index: DataFrame, size: int = SIZE, overlap: int = 0, upper: bool = True) -> DataFrame:
    """chrom, length, start0, seq: what ``intervals.chunks`` makes of contigs, read by its bytes. Each piece is
    ``overlap`` longer than the distance of their starts."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    own = index.where("length > 0").select("path", "chrom", "length", "offset", "linebases", "linewidth", starts.alias("start0"))
    own = own.repartition(4 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "start0")

    def read(batches):
        files: dict[str, pafs.NativeFile] = {}
        for batch in batches:
            rows = batch.to_pylist()
            for some in (rows[i : i + 64] for i in range(0, len(rows), 64)):  # a few pieces a batch
                seqs = []
                for r in some:
                    if r["path"] not in files:
                        if len(files) >= OPEN_FILES:
                            files.clear()
                        fs, at = open_path(r["path"])
                        files[r["path"]] = fs.open_input_file(at)
                    start, stop = r["start0"], min(r["start0"] + size + overlap, r["length"])
                    first, last = (r["offset"] + b // r["linebases"] * r["linewidth"] + b % r["linebases"] for b in (start, stop - 1))
                    seq = files[r["path"]].read_at(last + 1 - first, first).translate(None, b"\r\n")
                    if len(seq) != stop - start or b">" in seq:
                        raise ValueError(f"{r['chrom']}: lines of unequal length about base {start}")
                    seqs.append((seq.upper() if upper else seq).decode())
                cols = [pa.array([r[c] for r in some], t) for c, t in (("chrom", pa.string()), ("length", pa.int64()), ("start0", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(seqs, pa.string())], names=["chrom", "length", "start0", "seq"])

    return own.mapInArrow(read, "chrom string, length long, start0 long, seq string")
