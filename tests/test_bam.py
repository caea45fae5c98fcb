"""BAM files made by hand with zlib, read in parts of any size and by region."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helixframe.sources import bam as B
from helixframe.sources import readers

NAMES, LENGTHS = ["chr1", "chr2", "chrEmpty"], [2_000_000, 300_000, 500]
COLS = ["qname", "flag", "rname", "start0", "end0", "mapq", "cigar", "seq", "zn"]


def member(content):
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


def rows_of(rng, n):
    """Records as text fields, in the order of contig and position; unmapped ones last."""
    rows = []
    for i in range(n):
        tid = rng.choice([0, 0, 1])
        length = rng.choice([1, 2, 75, 150, 151])
        cigar = rng.choice([f"{length}M", f"{length}M", f"2S{length}M3D1I", f"{length}=5N2X", "*"])
        need = sum(int(x[:-1]) for x in __import__("re").findall(r"\d+[MIS=X]", cigar))
        seq = "".join(rng.choice("ACGTN") for _ in range(need)) or "*"
        tag = rng.choice([None, ("c", -1), ("C", 60), ("s", -300), ("S", 40000), ("i", 7)])
        rows.append((f"q{i}" + "x" * rng.randint(0, 40), rng.choice([0, 16, 1024]), tid, rng.randrange(LENGTHS[tid]), rng.randint(0, 60), cigar, seq, tag))
    rows.sort(key=lambda r: (r[2], r[3]))
    return rows + [(f"u{i}", 4, -1, -1, 0, "*", "ACGTN", None) for i in range(3)]


def packed(row):
    name, flag, tid, pos, mapq, cigar, seq, tag = row
    ops = [] if cigar == "*" else [(int(a), "MIDNSHP=X".index(b)) for a, b in __import__("re").findall(r"(\d+)(.)", cigar)]
    seq = "" if seq == "*" else seq
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    aux = b"XZZlong ZNi text\0XBBs\x02\0\0\0\1\0\2\0" + (b"ZN" + tag[0].encode() + struct.pack("<" + {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i"}[tag[0]], tag[1]) if tag else b"")
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", a << 4 | o) for a, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes([40] * len(seq)) + aux
    return struct.pack("<i", len(body)) + body


def bam_bytes(rows, rng, sizes):
    """Members of any size, so that records and the head go over their ends; some are empty."""
    content = B.header_bytes(NAMES, LENGTHS) + b"".join(map(packed, rows))
    out, at = [], 0
    while at < len(content):
        n = rng.choice(sizes)
        out.append(member(content[at : at + n]))
        at += n
    return b"".join(out) + B.END_BLOCK


def sam_lines(rows):
    for name, flag, tid, pos, mapq, cigar, seq, tag in rows:
        yield "\t".join(map(str, [name, flag, NAMES[tid] if tid >= 0 else "*", pos + 1, mapq, cigar, "*", 0, 0, seq, "*", "XZ:Z:long ZNi text", *([f"ZN:i:{tag[1]}"] if tag else [])]))


def sorted_rows(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


@pytest.mark.parametrize(("sizes", "split"), [((0, 1, 7, 40, 300), 700), ((200, 65280), 3000), ((65280,), 1 << 20)])
def test_equal_to_text(spark, tmp_path, sizes, split):
    rng = random.Random(len(sizes))
    rows = rows_of(rng, 700)
    (tmp_path / "a.bam").write_bytes(bam_bytes(rows, rng, sizes))
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + "\n".join(sam_lines(rows)) + "\n")
    got = B.bam(spark, str(tmp_path / "a.bam"), "s", split=split)
    text = readers.sam(spark, str(tmp_path / "a.sam"), "s")
    assert sorted_rows(got) == sorted_rows(text)
    assert [r.qname for r in got.orderBy("ord").collect()] == [r[0] for r in rows]
    assert got.select(*COLS).dtypes == text.select(*COLS).dtypes
    if split < 1 << 20:
        assert got.rdd.getNumPartitions() > 3


def test_long_records_over_many_parts(spark, tmp_path):
    """A record longer than a part, and members without the beginning of one."""
    rng = random.Random(5)
    rows = [("long", 0, 0, 10, 60, f"{n}M", "ACGT" * (n // 4), None) for n in (40, 200_000, 80, 400_000, 12)]
    (tmp_path / "a.bam").write_bytes(bam_bytes(rows, rng, (9000,)))
    got = B.bam(spark, str(tmp_path / "a.bam"), split=20_000).collect()
    assert [len(r.seq) for r in got] == [40, 200_000, 80, 400_000, 12]


def test_empty_and_broken(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam_bytes([], random.Random(1), (50,)))
    assert B.bam(spark, str(tmp_path / "a.bam")).count() == 0
    assert B.bam(spark, str(tmp_path / "none")).count() == 0
    whole = bam_bytes(rows_of(random.Random(2), 50), random.Random(2), (500,))
    (tmp_path / "b.bam").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="no block|not whole"):
        B.bam(spark, str(tmp_path / "b.bam")).count()


def test_bins():
    rng = random.Random(7)
    for _ in range(2000):
        a = rng.randrange(1 << 29)
        b = min(a + rng.choice([1, 150, 20_000, 5_000_000]), 1 << 29)
        c = rng.randrange(1 << 29)
        d = min(c + rng.choice([1, 150, 20_000, 5_000_000]), 1 << 29)
        over = set(B.bins_over(c, d))
        if a < d and c < b:
            assert B.bin_of(a, b) in over  # what overlaps is never missed
        assert B.bin_of(c, d) in over
    assert B.bin_of(0, 1 << 29) == 0 and B.bin_of(0, 1) == 4681  # numbers of the format


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A sorted folder with indexes, and its rows."""
    at = str(tmp_path_factory.mktemp("bam"))
    rng = random.Random(11)
    rows = [r for r in rows_of(rng, 12_000)]
    text = spark.createDataFrame([(line,) for line in sam_lines(rows)], "value string")
    reads = readers.parse_sam(text, "s").cache()
    contigs = spark.createDataFrame(list(zip(NAMES, LENGTHS, range(3))), "chrom string, length long, contig_ord long")
    B.write_bam(reads, f"{at}/x", contigs)
    return f"{at}/x", reads


def test_written_files_are_read(spark, written):
    path, reads = written
    assert sorted_rows(B.bam(spark, path)) == sorted_rows(reads)


def regions(rng):
    yield from [("chr1", 0, 2_000_000), ("chr1", 0, 1), ("chr2", 299_999, 300_000), ("chrEmpty", 0, 500), ("none", 0, 10), ("chr1", 5000, 5000)]
    for _ in range(12):
        a = rng.randrange(2_000_000)
        yield "chr1", a, a + rng.choice([1, 500, 40_000])


def test_regions(spark, written):
    path, reads = written
    for name, a, b in regions(random.Random(3)):
        want = reads.where((F.col("rname") == name) & (F.col("start0") < b) & (F.greatest("end0", F.col("start0") + 1) > a))
        got = B.bam(spark, path, "s", region=(name, a, b))
        assert sorted_rows(got) == sorted_rows(want), (name, a, b)


def opened(path, options, filters=()):
    """Members that a reader opens for records, all in this process."""
    seen = []

    class Counted(B.Blocks):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self)

    reader = B.PushedReader({"path": path, **options})
    list(reader.pushFilters(list(filters)))
    parts = reader.partitions()
    before, B.Blocks = B.Blocks, Counted
    try:
        n = sum(batch.num_rows for part in parts for batch in reader.read(part))
    finally:
        B.Blocks = before
    return n, sum(b.opened for b in seen) - len(seen) // 2 * 1


def test_regions_open_few_blocks(written):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    path, _ = written
    all_rows, all_blocks = opened(path, {})
    some = opened(path, {"region": '["chr1", 1000000, 1000500]'})
    pushed = opened(path, {}, [EqualTo(("rname",), "chr1"), LessThan(("start0",), 1_000_500), GreaterThan(("end0",), 1_000_000)])
    assert some == pushed and 0 < some[0] < all_rows / 20 and some[1] < all_blocks / 5


def test_index_survives_its_file(written):
    path, _ = written
    for name in B.bam_files(path):
        with open(f"{name}.csi", "rb") as f:
            index = B.Index.from_bytes(f.read())
        header = B.Header.read(name)
        assert header.names == NAMES and header.lengths == LENGTHS and index.n == 3
        again = B.Index.from_bytes(index.to_bytes())
        rng = random.Random(4)
        for _ in range(200):
            a = rng.randrange(2_000_000)
            assert again.runs(0, a, a + 700) == index.runs(0, a, a + 700)


def test_a_failed_write_leaves_the_old_files(spark, written, tmp_path):
    contigs = spark.createDataFrame([("chr1", 100)], "chrom string, length long")
    one = spark.createDataFrame([("a", 0, "chr1", 3, 60, "2M", "AC")], "qname string, flag int, rname string, start0 int, mapq int, cigar string, seq string")
    from helixframe.operators.sites import parse_cigar

    one = one.withColumn("cigar", parse_cigar(F.col("cigar"))).withColumn("end0", F.col("start0") + 2)
    at = str(tmp_path / "y")
    B.write_bam(one, at, contigs)
    with pytest.raises(Exception, match="too short|ValueError|error"):
        B.write_bam(one.withColumn("qname", F.expr("assert_true(false, 'an error')").cast("string")), at, contigs)
    assert [r.qname for r in B.bam(spark, at).collect()] == ["a"]
    B.write_bam(one.withColumn("qname", F.lit("b")), at, contigs)
    assert [r.qname for r in B.bam(spark, at).collect()] == ["b"]
