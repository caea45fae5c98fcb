"""Indexes and pieces of FASTA files by bytes, against the reader of whole records."""

import random
import resource

import pytest
from pyspark.sql import functions as F

from helixframe.operators import intervals
from helixframe.sources import fasta, readers


def text_of(rng, n, newline="\n"):
    """Records of any width and length, some empty, some in one line, some with blank lines behind them."""
    out, lengths = [], []
    for i in range(n):
        length = rng.choice([0, 1, 59, 60, 61, 120, 1000, 5003])
        width = rng.choice([1, 7, 60, 10_000])
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(length))
        lines = [seq[k : k + width] for k in range(0, length, width)]
        out.append(newline.join([f">chr{i}{rng.choice(['', ' a > b', chr(9) + 'x'])}", *lines]) + newline * rng.choice([1, 1, 2, 3]))
        lengths.append((f"chr{i}", length))
    return "".join(out), lengths


@pytest.mark.parametrize(("newline", "split", "window"), [("\n", 1 << 25, 1 << 20), ("\n", 777, 50), ("\r\n", 4001, 200)])
def test_pieces(spark, tmp_path, monkeypatch, newline, split, window):
    text, lengths = text_of(random.Random(split), 60, newline)
    for name, part in (("a.fa", text), ("b.fa", ">last\nAC" + newline + "GT")):  # no line end at the end
        (tmp_path / name).write_bytes(part.encode())
    monkeypatch.setattr(fasta, "WINDOW", window)
    index = fasta.index(spark, str(tmp_path), split)
    if split > 1 << 20:
        assert [(r.chrom, r.length) for r in index.orderBy("contig_ord").collect()] == [*lengths, ("last", 4)] or newline == "\r\n"
    else:
        assert index.rdd.getNumPartitions() > 4
    whole = {r.chrom: r.seq for r in readers.fasta(spark, str(tmp_path)).collect()}
    assert {r.chrom: r.length for r in index.collect()} == {c: len(s) for c, s in whole.items()}
    got = fasta.pieces(index, 100, 30).collect()
    want = {(c, len(s), a, s[a : a + 130]) for c, s in whole.items() for a in range(0, len(s), 100)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_places(spark):
    rows = spark.range(0, 1000, 1, 7).withColumn("o", F.monotonically_increasing_id())
    assert {(r.id, r.place) for r in readers.places(rows, "o").collect()} == {(i, i + 1) for i in range(1000)}


def test_index_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTA\nCG\n>y\nTT\n")
    index = fasta.index(spark, str(tmp_path / "a.fa"))
    fasta.write_fai(index, str(tmp_path / "a.fa.fai"))
    again = fasta.read_fai(spark, str(tmp_path / "a.fa"), str(tmp_path / "a.fa.fai"))
    assert [tuple(r)[:5] for r in again.collect()] == [("x", 7, 3, 5, 6), ("y", 2, 15, 2, 3)]
    assert sorted(tuple(r) for r in fasta.pieces(again, 4).collect()) == [("x", 7, 0, "ACGT"), ("x", 7, 4, "ACG"), ("y", 2, 0, "TT")]


def test_unequal_lines_are_an_error(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTA\nCG\nACGTA\nACGTA\n")
    with pytest.raises(Exception, match="unequal"):
        fasta.pieces(fasta.index(spark, str(tmp_path / "a.fa")), 4).collect()
    (tmp_path / "empty.fa").write_text("")
    assert fasta.index(spark, str(tmp_path / "empty.fa")).count() == 0


def test_fragments_of_pieces(spark, tmp_path):
    rng = random.Random(9)
    (tmp_path / "a.fa").write_text("".join(f">c{i}\n{''.join(rng.choice('ACGT') for _ in range(n))}\n" for i, n in enumerate((100, 150, 151, 70_000))))
    size = intervals.piece_size(75)
    got = intervals.fragments_of(fasta.pieces(fasta.index(spark, str(tmp_path / "a.fa")), size, 150), size)
    want = intervals.fragments(readers.fasta(spark, str(tmp_path / "a.fa")))
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.chrom, r.start, r.end, r.seq) for r in want.collect())


def test_a_long_contig_in_little_memory(spark, tmp_path):
    """A hundred megabases in one record: no process that reads it may hold it."""
    line = ("ACGTTGCAAC" * 6 + "\n").encode()
    with open(tmp_path / "long.fa", "wb") as f:
        f.write(b">long\n")
        for _ in range(1000):
            f.write(line * 1667)
    index = fasta.index(spark, str(tmp_path / "long.fa"))
    assert index.first().length == 1000 * 1667 * 60
    peak = lambda rows: (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss for _ in rows)

    def used(batches):
        import pyarrow as pa

        n = sum(sum(map(len, b.column(0).to_pylist())) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array(list(peak([0])))], names=["n", "kb"])

    rows = fasta.pieces(index).select("seq").mapInArrow(used, "n long, kb long").collect()
    assert sum(r.n for r in rows) == 1000 * 1667 * 60 and max(r.kb for r in rows) < 600_000
