"""Whole runs over again: what is kept, what is made anew, masked tiles, derived calls, depth and BAM."""

import json
import random
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.operators import sites
from helixframe.operators.sites import parse_cigar
from helixframe.plans import cli, runs
from helixframe.sources import bam, readers

from .test_io import genomes


@pytest.fixture
def logged(spark, tmp_path):
    """Genomes, their changes, and an aligner that notes each start."""
    files, changes, aligner = genomes(spark, tmp_path)
    script = aligner.split()[1]
    text = open(script).read()
    log = tmp_path / "starts"
    with open(script, "w") as f:
        f.write(f"open({str(log)!r}, 'a').write('x')\n{text}")
    return files, changes, aligner, lambda: len(log.read_text()) if log.exists() else 0


def calls(spark, out):
    return {(int(r["taxon"]), r["chromosome"], int(r["position"])) for r in spark.read.option("header", True).csv(f"{out}/Mutations").collect()}


def test_nothing_is_aligned_twice(spark, tmp_path, logged):
    files, changes, aligner, starts = logged
    own = ["pair", "--genomes", files[1], "--reference", files[0], "--aligner-cmd", aligner + " {fq} {ref} {cores}", "--out", str(tmp_path / "out")]
    calls = lambda spark, out: {(r["chromosome"], r["position"]) for r in spark.read.option("header", True).csv(f"{out}/Mutations").collect()}
    assert cli.main(own) == 0
    first, before = calls(spark, tmp_path / "out"), starts()
    assert before > 0 and len(first) == len(changes[1])
    assert cli.main(own) == 0 and cli.main([*own, "--mapq", "30"]) == 0
    assert starts() == before and calls(spark, tmp_path / "out") == first
    # one genome is edited: both its alignments and its calls are made anew
    lines = open(files[1]).read().split("\n")
    edited = lines[10]
    at = next(i for i in range(20, 60) if edited[i - 1 : i + 2] == edited[i - 1 : i + 2].upper())
    lines[10] = edited[:at] + "ACGT"[("ACGT".index(edited[at]) + 2) % 4] + edited[at + 1 :]
    with open(files[1], "w") as f:
        f.write("\n".join(lines))
    assert cli.main(own) == 0
    assert starts() > before and calls(spark, tmp_path / "out") != first
    before = starts()
    assert cli.main([*own, "--fragment-length", "100", "--fragment-offset", "50"]) == 0
    assert starts() > before


def test_other_alignments_are_seen(spark, tmp_path, logged):
    files, changes, aligner, _ = logged
    fasta = [readers.fasta(spark, f) for f in files]
    rows, _ = runs.align_genomes(spark, fasta[1:2], str(tmp_path / "a"), aligner)
    assert runs.source_of(rows) == runs.source_of(spark.read.parquet(str(tmp_path / "a/aligned")))
    pieces = runs.intervals.chunks(fasta[0], 1000)
    got = [runs.run_pair(spark, own, pieces, str(tmp_path / "out"))["site_classes"]["differs"] for own in (rows, rows.where("start0 < 1500"), rows)]
    assert got[0] == got[2] == len(changes[1]) > got[1] > 0


def test_tiles_avoid_their_genomes_repeats(spark, tmp_path, logged):
    files, changes, aligner, starts = logged
    for i, span in ((1, "chr_1\t0\t1500\n"), (2, "chr2\t10\t20\n")):
        (tmp_path / f"m{i}.bed").write_text(span)
    own = ["trio", "--genomes", *files[1:], "--reference", files[0], "--aligner-cmd", aligner + " {fq} {ref} {cores}", "--out", str(tmp_path / "out")]
    assert cli.main([*own, "--genome-masks", str(tmp_path / "m1.bed"), str(tmp_path / "m2.bed")]) == 0
    tiles = spark.read.parquet(str(tmp_path / "out/aligned"))
    first = tiles.where("taxon = 1 and rname = 'chr_1'").agg(F.min("start0")).first()[0]
    assert 1400 <= first <= 1500 and tiles.where("taxon = 2 and rname = 'chr_1'").agg(F.min("start0")).first()[0] == 0
    assert {p for t, c, p in calls(spark, tmp_path / "out") if t == 2 and c == "chr_1"} == {p for _, c, p, _ in changes[2] if c == "chr_1" and p > first}
    before = starts()
    assert cli.main(own) == 0 and starts() > before  # without masks other tiles are aligned


def test_derived_calls(spark, tmp_path, logged):
    files, changes, aligner, _ = logged
    own = ["--genomes", *files[1:], "--reference", files[0], "--aligner-cmd", aligner + " {fq} {ref} {cores}"]
    assert cli.main(["trio", *own, "--out", str(tmp_path / "plain")]) == 0
    assert cli.main(["trio", *own, "--annotate", "--out", str(tmp_path / "ann")]) == 0
    assert cli.main(["derive", "--run", str(tmp_path / "ann"), "--mapq", "60", "--out", str(tmp_path / "at")]) == 0
    assert calls(spark, tmp_path / "at") == calls(spark, tmp_path / "plain")
    for taxon in (1, 2):
        a, b = (json.loads((tmp_path / d / f"Counts/taxon{taxon}_mutations.json").read_text()) for d in ("at", "plain"))
        assert a == b and sum(a.values()) == len(changes[taxon])
    pair = [*own[:2], *own[3:]]
    assert cli.main(["pair", *pair, "--annotate", "--out", str(tmp_path / "p")]) == 0
    assert cli.main(["derive", "--run", str(tmp_path / "p"), "--mapq", "60", "--out", str(tmp_path / "q")]) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "q/Mutations")).collect()
    assert {(r["chromosome"], int(r["position"])) for r in rows} == {(c, p) for _, c, p, _ in changes[1]} and rows[0]["change"] and rows[0]["mutation"]


def test_bam_in_place_of_sam(spark, tmp_path, logged):
    files, changes, aligner, _ = logged
    fasta = [readers.fasta(spark, f) for f in files]
    rows, _ = runs.align_genomes(spark, fasta[1:], str(tmp_path / "a"), aligner)
    contigs = fasta[0].select("chrom", F.length("seq").cast("long").alias("length"))
    for t in (1, 2):
        bam.write_bam(rows.where(F.col("taxon") == t), str(tmp_path / f"{t}.bam"), contigs)
    assert cli.main(["trio", "--alignments", str(tmp_path / "1.bam"), str(tmp_path / "2.bam"), "--reference", files[0], "--out", str(tmp_path / "out")]) == 0
    assert calls(spark, tmp_path / "out") == {(t, c, p) for own in changes for t, c, p, _ in own}
    shutil.rmtree(tmp_path / "2.bam")
    assert cli.main(["trio", "--alignments", str(tmp_path / "1.bam"), str(tmp_path / "2.bam"), "--reference", files[0], "--out", str(tmp_path / "no")]) == 1


@pytest.mark.parametrize("most", [1, 3, 1500])
def test_depth(spark, most):
    """The first reads of a position by start and order, over tiles, deletions and insertions; one position is deep."""
    rng = random.Random(most)
    reads = []
    for i in range(900):
        start = rng.choice([500, 500, rng.randrange(0, 1200)])
        cigar = rng.choice(["20M", "8M2D10M", "9M1I10M"])
        reads.append((i, rng.choice([1, 2]), "c", start, cigar, "".join(rng.choice("AACG") for _ in range(20 - 2 * ("D" in cigar)))))
    rng.shuffle(reads)
    df = spark.createDataFrame(reads, "ord long, taxon int, rname string, start0 int, cigar string, seq string").withColumn("cigar", parse_cigar(F.col("cigar"))).withColumns({"flag": F.lit(0), "end0": F.col("start0") + 20})
    lines = sites.own_lines(sites.tiled_lines(df, [1, 2], F.lit("A"), None, 2, 250, max_depth=most))
    deep = defaultdict(list)
    for order, taxon, _, start, cigar, seq in sorted(reads, key=lambda r: (r[3], r[0])):
        p, q = start + 1, 0
        for k, op in {"20M": [(20, "M")], "8M2D10M": [(8, "M"), (2, "D"), (10, "M")], "9M1I10M": [(9, "M"), (1, "I"), (10, "M")]}[cigar]:
            if op == "I":
                q += k
                continue
            for j in range(k):
                deep[p, taxon].append((None if op == "D" else seq[q + j], op == "D", cigar == "9M1I10M" and p == start + 9))
                p += 1
            q += k * (op == "M")
    want = {}
    for (p, t), found in deep.items():
        own = found[:most]
        bases = {b for b, _, _ in own if b}
        want[p, t] = (min(bases) if len(bases) == 1 else None, any(d for _, d, _ in own), any(i for _, _, i in own), len(bases) > 1)
    got = {(r.pos, t): (r[f"base_{t}"], r[f"del_{t}"], r[f"ins_{t}"], r[f"dis_{t}"]) for r in lines.collect() for t in (1, 2) if r[f"cov_{t}"]}
    assert got == want and max(map(len, deep.values())) > 100
