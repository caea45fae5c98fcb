"""Readers, writers, runs, commands and the stream."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from helixframe.operators import intervals, reads
from helixframe.plans import cli, derived, runs
from helixframe.sources import external, readers, writers
from helixframe.streaming.continuity import ContinuityStream, NeighbourQualityStream

SF = "/root/testdata/sf0.001"


def test_masks(spark, tmp_path):
    (tmp_path / "rm.out").write_text("SW perc\nscore div\n\n 463 1.3 0.6 1.7 chr1 10 60 (2) + x\n 12 1 1 1 chr2 90 70 (2) C y\n")
    assert sorted(tuple(r) for r in readers.repeatmasker(spark, str(tmp_path / "rm.out")).collect()) == [("chr1", 10, 60), ("chr2", 70, 90)]
    (tmp_path / "wm").write_text(">chr1 x\n0 - 9\n20 - 29\n>chr2\n5 - 5\n")
    assert sorted(tuple(r) for r in readers.windowmasker(spark, str(tmp_path / "wm")).collect()) == [("chr1", 1, 10), ("chr1", 21, 30), ("chr2", 6, 6)]
    (tmp_path / "x.bed").write_text("#c\ntrack t\nchr1\t0\t10\nchr1\t20\t30\tname\n")
    own = readers.bed(spark, str(tmp_path / "x.bed"))
    writers.bed(own, str(tmp_path / "out.bed"))
    assert sorted(tuple(r) for r in readers.bed(spark, str(tmp_path / "out.bed")).collect()) == [("chr1", 1, 10), ("chr1", 21, 30)]


def test_fasta_and_sam(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 one\nacgt\nAC\n>chr2\nTT\n")
    assert sorted(tuple(r) for r in readers.fasta(spark, str(tmp_path / "g.fa")).collect()) == [("chr1", "ACGTAC"), ("chr2", "TT")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nchr1_1_4\t0\tchr1\t11\t60\t2M1D2M\t*\t0\t0\tACGT\tIIII\tZN:i:7\nbad\tline\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    own = readers.sam(spark, str(tmp_path / "a.sam"), "s")
    got = {r["qname"]: r for r in own.collect()}
    assert set(got) == {"chr1_1_4", "r2"} and got["chr1_1_4"]["start0"] == 10 and got["chr1_1_4"]["end0"] == 15 and got["chr1_1_4"]["zn"] == 7 and got["r2"]["cigar"] is None
    writers.sam(own, str(tmp_path / "out.sam"))
    assert sorted(r["qname"] for r in readers.sam(spark, str(tmp_path / "out.sam")).collect()) == ["chr1_1_4", "r2"]
    (tmp_path / "x.fai").write_text("chr1\t1000\t6\t60\t61\nchr2\t2000\t6\t60\t61\nchr3\t500\t6\t60\t61\n")
    from helixframe.operators.intervals import top_contigs

    assert [r["chrom"] for r in top_contigs(readers.fai(spark, str(tmp_path / "x.fai")), 2).collect()] == ["chr2", "chr1"]


def test_pileup_text(spark, tmp_path):
    (tmp_path / "p").write_text("chr1\t100\tA\t1\t.\tI\t1\t.\tI\nchr1\t101\tC\t1\t.\tI\t1\t^+T\tI\nchr1\t102\tG\t1\t.+1A\tI\t0\t*\t*\nshort\t1\n")
    own = {r["pos"]: r for r in readers.pileup_lines(readers.pileup(spark, str(tmp_path / "p"), 2), 2).collect()}
    assert own[101]["base_1"] == "C" and own[101]["base_2"] == "T" and not own[101]["ins_2"]
    assert own[102]["ins_1"] and not own[102]["cov_2"] and not own[102]["del_2"]
    (tmp_path / "q").write_text("chr1\t5\tA\t2\t^].+1C$\tII\t]!\t-1,3\n")
    rows = readers.pileup(spark, str(tmp_path / "q"), 1, annotated=True)
    assert rows.count() == 1


def test_tables(spark, tmp_path):
    counts = spark.createDataFrame([(0, "identical", "ACG", 1, 60, None, 7)], "mode int, site_class string, label string, lo int, hi int, indel_mapq int, n long")
    writers.site_counts(counts, str(tmp_path / "sc"), False)
    assert [tuple(r) for r in readers.site_counts(spark, str(tmp_path / "sc")).collect()] == [(0, "identical", "ACG", 1, 60, 7, None)]
    (tmp_path / "odd.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        readers.site_counts(spark, str(tmp_path / "odd.tsv"))
    writers.counts_json(spark.createDataFrame([("x", 2), ("y", 1)], "label string, n long"), "label", str(tmp_path / "c.json"))
    assert {r["label"]: r["n"] for r in readers.counts_json(spark, str(tmp_path / "c.json")).collect()} == {"x": 2.0, "y": 1.0}


def test_commands():
    assert external.aligner_command("bwa").startswith("bwa mem")
    for bad in (("x", None), ("bwa", "cmd {ref}"), ("bwa", "cmd {fq} {cores}")):
        with pytest.raises(ValueError):
            external.aligner_command(*bad)
    with pytest.raises(ValueError):
        external.masker("other")
    assert cli.parser().parse_args(["trio", "--alignments", "a", "--reference", "r", "--out", "o"]).mapq == 60
    assert cli.main(["derive", "--run", "/nonexistent", "--out", "/tmp/none"]) == 1


def test_runs(spark, tmp_path):
    own = derived.alignments(spark, SF, mapq=1)
    out = str(tmp_path / "trio")
    got = runs.run_trio(spark, own, derived.reference(), out, runs.Options(mapq=30, indel_window=3, five_mer=True))
    assert got["site_classes"]["identical"] > 1000 and got["near_indel"] and json.loads((tmp_path / "trio/run_summary.json").read_text())["parameters"]["mapq"] == 30
    again = runs.run_trio(spark, own, derived.reference(), out, runs.Options(mapq=30, indel_window=3, five_mer=True))
    assert again["site_classes"] == got["site_classes"]
    swapped = own.withColumn("taxon", 3 - F.col("taxon"))
    turned = runs.run_trio(spark, swapped, derived.reference(), str(tmp_path / "swapped"), runs.Options(mapq=30, indel_window=3))
    assert turned["site_classes"]["taxa1_mut"] == got["site_classes"]["taxa2_mut"]
    pair = runs.run_pair(spark, own.where("taxon = 1"), derived.reference(), str(tmp_path / "pair"), runs.Options(mapq=30))
    assert pair["site_classes"]["differs"] > 50
    runs.run_trio(spark, own, derived.reference(), str(tmp_path / "ann"), runs.Options(annotate=True))
    made = runs.derive_run(spark, str(tmp_path / "ann"), str(tmp_path / "at"), 30, True)
    assert made["site_classes"]["identical"] > 1000
    for bad in ((out, 30, False), (str(tmp_path / "ann"), 0, False), (str(tmp_path / "ann"), 30, True)):
        with pytest.raises(ValueError):
            runs.derive_run(spark, bad[0], str(tmp_path / "no"), bad[1], True, bad[2])
    multi = runs.run_multi(spark, own, derived.reference(), str(tmp_path / "multi"), "((a,b),out);", "out", runs.Options(mapq=30))
    assert multi["variable"] > 100


@pytest.mark.parametrize("run", [2, 3])
def test_stream_equals_batch(spark, tmp_path, run):
    """Whatever the batches; with a new object for each batch, and one batch that comes twice."""
    rows = derived.reads(spark, SF).select("species", "qname", "frag_ord", "rname", "start0", "end0", "mapq", "flag").cache()
    whole = {r["qname"]: r["status"] for r in reads.continuity_status(rows, run=run).collect()}
    tagged = {r["qname"]: r["zn"] for r in reads.neighbour_mapq(rows).collect()}
    edges = [0, 900, 3000, 1_000_000_600, 3_000_000_000]
    for name, make, value, want in (("c", lambda sink, at: ContinuityStream(sink, at, run=run), "status", whole), ("z", NeighbourQualityStream, "zn", tagged)):
        got: dict = {}
        sink = lambda df, epoch: got.__setitem__(epoch, {r["qname"]: r[value] for r in df.collect()})  # noqa: E731, B023
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            batch = rows.where((F.col("frag_ord") >= a) & (F.col("frag_ord") < b))
            make(sink, str(tmp_path / name))(batch, i)
            if i == 2:  # the stream stopped before it noted that the epoch was done
                before = dict(got)
                make(sink, str(tmp_path / name))(batch, i)
                assert got == before
        make(sink, str(tmp_path / name)).close(spark)
        assert sum(map(len, got.values())) == len(want) and {k: v for x in got.values() for k, v in x.items()} == want


ALIGNER = """import sys
lines = iter(sys.stdin)
print("@HD\\tVN:1.6")
for name in lines:
    seq = next(lines).strip(); next(lines); next(lines)
    chrom, start, end = name[1:].strip().rsplit("_", 2)
    print("\\t".join([name[1:].strip(), "0", chrom, start, "60", f"{len(seq)}M", "*", "0", "0", seq, "*"]))
if "--fail" in sys.argv:
    sys.exit("no index")
"""


def genomes(spark, tmp_path):
    """A reference and two genomes with a few changes; FASTA files and the changes of each."""
    import random

    rng = random.Random(4)
    ref = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("chr_1", 3000), ("chr2", 1200), ("tiny", 40))}
    files, changes = [], []
    for i in range(3):
        own = {c: list(s) for c, s in ref.items()}
        found = set()
        for p in range(100 + 10 * i, 2900, 97) if i else ():
            old = own["chr_1"][p]
            own["chr_1"][p] = "ACGT"[("ACGT".index(old) + 1) % 4]
            found.add((i, "chr_1", p + 1, f"{ref['chr_1'][p - 1]}[{old}>{own['chr_1'][p]}]{ref['chr_1'][p + 1]}"))
        path = tmp_path / f"g{i}.fa"
        path.write_text("".join(f">{c} some > text\n" + "\n".join("".join(s)[k : k + 70] for k in range(0, len(s), 70)) + "\n" for c, s in own.items()))
        files.append(str(path))
        changes.append(found)
    script = tmp_path / "aligner.py"
    script.write_text(ALIGNER)
    return files, changes, f"{sys.executable} {script}"


def test_from_genomes_to_spectra(spark, tmp_path):
    files, changes, aligner = genomes(spark, tmp_path)
    fasta = [readers.fasta(spark, f) for f in files]
    assert {(r["chrom"], len(r["seq"])) for r in fasta[0].collect()} == {("chr_1", 3000), ("chr2", 1200), ("tiny", 40)}
    mask = spark.createDataFrame([("chr_1", 190, 210)], "chrom string, start int, end int")
    got = runs.run_genomes(spark, fasta[1:], fasta[0], str(tmp_path / "out"), aligner, runs.Options(intervals=True, divergence=5.0), mask)
    calls = spark.read.option("header", True).csv(str(tmp_path / "out/Mutations"))
    found = {(int(r["taxon"]), r["chromosome"], int(r["position"]), r["mutation"]) for r in calls.collect()}
    assert found == {x for c in changes for x in c if not 189 <= x[2] <= 211} and len(found) > 50
    assert got["site_classes"]["taxa1_mut"] + got["site_classes"]["taxa2_mut"] == len(found) and got["mutations_per_year"]["1"] > 0
    own = json.loads((tmp_path / "out/Counts/taxon1_mutations.json").read_text())
    assert sum(own.values()) == sum(x[0] == 1 for x in found)
    assert readers.read_intervals(spark, str(tmp_path / "out/Intervals")).count() > 100
    pair = runs.run_genomes(spark, fasta[1:2], fasta[0], str(tmp_path / "pair"), aligner)
    assert pair["site_classes"]["differs"] == len(changes[1])
    with pytest.raises(Exception, match="no index"):
        external.align(intervals.fragments(fasta[0]), f"{aligner} --fail").count()
    runs.clean_up(spark, str(tmp_path / "pair"))
    assert not (tmp_path / "pair/aligned").exists() and (tmp_path / "pair/Mutations").exists()


def test_command_line(spark, tmp_path):
    files, changes, aligner = genomes(spark, tmp_path)
    own = ["--genomes", *files[1:], "--reference", files[0], "--aligner-cmd", aligner + " {fq} {ref} {cores}", "--species-list", '["one", "two"]']
    assert cli.main(["trio", *own, "--out", str(tmp_path / "trio")]) == 0
    made = json.loads((tmp_path / "trio/run_summary.json").read_text())
    assert made["site_classes"]["taxa1_mut"] + made["site_classes"]["taxa2_mut"] == sum(map(len, changes))
    assert cli.main(["trio", *own, "--annotate", "--out", str(tmp_path / "ann")]) == 0
    assert readers.site_counts(spark, str(tmp_path / "ann/Counts/site_counts")).count() > 50
    assert cli.main(["derive", "--run", str(tmp_path / "ann"), "--mapq", "30", "--out", str(tmp_path / "at")]) == 0
    assert json.loads((tmp_path / "at/run_summary.json").read_text())["site_classes"] == made["site_classes"]
    assert cli.main(["multi", *own, "--newick", "((one,two),out);", "--outgroup", "out", "--out", str(tmp_path / "multi")]) == 0
    search = tmp_path / "search.py"
    search.write_text("open('outfile','w').write(open('infile').read() + 'requires a total of 7.000\\n between and length\\n --- --- ---\\n 1 taxa0 0.1\\n 1 taxa1 0.1\\n 1 taxa2 0.1\\n\\n')\nopen('outtree','w').write('(taxa1,taxa2,taxa0);')\n")
    assert cli.main(["phylip", "--matrix", str(tmp_path / "multi/matching_bases"), "--species-list", '["out", "one", "two"]', "--phylip-cmd", f"{sys.executable} {search}", "--out", str(tmp_path / "tree")]) == 0
    found = json.loads((tmp_path / "tree/run_summary.json").read_text())["phylip"]
    assert found["score"] == 7.0 and "one" in found["tree"]
    assert (tmp_path / "tree/infile").read_text().split()[:2] == ["3", str(sum(map(len, changes)))]
    assert cli.main(["pair", "--alignments", "/nonexistent", "--reference", files[0], "--out", str(tmp_path / "no")]) == 1


MASKER = """#!{python}
import os, sys
a = sys.argv
open({log!r}, "a").write(" ".join(a[1:]) + "\\n")
if "-mk_counts" in a or "-ustat" in a:
    open(a[a.index("-out") + 1], "w").write("" if "-mk_counts" in a else ">chr_1 x\\n189 - 209\\n200 - 219\\n")
elif "-dir" in a:
    open(os.path.join(a[a.index("-dir") + 1], os.path.basename(a[-1]) + ".out"), "w").write("SW\\n\\n 463 1.3 0.6 1.7 chr_1 190 220 (2) + x\\n")
"""


def test_maskers(spark, tmp_path, monkeypatch):
    files, changes, aligner = genomes(spark, tmp_path)
    log, programs = tmp_path / "log", tmp_path / "bin"
    programs.mkdir()
    for name in ("windowmasker", "RepeatMasker"):
        (programs / name).write_text(MASKER.format(python=sys.executable, log=str(log)))
        (programs / name).chmod(0o755)
    monkeypatch.setenv("PATH", str(programs), prepend=":")
    want = [("chr_1", 190, 220)]
    for program, steps in (("windowmasker", 2), ("repeatmasker", 1)):
        log.write_text("")
        for _ in range(2):  # the second time finds the file
            mask = runs.build_mask(spark, files[0], str(tmp_path / program), program, species="fly", dust=False, cores=9)
            assert [tuple(r) for r in mask.collect()] == want
        said = log.read_text().splitlines()
        assert len(said) == steps and ("-dust false" in said[-1] if steps == 2 else "-pa 2 " in said[0] and "-species fly" in said[0])
    with pytest.raises(ValueError, match="unknown masker"):
        external.mask_genome(files[0], str(tmp_path / "other"), "other")
    own = ["--genomes", *files[1:], "--reference", files[0], "--aligner-cmd", aligner + " {fq} {ref} {cores}", "--out", str(tmp_path / "run")]
    assert cli.main(["trio", *own, "--repeat-mask", "windowmasker", "--index-cmd", f"touch {tmp_path}/made-{{cores}}"]) == 0
    calls = spark.read.option("header", True).csv(str(tmp_path / "run/Mutations"))
    assert {(int(r["taxon"]), int(r["position"])) for r in calls.collect()} == {(t, p) for c in changes for t, _, p, _ in c if not 189 <= p <= 221}
    made = json.loads((tmp_path / "run/run_summary.json").read_text())
    assert (tmp_path / "made-1").exists() and made["versions"]["spark"] == spark.version and made["resources"]["scan"]["driver_heap_mb"] > 0


def test_an_index_is_built_once(tmp_path):
    ref, log = tmp_path / "r.fa", tmp_path / "log"
    ref.write_text(">a\nA\n")
    command = f"{sys.executable} -c \"open('{log}', 'a').write('{{ref}} {{cores}};')\""
    assert external.index(str(ref), command, 3) and not external.index(str(ref), command, 3)
    assert log.read_text() == f"{ref} 3;"
    assert external.index(str(ref), command, 3, force=True)
    with pytest.raises(RuntimeError, match="exit 4"):
        external.index(str(ref), f"{sys.executable} -c 'import sys; sys.exit(4)'")
    assert external.index(str(ref), command, 3)  # the one that failed left no note


def test_another_mask_makes_a_stage_again(spark, tmp_path):
    files, changes, aligner = genomes(spark, tmp_path)
    fasta = [readers.fasta(spark, f) for f in files]
    pieces = intervals.chunks(fasta[0], 1000)
    rows = runs.align_genome(fasta[1], aligner, "one", 1, parts=2)
    span = lambda a, b: spark.createDataFrame([("chr_1", a, b)], "chrom string, start int, end int")
    out = str(tmp_path / "out")
    got = [runs.run_pair(spark, rows, pieces, out, mask=m)["site_classes"]["differs"] for m in (None, span(1, 1000), span(1, 2000), span(1, 2000))]
    whole = len(changes[1])
    assert got[0] == whole and got[1] == sum(x[2] > 1001 for x in changes[1]) and got[2] == got[3] == sum(x[2] > 2001 for x in changes[1])


def test_versions_and_retries(tmp_path):
    assert external.versions({"python": f"{sys.executable} --version", "none": "no-such-program -v"})["python"].startswith("Python 3")
    mark = tmp_path / "mark"
    flaky = f"import os,sys; p={str(mark)!r}; known=os.path.exists(p); open(p,'w').close(); sys.exit(0 if known else 3)"
    assert external.run(f'{sys.executable} -c "{flaky}"', tries=2, cap=0.01) == ""
    with pytest.raises(RuntimeError, match="exit 3"):
        external.run(f'{sys.executable} -c "import sys; sys.exit(3)"', tries=2, cap=0.01)
