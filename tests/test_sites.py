"""Sites, windows and classes against sequential versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.operators import intervals, neighbours, reads, sites, thresholds


def alignment(taxon, chrom, start0, cigar, seq, flag=0):
    import re

    return (taxon, chrom, start0, flag, [(m[1], int(m[0])) for m in re.findall(r"(\d+)([MIDNSHP=X])", cigar)], seq)


SCHEMA = "taxon int, rname string, start0 int, flag int, cigar array<struct<op:string,len:int>>, seq string"


def test_cigar_walk(spark):
    rows = [
        alignment(1, "c", 10, "2S3M1I2M2D2M", "TTACGAGTCC"),  # clips, an insertion behind 13, deletion of 16 and 17
        alignment(1, "c", 11, "3M", "CGT"),  # disagrees at 14
        alignment(1, "c", 0, "1I2M", "TAA"),  # an insertion at the very start has nowhere to land
        alignment(1, "c", 0, "4M", "CCCC", flag=256),
    ]
    got = {r["pos"]: r for r in sites.pileup_alignments(spark.createDataFrame(rows, SCHEMA), [1]).collect()}
    assert sorted(got) == [1, 2, 11, 12, 13, 14, 15, 16, 17, 18, 19]
    assert [got[p]["base_1"] for p in (1, 2, 11, 12, 13, 15, 18)] == ["A", "A", "A", "C", "G", "T", "C"]
    assert got[13]["ins_1"] and not got[1]["ins_1"] and not got[12]["ins_1"]
    assert got[16]["del_1"] and got[17]["del_1"] and got[16]["base_1"] is None and got[16]["cov_1"]
    assert got[14]["dis_1"] and got[14]["base_1"] is None


def lines_frame(spark, lines):
    cols = "chrom string, pos int, ref string, cov_1 boolean, cov_2 boolean, base_1 string, base_2 string, del_1 boolean, del_2 boolean, ins_1 boolean, ins_2 boolean, dis_1 boolean, dis_2 boolean"
    return spark.createDataFrame(lines, cols)


def line(chrom, pos, ref, a, b, d=False, i=False):
    return (chrom, pos, ref, a is not None, b is not None, a, b, d and a is not None, False, i and a is not None, False, False, False)


def test_hand_worked_call_and_mask(spark):
    rows = [line("chr1", 100, "A", "A", "A"), line("chr1", 101, "C", "C", "T"), line("chr1", 102, "G", "G", "G"), line("chr1", 103, "G", "G", "G")]
    frame = lines_frame(spark, rows)

    def calls(mask):
        m = None if mask is None else spark.createDataFrame([("chr1", mask, mask)], "chrom string, start int, end int")
        return sites.trio_calls(sites.classify_trio(sites.contexts(sites.scan(frame, [1, 2], m), [1, 2]))).collect()

    assert [tuple(r) for r in calls(None)] == [(2, "chr1", 101, "A[C>T]G")]
    assert calls(101) == [] and calls(100) == [] and len(calls(500)) == 1
    with pytest.raises(ValueError):
        sites.scan(frame, [1, 2], None, 0)


@pytest.mark.parametrize("seed", range(4))
def test_scan_matches_sequential(spark, seed):
    """Any tile gives the windows, gaps and near flags of a scan line by line."""
    rng = random.Random(seed)
    lines = []
    for chrom in ("a", "b"):
        pos = 0
        for _ in range(150):
            pos += 1 if rng.random() < 0.85 else rng.randint(2, 40)
            lines.append(line(chrom, pos, "A", "A" if rng.random() < 0.95 else None, rng.choice("AAAT"), d=rng.random() < 0.04, i=rng.random() < 0.03))
    mask = [(c, s, s + rng.randint(0, 5)) for c in ("a", "b") for s in rng.sample(range(1, 300), 6)]
    k = rng.choice([2, 5])
    expect = []
    masked = lambda c, p: any(m[0] == c and m[1] <= p <= m[2] for m in mask)
    for chrom in ("a", "b"):
        own = [x for x in lines if x[0] == chrom]
        kept = [x for x in own if not masked(chrom, x[1])]
        events = [x[1] for x in own if x[7] or x[9]]
        ok = [x[3] and x[4] and not x[7] and not x[9] for x in kept]
        for i in range(1, len(kept) - 1):
            if ok[i - 1] and ok[i] and ok[i + 1]:
                p = kept[i][1]
                whole = kept[i - 1][1] == p - 1 and kept[i + 1][1] == p + 1
                expect.append((chrom, p, whole, not whole, any(abs(e - p) <= k for e in events)))
    assert any(x[2] for x in expect) and any(x[3] for x in expect) and any(x[4] for x in expect)
    m = intervals.merge(spark.createDataFrame(mask, "chrom string, start int, end int"), ["chrom"], tile=7)
    for tile in (10, 1_000_000):
        got = sites.scan(lines_frame(spark, lines), [1, 2], m, k, tile).where("window or gap")
        assert sorted(tuple(r) for r in got.select("chrom", "pos", "window", "gap", "near").collect()) == sorted(expect)


def test_offsets(spark):
    rows = [("c", p, str(p)) for p in (1, 2, 3, 4, 5, 9, 10)]
    got = neighbours.at_offsets(spark.createDataFrame(rows, "c string, pos int, v string"), ["c"], "pos", ["v"], [-2, -1, 1, 2], tile=3)
    found = {r["pos"]: (r["m2"] and r["m2"]["v"], r["m1"] and r["m1"]["v"], r["p1"] and r["p1"]["v"], r["p2"] and r["p2"]["v"]) for r in got.collect()}
    assert found[3] == ("1", "2", "4", "5") and found[9] == (None, None, "10", None) and len(found) == 7


def test_merge(spark):
    run = lambda rows, **k: sorted(tuple(r) for r in intervals.merge(spark.createDataFrame(rows, "chrom string, start int, end int"), ["chrom"], **k).collect())
    assert run([("c", 10, 20), ("c", 21, 30)]) == [("c", 10, 30)]
    assert run([("c", 10, 20), ("c", 15, 25)]) == [("c", 10, 25)]
    assert run([("c", 50, 60), ("c", 10, 20)]) == [("c", 10, 20), ("c", 50, 60)]
    assert run([("c", 10, 20), ("c", 21, 30)], adjacent=False) == [("c", 10, 20), ("c", 21, 30)]
    assert run([("c", 1, 1000), ("c", 30, 40), ("c", 999, 1200), ("c", 1300, 1301)], tile=10) == [("c", 1, 1200), ("c", 1300, 1301)]


def test_fragments_and_mask(spark):
    contig = spark.createDataFrame([("chr1", "ACGT" * 75), ("short", "ACGT"), ("even", "ACGT" * 37 + "AC")], "chrom string, seq string")
    tiles = intervals.fragments(contig)
    assert sorted((r["chrom"], r["start"], r["end"]) for r in tiles.collect()) == [("chr1", 1, 150), ("chr1", 76, 225), ("chr1", 151, 300), ("even", 1, 150)]
    mask = spark.createDataFrame([("chr1", 1, 170)], "chrom string, start int, end int")
    assert [r["start"] for r in intervals.unmasked_fragments(tiles.where("chrom = 'chr1'"), mask).collect()] == [151]
    mask = spark.createDataFrame([("c", 100, 200), ("c", 300, 350)], "chrom string, start int, end int")
    span = spark.createDataFrame([("c", 150, 260)], "chrom string, start int, end int")
    got = intervals.masked_bases(span, mask, ["chrom", "start", "end"], bin_size=16).first()
    assert got["masked"] == 51 and abs(got["fraction"] - 51 / 111) < 1e-12


@pytest.mark.parametrize("n", [0, 149, 150, 151, 225, 226, 70_001])
def test_tiles_of_long_contigs(spark, n):
    """Pieces, tiles and runs against slices of the whole text."""
    rng = random.Random(n)
    seq = "".join(rng.choice("ACGTNN") for _ in range(n))
    contig = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    starts = sorted({*range(0, n - 150, 75), n - 150}) if n >= 150 else []
    got = sorted((r["start"], r["end"], r["seq"]) for r in intervals.fragments(contig).collect())
    assert got == [(s + 1, s + 150, seq[s : s + 150]) for s in starts]
    spans = intervals.tile_spans(contig.select("chrom", F.length("seq").alias("length")))
    assert sorted((r["start"], r["end"]) for r in spans.collect()) == [(s + 1, s + 150) for s in starts]
    import re

    assert sorted((r["start"], r["end"]) for r in intervals.runs_of(contig).collect()) == [(m.start() + 1, m.end()) for m in re.finditer("N+", seq)]
    pieces = intervals.chunks(contig, 1000, 10).orderBy("start0").collect()
    assert "".join(r["seq"][:1000] for r in pieces) == seq and all(len(r["seq"]) == min(1010, n - r["start0"]) for r in pieces)


def test_dealt_lines_match_separate_joins(spark):
    """Reads, reference and mask dealt by tile together give what separate aggregations and joins give."""
    from helixframe import queries as Q

    sf = "/root/testdata/sf0.001"
    reads_ = Q.D.alignments(spark, sf)
    mask = Q._mask(spark, sf)
    bases = sites.own_lines(Q._tiled(spark, sf)).select("chrom", "pos", "ref")
    pieces = bases.where("pos % 3 <> 0").cache()  # a reference with holes
    for k in (1, 5):
        old = sites.scan(sites.with_reference(sites.pileup_alignments(reads_, [1, 2]), pieces), [1, 2], mask, k, 500)
        for tile in (64, 5000):
            new = sites.scan(sites.tiled_lines(reads_, [1, 2], pieces, mask, max(2, k), tile), [1, 2], None, k, tile)
            cols = ["chrom", "pos", "ref", "qc", "near", "window", "gap", "base_1", "base_2"]
            a, b = (sorted(map(tuple, x.select(*cols).collect()), key=repr) for x in (old, new))
            assert a == b and len(a) > 1000 and any(r[6] for r in a) and any(r[5] for r in a)


FLAGS = "species string, qname string, frag_ord long, rname string, start0 int, end0 int, mapq int, flag int"


def neighbour_rows():
    own = [("f0", "chr1", 1000, 60, 0), ("f1", "chr1", 1075, 20, 0), ("f2", "chr1", 5000, 30, 0), ("f3", "chr1", 8000, 0, 0), ("f4", "chr1", 5075, 10, 0), ("f5", "chr1", 9000, 5, 0),
           ("f5", "chr1", 5150, 60, 2048), ("f6", "*", 0, 0, 4), ("f7", "chrUn_x", 9000, 60, 0), ("f8", "chr1", 9100, 3, 0)]
    return [("s", q, int(q[1:]), c, s, s + 150, m, f) for q, c, s, m, f in own]


def test_neighbour_quality_and_continuity(spark):
    frame = spark.createDataFrame(neighbour_rows(), FLAGS)
    got = {(r["qname"], r["flag"]): (r["mapq"], r["zn"]) for r in reads.neighbour_mapq(frame, tile=3).collect()}
    assert {k: v[1] for k, v in got.items()} == {("f0", 0): 20, ("f1", 0): 60, ("f2", 0): 10, ("f4", 0): 60, ("f5", 0): -1, ("f5", 2048): 10, ("f8", 0): -1}
    for t in (1, 3, 5, 10, 20, 30, 60, 61):
        kept = {(r["qname"], r["flag"]) for r in reads.continuity_filter(frame, 1, t, tile=2).collect()}
        assert kept == {k for k, (m, z) in got.items() if m >= t or z >= 0}
    with pytest.raises(ValueError):
        reads.continuity_filter(frame, run=1)


@pytest.mark.parametrize("seed", range(3))
def test_longer_runs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        for _ in range(rng.choice([1, 1, 2])):
            start = 75 * i if rng.random() < 0.7 else rng.randint(0, 4000)
            rows.append(("s", f"f{i}", i, "c", start, start + 150, rng.choice([5, 20, 60]), len(rows) * 4096))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    hit = lambda a, b: max(a[4], b[4]) < min(a[5], b[5])

    def chain(r, step, n):
        return 1 if n == 1 else 1 + max((chain(x, step, n - 1) for x in groups.get(r[2] + step, []) if hit(r, x)), default=0)

    for n in (2, 3, 4):
        expect = sorted(r[7] for r in rows if r[6] >= 60 or chain(r, 1, n) + chain(r, -1, n) - 1 >= n)
        got = sorted(r["flag"] for r in reads.continuity_filter(spark.createDataFrame(rows, FLAGS), 1, 60, n, tile=7).collect())
        assert got == expect and len(got) < len(rows)


def test_intervals_of_thresholds(spark):
    """Against every threshold, read by read."""
    rng = random.Random(5)
    rows = []
    for pos in range(1, 120):
        for _ in range(rng.randint(1, 5)):
            rows.append((pos, rng.choice(".....TG*"), rng.choice([1, 3, 9, 10, 12, 20, 30, 60]), rng.choice([-1, -1, 0, 20]), False))
    rows = [(p, b, q, z, b == "*" or rng.random() < 0.1) for p, b, q, z, _ in rows]
    got = {(r["pos"], r["mode"]): r for r in thresholds.site_intervals(spark.createDataFrame(rows, "pos int, base string, mapq int, zn int, rejects boolean"), ["pos"]).collect()}
    usable = 0
    for pos in range(1, 120):
        for mode in (0, 1):
            own = [(256 if mode and z >= 0 else q, b, j) for p, b, q, z, j in rows if p == pos]
            r = got[(pos, mode)]
            for t in range(0, 258):
                kept = [x for x in own if x[0] >= t]
                call = kept[0][1] if kept and len({b for _, b, _ in kept}) == 1 and not any(j for *_, j in kept) else None
                inside = r["base"] is not None and r["lo"] <= t <= r["hi"]
                assert (r["base"] if inside else None) == call
                usable += call is not None
    assert usable > 1000


def test_derived_equals_direct(spark):
    """One scan at a threshold gives what a scan of the reads above it gives."""
    from helixframe import queries as Q

    sf = "/root/testdata/sf0.001"
    own = thresholds.site_counts(Q._windows(spark, sf))
    for t in (5, 60):
        direct = Q._annotated_reads(spark, sf).where(F.col("mapq") >= t).withColumn("mapq", F.lit(60)).withColumn("zn", F.lit(-1))
        again = thresholds.site_counts(thresholds.scan(direct, Q.D.reference(), [1, 2]))
        a = {r["site_class"]: r["n"] for r in thresholds.derive(own, t, False)["classes"].collect()}
        b = {r["site_class"]: r["n"] for r in thresholds.derive(again, 60, False)["classes"].collect()}
        assert a == b and sum(a.values()) > 100


def test_packed_modes_are_those_of_the_intervals(spark):
    """Numbers of a scan against the modes read by read, with any letters, missing ones and up to six at a position."""
    rng = random.Random(7)
    rows = []
    for pos in range(1, 400):
        for taxon in (1, 2):
            letters = rng.choice(["AC", "A", "ACGT*N", ["", "*", "R", "Y", "=", "."], ["A", None]])
            for _ in range(rng.randint(0, 7)):
                rows.append((taxon, "c", pos, rng.choice(letters), rng.choice([None, 0, 1, 9, 30, 60, 255]) if pos % 3 else 30, rng.choice([-1, -1, 0, 20, None]), rng.random() < 0.1))
    frame = spark.createDataFrame(rows, "taxon int, chrom string, pos int, base string, mapq int, zn int, rejects boolean")
    want = {(r["taxon"], r["pos"], r["mode"]): (r["base"], r["base"] is not None and r["lo"], -1 if r["hi"] is None else r["hi"], r["indel"]) for r in thresholds.site_intervals(frame, ["taxon", "chrom", "pos"]).collect()}
    got = {}
    for r in thresholds._packed(frame.withColumn("_read", F.lit(True)), ["chrom", "pos"], [F.max("_read").alias("_line")]).collect():
        for m in (0, 1):
            x = r[f"p{m}"]
            base = None if not x >> 27 else "" if x >> 27 == 1 else chr((x >> 27) - 1)
            got[(r["taxon"], r["pos"], m)] = (base, base is not None and x >> 18 & 511, (x >> 9 & 511) - 1, (x & 511) - 1)
    assert got == want and sum(v[0] is not None for v in got.values()) > 300


def test_a_threshold_scan_sorts_lines_only(spark):
    """Bases are told apart by hashed numbers: no aggregation sorts, and positions are sorted once, as lines."""
    frame = spark.createDataFrame([(1, "c", 5, "A", 30, -1, False)], "taxon int, chrom string, pos int, base string, mapq int, zn int, rejects boolean")
    plan = thresholds.scan(frame, F.lit("A"), [1, 2])._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and len(re.findall(r"^\W*Window ", plan, re.M)) == 1


@pytest.mark.parametrize("adjacent", [True, False])
@pytest.mark.parametrize("tile", [7, 40, 1000])
def test_merge_across_tiles(spark, adjacent, tile):
    import random

    from helixframe.operators.intervals import merge

    rng = random.Random(tile)
    rows = [(c, s, s + rng.choice([0, 1, 2, 3, 60])) for c in ("a", "b", None) for s in (rng.randrange(600) for _ in range(60))]
    rows += [("c", 5, 900), ("c", 100, 101), ("c", 950, 960), ("c", 5, 900)]
    want = []
    for c in ("a", "b", "c", None):
        own = []
        for s, e in sorted(r[1:] for r in rows if r[0] == c):
            if own and s <= own[-1][1] + (1 if adjacent else 0):
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        want += [(c, s, e) for s, e in own]
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    got = [tuple(r) for r in merge(df, ["chrom"], adjacent, tile).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert merge(df.limit(0), ["chrom"], adjacent, tile).collect() == []
