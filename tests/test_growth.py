"""What keeps work in proportion to the input: whole tables, bounded rows, filters where they belong, compiled code."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from helixframe import format_queries, queries
from helixframe.operators import fitch, intervals, parsimony, sites
from helixframe.plans import derived as D

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["phylip_matrix", "phylip_infile"])
def test_a_matrix_of_more_sites_than_a_search_takes_is_whole(spark, monkeypatch, name):
    monkeypatch.setattr(fitch, "MOST_SITES", 10)
    rows = {r["taxon"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    own = sorted((r["chrom"], r["pos"], r["taxa"]) for r in D.matrix(spark, SF).distinct().collect())
    lines = ["".join(r[2][k] for r in own) for k in range(5)]
    import hashlib

    assert len(own) > 10 and sorted(rows) == list(range(5))
    assert [(rows[k]["digest"], rows[k]["n"]) for k in range(5)] == [(hashlib.md5(x.encode()).hexdigest(), len(x)) for x in lines]


def test_overlapping_intervals_mask_a_base_once(spark):
    mask = spark.createDataFrame([("a", 3, 70), ("a", 60, 64), ("a", 500, 1100), ("b", 1, 9)], "chrom string, start long, end long")
    spans = spark.createDataFrame([("a", 1, 1200), ("a", 64, 64), ("a", 512, 511), ("c", 1, 5)], "chrom string, start long, end long")
    for size in (16, 64, 100, 512):
        got = {(r["chrom"], r["start"]): r["masked"] for r in intervals.masked_bases(spans, mask, ["chrom", "start", "end"], size).collect()}
        assert got == {("a", 1): 68 + 601, ("a", 64): 1, ("a", 512): 0, ("c", 1): 0}


def test_runs_are_not_sorted_piece_by_piece(spark, monkeypatch):
    """Only runs at a piece's ends are merged, and they are found across several pieces."""
    monkeypatch.setattr(intervals, "CHUNK", 8)
    monkeypatch.setattr(intervals.chunks, "__defaults__", (8, 0))
    seq = "NNACNNNNNNNNNNNNNNNNNNGTNACGTACNNACGTNNN"
    got = intervals.runs_of(spark.createDataFrame([("x", seq), ("y", "N"), ("z", "ACGT")], "chrom string, seq string"))
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString() and "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [("x", m.start() + 1, m.end()) for m in re.finditer("N+", seq)] + [("y", 1, 1)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_window_masks_have_records_of_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(format_queries, "folder", lambda spark: str(tmp_path / "mask"))
    format_queries.windowmasker_file(spark, "/root/testdata/sf0.01").collect()
    records = "".join(open(p).read() for p in glob.glob(f"{tmp_path}/mask/part-*")).split(">")[1:]
    for r in records:
        tiles = {(int(line.split(" - ")[0]) + 1) // queries.TILE for line in r.splitlines()[1:] if line}
        assert len(tiles) == 1


def test_sites_are_counted_before_they_are_told_apart(spark):
    matrix = spark.createDataFrame([(["A", "A", "C", "C"],)] * 3 + [(["A", "C", "C", "C"],)] * 2, "taxa array<string>").repartition(2)
    own = parsimony.site_patterns(matrix)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan[plan.rindex("Aggregate") :].split("\n", 1)[1]
    assert [tuple(r) for r in own.collect()] == [("AACC", 3)]
    assert parsimony.constant_changes(matrix).first()[0] == 2


def test_classes_are_compiled_code(spark):
    """HotSpot runs methods over 8,000 bytes in its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = queries._trio(spark, SF).where(F.col("site_class").isin("taxa1_mut", "taxa2_mut"))
        text = spark._jvm.PythonSQLUtils.explainString(sites.spectrum(own)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["pileup_trio_file", "pileup_pair_file", "pileup_annotated_file"])
def test_a_pileup_file_shuffles_reads_and_not_their_positions(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def look(positions, *_, **__):
        lines = positions.groupBy("chrom", "_tile", "pos").count()
        plan = lines._jdf.queryExecution().executedPlan().toString()
        walked = plan.index("_j#")  # what stands above a read's positions
        assert "Exchange" not in plan[:walked] and "Exchange" in plan[walked:]
        raise Seen

    monkeypatch.setattr(format_queries, "_pileup_file", look)
    with pytest.raises(Seen):
        queries.QUERIES[name](spark, SF)
