"""Rows of a stream that come too late."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import reads
from helixframe.plans import derived
from helixframe.streaming.continuity import ContinuityStream

SF = "/root/testdata/sf0.001"


def test_late_rows_are_told_and_not_used(spark, tmp_path):
    rows = derived.reads(spark, SF).select("species", "qname", "frag_ord", "rname", "start0", "end0", "mapq", "flag").cache()
    counts = reads.well_mapped() & (F.col("mapq") >= 1)
    first = rows.where("frag_ord < 1500")
    # of the first rows a few that count come with the next batch, with some that do not count
    held = first.where((F.col("frag_ord") > 300) & (F.col("frag_ord") < 420))
    late_names = {r.qname for r in held.where(counts).collect()}
    got, late = {}, {}
    sink = lambda df, epoch: got.update({r["qname"]: r["status"] for r in df.collect()})
    tell = lambda df, epoch: late.update({r["qname"]: epoch for r in df.collect()})
    stream = ContinuityStream(sink, str(tmp_path / "a"), late=tell)
    stream(first.join(held.select("qname"), "qname", "left_anti"), 0)
    stream(rows.where("frag_ord >= 1500").unionByName(held), 1)
    stream.close(spark)
    assert set(late) == late_names and set(late.values()) == {1} and len(late_names) > 3
    in_time = rows.join(held.where(counts).select("qname"), "qname", "left_anti")
    assert got == {r["qname"]: r["status"] for r in reads.continuity_status(in_time).collect()}
    strict = ContinuityStream(sink, str(tmp_path / "b"))
    strict(first.join(held.select("qname"), "qname", "left_anti"), 0)
    with pytest.raises(ValueError, match="came behind"):
        strict(rows.where("frag_ord >= 1500").unionByName(held), 1)
