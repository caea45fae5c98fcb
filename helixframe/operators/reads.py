"""Filters over alignments, and the continuity of neighbouring pseudo-reads.

Alignments: species, qname, frag_ord (the order of pseudo-reads, from the span in their names), rname, start0, end0
(half open), mapq, flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import with_neighbours

ALT_CONTIGS = "Un|random|alt|fix|hap"
ORDER_TILE = 100_000


def mapq_filter(reads: DataFrame, threshold: int = 60, strict: bool = False) -> DataFrame:
    """Mapping quality only; strict also drops unmapped and secondary reads and those on alternative contigs."""
    out = reads.where(F.col("mapq") >= threshold)
    return out.where(well_mapped() & ~on_alt_contig()) if strict else out


def well_mapped():
    """Neither unmapped nor secondary; supplementary alignments stay."""
    return F.col("flag").bitwiseAND(0x104) == 0


def on_alt_contig():
    """The name holds one of a few words anywhere, in this case."""
    return F.col("rname").rlike(ALT_CONTIGS)


def _fragments(reads: DataFrame, extra: list[str]) -> DataFrame:
    """A row for each pseudo-read with an array of its alignments."""
    return reads.groupBy("species", "frag_ord").agg(F.collect_list(F.struct("rname", "start0", "end0", "mapq", *extra)).alias("aln"))


def _overlaps(x, y):
    return (x["rname"] == y["rname"]) & (F.greatest(x["start0"], y["start0"]) < F.least(x["end0"], y["end0"]))


def neighbour_mapq(reads: DataFrame, low_mapq: int = 1, tile: int = ORDER_TILE) -> DataFrame:
    """Adds zn: the highest mapping quality among overlapping alignments of the pseudo-reads before and behind, -1 for
    none. Poorly mapped and low-quality reads go first, alternative contigs last, so those still count as neighbours."""
    own = reads.where(well_mapped() & (F.col("mapq") >= low_mapq))
    groups = with_neighbours(_fragments(own, []), ["species"], "frag_ord", ["aln"], tile)
    near = F.concat(F.coalesce("before.aln", F.array()), F.coalesce("behind.aln", F.array()))
    groups = groups.select("species", "frag_ord", near.alias("near"))
    best = F.array_max(F.transform(F.filter("near", lambda y: (y["rname"] == F.col("rname")) & (F.greatest(y["start0"], F.col("start0")) < F.least(y["end0"], F.col("end0")))), lambda y: y["mapq"]))
    out = own.join(groups, ["species", "frag_ord"]).withColumn("zn", F.coalesce(best, F.lit(-1))).drop("near")
    return out.where(~on_alt_contig())


def _chains(groups: DataFrame, side: str, run: int, tile: int) -> DataFrame:
    """For each alignment the longest chain of overlapping ones through the pseudo-reads on one side, itself included,
    at most ``run``: one hop after the other."""
    cur = groups.withColumn("chain", F.transform("aln", lambda x: F.lit(1)))
    for _ in range(run - 1):
        cur = with_neighbours(cur, ["species"], "frag_ord", ["aln", "chain"], tile)
        ok = F.col(side).isNotNull()
        grown = F.transform(
            "aln",
            lambda x: F.lit(1) + F.coalesce(F.array_max(F.transform(F.filter(F.arrays_zip(F.col(f"{side}.aln").alias("a"), F.col(f"{side}.chain").alias("n")), lambda y: _overlaps(x, y["a"])), lambda y: y["n"])), F.lit(0)),
        )
        cur = cur.withColumn("chain", F.when(ok, grown).otherwise(F.transform("aln", lambda x: F.lit(1)))).drop("before", "behind")
    return cur.select("species", "frag_ord", F.explode(F.arrays_zip("aln", "chain")).alias("z")).select("species", "frag_ord", "z.aln.id", F.col("z.chain").alias(side))


def continuity_status(reads: DataFrame, low_mapq: int = 1, threshold: int = 60, run: int = 2, tile: int = ORDER_TILE) -> DataFrame:
    """Adds status: poor, low_mapq, alt_contig, high_mapq, rescued or disjoint. A read below the threshold is rescued
    by a chain of at least ``run`` consecutive pseudo-reads that overlap, each the next, through it."""
    if run < 2:
        raise ValueError("the run must be at least 2")
    own = reads.where(well_mapped() & (F.col("mapq") >= low_mapq))
    if run == 2:
        near = neighbour_mapq_all(own, tile)
        kept = near.withColumn("joined", F.col("zn") >= 0).drop("zn")
    else:
        keyed = own.withColumn("id", F.struct("qname", "rname", "start0", "end0", "flag", "mapq"))
        groups = _fragments(keyed, ["id"])
        left, right = (_chains(groups, side, run, tile).distinct() for side in ("before", "behind"))
        kept = keyed.join(left, ["species", "frag_ord", "id"]).join(right, ["species", "frag_ord", "id"]).withColumn("joined", F.col("before") + F.col("behind") - 1 >= run).drop("id", "before", "behind")
    kept = kept.withColumn("status", F.when(on_alt_contig(), "alt_contig").when(F.col("mapq") >= threshold, "high_mapq").when(F.col("joined"), "rescued").otherwise("disjoint")).drop("joined")
    rest = reads.where(~(well_mapped() & (F.col("mapq") >= low_mapq))).withColumn("status", F.when(~well_mapped(), "poor").otherwise("low_mapq"))
    return kept.select(*reads.columns, "status").unionByName(rest)


def neighbour_mapq_all(own: DataFrame, tile: int) -> DataFrame:
    groups = with_neighbours(_fragments(own, []), ["species"], "frag_ord", ["aln"], tile)
    groups = groups.select("species", "frag_ord", F.concat(F.coalesce("before.aln", F.array()), F.coalesce("behind.aln", F.array())).alias("near"))
    hit = F.filter("near", lambda y: (y["rname"] == F.col("rname")) & (F.greatest(y["start0"], F.col("start0")) < F.least(y["end0"], F.col("end0"))))
    return own.join(groups, ["species", "frag_ord"]).withColumn("zn", F.coalesce(F.array_max(F.transform(hit, lambda y: y["mapq"])), F.lit(-1))).drop("near")


def continuity_filter(reads: DataFrame, low_mapq: int = 1, threshold: int = 60, run: int = 2, tile: int = ORDER_TILE) -> DataFrame:
    return continuity_status(reads, low_mapq, threshold, run, tile).where(F.col("status").isin("high_mapq", "rescued")).drop("status")


def filter_stats(status: DataFrame) -> DataFrame:
    """One row of counts for each species."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    return status.groupBy("species").agg(
        F.count(F.lit(1)).alias("total_reads"), count("high_mapq", "rescued").alias("kept_reads"), count("high_mapq").alias("kept_high_mapq"), count("rescued").alias("kept_rescued"),
        count("poor").alias("filtered_poor_mapping"), count("low_mapq").alias("filtered_low_mapq"), count("disjoint").alias("filtered_disjoint"), count("alt_contig").alias("filtered_alt_contig"),
    )


def mapq_histogram(reads: DataFrame, low_mapq: int | None = None) -> DataFrame:
    """All reads, or those that survive the first filters."""
    own = reads if low_mapq is None else reads.where(well_mapped() & (F.col("mapq") >= low_mapq))
    return own.groupBy("species", "mapq").agg(F.count(F.lit(1)).alias("n"))
