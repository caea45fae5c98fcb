"""Intervals: merging, masks, fragments, binned coverage and density. All joins are by contig and bin, never by range
alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14
TILE_BIN = 1 << 9  # for spans of a tile's size
CHUNK = 1 << 16


def merge(intervals: DataFrame, keys: list[str], adjacent: bool = True, tile: int = 1_000_000) -> DataFrame:
    """Merged, disjoint intervals. ``adjacent``: both ends are in, and intervals that follow each other merge; otherwise
    ends are out and touching intervals merge.

    Intervals are first merged within tiles of their start, in parallel. What a tile's rows have before them, and how
    far its last one reaches, is then told by summaries of one row a tile, so no task sees the intervals of a contig."""
    gap = 1 if adjacent else 0
    by = [*keys, "_t"]
    rows = _merge(intervals.select(*keys, "start", "end").withColumn("_t", F.floor(F.col("start") / tile)), by, gap)
    order = Window.partitionBy(*keys).orderBy("_t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by).agg(F.max("end").alias("_m")).withColumn("_reach", F.max("_m").over(before)).drop("_m")
    rows = _null_safe(rows, tops, by).withColumn("_open", F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)).drop("_reach")
    # rows that are not open go on with the last open one of an earlier tile; only that one can still grow
    ends = rows.groupBy(*by).agg(F.max(F.when(~F.col("_open"), F.col("end"))).alias("_more"), F.max(F.when(F.col("_open"), F.col("start"))).alias("_last"))
    ends = ends.withColumn("_g", F.count("_last").over(before))  # open tiles before this one
    more = Window.partitionBy(*keys).orderBy("_g").rangeBetween(1, 1)
    ends = ends.withColumn("_more", F.max("_more").over(more)).drop("_g")
    rows = _null_safe(rows.where("_open"), ends, by)
    end = F.when(F.col("start") == F.col("_last"), F.greatest("end", "_more")).otherwise(F.col("end"))
    return rows.select(*keys, "start", end.alias("end"))


def _null_safe(rows: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Adds a summary's columns to its rows; keys may be null."""
    right = summary.select(*(F.col(c).alias(f"_r{c}") for c in by), *(c for c in summary.columns if c not in by))
    on = [rows[c].eqNullSafe(right[f"_r{c}"]) for c in by]
    return rows.join(right, on).drop(*(f"_r{c}" for c in by))


def _merge(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy("start", "end")
    top = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start") > top + gap, 1).otherwise(0)).withColumn("_g", F.sum("_new").over(own))
    return rows.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


WORD = 64  # bases whose state a long holds


def _inside(start: str, end: str, size: int) -> list[Column]:
    """The bases of bin ``_b`` that lie from ``start`` to ``end``, as bits of longs, 64 each."""
    out = []
    for at in range(0, size, WORD):
        most = min(WORD, size - at) - 1
        first, last = f"cast(greatest({start} - _b * {size} - {at}, 0) as int)", f"cast(least({end} - _b * {size} - {at}, {most}) as int)"
        out.append(F.expr(f"if({first} <= {last}, shiftleft(-1L, {first}) & shiftrightunsigned(-1L, {WORD - 1} - {last}), 0L)"))
    return out


def masked_bases(spans: DataFrame, mask: DataFrame, key: list[str], bin_size: int = TILE_BIN) -> DataFrame:
    """Adds masked: bases of the span (chrom, start, end; 1-based, ends in) that lie in the mask, and fraction. ``key``
    tells spans apart.

    A bin of the mask is one row, a bit a base, however many intervals it has; one left join by contig and bin counts the
    bits that spans have, and sums follow."""
    words = [f"_w{i}" for i in range(-(-bin_size // WORD))]
    binned = lambda df, start, end: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.greatest(start, end) / bin_size))))
    m = binned(mask.where("end >= start").select("chrom", F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e")
    m = m.select("chrom", "_b", *(c.alias(w) for w, c in zip(words, _inside("_s", "_e", bin_size))))
    m = m.groupBy("chrom", "_b").agg(*(F.bit_or(w).alias(w) for w in words))
    cols = list(dict.fromkeys([*key, "chrom", "start", "end"]))
    hit = binned(spans.select(*cols), "start", "end").join(m, ["chrom", "_b"], "left")
    n = F.lit(0)
    for w, c in zip(words, _inside("start", "end", bin_size)):
        n = n + F.coalesce(F.bit_count(F.col(w).bitwiseAND(c)), F.lit(0))
    out = hit.withColumn("n", n).groupBy(*cols).agg(F.sum("n").cast("long").alias("masked"))
    size = F.col("end") - F.col("start") + 1
    return out.withColumn("fraction", F.when(size > 0, F.col("masked") / size).otherwise(0.0))


def _bytes(column: str, use) -> Column:
    """What ``use`` makes of a text's bytes, which are taken from it once and whose slices are direct."""
    return F.transform(F.array(F.col(column).cast("binary")), use)[0]


def chunks(contigs: DataFrame, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """chrom, length, start0 and seq: pieces of each contig, each ``overlap`` longer than the distance of their starts.
    Slices of bytes are direct, so time grows with the contig, and no step sees more of a contig than its text."""
    cut = lambda raw: lambda o: F.struct(o.alias("start0"), F.substring(raw, o + 1, F.lit(size + overlap)).cast("string").alias("seq"))
    pieces = _bytes("seq", lambda raw: F.transform(F.sequence(F.lit(0), F.length(raw) - 1, F.lit(size)), cut(raw)))
    own = contigs.where(F.length("seq") > 0).select("chrom", F.octet_length("seq").alias("length"), F.explode(pieces).alias("p"))
    # contigs are few and long: what is done with their pieces is spread over all tasks
    parts = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.select("chrom", "length", "p.start0", "p.seq").repartition(4 * parts, "chrom", "start0")


def tile_spans(contigs: DataFrame, length: int = 150, step: int = 75) -> DataFrame:
    """chrom, start, end of the tiles of contigs (chrom, length). The last tile ends with the contig; a contig shorter
    than a tile has none."""
    last = (F.col("length") - length).cast("long")
    starts = F.concat(F.filter(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")), lambda x: x < last), F.array(last))
    own = contigs.where(F.col("length") >= length).select("chrom", F.explode(starts).alias("_s"))
    return own.select("chrom", (F.col("_s") + 1).alias("start"), (F.col("_s") + length).alias("end"))


def fragments(contigs: DataFrame, length: int = 150, step: int = 75) -> DataFrame:
    """Tiles of each contig (chrom, seq) with their bases: chrom, start, end (1-based, ends in) and seq, cut from pieces
    that overlap by a tile."""
    size = piece_size(step)
    return fragments_of(chunks(contigs, size, length), size, length, step)


def piece_size(step: int) -> int:
    """Bases of a piece that holds whole steps."""
    return CHUNK // step * step


def fragments_of(pieces: DataFrame, size: int, length: int = 150, step: int = 75) -> DataFrame:
    """``fragments`` of pieces (chrom, length, start0, seq) of ``size`` bases, a multiple of the step, that overlap by a
    tile."""
    own = pieces.withColumn("last", F.col("length") - length).where("last >= 0 and start0 <= last")
    regular = F.filter(F.sequence(F.lit(0), F.lit(size - step), F.lit(step)), lambda s: F.col("start0") + s < F.col("last"))
    end = F.when(F.col("last") < F.col("start0") + size, F.array(F.col("last") - F.col("start0"))).otherwise(F.array().cast("array<int>"))
    cut = lambda raw: lambda s: F.struct((F.col("start0") + s + 1).alias("start"), (F.col("start0") + s + length).alias("end"), F.substring(raw, s + 1, F.lit(length)).cast("string").alias("seq"))
    tiles = _bytes("seq", lambda raw: F.transform(F.concat(regular, end), cut(raw)))
    return own.select("chrom", F.explode(tiles).alias("t")).select("chrom", "t.*")


def runs_of(contigs: DataFrame, letter: str = "N") -> DataFrame:
    """Merged runs of a letter: chrom, start, end (1-based, ends in). A run that ends inside its piece is whole; only
    those at a piece's ends, two a piece at most, are merged with their neighbours."""
    pieces = chunks(contigs).where(F.col("seq").contains(letter))

    def find(at_ends: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    chrom, length, start0, seq = part.columns
                    stops = np.cumsum(pc.binary_length(seq).to_numpy(zero_copy_only=False).astype(np.int64))
                    starts = np.concatenate(([0], stops[:-1]))
                    length, start0 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, start0))
                    hit = np.frombuffer("".join(seq.to_pylist()).encode(), np.uint8) == ord(letter)
                    first, last = hit.copy(), hit.copy()
                    first[1:] &= ~hit[:-1]
                    last[:-1] &= ~hit[1:]
                    first[starts], last[stops - 1] = hit[starts], hit[stops - 1]  # pieces end runs
                    first, last = np.flatnonzero(first), np.flatnonzero(last)
                    piece = np.searchsorted(stops, first, "right")
                    begin, end = (x - starts[piece] + start0[piece] + 1 for x in (first, last))
                    open_ = (first == starts[piece]) & (start0[piece] > 0) | (last == stops[piece] - 1) & (end < length[piece])
                    own = np.flatnonzero(open_ == at_ends)
                    yield pa.RecordBatch.from_arrays([chrom.take(pa.array(piece[own])), pa.array(begin[own]), pa.array(end[own])], names=["chrom", "start", "end"])

        return run

    whole, parts = (pieces.mapInArrow(find(at_ends), "chrom string, start long, end long") for at_ends in (False, True))
    return whole.unionByName(merge(parts, ["chrom"]))


def unmasked_fragments(tiles: DataFrame, mask: DataFrame, most: float = 0.5) -> DataFrame:
    """Tiles with less than ``most`` of their bases masked. Bases, if there, don't go through the joins that decide."""
    kept = masked_bases(tiles.select("chrom", "start", "end"), mask, ["chrom", "start", "end"], TILE_BIN).where(F.col("fraction") < most)
    return tiles.join(kept.drop("end"), ["chrom", "start"]) if "seq" in tiles.columns else kept


def top_contigs(fai: DataFrame, n: int = 2) -> DataFrame:
    """The longest, the first of equals first."""
    return fai.orderBy(F.desc("length"), "contig_ord").limit(n)


def bins(contigs: DataFrame, size: int, slide: int) -> DataFrame:
    """Whole bins of each contig (chrom, length): chrom, bin_start; the rest at the end has none."""
    return contigs.where(F.col("length") >= size).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("length") - size).cast("long"), F.lit(slide).cast("long"))).alias("bin_start"))


def binned_coverage(intervals: DataFrame, contigs: DataFrame, size: int = 1000, slide: int = 1000) -> DataFrame:
    """chrom, bin_start, midpoint, coverage: overlapping bases over the bin's size; intervals are half open."""
    first = F.greatest(F.lit(0).cast("long"), (F.floor((F.col("start") - size) / slide) + 1).cast("long"))
    last = F.floor((F.col("end") - 1) / slide).cast("long")
    hit = intervals.where("end > start").where(last >= first).withColumn("_k", F.explode(F.sequence(first, last)))
    hit = hit.withColumn("bin_start", F.col("_k") * slide)
    n = F.least("end", F.col("bin_start") + size) - F.greatest("start", "bin_start")
    hit = hit.withColumn("n", n).where("n > 0").groupBy("chrom", "bin_start").agg(F.sum("n").alias("n"))
    out = bins(contigs, size, slide).join(hit, ["chrom", "bin_start"], "left")
    return out.select("chrom", "bin_start", (F.col("bin_start") + F.floor(F.lit(size) / 2)).cast("long").alias("midpoint"), (F.coalesce("n", F.lit(0)) / F.lit(float(size))).alias("coverage"))


def mutation_density(calls: DataFrame, contigs: DataFrame, size: int = 1000, slide: int = 1000, pattern: str | None = None) -> DataFrame:
    """chrom, bin_start, midpoint, n: calls with bin_start <= pos < bin_start + size, pos from 1. ``pattern`` selects
    mutations; ``CPG`` is a right one for CpG transitions."""
    own = calls if pattern is None else calls.where(F.col("mutation").rlike(pattern))
    first = F.greatest(F.lit(0).cast("long"), (F.floor((F.col("pos") - size) / slide) + 1).cast("long"))
    last = F.floor(F.col("pos") / slide).cast("long")
    hit = own.where(last >= first).withColumn("_k", F.explode(F.sequence(first, last))).groupBy("chrom", (F.col("_k") * slide).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))
    out = bins(contigs, size, slide).join(hit, ["chrom", "bin_start"], "left")
    return out.select("chrom", "bin_start", (F.col("bin_start") + F.floor(F.lit(size) / 2)).cast("long").alias("midpoint"), F.coalesce("n", F.lit(0)).alias("n"))


CPG = r"^[ACGT]\[C>T\]G$"
#: The pattern that earlier tools use for CpG; it is a character class and selects other changes as well.
CPG_AS_PUBLISHED = "[ACTG][C>T]G"


def density_by_coverage(density: DataFrame, coverage: DataFrame) -> DataFrame:
    out = density.join(coverage, ["chrom", "bin_start", "midpoint"])
    return out.select("chrom", "bin_start", "midpoint", F.when(F.col("coverage") > 0, F.col("n") / F.col("coverage")).otherwise(0.0).alias("rate"))


def genome_stats(contigs: DataFrame, mask: DataFrame, tiles: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: contigs, total_bp, masked_bp, n_intervals, fragments written and skipped."""
    size = F.length("seq") if "seq" in contigs.columns else F.col("length")
    a = contigs.agg(F.count(F.lit(1)).alias("contigs"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("total_bp"))
    b = mask.agg(F.coalesce(F.sum((F.col("end") - F.col("start") + 1).cast("long")), F.lit(0)).alias("masked_bp"), F.count(F.lit(1)).alias("n_intervals"))
    c = tiles.agg(F.count(F.lit(1)).alias("made"))
    d = kept.agg(F.count(F.lit(1)).alias("fragments_written"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).withColumn("fragments_skipped", F.col("made") - F.col("fragments_written")).drop("made")  # one row each
