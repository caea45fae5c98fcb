"""All mapping-quality thresholds in one scan.

For each sample and position the reads give a base and an inclusive range [lo, hi] of thresholds at which the position
is callable: plain, and with continuity, where a read with an overlapping neighbour is kept at every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import settle
from .neighbours import TILE, in_tile, tile_of, with_halo
from .sites import classify_pair, classify_trio, mark_masked, with_reference

ALWAYS = 256


def _by_base(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base and, plain (0) and with continuity (1), the best quality and the best of a read that rejects."""
    joined = F.when(F.col("zn") >= 0, ALWAYS).otherwise(F.col("mapq"))
    cols = [F.max(q).alias(f"q{m}") for m, q in enumerate((F.col("mapq"), joined))] + [F.max(F.when(F.col("rejects"), q)).alias(f"bad{m}") for m, q in enumerate((F.col("mapq"), joined))]
    return reads.groupBy(*keys, "base").agg(*cols, F.count(F.lit(1)).alias("n"))


def _with_tops(own: DataFrame, keys: list[str]) -> DataFrame:
    """Adds t0 and t1, the best quality at the keys and the base that has it (the larger letter among equals, as tuples
    compare). ``pos`` is the first key, so that rows sort by a number."""
    at = Window.partitionBy(*keys)
    return own.withColumns({f"t{m}": F.max(F.struct(F.col(f"q{m}").alias("q"), "base")).over(at) for m in (0, 1)})


def _maxima(m: int) -> list[Column]:
    """What a mode keeps of rows: the top, the best of those of other bases, the best that reject."""
    other = ~F.coalesce(F.col("base") == F.col(f"t{m}.base"), F.lit(False))
    return [F.max(f"t{m}").alias(f"_t{m}"), F.max(F.when(other, F.col(f"q{m}"))).alias(f"_o{m}"), F.max(f"bad{m}").alias(f"_r{m}")]


def _mode(m: int) -> Column:
    """mode, base, lo, hi, indel of the reads at a position.

    The base is that of the highest read; lo is one above the best read that rejects or disagrees (one that rejects and
    shows another base disagrees too, so all that reject count)."""
    top, indel = F.col(f"_t{m}"), F.coalesce(f"_r{m}", F.lit(-1))
    lo = F.greatest(F.coalesce(f"_o{m}", F.lit(-1)), indel) + 1
    return F.struct(F.lit(m).alias("mode"), F.when(lo <= top["q"], top["base"]).alias("base"), lo.alias("lo"), top["q"].alias("hi"), indel.alias("indel"))


def site_intervals(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mode (0 plain, 1 continuity), base, lo, hi, indel (highest quality of reads with an indel here, -1 for
    none), n_reads. reads: keys, base, mapq, zn, rejects. base is null where no threshold calls the position.

    Built from maxima over bases for both modes at once, so reads are neither collected nor doubled: a window tells the
    top, one aggregation in the window's order the rest."""
    order = ["pos", *(k for k in keys if k != "pos")] if "pos" in keys else keys
    best = _with_tops(_by_base(reads, keys), order)
    best = best.groupBy(*order).agg(*(c for m in (0, 1) for c in _maxima(m)), F.sum("n").alias("n_reads"))
    out = best.select(*keys, F.explode(F.array(_mode(0), _mode(1))).alias("m"), "n_reads")
    return out.select(*keys, "m.*", "n_reads")


# a base as a number: 0 for null, else one more than its ASCII code, so that numbers compare as bases do
_LETTER = "least(coalesce(ascii(base), -1), 126) + 1"
_LETTER_BITS = 7
_FIELD = 9  # bits of a quality from -1 to 256, one added


def _packed(reads: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
    """keys, taxon, what ``more`` aggregates, and p0, p1 (null without reads): what ``_mode`` tells of the reads, as a
    number: base (0 for none), lo (of use where there is a base), hi + 1, indel + 1. ``_read``: which rows are reads.

    One aggregation of numbers. The best read of another base than the top's: for each bit of a letter the best read
    with and without it is kept, and a letter that is another one differs in a bit. Reads with a neighbour, at 256 in
    mode 1, need the largest and smallest letter only; if there are none, mode 1 is mode 0."""
    own = reads.selectExpr(*keys, "taxon", *(c for c in ("kind", "mask_end", "_read") if c in reads.columns), f"{_LETTER} as _c", "if(_read, coalesce(cast(mapq as int), -1), null) as _q", "_read and zn >= 0 as _z", "rejects")
    planes = [F.expr(f"max(if((_c & {1 << j}) {'<>' if side else '='} 0, _q, null)) as _p{side}_{j}") for j in range(_LETTER_BITS) for side in (0, 1)]
    tops = ["max(_q * 128 + _c) as _top", "max(if(rejects, _q, null)) as _bad", "max(if(_z, _c, null)) as _most", "min(if(_z, _c, null)) as _least", "max(if(_z and rejects, 256, null)) as _zbad"]
    best = own.groupBy(*keys, "taxon").agg(*more, *map(F.expr, tops), *planes)
    rest = [c for c in best.columns if not c.startswith("_p") and c not in ("_top", "_bad", "_most", "_least", "_zbad")]
    other = lambda c: f"coalesce(greatest({', '.join(f'if(({c} & {1 << j}) = 0, _p1_{j}, _p0_{j})' for j in range(_LETTER_BITS))}), -1)"
    best = settle(best, {"_o0": F.expr(other("_top")), "_o1": F.expr(f"if(_most is null, null, if(_most <> _least, 256, {other('_most')}))"), "_r0": F.expr("coalesce(_bad, -1)"), "_r1": F.expr("coalesce(_zbad, _bad, -1)")})
    pack = lambda base, lo, hi, indel: f"((cast(if({lo} <= {hi}, {base}, 0) as long) << {3 * _FIELD}) | (cast({lo} as long) << {2 * _FIELD}) | (({hi} + 1) << {_FIELD}) | ({indel} + 1))"
    p0 = pack("(_top & 127)", "(greatest(_o0, _r0) + 1)", "(_top >> 7)", "_r0")
    p1 = pack("_most", "(greatest(_o1, _r1) + 1)", "256", "_r1")
    return best.selectExpr(*rest, f"if(_top is null, null, {p0}) as p0", f"if(_top is null, null, if(_most is null, {p0}, {p1})) as p1")


def scan(reads: DataFrame, reference, taxa: list[int], mask: DataFrame | None = None, indel_window: int = 1, tile: int = TILE) -> DataFrame:
    """Classified windows: chrom, pos, mode, site_class, label, lo, hi, repeat and, for indel_window over 1,
    indel_mapq. reads: taxon, chrom, pos, base (an ASCII letter), mapq (to 255), zn, rejects, and those of
    ``dealt_positions`` kind, mask_end and _tile too. A position that any taxon covers is a line.

    Both modes stay in one line, a number for each and taxon, until windows are classified, and all frames share the
    lines' one deal."""
    dealt = "_tile" in reads.columns
    table = None if isinstance(reference, Column) else reference
    if not dealt:
        reads = with_halo(reads, "pos", max(2, indel_window), tile).drop("_own")
    keys = ["chrom", "_tile", "pos"]
    reads = reads.withColumn("_read", F.col("kind") == 0 if dealt else F.lit(True))
    more = ["max(_read) as _line"]
    if dealt:
        more += ["max(if(kind = 2, _c, null)) as _ref", "max(mask_end) as mask_end"]
    lines = _packed(reads, keys, [F.expr(c) for c in more])
    again = [f"max({c}) as {c}" for c in ("_line", "_ref", "mask_end") if c in lines.columns]
    lines = lines.groupBy(*keys).agg(*map(F.expr, again), *(F.expr(f"max(if(taxon = {t}, p{m}, null)) as s{t}_{m}") for t in taxa for m in (0, 1)))
    if table is None:
        lines = lines.withColumn("ref", reference)
    else:
        lines = lines.withColumn("ref", F.coalesce(F.char(F.col("_ref") - 1), F.lit("N"))) if dealt else with_reference(lines, table)
    frame = in_tile(["chrom"], "pos")
    if dealt:
        top = F.max("mask_end").over(frame.rowsBetween(Window.unboundedPreceding, 0))
        lines = lines.withColumn("masked", F.coalesce(top >= F.col("pos"), F.lit(False))).drop("mask_end", "_ref")
    else:
        lines = mark_masked(lines, mask)  # a flag here: masked positions stay
    field = lambda c, at: F.shiftright(c, at * _FIELD).bitwiseAND(F.lit((1 << _FIELD) - 1)).cast("int")
    lines = lines.where("_line").drop("_line").withColumn("ref", F.ascii("ref"))
    if indel_window > 1:
        for m in (0, 1):
            here = F.greatest(F.lit(0), *(field(F.col(f"s{t}_{m}"), 0) - 1 for t in taxa))
            lines = lines.withColumn(f"indel{m}", F.max(here).over(frame.rangeBetween(-indel_window, indel_window)))
    line = ["pos", "ref", "masked", *(f"s{t}_{m}" for t in taxa for m in (0, 1))]
    lines = lines.select("*", *(move(c).over(frame).alias(f"{side}_{c}") for side, move in (("before", F.lag), ("behind", F.lead)) for c in line))
    lines = lines.where(F.col("_tile") == tile_of("pos", max(tile, 2 * max(2, indel_window) + 1))).where("before_pos = pos - 1 and behind_pos = pos + 1")
    every = [f"{side}s{t}" for side in ("before_", "", "behind_") for t in taxa]
    # both modes have a number where one has, its base is none where no threshold calls the position
    lines = lines.where(" and ".join(f"{c}_0 is not null" for c in every)).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("mode"))
    indel = "if(mode = 0, indel0, indel1)" if indel_window > 1 else "cast(null as int)"
    repeat = "cast(masked or before_masked or behind_masked as int) as repeat"
    lines = lines.selectExpr("chrom", "pos", "mode", f"{indel} as indel_mapq", repeat, "before_ref", "ref", "behind_ref", *(f"if(mode = 0, {c}_0, {c}_1) as {c}" for c in every))
    lines = lines.where(" and ".join(f"{c} >= {1 << 3 * _FIELD}L" for c in every))
    # neighbours' bounds, from 0 to ALWAYS
    lo = F.greatest(F.lit(0), *(field(F.col(c), 2) for c in every))
    hi = F.least(F.lit(ALWAYS), *(field(F.col(c), 1) - 1 for c in every))
    lines = settle(lines, {"lo": lo, "hi": hi}).where("lo <= hi")
    sides = ("before_", "", "behind_")
    ref3 = F.concat(*(F.char(f"{side}ref") for side in sides))
    own = {f"t{t}_3": F.concat(*(F.char(F.shiftright(f"{side}s{t}", 3 * _FIELD) - 1) for side in sides)) for t in taxa}
    out = settle(lines, {"ref3": ref3, **own}).select("chrom", "pos", "mode", "lo", "hi", "indel_mapq", "repeat", "ref3", *(f"t{t}_3" for t in taxa))
    return classify_trio(out, acgt=False) if len(taxa) == 2 else classify_pair(out)


def annotated(positions: DataFrame) -> DataFrame:
    """Positions of ``dealt_positions`` with mapq and zn as reads of ``scan``: a deletion is a star, and a read with an
    indel here rejects."""
    base = F.when(F.col("deleted"), "*").otherwise(F.col("base"))
    return positions.withColumn("base", base).withColumn("rejects", F.col("deleted") | F.col("inserted")).drop("deleted", "inserted")


def site_counts(windows: DataFrame) -> DataFrame:
    """mode, site_class, label, lo, hi, indel_mapq, n: an interval-encoded view for every threshold."""
    return windows.groupBy("mode", "site_class", "label", "lo", "hi", "indel_mapq").agg(F.count(F.lit(1)).alias("n"))


def calls(windows: DataFrame) -> DataFrame:
    own = windows.where(F.col("site_class").isin("taxa1_mut", "taxa2_mut", "differs"))
    taxon = F.when(F.col("site_class") == "taxa2_mut", 2).otherwise(1)
    return own.select("chrom", "pos", "mode", taxon.alias("taxon"), F.col("label").alias("mutation"), "lo", "hi", "repeat", "indel_mapq")


def at_threshold(counts: DataFrame, mapq: int, continuity: bool, indel: bool = False) -> DataFrame:
    out = counts.where((F.col("mode") == int(continuity)) & (F.col("lo") <= mapq) & (F.col("hi") >= mapq))
    return out.where(F.coalesce(F.col("indel_mapq") < mapq, F.lit(True))) if indel else out


def derive_calls(calls: DataFrame, mapq: int, continuity: bool, indel: bool = False, pair: bool = False) -> DataFrame:
    """chrom, pos and mutation (and the taxon of a trio's, the change of a pair's) of ``calls`` at one threshold."""
    own = at_threshold(calls, mapq, continuity, indel)
    if not pair:
        return own.select("chrom", "pos", "taxon", "mutation")
    from ..functions.bases import change_triplets, fold

    return own.select("chrom", "pos", F.col("mutation").alias("change"), fold(*change_triplets("mutation")).alias("mutation"))


def derive(counts: DataFrame, mapq: int, continuity: bool, indel: bool = False) -> dict[str, DataFrame]:
    """mut (taxon, mutation, n), trip (triplet, n), classes and ref_diff of a trio at one threshold."""
    own = at_threshold(counts, mapq, continuity, indel)
    context = F.when(F.col("site_class") == "identical", F.col("label")).otherwise(F.concat(F.substring("label", 1, 1), F.substring("label", 3, 1), F.substring("label", 7, 1)))
    called = own.where(F.col("site_class").isin("taxa1_mut", "taxa2_mut"))
    return {
        "mut": called.groupBy(F.substring("site_class", 5, 1).cast("int").alias("taxon"), F.col("label").alias("mutation")).agg(F.sum("n").alias("n")),
        "trip": own.where(F.col("site_class").isin("taxa1_mut", "taxa2_mut", "identical")).groupBy(context.alias("triplet")).agg(F.sum("n").alias("n")),
        "classes": own.groupBy("site_class").agg(F.sum("n").alias("n")),
        "ref_diff": own.where("site_class = 'ref_differs'").groupBy(F.col("label").alias("mutation")).agg(F.sum("n").alias("n")),
    }


def derive_pair(counts: DataFrame, mapq: int, continuity: bool, indel: bool = False) -> dict[str, DataFrame]:
    from ..functions.bases import change_triplets, fold

    own = at_threshold(counts, mapq, continuity, indel)
    a, b = change_triplets("label")
    called = own.where("site_class = 'differs'")
    halves = called.select(F.explode(F.array(a, b)).alias("triplet"), (F.col("n") * 0.5).alias("n")).unionByName(own.where("site_class = 'identical'").select(F.col("label").alias("triplet"), F.col("n").cast("double").alias("n")))
    return {
        "mut": called.groupBy(fold(a, b).alias("mutation")).agg(F.sum("n").alias("n")),
        "trip": halves.groupBy("triplet").agg(F.sum("n").alias("n")),
        "classes": own.groupBy("site_class").agg(F.sum("n").alias("n")),
    }


def sweep(counts: DataFrame, thresholds: list[int]) -> DataFrame:
    """mapq, mode, site_class, n at each of a few thresholds: each count row is exploded to those in its range."""
    hit = F.filter(F.array(*map(F.lit, thresholds)), lambda t: (t >= F.col("lo")) & (t <= F.col("hi")))
    return counts.select("mode", "site_class", "n", F.explode(hit).alias("mapq")).groupBy("mapq", "mode", "site_class").agg(F.sum("n").alias("n"))
