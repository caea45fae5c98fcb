"""From alignments to callable positions: CIGAR expansion, pileup aggregation, quality checks, windows, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import directed_label, fold, is_acgt, settle
from .neighbours import TILE, at_offsets, far_neighbours, in_tile, tile_of, with_halo

SKIP_FLAGS = 0x4 | 0x100 | 0x200 | 0x400  # unmapped, secondary, failed, duplicate


def parse_cigar(cigar: Column) -> Column:
    """Array of (op, len)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("len")))


def _usable():
    return (F.col("flag").bitwiseAND(SKIP_FLAGS) == 0) & F.col("cigar").isNotNull() & F.col("seq").isNotNull()


# what comes before each operation, on the reference (r) and in the read (q), and whether an insertion comes right behind;
# most reads have one operation, which needs no walk
_OPS = "case when size(cigar) = 1 then array(struct(cigar[0].op as op, cigar[0].len as len, 0 as r, 0 as q, false as ins))"
_OPS += " else transform(cigar, (c, i) -> struct(c.op as op, c.len as len,"
_OPS += " aggregate(slice(cigar, 1, i), 0, (a, x) -> a + if(x.op in ('M', '=', 'X', 'D', 'N'), x.len, 0)) as r,"
_OPS += " aggregate(slice(cigar, 1, i), 0, (a, x) -> a + if(x.op in ('M', '=', 'X', 'I', 'S'), x.len, 0)) as q,"
_OPS += " coalesce(get(cigar, i + 1).op = 'I', false) as ins)) end"
_COVERS = "_o.op in ('M', '=', 'X', 'D') and _o.len > 0"


def _walked(rows: DataFrame, keep: list[str], first: str = "0", last: str = "_o.len - 1") -> DataFrame:
    """A row for each place ``first`` to ``last`` of operations (_o, of reads with start0 and seq, in bytes). Positions
    are exploded as numbers and everything else is told for each row, so that all of it runs as generated code."""
    pos = f"cast(start0 + _o.r + _j + 1 as {rows.schema['start0'].dataType.simpleString()}) as pos"
    base = "if(_o.op = 'D', null, cast(substring(seq, _o.q + _j + 1, 1) as string)) as base"
    # an insertion flags the covered position before it, whatever operation covers that
    rows = rows.select(*keep, "start0", "seq", "_o", F.expr(f"explode(sequence(cast({first} as int), cast({last} as int)))").alias("_j"))
    return rows.selectExpr(*keep, "start0", pos, base, "_o.op = 'D' as deleted", "_o.ins and _j = _o.len - 1 as inserted")


def aligned_positions(alignments: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each reference position that a read covers: pos (1-based), base (null in a deletion), deleted,
    inserted (the read has an insertion right behind). Reads with skipped flags, or without CIGAR or bases, are left
    out; skips and clips cover nothing."""
    own = list(dict.fromkeys(keep))
    rows = alignments.where(_usable()).select(*own, *(["start0"] if "start0" not in own else []), F.upper("seq").cast("binary").alias("seq"), F.explode(F.expr(_OPS)).alias("_o"))
    return _walked(rows.where(_COVERS), [c for c in own if c != "start0"]).select(*keep, "pos", "base", "deleted", "inserted")


def first_reads(positions: DataFrame, most: int, by: list[str]) -> DataFrame:
    """Positions of at most ``most`` reads each (of the keys ``by``): those that start first, the first in order among
    equals. A rank that is cut off needs no more rows of a position than these, however deep it is."""
    order = Window.partitionBy(*by).orderBy("start0", "ord")
    return positions.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def dealt_positions(alignments: DataFrame, reference: DataFrame | None, mask: DataFrame | None, keep: list[str], reach: int, tile: int, max_depth: int = 0) -> DataFrame:
    """``aligned_positions`` of reads that are dealt by contig and tile first, with a halo of ``reach`` positions: the
    one shuffle of a scan, of reads and not of their positions. Adds kind (0 for a read) and _tile.

    The reference (chrom, start0, seq: pieces of any length; or chrom, pos, ref) and merged masks (chrom, start, end)
    are dealt along: a base of the reference is a row of kind 2, an interval one of kind 1 at its first position in the
    tile, with its end in ``mask_end``. ``max_depth``: reads (with ord) of a taxon that count at a position, the first
    by start and order; 0 for all."""
    if max_depth:
        if "ord" not in alignments.columns:
            alignments = alignments.withColumn("ord", F.col("frag_ord" if "frag_ord" in alignments.columns else "qname"))
        keep = [*keep, "ord"]
    at = alignments.schema["start0"].dataType
    rows = alignments.where(_usable()).withColumnRenamed("rname", "chrom").select(*keep, "chrom", "start0", "end0", "cigar", F.upper("seq").cast("binary").alias("seq"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("mask_end"))
    if mask is not None:
        own = mask.select("chrom", (F.col("start") - 1).cast(at).alias("start0"), F.col("end").cast(at).alias("end0"), F.lit(1).alias("kind"), F.col("end").cast("long").alias("mask_end"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    if reference is not None:
        own = reference.select("chrom", (F.col("pos") - 1).alias("start0"), F.col("ref").alias("seq")) if "pos" in reference.columns else reference.select("chrom", "start0", "seq")
        own = own.select("chrom", F.col("start0").cast(at).alias("start0"), (F.col("start0") + F.length("seq")).cast(at).alias("end0"), F.upper("seq").cast("binary").alias("seq"), F.lit(2).alias("kind"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    first, last = F.floor((F.col("start0") + 1 - reach) / tile), F.floor((F.greatest(F.col("end0"), F.col("start0") + 1) + reach) / tile)
    rows = rows.withColumn("_tile", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    # reads are few bytes beside what they are walked into, so the number of tasks is given and not left to their size
    rows = rows.repartition(4 * int(alignments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "_tile")
    # a base of the reference is walked like a read's, an interval is one place
    plain = lambda op, n: f"array(struct('{op}' as op, {n} as len, 0 as r, 0 as q, false as ins))"
    ops = f"case kind when 0 then {_OPS} when 1 then {plain('K', 1)} else {plain('R', 'length(seq)')} end"
    low, high = f"(_tile * {tile} - {reach})", f"((_tile + 1) * {tile} - 1 + {reach})"
    cols = [*keep, "chrom", "_tile", "kind", "mask_end"]
    rows = rows.select(*cols, "start0", "seq", F.explode(F.expr(ops)).alias("_o"))
    rows = rows.where(f"kind > 0 and _o.len > 0 or {_COVERS}")
    # where an interval's place is; what a read or a piece has in the tile and its halo
    rows = rows.withColumn("start0", F.expr(f"if(kind = 1, cast(greatest(start0, {low} - 1) as {at.simpleString()}), start0)"))
    first, last = f"greatest(0, {low} - start0 - _o.r - 1)", f"least(_o.len - 1, {high} - start0 - _o.r - 1)"
    rows = _walked(rows.where(f"{first} <= {last}"), cols, first, last)
    rows = rows.withColumn("base", F.when(F.col("kind") != 1, F.col("base")))
    if max_depth:  # the rows are where they are needed; of a mask and of the reference a position has one each
        rows = first_reads(rows, max_depth, ["chrom", "_tile", "taxon", "kind", "pos"]).drop("ord")
    return rows.drop("start0")


# a read's letter at a position as a bit, and three bits beside the letters
_DELETED, _INSERTED, _COVERED = 60, 61, 62
_LETTERS = (1 << _DELETED) - 1
_BITS = f"coalesce(shiftleft(1L, ascii(base) - 33), 0L) | if(deleted, {1 << _DELETED}L, 0L) | if(inserted, {1 << _INSERTED}L, 0L) | {1 << _COVERED}L"


def pileup(positions: DataFrame, taxa: list[int]) -> DataFrame:
    """A row for each covered position with, for each taxon t, cov_t, base_t (null unless the reads agree), del_t, ins_t
    and dis_t. One aggregation for all taxa, so a position that any of them covers is a line. What the reads of a taxon
    show is one long of bits, so the aggregation hashes and its state is a long a taxon."""
    dealt = "_tile" in positions.columns
    read = (F.col("kind") == 0) if dealt else F.lit(True)
    shown = F.expr(_BITS)
    out = [F.bit_or(F.when(read & (F.col("taxon") == t), shown)).alias(f"_b{t}") for t in taxa]
    if dealt:
        out += [F.max(F.when(F.col("kind") == 2, F.ascii("base"))).alias("ref"), F.max("mask_end").alias("mask_end"), F.max(read).alias("_line")]
    keys = ["chrom", "_tile", "pos"] if dealt else ["chrom", "pos"]
    lines = positions.groupBy(*keys).agg(*out)
    cols = []
    for t in taxa:
        bits = F.col(f"_b{t}")
        letters = bits.bitwiseAND(F.lit(_LETTERS))
        flag = lambda i: F.coalesce(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))  # noqa: E731, B023
        cols += [
            bits.isNotNull().alias(f"cov_{t}"),
            F.when(F.bit_count(letters) == 1, F.char(F.bit_count(letters - 1) + 33)).alias(f"base_{t}"),  # below the bit are as many as its place
            flag(_DELETED).alias(f"del_{t}"),
            flag(_INSERTED).alias(f"ins_{t}"),
            F.coalesce(F.bit_count(letters) > 1, F.lit(False)).alias(f"dis_{t}"),
        ]
    more = [F.char("ref").alias("ref"), "mask_end", "_line"] if dealt else []
    return lines.select(*keys, *cols, *more)


def tiled_lines(alignments: DataFrame, taxa: list[int], reference: DataFrame | Column, mask: DataFrame | None = None, reach: int = 2, tile: int = TILE, max_depth: int = 0) -> DataFrame:
    """Lines with a halo for ``scan``: one shuffle, of reads, whatever the scan asks for."""
    table = None if isinstance(reference, Column) else reference
    tile = max(tile, 2 * reach + 1)
    lines = pileup(dealt_positions(alignments, table, mask, ["taxon"], reach, tile, max_depth), taxa)
    ref = F.coalesce("ref", F.lit("N")) if table is not None else reference
    return lines.withColumn("ref", ref).withColumn("_own", F.col("_tile") == tile_of("pos", tile))


def own_lines(lines: DataFrame) -> DataFrame:
    """Lines without their halo."""
    return lines.where("_own and _line").drop("_tile", "_own", "_line", "mask_end")


def pileup_alignments(alignments: DataFrame, taxa: list[int]) -> DataFrame:
    """alignments: taxon, rname, start0, flag, cigar, seq."""
    return pileup(aligned_positions(alignments.withColumnRenamed("rname", "chrom"), ["taxon", "chrom"]), taxa)


def problem(t: int) -> Column:
    """The first reason why a sample's position can't be used, or null."""
    return F.when(~F.col(f"cov_{t}"), "no_depth").when(F.col(f"del_{t}"), "deletion").when(F.col(f"ins_{t}"), "insertion").when(F.col(f"dis_{t}"), "reads_disagree")


def quality(taxa: list[int]) -> Column:
    """The reason why a line is dropped: over several samples the first of deletion, insertion, no depth, disagreement."""
    problems = F.array(*map(problem, taxa))
    out = None
    for name in ("deletion", "insertion", "no_depth", "reads_disagree"):
        hit = F.array_contains(F.array_compact(problems), name)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def has_indel(taxa: list[int]) -> Column:
    out = F.lit(False)
    for t in taxa:
        out = out | F.col(f"del_{t}") | F.col(f"ins_{t}")
    return out


def with_reference(lines: DataFrame, reference: DataFrame | Column) -> DataFrame:
    """Adds ``ref``: from a table (chrom, pos, ref), or from an expression."""
    return lines.withColumn("ref", reference) if isinstance(reference, Column) else lines.join(reference.select("chrom", "pos", "ref"), ["chrom", "pos"], "left").withColumn("ref", F.coalesce(F.upper("ref"), F.lit("N")))


def mark_masked(lines: DataFrame, mask: DataFrame | None, bin_size: int = 1 << 14) -> DataFrame:
    """Adds ``masked``: the position lies in an interval (chrom, start, end; 1-based, both ends in). Intervals are
    exploded to bins and met by equality, so a mask of any size is never broadcast as a whole nor met by ranges only."""
    if mask is None:
        return lines.withColumn("masked", F.lit(False))
    bins = mask.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    bins = bins.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bin_size), F.floor(F.col("_e") / bin_size))))
    hit = (F.col("chrom") == F.col("_c")) & (F.floor(F.col("pos") / bin_size) == F.col("_b")) & F.col("pos").between(F.col("_s"), F.col("_e"))
    return lines.join(bins, hit, "left").withColumn("masked", F.col("_s").isNotNull()).drop("_c", "_s", "_e", "_b")


def scan(lines: DataFrame, taxa: list[int], mask: DataFrame | None = None, indel_window: int = 1, tile: int = TILE, gaps: bool = True, halo: bool = False) -> DataFrame:
    """Lines after the mask with qc, near, before, behind, ``window`` (three clean consecutive lines around this one)
    and, with ``gaps``, ``gap`` (three clean adjacent lines that aren't consecutive, however far). ``mask`` has merged
    intervals. Lines of ``tiled_lines`` have their halo and mask; others are dealt here. With ``halo`` the lines of the
    halo stay, for further frames."""
    if indel_window < 1:
        raise ValueError("indel_window must be at least 1")
    if "_tile" not in lines.columns:
        lines = with_halo(mark_masked(lines, mask), "pos", max(2, indel_window), tile).withColumn("_line", F.lit(True))
    else:
        top = F.max("mask_end").over(in_tile(["chrom"], "pos").rowsBetween(Window.unboundedPreceding, 0))
        lines = lines.withColumn("masked", F.coalesce(top >= F.col("pos"), F.lit(False))).drop("mask_end")
    own = in_tile(["chrom"], "pos")
    lines = lines.where("_line").drop("_line").withColumn("qc", quality(taxa)).withColumn("ok", F.col("qc").isNull())
    if indel_window > 1:  # events on masked lines count too
        lines = lines.withColumn("near", F.max(has_indel(taxa).cast("int")).over(own.rangeBetween(-indel_window, indel_window)) > 0)
    else:
        lines = lines.withColumn("near", F.lit(False))
    lines = lines.where("not masked").drop("masked")
    line = F.struct("pos", "ok", "ref", *(f"base_{t}" for t in taxa))
    lines = lines.withColumn("before", F.lag(line).over(own)).withColumn("behind", F.lead(line).over(own))
    three = F.col("ok") & F.col("before.ok") & F.col("behind.ok")
    adjacent = (F.col("before.pos") == F.col("pos") - 1) & (F.col("behind.pos") == F.col("pos") + 1)
    lines = lines.withColumn("window", F.coalesce(three & adjacent, F.lit(False)))
    if gaps:
        lines = far_neighbours(lines, ["chrom"], "pos", ["ok"])
        clean = F.col("ok") & F.coalesce("before.ok", "far_before.ok") & F.coalesce("behind.ok", "far_behind.ok")
        lines = lines.withColumn("gap", F.coalesce(clean & ~F.col("window"), F.lit(False))).drop("far_before", "far_behind")
    return lines if halo else lines.where("_own").drop("_tile", "_own")


def contexts(scanned: DataFrame, taxa: list[int]) -> DataFrame:
    """Windows with the 3-mers of the reference (ref3) and of each taxon (t_3)."""
    three = lambda c: F.concat(F.col(f"before.{c}"), F.col(c), F.col(f"behind.{c}"))
    own = scanned.where("_own") if "_own" in scanned.columns else scanned
    out = settle(own.where("window"), {"ref3": three("ref"), **{f"t{t}_3": three(f"base_{t}") for t in taxa}})
    return out.select("chrom", "pos", "near", "ref3", *(f"t{t}_3" for t in taxa))


def _flanks(a: str, b: str) -> Column:
    return (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.substring(a, 3, 1) == F.substring(b, 3, 1))


def _mid(c: str) -> Column:
    return F.substring(c, 2, 1)


def classify_trio(windows: DataFrame, acgt: bool = True) -> DataFrame:
    """Adds site_class and label. Without ``acgt`` windows with other letters fall in the ordinary classes."""
    flanks = _flanks("ref3", "t1_3") & _flanks("ref3", "t2_3")
    r, a, b = _mid("ref3"), _mid("t1_3"), _mid("t2_3")
    other = ~is_acgt(F.concat("ref3", "t1_3", "t2_3")) if acgt else F.lit(False)
    site = F.when(other, "not_acgt").when(~flanks, "flanks_not_conserved").when((r == a) & (r == b), "identical").when((r == a) & (r != b), "taxa2_mut")
    site = site.when((r != a) & (r == b), "taxa1_mut").when(a == b, "ref_differs").otherwise("all_differ")
    left, right = F.substring("ref3", 1, 1), F.substring("ref3", 3, 1)
    label = F.when(F.col("site_class") == "taxa1_mut", directed_label(left, r, a, right)).when(F.col("site_class") == "taxa2_mut", directed_label(left, r, b, right))
    label = label.when(F.col("site_class") == "identical", F.col("ref3")).when(F.col("site_class") == "ref_differs", directed_label(left, a, r, right)).otherwise("")
    return settle(settle(windows, {"site_class": site}), {"label": label})


def classify_pair(windows: DataFrame) -> DataFrame:
    """Adds site_class and label (the change seen from the reference, or the context)."""
    r, a = _mid("ref3"), _mid("t1_3")
    site = F.when(~is_acgt(F.concat("ref3", "t1_3")), "not_acgt").when(~_flanks("ref3", "t1_3"), "flanks_not_conserved").when(r == a, "identical").otherwise("differs")
    label = F.when(F.col("site_class") == "differs", directed_label(F.substring("ref3", 1, 1), r, a, F.substring("ref3", 3, 1))).when(F.col("site_class") == "identical", F.col("ref3")).otherwise("")
    return settle(settle(windows, {"site_class": site}), {"label": label})


def trio_calls(classified: DataFrame) -> DataFrame:
    own = classified.where(F.col("site_class").isin("taxa1_mut", "taxa2_mut"))
    return own.select(F.substring("site_class", 5, 1).cast("int").alias("taxon"), "chrom", "pos", F.col("label").alias("mutation"))


def pair_calls(classified: DataFrame) -> DataFrame:
    return classified.where("site_class = 'differs'").select("chrom", "pos", F.col("label").alias("change"), fold("ref3", "t1_3").alias("mutation"))


def _rows(classified: DataFrame) -> Column:
    """How many rows, or what they count where they have been counted."""
    return F.sum("n") if "n" in classified.columns else F.count(F.lit(1))


def spectrum(classified: DataFrame) -> DataFrame:
    """taxon, mutation, n of a trio."""
    own = classified.where(F.col("site_class").isin("taxa1_mut", "taxa2_mut")).groupBy("site_class", "label").agg(_rows(classified).alias("n"))
    return own.select(F.substring("site_class", 5, 1).cast("int").alias("taxon"), F.col("label").alias("mutation"), "n")


def triplets(classified: DataFrame) -> DataFrame:
    """triplet, n: the opportunities that both branches of a trio share."""
    return classified.where(F.col("site_class").isin("taxa1_mut", "taxa2_mut", "identical")).groupBy(F.col("ref3").alias("triplet")).agg(_rows(classified).alias("n"))


def pair_spectrum(classified: DataFrame) -> DataFrame:
    own = classified.where("site_class = 'differs'").groupBy("ref3", "t1_3").agg(_rows(classified).alias("n"))
    return own.groupBy(fold("ref3", "t1_3").alias("mutation")).agg(F.sum("n").alias("n"))  # labels are made of counted pairs


def pair_triplets(classified: DataFrame) -> DataFrame:
    """triplet, n: half a count for either allele's context."""
    own = classified.where(F.col("site_class").isin("identical", "differs")).groupBy("ref3", "t1_3").agg(_rows(classified).alias("n"))
    return own.select(F.explode(F.array("ref3", "t1_3")).alias("triplet"), "n").groupBy("triplet").agg((F.sum("n") * 0.5).alias("n"))


def ref_differences(classified: DataFrame) -> DataFrame:
    return classified.where("site_class = 'ref_differs'").groupBy(F.col("label").alias("mutation")).agg(_rows(classified).alias("n"))


def site_classes(classified: DataFrame) -> DataFrame:
    return classified.groupBy("site_class").agg(_rows(classified).alias("n"))


def drop_reasons(lines: DataFrame) -> DataFrame:
    return lines.where("qc is not null").groupBy(F.col("qc").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def five_mers(scanned: DataFrame, taxa: list[int], tile: int = TILE) -> DataFrame:
    """Windows kept by the trio scan whose outer bases are clean too and all four flanks equal in three genomes:
    chrom, pos, ref5, t1, t2."""
    own = scanned.select("chrom", "pos", "ok", "window", "near", "ref", *(f"base_{t}" for t in taxa), *(c for c in ("_tile", "_own") if c in scanned.columns))
    wide = at_offsets(own, ["chrom"], "pos", ["ok", "ref", *(f"base_{t}" for t in taxa)], [-2, -1, 1, 2], tile)
    good = F.col("window") & ~F.col("near") & F.col("m2.ok") & F.col("p2.ok")
    every = ["m2", "m1", "p1", "p2"]
    for side in every:
        for t in taxa:
            good = good & (F.col(f"{side}.ref") == F.col(f"{side}.base_{t}"))
    ref5 = F.concat("m2.ref", "m1.ref", "ref", "p1.ref", "p2.ref")
    letters = F.concat(ref5, *(f"base_{t}" for t in taxa))
    return wide.where(good & is_acgt(letters)).select("chrom", "pos", ref5.alias("ref5"), *(F.col(f"base_{t}").alias(f"t{t}") for t in taxa))


def five_mer_spectrum(windows: DataFrame) -> DataFrame:
    """taxon, mutation (XX[Y>Z]WW), n."""
    r = F.substring("ref5", 3, 1)
    taxon = F.when((F.col("t1") != r) & (F.col("t2") == r), 1).when((F.col("t1") == r) & (F.col("t2") != r), 2)
    new = F.when(taxon == 1, F.col("t1")).otherwise(F.col("t2"))
    label = directed_label(F.substring("ref5", 1, 2), r, new, F.substring("ref5", 4, 2))
    return windows.withColumn("taxon", taxon).where("taxon is not null").groupBy("taxon", label.alias("mutation")).agg(F.count(F.lit(1)).alias("n"))


def five_mer_opportunity(windows: DataFrame) -> DataFrame:
    r = F.substring("ref5", 3, 1)
    return windows.where((F.col("t1") == r) | (F.col("t2") == r)).groupBy(F.col("ref5").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def matrix_sites(lines: DataFrame, taxa: list[int]) -> DataFrame:
    """Windows of N samples with conserved flanks: chrom, pos, left, right, ref, taxa (the samples' bases), varies."""
    out = contexts(scan(lines, taxa, gaps=False), taxa)
    own = F.array(*(F.col(f"t{t}_3") for t in taxa))
    flanks = F.forall(own, lambda x: (F.substring(x, 1, 1) == F.substring("ref3", 1, 1)) & (F.substring(x, 3, 1) == F.substring("ref3", 3, 1)))
    mids = F.transform(own, lambda x: F.substring(x, 2, 1))
    ref = F.substring("ref3", 2, 1)
    out = out.where(flanks).withColumn("taxa", mids).where(F.array_contains("taxa", ref))
    return out.select("chrom", "pos", F.substring("ref3", 1, 1).alias("left"), F.substring("ref3", 3, 1).alias("right"), ref.alias("ref"), "taxa", (F.size(F.array_distinct("taxa")) > 1).alias("varies"), "ref3")
