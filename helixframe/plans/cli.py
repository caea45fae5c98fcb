"""Command line: pair, trio and multi over alignments (Parquet, or SAM or BAM in the order of taxa) or genomes (FASTA, with an
aligner), phylip over a matrix, and derive."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description=__doc__)
    sub = p.add_subparsers(dest="mode", required=True)
    for mode in ("pair", "trio", "multi"):
        q = sub.add_parser(mode)
        given = q.add_mutually_exclusive_group(required=True)
        given.add_argument("--alignments", nargs="+", help="Parquet with taxon, rname, start0, ..., or a SAM or BAM file for each taxon")
        given.add_argument("--genomes", nargs="+", help="a FASTA file for each taxon, aligned first")
        q.add_argument("--aligner", default="bwa", help="a known aligner")
        q.add_argument("--aligner-cmd", help="an aligner's command with {fq}, {cores} and {ref} or {refdir}")
        q.add_argument("--ref-index", default="", help="what the aligner is given as {ref}; the reference itself by default")
        q.add_argument("--species-list", help="names of the taxa, a JSON list")
        q.add_argument("--reference", required=True, help="FASTA")
        q.add_argument("--out", required=True)
        q.add_argument("--mapq", type=int, default=60)
        q.add_argument("--low-mapq", type=int, default=1)
        q.add_argument("--no-continuity", action="store_true")
        q.add_argument("--continuity-run", type=int, default=2)
        q.add_argument("--indel-window", type=int, default=1)
        q.add_argument("--no-cache", action="store_true")
        q.add_argument("--no-cleanup", action="store_true")
        q.add_argument("--intervals", action="store_true", help="write the spans of reads too")
        q.add_argument("--index-cmd", help="prepares the reference for the aligner, with {ref}, {refdir} and {cores}; known aligners have their own")
        masks = q.add_mutually_exclusive_group()
        masks.add_argument("--mask", help="BED of repeats")
        masks.add_argument("--repeat-mask", choices=["windowmasker", "repeatmasker"], help="finds the reference's repeats first, in the run's folder")
        q.add_argument("--repeat-species", help="RepeatMasker's library")
        q.add_argument("--genome-masks", nargs="+", help="a BED of repeats for each genome, whose tiles avoid them; --repeat-mask finds these, too")
        q.add_argument("--repeat-mask-frac", type=float, default=0.5, help="a tile with this share of repeats is not aligned")
        q.add_argument("--fragment-length", type=int, default=150)
        q.add_argument("--fragment-offset", type=int, default=75)
        q.add_argument("--max-depth", type=int, default=100, help="reads of a taxon that count at a position; 0 for all")
        if mode == "multi":
            q.add_argument("--newick", required=True)
            q.add_argument("--outgroup", required=True)
        else:
            q.add_argument("--annotate", action="store_true")
        if mode == "trio":
            q.add_argument("--five-mer", action="store_true")
            q.add_argument("--divergence-time", type=float, help="million years")
    q = sub.add_parser("phylip")
    q.add_argument("--matrix", required=True, help="CSV of variable sites")
    q.add_argument("--species-list", required=True, help="names in the order of columns, the outgroup first, a JSON list")
    q.add_argument("--out", required=True)
    q.add_argument("--phylip-cmd", help="reads infile, writes outfile and outtree in its folder; without one the search is this library's, over all sites")
    q.add_argument("--newick", help="a tree to compare the found one with")
    q.add_argument("--phylip-sites", type=int, default=1_000_000)
    q = sub.add_parser("derive")
    q.add_argument("--run", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--mapq", type=int, default=60)
    q.add_argument("--no-continuity", action="store_true")
    q.add_argument("--indel", action="store_true")
    return p


def _alignments(spark, a, names, o):
    """Rows of all taxa, from Parquet, SAM or BAM files, or genomes that are aligned and kept in the run's folder, and the
    digest of what they were made of."""
    from pyspark.sql import functions as F

    from ..operators.intervals import merge, piece_size
    from ..sources import bam, external, fasta, readers
    from . import runs

    paths = a.alignments or a.genomes
    names = names or [f"taxon{i}" for i in range(1, len(paths) + 1)]
    source = runs.files_digest(spark, paths)
    if a.alignments and not all(p.endswith((".sam", ".bam")) for p in paths):
        return spark.read.parquet(*paths), source
    if a.alignments:
        read = lambda p, n: bam.bam(spark, p, n) if p.endswith(".bam") else readers.sam(spark, p, n)
        rows = None
        for i, (p, n) in enumerate(zip(paths, names), 1):
            own = readers.fragment_order(read(p, n)).withColumn("taxon", F.lit(i)).drop("zn")
            rows = own if rows is None else rows.unionByName(own)
        return rows, source
    command = external.aligner_command(a.aligner, a.aligner_cmd)
    prepare = a.index_cmd or (None if a.aligner_cmd else external.ALIGNERS[a.aligner][1])
    if prepare and not a.ref_index:
        external.index(a.reference, prepare)
    ref = a.ref_index or a.reference
    masks = [merge(readers.bed(spark, p), ["chrom"]) for p in a.genome_masks] if a.genome_masks else None
    if a.repeat_mask and masks is None:
        masks = [runs.build_mask(spark, p, f"{a.out.rstrip('/')}/repeats/{n}", a.repeat_mask, species=a.repeat_species, cache=not a.no_cache) for p, n in zip(paths, names)]
    pieces = [fasta.pieces(fasta.index(spark, p), piece_size(a.fragment_offset), a.fragment_length) for p in paths]
    return runs.align_genomes(
        spark, pieces, a.out, command, o, names, masks, [runs.files_digest(spark, [p]) for p in paths], a.repeat_mask_frac, a.fragment_length, a.fragment_offset, ref=ref, refdir=ref
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from ..operators.intervals import merge
    from ..sources import fasta, readers
    from . import runs

    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    try:
        if a.mode == "derive":
            runs.derive_run(spark, a.run, a.out, a.mapq, not a.no_continuity, a.indel)
            return 0
        names = json.loads(a.species_list) if a.species_list else None
        if a.mode == "phylip":
            matrix = readers.matrix(spark, a.matrix, len(names))
            if a.phylip_cmd:
                runs.run_phylip(spark, matrix, names, a.out, a.phylip_cmd, a.phylip_sites)
            else:
                runs.search_tree(spark, matrix, names, a.out, a.newick)
            return 0
        o = runs.Options(
            a.mapq, a.low_mapq, not a.no_continuity, a.continuity_run, a.indel_window, getattr(a, "annotate", False), getattr(a, "five_mer", False), not a.no_cache,
            intervals=a.intervals, divergence=getattr(a, "divergence_time", None), max_depth=a.max_depth,
        )
        mask = merge(readers.bed(spark, a.mask), ["chrom"]) if a.mask else None
        if a.repeat_mask:
            mask = runs.build_mask(spark, a.reference, f"{a.out.rstrip('/')}/repeats", a.repeat_mask, species=a.repeat_species, cache=not a.no_cache)
        rows, source = _alignments(spark, a, names, o)
        reference = fasta.pieces(fasta.index(spark, a.reference), 1000)  # short pieces, dealt with the reads
        if a.mode == "multi":
            runs.run_multi(spark, rows, reference, a.out, a.newick, a.outgroup, o, mask, source)
        else:
            (runs.run_pair if a.mode == "pair" else runs.run_trio)(spark, rows, reference, a.out, o, mask, source)
        if not a.no_cleanup and not o.annotate and not o.cache:
            runs.clean_up(spark, a.out)
        return 0
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
