"""Whole runs: pair, trio, several species, and runs derived from an annotated one.

A run takes alignments (species, taxon, rname, start0, end0, flag, mapq, cigar, seq, frag_ord, qname) and a reference
(chrom, pos, ref, or an expression) and writes its tables below a folder. A stage is skipped if its output is there
and was made by the same kind of run from the same alignments, reference and mask with the same options and tree.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import platform
import resource
import tempfile
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fitch, intervals, parsimony, rates, reads, sites, thresholds
from ..operators.neighbours import TILE
from ..sources import external, readers, writers
from . import tree as trees


@dataclass(frozen=True)
class Options:
    mapq: int = 60
    low_mapq: int = 1
    continuity: bool = True
    continuity_run: int = 2
    indel_window: int = 1
    annotate: bool = False
    five_mer: bool = False
    cache: bool = True
    intervals: bool = False
    divergence: float | None = None
    tile: int = TILE
    max_depth: int = 0  # reads of a taxon that count at a position, the first to come; 0 for all

    def fingerprint(self, **given) -> str:
        own = {k: v for k, v in asdict(self).items() if k not in ("cache", "intervals", "divergence")} | given
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]


class Run:
    """Stages with timings and a summary in run_summary.json. ``inputs`` are the tables that the run reads, or digests of
    them; ``given`` is what decides on results beside these and the options."""

    def __init__(self, spark: SparkSession, out: str, options: Options, inputs: list, **given):
        self.spark, self.out, self.options, self.timings, self.resources = spark, out.rstrip("/"), options, {}, {}
        self.made_by = options.fingerprint(**given, inputs=[source_of(x) for x in inputs]) if options.cache else ""

    def stage(self, name: str, path: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is made once for the same inputs and options."""
        at, mark = f"{self.out}/{path}", f"{self.out}/{path}.options"
        began, cpu = time.time(), _driver()[0]
        if not (self.options.cache and writers.exists(self.spark, mark) and writers.read_text(self.spark, mark) == self.made_by):
            make().write.mode("overwrite").parquet(at)
            writers.write_text(self.spark, mark, self.made_by)
        self.timings[name] = round(time.time() - began, 3)
        now, peak, heap = _driver(self.spark)
        self.resources[name] = {"driver_python_cpu_s": round(now - cpu, 3), "driver_python_peak_mb": peak, "driver_heap_mb": heap}
        return self.spark.read.parquet(at)

    def finish(self, **sections) -> dict:
        return writers.merge_summary(self.spark, f"{self.out}/run_summary.json", sections | {"parameters": asdict(self.options), "timings": self.timings, "resources": self.resources, "versions": self.versions()})

    def versions(self) -> dict:
        """Of Spark, Python and what programs are there."""
        return {"spark": self.spark.version, "python": platform.python_version()} | external.versions(external.VERSIONS)


def _driver(spark: SparkSession | None = None) -> tuple[float, int, int]:
    """CPU seconds and peak MB of the driver's Python, and the MB that its JVM's heap holds; executors' are in Spark's own
    listeners."""
    used = resource.getrusage(resource.RUSAGE_SELF)
    vm = spark._jvm.java.lang.Runtime.getRuntime() if spark else None
    return used.ru_utime + used.ru_stime, used.ru_maxrss >> 10, (vm.totalMemory() - vm.freeMemory()) >> 20 if vm else 0


def source_of(table) -> str | None:
    """What tells tables apart: the names, sizes and times of the files if one is read as it is, or else all of its rows,
    whatever their order. Texts (digests) and expressions tell themselves apart."""
    if not isinstance(table, DataFrame):
        return None if table is None else str(table)
    bare = table._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"
    if bare and (files := table.inputFiles()):
        return f"{files_digest(table.sparkSession, files)} {sorted(table.columns)}"
    cols = [F.col(f"`{c}`") for c, kind in table.dtypes if "map<" not in kind]
    n, total = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return f"{n} {total}"


def files_digest(spark: SparkSession, paths: list[str]) -> str:
    """Of files' and folders' names, sizes and times of change."""
    own = hashlib.sha256()
    for path in sorted(paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in sorted(fs.listStatus(p), key=lambda s: str(s.getPath())):
            own.update(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}\n".encode())
    return own.hexdigest()[:24]


def _kept(alignments: DataFrame, o: Options) -> DataFrame:
    if o.annotate:
        return reads.neighbour_mapq(alignments, o.low_mapq, o.tile)
    return reads.continuity_filter(alignments, o.low_mapq, o.mapq, o.continuity_run, o.tile) if o.continuity else reads.mapq_filter(alignments, o.mapq)


def _counts(df: DataFrame, key: str) -> dict:
    return {r[key]: r["n"] for r in df.collect()}  # a handful of classes


def _scan(run: Run, alignments: DataFrame, reference, taxa: list[int], mask: DataFrame | None) -> DataFrame:
    o = run.options
    kept = run.stage("align", "alignments", lambda: _kept(alignments, o))
    if o.intervals:
        writers.read_intervals(kept.select(F.col("rname").alias("chrom"), F.col("start0").alias("start"), F.col("end0").alias("end")), f"{run.out}/Intervals")
    reach = max(2, o.indel_window)
    return run.stage("scan", "scan", lambda: sites.scan(sites.tiled_lines(kept, taxa, reference, mask, reach, o.tile, o.max_depth), taxa, None, o.indel_window, o.tile))


def run_trio(spark: SparkSession, alignments: DataFrame, reference, out: str, options: Options = Options(), mask: DataFrame | None = None, source: str | None = None) -> dict:
    """Two sister taxa against an outgroup: 96 classes a branch. Returns the summary. ``source``: a digest of what the
    alignments were made of; their rows are read for one where it is not given."""
    if options.annotate:
        return run_annotated(spark, alignments, reference, out, options, mask, [1, 2], source)
    run = Run(spark, out, options, [source or alignments, reference, mask], kind="trio")
    scanned = _scan(run, alignments, reference, [1, 2], mask)
    windows = sites.contexts(scanned, [1, 2])
    classified = run.stage("classify", "windows", lambda: sites.classify_trio(windows.where("not near")))
    muts = sites.spectrum(classified)
    trips = sites.triplets(classified).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("taxon"), "triplet", "n")
    writers.calls_csv(sites.trio_calls(classified), f"{run.out}/Mutations")
    table = rates.normalize(muts, trips, ["taxon"])
    for value in ("n", "rate", "scaled", "scaled_raw"):
        writers.table_tsv(rates.wide_table(table, "mutation", "taxon", value, [1, 2]), "mutation", f"{run.out}/Tables/{value}.tsv")
    near = sites.classify_trio(windows.where("near"))
    for taxon in (1, 2):
        own = muts.where(F.col("taxon") == taxon).select("mutation", "n")
        writers.counts_json(own, "mutation", f"{run.out}/Counts/taxon{taxon}_mutations.json")
        writers.counts_json(trips.where(F.col("taxon") == taxon).select("triplet", "n"), "triplet", f"{run.out}/Counts/taxon{taxon}_triplets.json")
    if options.indel_window > 1:
        writers.write_text(spark, f"{run.out}/Counts/near_indel.json", json.dumps({str(r["taxon"]) + " " + r["mutation"]: r["n"] for r in sites.spectrum(near).collect()}, indent=1, sort_keys=True))
    extra = {}
    if options.five_mer:
        five = sites.five_mers(scanned, [1, 2], options.tile)
        five_counts = run.stage("five_mers", "five_mers", lambda: sites.five_mer_spectrum(five))
        run.stage("five_mer_opportunity", "five_mer_opportunity", lambda: sites.five_mer_opportunity(five))
        extra["five_mer_mutations"] = five_counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    per = rates.mutations_per_triplet(muts, trips, ["taxon"], options.divergence)
    if options.divergence is not None:
        extra["mutations_per_year"] = {str(r["taxon"]): r["per_year"] for r in per.collect()}
    return run.finish(
        site_classes=_counts(sites.site_classes(classified), "site_class"), dropped=_counts(sites.drop_reasons(scanned), "reason"), near_indel=_counts(sites.site_classes(near), "site_class"),
        reference_differences=_counts(sites.ref_differences(classified), "mutation"), lines_after_mask=scanned.count(), non_consecutive=scanned.where("gap").count(),
        mutations_per_triplet={str(r["taxon"]): r["ratio"] for r in per.collect()}, **extra,
    )


def run_pair(spark: SparkSession, alignments: DataFrame, reference, out: str, options: Options = Options(), mask: DataFrame | None = None, source: str | None = None) -> dict:
    """One target against a reference: 52 classes without direction."""
    if options.annotate:
        return run_annotated(spark, alignments, reference, out, options, mask, [1], source)
    run = Run(spark, out, options, [source or alignments, reference, mask], kind="pair")
    scanned = _scan(run, alignments, reference, [1], mask)
    windows = sites.contexts(scanned, [1])
    classified = run.stage("classify", "windows", lambda: sites.classify_pair(windows.where("not near")))
    writers.calls_csv(sites.pair_calls(classified), f"{run.out}/Mutations")
    table = rates.normalize_pair(sites.pair_spectrum(classified), sites.pair_triplets(classified))
    writers.table_tsv(table, "mutation", f"{run.out}/Tables/normalized.tsv")
    writers.counts_json(sites.pair_spectrum(classified), "mutation", f"{run.out}/Counts/mutations.json")
    writers.counts_json(sites.pair_triplets(classified), "triplet", f"{run.out}/Counts/triplets.json")
    return run.finish(site_classes=_counts(sites.site_classes(classified), "site_class"), dropped=_counts(sites.drop_reasons(scanned), "reason"), lines_after_mask=scanned.count(), non_consecutive=scanned.where("gap").count())


def run_annotated(spark: SparkSession, alignments: DataFrame, reference, out: str, options: Options, mask: DataFrame | None, taxa: list[int], source: str | None = None) -> dict:
    """Counts and calls for all thresholds at once, in site_counts and annotated_calls."""
    if options.continuity_run != 2:
        raise ValueError("an annotated run knows neighbours only: the run must be 2")
    run = Run(spark, out, options, [source or alignments, reference, mask], kind="annotated", taxa=len(taxa))
    kept = run.stage("align", "alignments", lambda: _kept(alignments, options))
    reach = max(2, options.indel_window)
    table = reference if isinstance(reference, DataFrame) else None
    own = lambda: thresholds.annotated(sites.dealt_positions(kept, table, mask, ["taxon", "mapq", "zn"], reach, max(options.tile, 2 * reach + 1)))
    windows = run.stage("scan", "windows", lambda: thresholds.scan(own(), reference, taxa, None, options.indel_window, options.tile))
    counts = run.stage("counts", "site_counts", lambda: thresholds.site_counts(windows))
    calls = run.stage("calls", "annotated_calls", lambda: thresholds.calls(windows))
    indel = options.indel_window > 1
    writers.site_counts(counts, f"{run.out}/Counts/site_counts", indel)
    writers.annotated_calls(calls, f"{run.out}/Counts/annotated_calls", indel)
    return run.finish(annotated={"taxa": len(taxa), "keys": counts.count()})


def derive_run(spark: SparkSession, run_dir: str, out: str, mapq: int, continuity: bool, indel: bool = False) -> dict:
    """A normal run's tables at one threshold, from an annotated run."""
    text = writers.read_text(spark, f"{run_dir.rstrip('/')}/run_summary.json")
    made = json.loads(text) if text else {}
    params = made.get("parameters", {})
    if not params.get("annotate"):
        raise ValueError(f"{run_dir} is no annotated run")
    if mapq < params["low_mapq"]:
        raise ValueError(f"reads below {params['low_mapq']} were not kept")
    if indel and params["indel_window"] < 2:
        raise ValueError("the run has no indel flags: its indel window is 1")
    counts = spark.read.parquet(f"{run_dir.rstrip('/')}/site_counts")
    pair = made["annotated"]["taxa"] == 1
    parts = (thresholds.derive_pair if pair else thresholds.derive)(counts, mapq, continuity, indel)
    out = out.rstrip("/")
    if pair:
        table = rates.normalize_pair(parts["mut"], parts["trip"])
    else:
        trips = parts["trip"].select(F.explode(F.array(F.lit(1), F.lit(2))).alias("taxon"), "triplet", "n")
        table = rates.normalize(parts["mut"], trips, ["taxon"])
    writers.table_tsv(table, "mutation", f"{out}/Tables/normalized.tsv")
    writers.calls_csv(thresholds.derive_calls(spark.read.parquet(f"{run_dir.rstrip('/')}/annotated_calls"), mapq, continuity, indel, pair), f"{out}/Mutations")
    writers.counts_json(parts["trip"], "triplet", f"{out}/Counts/triplets.json")
    for taxon in (1,) if pair else (1, 2):
        own = parts["mut"] if pair else parts["mut"].where(F.col("taxon") == taxon)
        writers.counts_json(own.select("mutation", "n"), "mutation", f"{out}/Counts/taxon{taxon}_mutations.json")
    return writers.merge_summary(spark, f"{out}/run_summary.json", {"site_classes": _counts(parts["classes"], "site_class"), "derived": {"mapq": mapq, "continuity": continuity, "indel": indel}})


def run_multi(spark: SparkSession, alignments: DataFrame, reference, out: str, newick: str, outgroup: str, options: Options = Options(), mask: DataFrame | None = None, source: str | None = None) -> dict:
    """N species on a tree: mutations on each branch by parsimony. taxon k is the k-th leaf besides the outgroup."""
    run = Run(spark, out, options, [source or alignments, reference, mask], kind="multi", newick=newick, outgroup=outgroup)
    root = trees.parse_newick(newick)
    columns = trees.index_leaves(root, outgroup)
    taxa = list(range(1, len(columns)))
    kept = run.stage("align", "alignments", lambda: _kept(alignments, options))
    found = run.stage("scan", "sites", lambda: sites.matrix_sites(sites.tiled_lines(kept, taxa, reference, mask, 2, options.tile, options.max_depth), taxa))
    matrix = found.where("varies").withColumn("taxa", F.concat(F.array("ref"), "taxa"))
    resolved = run.stage("fitch", "fitch", lambda: fitch.resolve(matrix, trees.Flat.of(root, columns)))
    muts = fitch.branch_mutations(resolved)
    writers.branches(muts, f"{run.out}/Mutations")
    trips = found.groupBy(F.col("ref3").alias("triplet")).agg(F.count(F.lit(1)).alias("n"))
    writers.matrix_csv(matrix, len(columns), f"{run.out}/matching_bases")
    writers.counts_json(trips, "triplet", f"{run.out}/Counts/triplets.json")
    table = rates.normalize(fitch.branch_spectra(muts), trips, ["branch"], on=[])
    table.write.mode("overwrite").parquet(f"{run.out}/Tables")
    ambiguous = resolved.agg(F.coalesce(F.sum("ambiguous"), F.lit(0))).first()[0]
    return run.finish(sites=found.count(), variable=matrix.count(), ambiguous=ambiguous)


def run_phylip(spark: SparkSession, matrix: DataFrame, names: list[str], out: str, command: str, most: int = fitch.MOST_SITES) -> dict:
    """A parsimony search over at most ``most`` sites of a matrix (chrom, pos, taxa; the outgroup first): writes infile
    and the tree found, with names, and returns the summary."""
    out = out.rstrip("/")
    own = fitch.sample_sites(matrix.dropDuplicates(["chrom", "pos"]), most)
    writers.phylip_infile(fitch.phylip_blocks(own), f"{out}/infile")
    with tempfile.TemporaryDirectory() as folder:  # the program runs on the driver
        outfile, outtree = external.parsimony_search(writers.read_text(spark, f"{out}/infile"), command, folder)
    root = trees.from_phylip(outtree, outfile, {f"taxa{i}": n for i, n in enumerate(names)}, "taxa0")
    writers.write_text(spark, f"{out}/outtree", root.newick() + "\n")
    return writers.merge_summary(spark, f"{out}/run_summary.json", {"phylip": {"score": trees.parsimony_of(outfile), "tree": root.newick()}})


def search_tree(spark: SparkSession, matrix: DataFrame, names: list[str], out: str, newick: str | None = None, starts: int = 4, seed: int = 1) -> dict:
    """The most parsimonious tree that a search of all sites of a matrix (chrom, pos, taxa; the outgroup first) finds,
    without a program; with a tree given, its score, too, and how many times more changes it needs."""
    out = out.rstrip("/")
    sites_of = matrix.dropDuplicates(["chrom", "pos"])
    parsimony.site_patterns(sites_of).write.mode("overwrite").parquet(f"{out}/patterns")
    patterns = spark.read.parquet(f"{out}/patterns")
    constant = parsimony.constant_changes(sites_of).first().changes
    given = parsimony.from_newick(newick, names) if newick else None
    tree, score = parsimony.search(patterns, len(names), starts, seed, given)
    found = {"score": score + constant, "tree": parsimony.newick(tree, names), "patterns": patterns.count()}
    if given is not None:
        found["given_score"] = parsimony.score_trees(patterns, [given])[0] + constant
        found["ratio"] = found["given_score"] / found["score"] if found["score"] else 1.0
    writers.write_text(spark, f"{out}/outtree", found["tree"] + "\n")
    return writers.merge_summary(spark, f"{out}/run_summary.json", {"phylip": found})


def build_mask(spark: SparkSession, fasta: str, folder: str, program: str = "windowmasker", **options) -> DataFrame:
    """Merged intervals (chrom, start, end) that a masker finds in a FASTA file of the driver's; kept as BED in the
    folder, which executors must see too. ``options``: species, dust, cores and cache."""
    found = external.mask_genome(fasta, folder, program, **options)
    at = pathlib.Path(found).resolve().as_uri()
    rows = readers.windowmasker(spark, at) if program == "windowmasker" else readers.repeatmasker(spark, at)
    writers.bed(intervals.merge(rows, ["chrom"]), f"{at}.bed")
    return readers.bed(spark, f"{at}.bed")


def align_genome(contigs: DataFrame, command: str, species: str, taxon: int, mask: DataFrame | None = None, most_masked: float = 0.5, length: int = 150, step: int = 75, parts: int | None = None, **places) -> DataFrame:
    """Alignments of a genome's tiles against a reference, in the form that runs take: cut, masked, piped through an
    aligner a partition at a time. The genome: contigs (chrom, seq), or pieces of ``intervals.piece_size`` bases that
    overlap by a tile. ``places``: ref, refdir and cores of the command's template."""
    tiles = intervals.fragments_of(contigs, intervals.piece_size(step), length, step) if "start0" in contigs.columns else intervals.fragments(contigs, length, step)
    if mask is not None:
        tiles = intervals.unmasked_fragments(tiles, mask, most_masked)
    tiles = tiles.repartition(parts or int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "start")
    rows = readers.parse_sam(external.align(tiles, command, **places), species)
    return readers.fragment_order(rows).withColumn("taxon", F.lit(taxon)).drop("zn")


def align_genomes(spark: SparkSession, genomes: list[DataFrame], out: str, command: str, options: Options = Options(), names: list[str] | None = None, masks: list[DataFrame | None] | None = None, sources: list[str] | None = None, most_masked: float = 0.5, length: int = 150, step: int = 75, **places) -> tuple[DataFrame, str]:
    """Alignments of all genomes, kept in the run's folder, and the digest of what they were made of: the aligner's
    command and places, the tiles, each genome and its mask. The aligner starts only if that changed. ``masks``: repeats
    of each genome, which its tiles avoid; ``sources``: digests of the genomes where they are known."""
    names = names or [f"taxon{i}" for i in range(1, len(genomes) + 1)]
    masks = masks or [None] * len(genomes)
    own = {k: files_digest(spark, [v]) if k == "ref" and v and writers.exists(spark, v) else v for k, v in places.items()}
    # thresholds and windows do not touch what is aligned
    plain = Options(cache=options.cache)
    run = Run(spark, out, plain, [*(sources or genomes), *masks], command=command, names=names, places=own, tiles=[most_masked, length, step])

    def make() -> DataFrame:
        rows = None
        for i, (genome, name, mask) in enumerate(zip(genomes, names, masks), 1):
            one = align_genome(genome, command, name, i, mask, most_masked, length, step, **places)
            rows = one if rows is None else rows.unionByName(one)
        return rows

    return run.stage("aligned", "aligned", make), run.made_by


def run_genomes(spark: SparkSession, genomes: list[DataFrame], reference: DataFrame, out: str, command: str, options: Options = Options(), mask: DataFrame | None = None, names: list[str] | None = None, masks: list[DataFrame | None] | None = None, **more) -> dict:
    """From genomes (chrom, seq) to spectra: one genome against the reference makes a pair, two a trio. ``mask`` is the
    reference's, ``masks`` are the genomes' own. ``more``: see ``align_genomes``."""
    rows, source = align_genomes(spark, genomes, out, command, options, names, masks, **more)
    return (run_pair if len(genomes) == 1 else run_trio)(spark, rows, intervals.chunks(reference, 1000), out, options, mask, source or None)


def clean_up(spark: SparkSession, out: str, names: tuple[str, ...] = ("aligned", "alignments", "scan", "windows")) -> None:
    """Removes a run's intermediate tables."""
    for name in names:
        for path in (f"{out.rstrip('/')}/{name}", f"{out.rstrip('/')}/{name}.options"):
            writers.remove(spark, path)
