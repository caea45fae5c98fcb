"""Queries that write a file format and read it back, and those of scalar functions, tables of bases and trees."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import bases as B
from .operators import fitch, intervals, rates, sites, thresholds
from .plans import derived as D
from .plans import tree as T
from .queries import query
from .sources import bam, fasta, readers, writers


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
    path = f"{base.rstrip('/')}/helixframe-files-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if c in cols else c for c in df.columns))


# ---------------------------------------------------------------- sequences


@query("fasta_file", f"WITH c AS ({D.CONTIGS_SQL}) SELECT chrom, md5(seq) AS digest, length(seq) AS n FROM c WHERE length(seq) > 0")
def fasta_file(spark, sf):
    at = folder(spark)
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    D.contigs(spark, sf).where(F.length("seq") > 0).select(F.concat(F.lit(">"), "chrom", F.lit(" a description\n"), wrapped).alias("value")).write.text(at)
    return readers.fasta(spark, at).select("chrom", F.md5(F.col("seq").cast("binary")).alias("digest"), F.length("seq").cast("long").alias("n"))


def _fasta_folder(spark, sf, width: int = 60) -> str:
    """The derived contigs as FASTA, in their order."""
    at = folder(spark)
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})", "$1\n")
    D.contigs(spark, sf).orderBy("contig_ord").select(F.concat(F.lit(">"), "chrom", F.lit(" a description\n"), wrapped).alias("value")).write.text(at)
    return at


@query("fai_file", f"WITH c AS ({D.CONTIGS_SQL}) SELECT chrom, length(seq) AS length, row_number() OVER (ORDER BY contig_ord) AS place FROM c")
def fai_file(spark, sf):
    """An index made of the FASTA's bytes, in parallel."""
    return readers.places(fasta.index(spark, _fasta_folder(spark, sf)), "contig_ord").select("chrom", "length", "place")


@query("fasta_pieces", f"""WITH c AS ({D.CONTIGS_SQL}), s AS (SELECT chrom, seq, length(seq) AS length, unnest(range(0, length(seq), 1024)) AS start0 FROM c)
    SELECT chrom, length, start0, md5(substring(seq, start0 + 1, 1124)) AS digest FROM s""")
def fasta_pieces(spark, sf):
    """Pieces of 1,024 bases and 100 more, read by their bytes."""
    own = fasta.pieces(fasta.index(spark, _fasta_folder(spark, sf)), 1024, 100)
    return own.select("chrom", "length", "start0", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("fastq_file", Q.SQL["fragment_reads"])
def fastq_file(spark, sf):
    at = folder(spark)
    writers.fastq(intervals.fragments(D.contigs(spark, sf)), at)
    lines = F.split("value", "\n")
    own = spark.read.option("lineSep", "@").text(at).where(F.length("value") > 0).select(lines[0].alias("name"), lines[1].alias("seq"))
    chrom, start, end = B.read_span("name")
    return own.select(chrom.alias("chrom"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.md5(F.col("seq").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- reads and pileups


@query("sam_file", f"""WITH reads AS ({D.READS_SQL}) SELECT 'r' || CAST(ord AS VARCHAR) AS qname, flag, {D.chrom_sql()} AS rname, start0, start0 + 25 AS end0, mapq,
    25 - CASE WHEN ck % 40 = 3 THEN 2 ELSE 0 END + CASE WHEN ck % 37 = 5 THEN 1 ELSE 0 END AS bases, CASE WHEN ck % 3 = 0 THEN ck % 61 ELSE -1 END AS zn FROM reads WHERE mapq >= 30 AND flag = 0""")
def sam_file(spark, sf):
    at = folder(spark)
    writers.sam(D.alignments(spark, sf).withColumn("zn", F.expr("case when ck % 3 = 0 then ck % 61 else -1 end").cast("int")), at)
    own = readers.sam(spark, at).select("qname", "flag", "rname", "start0", "end0", "mapq", F.length("seq").alias("bases"), "zn")
    return _longs(own, "flag", "start0", "end0", "mapq", "bases", "zn")


def _bam_folder(spark, sf) -> tuple[str, DataFrame]:
    """The derived reads as sorted BAM files with indexes, and their contigs."""
    at = folder(spark)
    own = D.alignments(spark, sf).withColumn("zn", F.expr("case when ck % 3 = 0 then ck % 61 else -1 end").cast("int"))
    contigs = own.groupBy(F.col("rname").alias("chrom")).agg(F.max("end0").cast("long").alias("length"))
    bam.write_bam(own, at, contigs)
    return at, contigs


def _bam_rows(own: DataFrame) -> DataFrame:
    return _longs(own.select("qname", "flag", "rname", "start0", "end0", "mapq", F.length("seq").alias("bases"), "zn"), "flag", "start0", "end0", "mapq", "bases", "zn")


@query("bam_file", Q.SQL["sam_file"])
def bam_file(spark, sf):
    at, _ = _bam_folder(spark, sf)
    return _bam_rows(bam.bam(spark, at))


@query("bam_region", f"""WITH r AS ({Q.SQL["sam_file"]}), c AS (SELECT rname, max(end0) AS n FROM r GROUP BY rname)
    SELECT r.* FROM r JOIN c USING (rname) WHERE start0 < n - n // 3 AND end0 > n // 3""")
def bam_region(spark, sf):
    """The middle third of each contig, by index."""
    at, contigs = _bam_folder(spark, sf)
    header = [(r.chrom, r.length) for r in contigs.collect()]  # a row a contig
    parts = [bam.bam(spark, at, region=(chrom, n // 3, n - n // 3)) for chrom, n in header]
    return _bam_rows(functools.reduce(DataFrame.unionByName, parts))


@query("sam_pileup", Q.SQL["pileup_sites"])
def sam_pileup(spark, sf):
    """Alignments through SAM text, sorted and read by region, give the pileup of the alignments themselves."""
    at = folder(spark)
    for taxon in Q.TAXA:
        own = D.alignments(spark, sf).where(F.col("taxon") == taxon)
        writers.sam(own.withColumn("zn", F.lit(None).cast("int")), f"{at}/sam{taxon}")
    rows = [readers.sam(spark, f"{at}/sam{t}", f"taxon{t}").withColumn("taxon", F.lit(t)) for t in Q.TAXA]
    writers.sorted_alignments(rows[0].unionByName(rows[1]), f"{at}/sorted")
    own = spark.read.parquet(f"{at}/sorted").join(F.broadcast(readers.chroms_with_reads(rows[0]).withColumnRenamed("chrom", "rname")), "rname", "left_semi")  # a row a contig
    lines = sites.own_lines(sites.tiled_lines(own, Q.TAXA, D.reference(), None, 2, Q.TILE))
    return _longs(lines.select("chrom", "pos", "ref", "cov_1", "cov_2", "base_1", "base_2", (F.col("del_1") | F.col("del_2")).alias("del"), (F.col("ins_1") | F.col("ins_2")).alias("ins"), "dis_1", "dis_2"), "pos")


def _pileup_file(positions: DataFrame, taxa: list[int], at: str, annotated: bool = False) -> None:
    """Lines of depth, bases and qualities (and mapq and zn) of each sample. positions: chrom, pos, taxon, base,
    deleted, inserted, ord, mapq, zn, and _tile where reads were dealt before they were walked."""
    shown = F.when(F.col("deleted"), "*").when(F.col("base") == D.reference(), ".").otherwise(F.col("base"))
    token = F.concat(shown, F.when(F.col("inserted"), "+1A").otherwise(""))
    read = F.struct("ord", token.alias("t"), F.char(F.col("mapq") + 33).alias("q"), F.col("zn").cast("string").alias("z"))
    cols = [F.sort_array(F.collect_list(F.when(F.col("taxon") == t, read))).alias(f"r{t}") for t in taxa]
    rows = positions.groupBy("chrom", *(["_tile"] if "_tile" in positions.columns else []), "pos").agg(*cols)
    joined = lambda t, c, sep="": F.when(F.size(f"r{t}") > 0, F.array_join(F.transform(f"r{t}", lambda x: x[c]), sep)).otherwise("*")
    fields = ["chrom", F.col("pos").cast("string"), D.reference()]
    for t in taxa:
        fields += [F.size(f"r{t}").cast("string"), joined(t, "t"), F.when(F.size(f"r{t}") > 0, F.repeat(F.lit("I"), F.size(f"r{t}"))).otherwise("*")]
        fields += [joined(t, "q"), joined(t, "z", ",")] if annotated else []
    rows.select(F.concat_ws("\t", *fields).alias("value")).write.text(at)


def _dealt(alignments: DataFrame) -> DataFrame:
    """Positions of reads that are dealt by tile, so that reads are shuffled and not their positions."""
    return sites.dealt_positions(alignments, None, None, ["taxon", "ord", "mapq", "zn"], 0, Q.TILE)


@query("pileup_trio_file", Q.SQL["pileup_sites"])
def pileup_trio_file(spark, sf):
    at = folder(spark)
    _pileup_file(_dealt(D.alignments(spark, sf).withColumn("zn", F.lit(-1))), Q.TAXA, at)
    lines = readers.pileup_lines(readers.pileup(spark, at, 2), 2)
    return _longs(lines.select("chrom", "pos", "ref", "cov_1", "cov_2", "base_1", "base_2", (F.col("del_1") | F.col("del_2")).alias("del"), (F.col("ins_1") | F.col("ins_2")).alias("ins"), "dis_1", "dis_2"), "pos")


@query("pileup_pair_file", f"{Q.PAIR_LINES} SELECT chrom, pos, ref, cov_1, base_1, del_1, ins_1, dis_1 FROM lines")
def pileup_pair_file(spark, sf):
    at = folder(spark)
    _pileup_file(_dealt(D.alignments(spark, sf).where("taxon = 1").withColumn("zn", F.lit(-1))), [1], at)
    return _longs(readers.pileup_lines(readers.pileup(spark, at, 1), 1).select("chrom", "pos", "ref", "cov_1", "base_1", "del_1", "ins_1", "dis_1"), "pos")


@query("pileup_annotated_file", Q.SQL["annotated_site_intervals"])
def pileup_annotated_file(spark, sf):
    from .operators import reads

    at = folder(spark)
    kept = reads.neighbour_mapq(D.reads(spark, sf), tile=Q.TILE)
    own = D.with_bases(kept)
    _pileup_file(_dealt(own), Q.TAXA, at, annotated=True)
    rows = readers.annotated_reads(readers.pileup(spark, at, 2, annotated=True), 2)
    rows = rows.withColumn("base", F.when(F.col("base") == ".", F.col("ref")).otherwise(F.col("base")))
    out = thresholds.site_intervals(rows, ["taxon", "chrom", "pos"]).select("taxon", "chrom", "pos", "mode", "base", "lo", "hi", "indel")
    return _longs(out, "pos")


# ---------------------------------------------------------------- intervals


_SPANS = f"WITH {Q.SPANS} SELECT chrom, s AS start, e AS \"end\" FROM spans"


@query("bed_file", Q.SQL["mask_merge"])
def bed_file(spark, sf):
    at = folder(spark)
    writers.bed(Q._mask(spark, sf), at)
    return _longs(readers.bed(spark, at), "start", "end")


@query("repeatmasker_file", _SPANS)
def repeatmasker_file(spark, sf):
    at = folder(spark)
    line = F.concat_ws(" ", F.lit("  239 2.9 0.0 0.0"), "chrom", F.col("end").cast("string"), F.col("start").cast("string"), F.lit("(100) + name class 1 9 (0) 1"))  # ends swapped
    head = spark.createDataFrame([("SW perc perc perc query position in query matching repeat",), ("",)], "value string")
    D.repeat_spans(spark, sf).select(line.alias("value")).unionByName(head).write.text(at)
    return _longs(readers.repeatmasker(spark, at), "start", "end")


@query("windowmasker_file", _SPANS)
def windowmasker_file(spark, sf):
    at = folder(spark)
    line = F.concat_ws(" - ", (F.col("start") - 1).cast("string"), (F.col("end") - 1).cast("string"))
    part = F.floor(F.col("start") / Q.TILE)  # a contig has several records here, each of a tile's intervals
    own = D.repeat_spans(spark, sf).groupBy("chrom", part.alias("part")).agg(F.collect_list(line).alias("lines"))
    own.select(F.concat(F.lit(">"), "chrom", F.lit(" x\n"), F.array_join("lines", "\n")).alias("value")).write.text(at)
    return _longs(readers.windowmasker(spark, at), "start", "end")


@query("read_intervals_file", f"WITH reads AS ({D.READS_SQL}) SELECT {D.chrom_sql()} AS chrom, start0 AS start, start0 + 25 AS \"end\", count(*) AS n FROM reads WHERE mapq >= 30 AND flag = 0 GROUP BY ALL")
def read_intervals_file(spark, sf):
    at = folder(spark)
    writers.read_intervals(D.alignments(spark, sf).select(F.col("rname").alias("chrom"), F.col("start0").alias("start"), F.col("end0").alias("end")), at)
    own = readers.read_intervals(spark, at)
    return _longs(own.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n")), "start", "end")


# ---------------------------------------------------------------- counts, calls and tables


@query("counts_json_file", f"{Q.TRIO}, {Q.TRIPS} SELECT triplet AS label, CAST(n AS DOUBLE) AS n FROM trips")
def counts_json_file(spark, sf):
    at = f"{folder(spark)}/triplets.json"
    writers.counts_json(sites.triplets(Q._trio(spark, sf)), "triplet", at)
    return readers.counts_json(spark, at)


@query("spectra_tsv_file", Q.SQL["spectra_table"])
def spectra_tsv_file(spark, sf):
    at = f"{folder(spark)}/spectra.tsv"
    writers.table_tsv(Q.spectra_table(spark, sf), "mutation", at)
    return spark.read.option("sep", "\t").option("header", True).schema("mutation string, `1` long, `2` long").csv(at)


@query("calls_csv_file", Q.SQL["trio_calls"])
def calls_csv_file(spark, sf):
    at = folder(spark)
    fai = spark.createDataFrame([("chrC", 0), ("chrA", 1), ("chrB", 2)], "chrom string, contig_ord int")
    writers.calls_csv(sites.trio_calls(Q._trio(spark, sf)), at, fai)
    own = spark.read.option("header", True).csv(at).withColumnsRenamed({"chromosome": "chrom", "position": "pos"})
    return _longs(own.withColumn("taxon", F.col("taxon").cast("int")), "pos")


@query("site_counts_file", Q.SQL["annotated_site_counts"])
def site_counts_file(spark, sf):
    at = folder(spark)
    writers.site_counts(thresholds.site_counts(Q._windows(spark, sf)), at, indel=False)
    return readers.site_counts(spark, at).drop("indel_mapq")


@query("annotated_calls_file", Q.SQL["annotated_calls"])
def annotated_calls_file(spark, sf):
    at = folder(spark)
    writers.annotated_calls(thresholds.calls(Q._windows(spark, sf, mask=Q._mask(spark, sf))), at, indel=False)
    return _longs(readers.annotated_calls(spark, at).drop("indel_mapq").withColumn("taxon", F.col("taxon").cast("int")), "pos")


@query("matrix_csv_file", Q.SQL["multi_matching_bases"])
def matrix_csv_file(spark, sf):
    at = folder(spark)
    own = sites.matrix_sites(Q._tiled(spark, sf), Q.TAXA).where("varies").withColumn("taxa", F.concat(F.array("ref"), "taxa"))
    writers.matrix_csv(own, 3, at)
    own = readers.matrix(spark, at, 3)
    return _longs(own.select("chrom", "pos", "left", "right", *(F.col("taxa")[i].alias(f"taxa{i}") for i in range(3))), "pos")


@query("branch_files", Q.SQL["branch_spectra"])
def branch_files(spark, sf):
    at = folder(spark)
    writers.branches(fitch.branch_mutations(fitch.resolve(D.matrix(spark, sf), Q._tree())), at, header=False)
    own = spark.read.option("sep", "\t").schema("chrom string, pos long, mutation string, branch string").csv(at)
    return own.groupBy("branch", "mutation").agg(F.count(F.lit(1)).alias("n"))


@query("phylip_infile", Q.SQL["phylip_matrix"])
def phylip_infile(spark, sf):
    at = f"{folder(spark)}/infile"
    writers.phylip_infile(fitch.phylip_blocks(D.matrix(spark, sf).dropDuplicates(["chrom", "pos"])), at)
    line, name = F.substring("value", 11, 1 << 30), F.substring("value", 1, 10)
    own = spark.read.text(at).where(F.col("value").startswith("taxa"))
    return own.select(F.regexp_extract(name, r"^taxa(\d+)", 1).cast("int").alias("taxon"), F.md5(line.cast("binary")).alias("digest"), F.length(line).cast("long").alias("n"))


# ---------------------------------------------------------------- functions of fields and labels

_FIELDS = ["", "a", ".,", "Tt.", "ACg", ",", "gg", "*"]
_PICK = "[" + ", ".join(f"'{x}'" for x in _FIELDS) + "]"
_FIELD_SQL = f"""WITH o AS (SELECT o_orderkey AS k, {_PICK}[CAST(o_orderkey % 8 + 1 AS INTEGER)] AS field, {D.letter_sql('o_custkey % 4')} AS ref, o_orderkey % 60 AS q FROM orders),
  p AS (SELECT *, CASE WHEN field = '' THEN '' WHEN field[1] IN ('.', ',') THEN ref ELSE upper(field[1]) END AS b FROM o)"""


@query("sample_bases", f"""{_FIELD_SQL} SELECT k, CASE WHEN b = '' THEN 'N' ELSE b END AS base, CASE WHEN b = '' THEN ref ELSE b END AS base_or_ref, field IN ('a', '.,', ',', 'gg', '*') AS same,
  q AS quality, strpos('ACGT', ref) - 1 AS code FROM p""")
def sample_bases(spark, sf):
    pick = F.element_at(F.array(*map(F.lit, _FIELDS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    own = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), pick.alias("field"), F.expr(D.letter_sql("o_custkey % 4")).alias("ref"), F.char(F.col("o_orderkey") % 60 + 33).alias("q"))
    out = own.select("k", B.sample_base("field", "ref").alias("base"), B.sample_base("field", "ref", "ref").alias("base_or_ref"), B.all_same("field").alias("same"), B.phred("q").alias("quality"), B.base_code("ref").alias("code"))
    return _longs(out, "quality", "code")


@query("trio_spectrum_with_table", Q.SQL["trio_spectrum"])
def trio_spectrum_with_table(spark, sf):
    """The reference as a table of pieces, dealt with the reads, in place of an expression."""
    size, number = 500, D.number_of()
    reach = D.reads(spark, sf).groupBy("chrom").agg((F.max("end0") + 1).alias("n"))
    starts = reach.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"), F.lit(size).cast("long"))).alias("start0"))
    base = D.letter_sql(f"{D.h(f'{number} * 1000003 + start0 + j', 1)} % 4")
    pieces = starts.withColumn("seq", F.expr(f"array_join(transform(sequence(1, {size}), j -> {base}), '')"))
    lines = sites.tiled_lines(D.alignments(spark, sf), Q.TAXA, pieces, None, 2, Q.TILE)
    return sites.spectrum(sites.classify_trio(sites.contexts(sites.scan(lines, Q.TAXA, None, 1, Q.TILE, gaps=False), Q.TAXA)))


@query("branch_rates", f"""{Q._down()}, muts AS (SELECT branch AS taxon, mutation FROM rows), trips AS (SELECT lft || taxa0 || rgt AS triplet, count(*) AS n FROM m GROUP BY 1), {Q.M96}, {Q.T32},
  rate AS (SELECT taxon, mutation, n, CAST(coalesce(o, 0) AS BIGINT) AS opportunity, coalesce(n / nullif(o, 0), 0) AS rate FROM m96 LEFT JOIN t32 ON triplet = mutation[1] || mutation[3] || mutation[7])
  SELECT taxon AS branch, mutation, n, opportunity, round(rate, 9) AS rate FROM rate""")
def branch_rates(spark, sf):
    """Branches share one denominator."""
    matrix = D.matrix(spark, sf)
    trips = matrix.groupBy(F.concat("left", F.col("taxa")[0], "right").alias("triplet")).agg(F.count(F.lit(1)).alias("n"))
    own = rates.normalize(fitch.branch_spectra(fitch.branch_mutations(fitch.resolve(matrix, Q._tree()))), trips, ["branch"], on=[])
    return own.select("branch", "mutation", "n", "opportunity", F.round("rate", 9).alias("rate"))


@query("derive_away_from_indels", f"""{Q._awin()}, near AS (SELECT al.*, greatest(0, coalesce((SELECT max(s.indel) FROM si s WHERE s.chrom = al.chrom AND s.mode = al.mode AND s.pos BETWEEN al.pos - 3 AND al.pos + 3), 0)) AS indel_mapq FROM al)
  SELECT CASE site_class WHEN 'taxa1_mut' THEN 1 ELSE 2 END AS taxon, label AS mutation, count(*) AS n FROM near WHERE mode = 0 AND 30 BETWEEN lo AND hi AND indel_mapq < 30 AND site_class IN ('taxa1_mut', 'taxa2_mut') GROUP BY ALL""")
def derive_away_from_indels(spark, sf):
    return thresholds.derive(thresholds.site_counts(Q._windows(spark, sf, indel_window=3)), 30, False, True)["mut"]


# at one threshold a pair's windows are three positions whose reads above it agree
_PAIR_AT = f"""{Q.AREADS}, kept AS (SELECT cn, chrom, pos, min(base) AS base FROM q WHERE taxon = 1 AND mode = 1 AND q.q >= 30 GROUP BY cn, chrom, pos HAVING count(DISTINCT base) = 1 AND NOT bool_or(rejects)),
  win AS (SELECT m.chrom, m.pos, {D.letter_sql(f"{D.h('m.cn * 1000003 + m.pos - 1', 1)} % 4")} || {D.letter_sql(f"{D.h('m.cn * 1000003 + m.pos', 1)} % 4")} || {D.letter_sql(f"{D.h('m.cn * 1000003 + m.pos + 1', 1)} % 4")} AS ref3, a.base || m.base || b.base AS t1_3
    FROM kept m JOIN kept a ON a.chrom = m.chrom AND a.pos = m.pos - 1 JOIN kept b ON b.chrom = m.chrom AND b.pos = m.pos + 1), {Q.CLASS_PAIR}, {Q.FOLD}"""


@query("derive_pair_at_mapq", f"{_PAIR_AT} SELECT mutation, count(*) AS n FROM cls JOIN fold ON old3 = ref3 AND new3 = t1_3 WHERE site_class = 'differs' GROUP BY mutation")
def derive_pair_at_mapq(spark, sf):
    return thresholds.derive_pair(thresholds.site_counts(Q._windows(spark, sf, [1])), 30, True)["mut"]


# ---------------------------------------------------------------- trees

_OUTTREE = "2\n((taxa1,taxa2),\n((taxa3,taxa4),taxa0));"
_OUTFILE = "requires a total of     12.000\n\n  between      and       length\n  -------      ---       ------\n     1          2         0.1\n     2        taxa1       0.1\n     2        taxa2       0.1\n     1          3         0.1\n     3        taxa3       0.1\n     3        taxa4       0.1\n     1        taxa0       0.1\n\n"


_SAME = {"n5": range(5), "n4": range(1, 5), "n12": (1, 2), "n34": (3, 4)}
_NODES = [("ROOT", None, -1, "n5"), ("1", "ROOT", -1, "n4"), ("2", "1", -1, "n12"), ("sp1", "2", 1, "n"), ("sp2", "2", 2, "n"), ("3", "1", -1, "n34"), ("sp3", "3", 3, "n"), ("sp4", "3", 4, "n"), ("outg", "ROOT", 0, "n")]
_NODES_SQL = ", ".join(f"('{a}', {'NULL' if p is None else repr(p)}, {leaf}, '{n}')" for a, p, leaf, n in _NODES)


@query("phylip_tree_nodes", f"""WITH m AS ({D.MATRIX_SQL}), c AS (SELECT count(*) AS n, {', '.join(f"count(*) FILTER (WHERE {' AND '.join(f'taxa{a} = taxa{b}' for a, b in zip(k, k[1:]))}) AS {n}" for n, k in _SAME.items())} FROM m),
    u AS (UNPIVOT c ON n, n5, n4, n12, n34 INTO NAME which VALUE same)
    SELECT label, parent, leaf, same FROM (VALUES {_NODES_SQL}) t(label, parent, leaf, which) JOIN u USING (which)""")
def phylip_tree_nodes(spark, sf):
    """A search's tree with species' names, rooted on the outgroup, inner nodes named by the search's own table; ``same``
    counts the matrix' sites at which all species below a node have one base."""
    names = {f"taxa{i}": f"sp{i}" for i in range(1, 5)} | {"taxa0": "outg"}
    root = T.from_phylip(_OUTTREE, _OUTFILE, names, "taxa0")
    flat = T.Flat.of(root, T.index_leaves(root, "outg"))
    below = [{flat.column[i]} if flat.column[i] >= 0 else set() for i in range(len(flat.parent))]
    for i in sorted(range(len(flat.parent)), key=lambda i: -_depth(flat.parent, i)):
        if flat.parent[i] >= 0:
            below[flat.parent[i]] |= below[i]
    same = [F.count(F.when(F.size(F.array_distinct(F.array(*(F.col("taxa")[k] for k in sorted(b))))) == 1, 1)).alias(f"n{i}") for i, b in enumerate(below)]
    nodes = [F.struct(F.lit(flat.label[i]).alias("label"), F.lit(flat.label[p] if p >= 0 else None).cast("string").alias("parent"), F.lit(flat.column[i]).alias("leaf"), F.col(f"n{i}").alias("same")) for i, p in enumerate(flat.parent)]
    return D.matrix(spark, sf).agg(*same).select(F.inline(F.array(*nodes)))


def _depth(parent: list[int], i: int) -> int:
    return 0 if parent[i] < 0 else 1 + _depth(parent, parent[i])
