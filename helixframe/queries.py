"""A query for each operator over the derived views, and the same result in SQL, written in another form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bases as B
from .operators import fitch, intervals, parsimony, rates, reads, sites, thresholds
from .plans import derived as D
from .plans.tree import Flat, index_leaves, parse_newick

TAXA = [1, 2]
TILE = 1 << 14  # small, so that these tables have many tiles
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL parts

READS = f"WITH reads AS ({D.READS_SQL}), read_bases AS MATERIALIZED ({D.READ_BASES_SQL}), one AS MATERIALIZED ({D.ONE_SQL}), s0 AS MATERIALIZED ({D.SITES_SQL})"
QC_TRIO = "CASE WHEN (cov_1 AND del_1) OR (cov_2 AND del_2) THEN 'deletion' WHEN (cov_1 AND NOT del_1 AND ins_1) OR (cov_2 AND NOT del_2 AND ins_2) THEN 'insertion' WHEN NOT (cov_1 AND cov_2) THEN 'no_depth' WHEN dis_1 OR dis_2 THEN 'reads_disagree' END"
QC_PAIR = "CASE WHEN del_1 THEN 'deletion' WHEN ins_1 THEN 'insertion' WHEN dis_1 THEN 'reads_disagree' END"
LINES = f"{READS}, lines AS MATERIALIZED (SELECT *, cn * 10000000000 + pos AS k, {QC_TRIO} AS qc FROM s0)"
PAIR_LINES = f"{READS}, lines AS MATERIALIZED (SELECT *, cn * 10000000000 + pos AS k, {QC_PAIR} AS qc FROM s0 WHERE cov_1)"
SPANS = f"spans AS ({D.SPANS_SQL}), hidden AS MATERIALIZED (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS pos FROM spans)"
# merged with events of a sweep: where more intervals have begun than ended a group goes on
MERGED = """marks AS (SELECT chrom, s AS p, 1 AS d FROM spans UNION ALL SELECT chrom, e + 1 AS p, -1 AS d FROM spans),
  sweep AS (SELECT chrom, p, sum(d) AS d FROM marks GROUP BY chrom, p),
  depth AS (SELECT chrom, p, sum(d) OVER (PARTITION BY chrom ORDER BY p) AS n, lag(p) OVER (PARTITION BY chrom ORDER BY p) AS before, sum(d) OVER (PARTITION BY chrom ORDER BY p) - d AS prev FROM sweep),
  opens AS (SELECT chrom, p, row_number() OVER (PARTITION BY chrom ORDER BY p) AS k FROM depth WHERE prev = 0 AND n > 0),
  ends AS (SELECT chrom, p - 1 AS p, row_number() OVER (PARTITION BY chrom ORDER BY p) AS k FROM depth WHERE prev > 0 AND n = 0),
  mask AS (SELECT o.chrom, o.p AS s, e.p AS e FROM opens o JOIN ends e ON o.chrom = e.chrom AND o.k = e.k)"""
CONTEXT = """win AS MATERIALIZED (SELECT m.chrom, m.pos, a.ref || m.ref || b.ref AS ref3, a.base_1 || m.base_1 || b.base_1 AS t1_3, a.base_2 || m.base_2 || b.base_2 AS t2_3
  FROM lines m JOIN lines a ON a.k = m.k - 1 JOIN lines b ON b.k = m.k + 1 WHERE m.qc IS NULL AND a.qc IS NULL AND b.qc IS NULL)"""
PAIR_CONTEXT = CONTEXT.replace(", a.base_2 || m.base_2 || b.base_2 AS t2_3", "")
FLANKS = "ref3[1] = t1_3[1] AND ref3[3] = t1_3[3]"
CLASS_TRIO = f"""cls AS (SELECT *, CASE WHEN NOT regexp_full_match(ref3 || t1_3 || t2_3, '[ACGT]+') THEN 'not_acgt'
  WHEN NOT ({FLANKS} AND ref3[1] = t2_3[1] AND ref3[3] = t2_3[3]) THEN 'flanks_not_conserved'
  WHEN ref3[2] <> t1_3[2] AND ref3[2] = t2_3[2] THEN 'taxa1_mut' WHEN ref3[2] = t1_3[2] AND ref3[2] <> t2_3[2] THEN 'taxa2_mut'
  WHEN ref3[2] = t1_3[2] THEN 'identical' WHEN t1_3[2] = t2_3[2] THEN 'ref_differs' ELSE 'all_differ' END AS site_class FROM win)"""
CLASS_PAIR = f"""cls AS (SELECT *, CASE WHEN NOT regexp_full_match(ref3 || t1_3, '[ACGT]+') THEN 'not_acgt' WHEN NOT ({FLANKS}) THEN 'flanks_not_conserved'
  WHEN ref3[2] = t1_3[2] THEN 'identical' ELSE 'differs' END AS site_class FROM win)"""
TRIO = f"{LINES}, {CONTEXT}, {CLASS_TRIO}"
PAIR = f"{PAIR_LINES}, {PAIR_CONTEXT}, {CLASS_PAIR}"
MUT = "muts AS (SELECT CASE site_class WHEN 'taxa1_mut' THEN 1 ELSE 2 END AS taxon, ref3[1] || '[' || ref3[2] || '>' || CASE site_class WHEN 'taxa1_mut' THEN t1_3[2] ELSE t2_3[2] END || ']' || ref3[3] AS mutation, chrom, pos, ref3 FROM cls WHERE site_class IN ('taxa1_mut', 'taxa2_mut'))"
COMP = "translate({}, 'ACGT', 'TGCA')"


def rc_sql(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


# the 52 classes as a table that is made from all pairs of 3-mers, by another road: the two strands' forms are written
# side by side and one is chosen
FOLD = f"""b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), forms AS (
  SELECT l.x || o.x || r.x AS old3, l.x || n.x || r.x AS new3, least(o.x, n.x) || greatest(o.x, n.x) AS mid,
    l.x AS l, r.x AS r, {COMP.format('r.x')} AS cl, {COMP.format('l.x')} AS cr FROM b l, b o, b n, b r WHERE o.x <> n.x),
  fold AS (SELECT old3, new3, CASE mid
    WHEN 'AC' THEN l || '[C-A]' || r WHEN 'GT' THEN cl || '[C-A]' || cr
    WHEN 'CT' THEN l || '[C-T]' || r WHEN 'AG' THEN cl || '[C-T]' || cr
    WHEN 'CG' THEN CASE WHEN l || r <= cl || cr THEN l || '[C-G]' || r ELSE cl || '[C-G]' || cr END
    WHEN 'AT' THEN CASE WHEN l || r <= cl || cr THEN l || '[T-A]' || r ELSE cl || '[T-A]' || cr END END AS mutation FROM forms)"""


# ---------------------------------------------------------------- engine parts


def _tiled(spark, sf, taxa=TAXA, mask=None, reach=2) -> DataFrame:
    return sites.tiled_lines(D.alignments(spark, sf).where(F.col("taxon").isin(taxa)), taxa, D.reference(), mask, reach, TILE)


def _lines(spark, sf, taxa=TAXA) -> DataFrame:
    return sites.own_lines(_tiled(spark, sf, taxa))


def _scan(spark, sf, taxa=TAXA, mask=None, indel_window=1, gaps=False, halo=False) -> DataFrame:
    return sites.scan(_tiled(spark, sf, taxa, mask, max(2, indel_window)), taxa, None, indel_window, TILE, gaps, halo)


def _trio(spark, sf, mask=None, indel_window=1) -> DataFrame:
    return sites.classify_trio(sites.contexts(_scan(spark, sf, TAXA, mask, indel_window), TAXA).where("not near"))


def _pair(spark, sf) -> DataFrame:
    return sites.classify_pair(sites.contexts(_scan(spark, sf, [1]), [1]))


def _mask(spark, sf) -> DataFrame:
    return intervals.merge(D.repeat_spans(spark, sf), ["chrom"], tile=TILE)


def _as(df: DataFrame, **kinds: str) -> DataFrame:
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in df.columns))


# ---------------------------------------------------------------- sequences


@query("reverse_complement", f"WITH c AS ({D.CONTIGS_SQL}) SELECT chrom, md5({rc_sql('seq')}) AS digest, length(seq) AS n FROM c")
def reverse_complement(spark, sf):
    return D.contigs(spark, sf).select("chrom", F.md5(B.reverse_complement("seq").cast("binary")).alias("digest"), F.length("seq").cast("long").alias("n"))


@query("fold_52", f"WITH {FOLD} SELECT mutation, count(*) AS n FROM fold, (SELECT DISTINCT n_regionkey FROM nation) GROUP BY mutation")
def fold_52(spark, sf):
    bases = lambda c: F.explode(F.array(*map(F.lit, "ACGT"))).alias(c)
    own = D.table(spark, sf, "nation").select("n_regionkey").distinct()
    for c in "lonr":
        own = own.select("*", bases(c))  # 256 rows a region
    return own.where("o <> n").groupBy(B.fold(F.concat("l", "o", "r"), F.concat("l", "n", "r")).alias("mutation")).agg(F.count(F.lit(1)).alias("n"))


_FRAGMENTS = f"""c AS ({D.CONTIGS_SQL}), starts AS (SELECT chrom, seq, unnest(range(0, length(seq) - 149, 75)) AS s FROM c WHERE length(seq) >= 150
  UNION SELECT chrom, seq, length(seq) - 150 AS s FROM c WHERE length(seq) >= 150), frags AS MATERIALIZED (SELECT chrom, s + 1 AS start, s + 150 AS end_, substring(seq, s + 1, 150) AS seq FROM starts)"""


@query("fragment_reads", f'WITH {_FRAGMENTS} SELECT chrom, start, end_ AS "end", md5(seq) AS digest FROM frags')
def fragment_reads(spark, sf):
    own = intervals.fragments(D.contigs(spark, sf))
    return own.select("chrom", F.col("start").cast("long"), F.col("end").cast("long"), F.md5(F.col("seq").cast("binary")).alias("digest"))


# runs of N of at least 3 in a contig are its mask here
_NMASK = """nruns AS MATERIALIZED (SELECT chrom, unnest(list_filter(range(1, length(seq) + 1), lambda i: seq[i] = 'N')) AS p FROM c)"""


@query("fragment_masked", f'WITH {_FRAGMENTS}, {_NMASK}, hits AS (SELECT f.chrom, f.start, count(p) AS masked FROM frags f LEFT JOIN nruns n ON n.chrom = f.chrom AND n.p BETWEEN f.start AND f.end_ GROUP BY f.chrom, f.start) SELECT chrom, start, masked FROM hits WHERE masked / 150.0 < 0.2')
def fragment_masked(spark, sf):
    kept = intervals.unmasked_fragments(_tiles(spark, sf), _n_runs(spark, sf), 0.2)
    return kept.select("chrom", F.col("start").cast("long"), "masked")


def _n_runs(spark, sf) -> DataFrame:
    return intervals.runs_of(D.contigs(spark, sf))


def _tiles(spark, sf) -> DataFrame:
    return intervals.tile_spans(D.contigs(spark, sf).select("chrom", F.length("seq").alias("length")))


@query("genome_stats", f"""WITH {_FRAGMENTS}, {_NMASK}, hits AS (SELECT f.chrom, f.start, count(p) AS masked FROM frags f LEFT JOIN nruns n ON n.chrom = f.chrom AND n.p BETWEEN f.start AND f.end_ GROUP BY f.chrom, f.start)
  SELECT (SELECT count(*) FROM c) AS contigs, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM c) AS total_bp, (SELECT count(*) FROM nruns) AS masked_bp,
    (SELECT count(*) FROM (SELECT p, lag(p) OVER (PARTITION BY chrom ORDER BY p) AS q FROM nruns) WHERE q IS NULL OR q < p - 1) AS n_intervals,
    (SELECT count(*) FROM hits WHERE masked / 150.0 < 0.2) AS fragments_written, (SELECT count(*) FROM hits WHERE masked / 150.0 >= 0.2) AS fragments_skipped""")
def genome_stats(spark, sf):
    contigs, mask = D.contigs(spark, sf), _n_runs(spark, sf)
    tiles = _tiles(spark, sf)
    return intervals.genome_stats(contigs, mask, tiles, intervals.unmasked_fragments(tiles, mask, 0.2))


@query("masked_fraction", f'WITH {_FRAGMENTS}, {_NMASK} SELECT f.chrom, f.start, count(p) AS masked, round(count(p) / 150.0, 6) AS fraction FROM frags f LEFT JOIN nruns n ON n.chrom = f.chrom AND n.p BETWEEN f.start AND f.end_ GROUP BY f.chrom, f.start')
def masked_fraction(spark, sf):
    own = intervals.masked_bases(_tiles(spark, sf), _n_runs(spark, sf), ["chrom", "start", "end"], intervals.TILE_BIN)
    return own.select("chrom", F.col("start").cast("long"), "masked", F.round("fraction", 6).alias("fraction"))


@query("top_contigs", f"WITH c AS ({D.CONTIGS_SQL}), r AS (SELECT chrom, length(seq) AS length, contig_ord FROM c) SELECT chrom, length FROM r WHERE (SELECT count(*) FROM r q WHERE q.length > r.length OR (q.length = r.length AND q.contig_ord < r.contig_ord)) < 3")
def top_contigs(spark, sf):
    fai = D.contigs(spark, sf).select("chrom", F.length("seq").cast("long").alias("length"), "contig_ord")
    return intervals.top_contigs(fai, 3).select("chrom", "length")


# ---------------------------------------------------------------- reads

ALL_READS = f"WITH reads AS (SELECT *, {D.chrom_sql()} AS chrom, {D.chrom_sql()} || CASE WHEN ck % 17 = 3 THEN '_alt' ELSE '' END AS rname, cn * 1000000000 + start0 AS frag_ord FROM ({D.READS_SQL}))"
# each read's neighbours by rank among those that pass the first filters
GROUPED = f"{ALL_READS}, own AS (SELECT *, dense_rank() OVER (PARTITION BY taxon ORDER BY frag_ord) AS g FROM reads WHERE flag NOT IN (4, 256) AND mapq >= 1), zn AS (SELECT a.ord, coalesce(max(b.mapq), -1) AS zn FROM own a LEFT JOIN own b ON a.taxon = b.taxon AND abs(a.g - b.g) = 1 AND a.rname = b.rname AND a.start0 < b.start0 + 25 AND b.start0 < a.start0 + 25 GROUP BY a.ord)"
STATUS = f"{GROUPED}, status AS (SELECT r.ord, r.taxon, CASE WHEN flag IN (4, 256) THEN 'poor' WHEN mapq < 1 THEN 'low_mapq' WHEN rname LIKE '%alt%' THEN 'alt_contig' WHEN mapq >= 60 THEN 'high_mapq' WHEN zn >= 0 THEN 'rescued' ELSE 'disjoint' END AS status FROM reads r LEFT JOIN zn USING (ord))"


@query("mapq_filter", f"{ALL_READS} SELECT ord, mapq FROM reads WHERE mapq >= 60")
def mapq_filter(spark, sf):
    return reads.mapq_filter(D.reads(spark, sf)).select("ord", "mapq")


@query("alt_contig_filter", f"{ALL_READS} SELECT ord, rname FROM reads WHERE mapq >= 60 AND flag = 0 AND NOT contains(rname, 'alt')")
def alt_contig_filter(spark, sf):
    return reads.mapq_filter(D.reads(spark, sf), strict=True).select("ord", "rname")


@query("continuity_filter", f"{STATUS} SELECT ord, status FROM status WHERE status IN ('high_mapq', 'rescued')")
def continuity_filter(spark, sf):
    own = reads.continuity_status(D.reads(spark, sf), tile=TILE)
    return own.where(F.col("status").isin("high_mapq", "rescued")).select("ord", "status")


_HOP = "a.taxon = b.taxon AND b.g = a.g {} AND a.rname = b.rname AND a.start0 < b.start0 + 25 AND b.start0 < a.start0 + 25"


@query("continuity_run3", f"""{GROUPED}, r1 AS (SELECT DISTINCT a.ord FROM own a JOIN own b ON {_HOP.format('+ 1')}), l1 AS (SELECT DISTINCT a.ord FROM own a JOIN own b ON {_HOP.format('- 1')}),
  r2 AS (SELECT DISTINCT a.ord FROM own a JOIN own b ON {_HOP.format('+ 1')} JOIN r1 ON r1.ord = b.ord), l2 AS (SELECT DISTINCT a.ord FROM own a JOIN own b ON {_HOP.format('- 1')} JOIN l1 ON l1.ord = b.ord)
  SELECT o.ord, o.mapq FROM own o WHERE NOT contains(o.rname, 'alt') AND (o.mapq >= 60 OR o.ord IN (SELECT ord FROM r2) OR o.ord IN (SELECT ord FROM l2) OR (o.ord IN (SELECT ord FROM r1) AND o.ord IN (SELECT ord FROM l1)))""")
def continuity_run3(spark, sf):
    return reads.continuity_filter(D.reads(spark, sf), run=3, tile=TILE).select("ord", "mapq")


@query("zn_annotation", f"{GROUPED} SELECT ord, zn FROM own JOIN zn USING (ord) WHERE NOT contains(rname, 'alt')")
def zn_annotation(spark, sf):
    return reads.neighbour_mapq(D.reads(spark, sf), tile=TILE).select("ord", "zn")


@query("mapq_histogram", f"{ALL_READS} SELECT 'taxon' || CAST(taxon AS VARCHAR) AS species, mapq, count(*) AS n FROM reads WHERE flag NOT IN (4, 256) AND mapq >= 1 GROUP BY ALL")
def mapq_histogram(spark, sf):
    return reads.mapq_histogram(D.reads(spark, sf), 1)


@query("filter_stats", f"""{STATUS} SELECT 'taxon' || CAST(taxon AS VARCHAR) AS species, count(*) AS total_reads, count(*) FILTER (status IN ('high_mapq', 'rescued')) AS kept_reads, count(*) FILTER (status = 'high_mapq') AS kept_high_mapq,
  count(*) FILTER (status = 'rescued') AS kept_rescued, count(*) FILTER (status = 'poor') AS filtered_poor_mapping, count(*) FILTER (status = 'low_mapq') AS filtered_low_mapq,
  count(*) FILTER (status = 'disjoint') AS filtered_disjoint, count(*) FILTER (status = 'alt_contig') AS filtered_alt_contig FROM status GROUP BY taxon""")
def filter_stats(spark, sf):
    return reads.filter_stats(reads.continuity_status(D.reads(spark, sf), tile=TILE))


@query("read_intervals", f"{ALL_READS} SELECT 'taxon' || CAST(taxon AS VARCHAR) AS species, rname AS chrom, start0 AS start, start0 + 25 AS \"end\" FROM reads WHERE flag <> 4")
def read_intervals(spark, sf):
    return D.reads(spark, sf).where(F.col("flag").bitwiseAND(4) == 0).select("species", F.col("rname").alias("chrom"), F.col("start0").alias("start"), F.col("end0").alias("end"))


@query("merged_intervals", f"""{ALL_READS}, spans AS (SELECT taxon, rname, start0 AS s, start0 + 25 AS e FROM reads WHERE flag <> 4 AND mapq >= 60),
  opens AS (SELECT DISTINCT taxon, rname, s FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.taxon = a.taxon AND b.rname = a.rname AND b.s < a.s AND b.e >= a.s)),
  ends AS (SELECT DISTINCT taxon, rname, e FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.taxon = a.taxon AND b.rname = a.rname AND b.s <= a.e AND b.e > a.e))
  SELECT 'taxon' || CAST(o.taxon AS VARCHAR) AS species, o.rname AS chrom, o.s AS start, min(e.e) AS \"end\" FROM opens o JOIN ends e ON e.taxon = o.taxon AND e.rname = o.rname AND e.e > o.s GROUP BY ALL""")
def merged_intervals(spark, sf):
    own = D.reads(spark, sf).where((F.col("flag").bitwiseAND(4) == 0) & (F.col("mapq") >= 60))
    return intervals.merge(own.select("species", F.col("rname").alias("chrom"), F.col("start0").alias("start"), F.col("end0").alias("end")), ["species", "chrom"], adjacent=False, tile=TILE)


# ---------------------------------------------------------------- sites


@query("pileup_sites", f"{LINES} SELECT chrom, pos, ref, cov_1, cov_2, base_1, base_2, del_1 OR del_2 AS del, ins_1 OR ins_2 AS ins, dis_1, dis_2 FROM lines")
def pileup_sites(spark, sf):
    return _lines(spark, sf).select("chrom", "pos", "ref", "cov_1", "cov_2", "base_1", "base_2", (F.col("del_1") | F.col("del_2")).alias("del"), (F.col("ins_1") | F.col("ins_2")).alias("ins"), "dis_1", "dis_2")


#: The lines of at most two reads a taxon and position.
CAPPED = LINES.replace("r.start0,", "r.start0, r.ord,").replace(
    D.ONE_SQL.strip(), D.ONE_SQL.strip().replace("FROM read_bases WHERE mapq >= 30 AND flag = 0", "FROM (SELECT *, row_number() OVER (PARTITION BY taxon, chrom, pos ORDER BY start0, ord) AS k FROM read_bases WHERE mapq >= 30 AND flag = 0) WHERE k <= 2")
)


@query("pileup_depth_cap", SQL["pileup_sites"].replace(LINES, CAPPED))
def pileup_depth_cap(spark, sf):
    lines = sites.own_lines(sites.tiled_lines(D.alignments(spark, sf), TAXA, D.reference(), None, 2, TILE, max_depth=2))
    return lines.select("chrom", "pos", "ref", "cov_1", "cov_2", "base_1", "base_2", (F.col("del_1") | F.col("del_2")).alias("del"), (F.col("ins_1") | F.col("ins_2")).alias("ins"), "dis_1", "dis_2")


@query("qc_reasons_trio", f"{LINES} SELECT qc AS reason, count(*) AS n FROM lines WHERE qc IS NOT NULL GROUP BY qc")
def qc_reasons_trio(spark, sf):
    return sites.drop_reasons(_lines(spark, sf).withColumn("qc", sites.quality(TAXA)))


@query("qc_reasons_pair", f"{PAIR_LINES} SELECT qc AS reason, count(*) AS n FROM lines WHERE qc IS NOT NULL GROUP BY qc")
def qc_reasons_pair(spark, sf):
    return sites.drop_reasons(_lines(spark, sf, [1]).withColumn("qc", sites.quality([1])))


@query("trio_site_classes", f"{TRIO} SELECT site_class, count(*) AS n FROM cls GROUP BY site_class")
def trio_site_classes(spark, sf):
    return sites.site_classes(_trio(spark, sf))


@query("pair_site_classes", f"{PAIR} SELECT site_class, count(*) AS n FROM cls GROUP BY site_class")
def pair_site_classes(spark, sf):
    return sites.site_classes(_pair(spark, sf))


@query("trio_calls", f"{TRIO}, {MUT} SELECT taxon, chrom, pos, mutation FROM muts")
def trio_calls(spark, sf):
    return sites.trio_calls(_trio(spark, sf))


@query("pair_calls", f"{PAIR}, {FOLD} SELECT chrom, pos, ref3[1] || '[' || ref3[2] || '>' || t1_3[2] || ']' || ref3[3] AS change, mutation FROM cls JOIN fold ON old3 = ref3 AND new3 = t1_3 WHERE site_class = 'differs'")
def pair_calls(spark, sf):
    return sites.pair_calls(_pair(spark, sf))


@query("trio_spectrum", f"{TRIO}, {MUT} SELECT taxon, mutation, count(*) AS n FROM muts GROUP BY taxon, mutation")
def trio_spectrum(spark, sf):
    return sites.spectrum(_trio(spark, sf))


@query("pair_spectrum", f"{PAIR}, {FOLD} SELECT mutation, count(*) AS n FROM cls JOIN fold ON old3 = ref3 AND new3 = t1_3 WHERE site_class = 'differs' GROUP BY mutation")
def pair_spectrum(spark, sf):
    return sites.pair_spectrum(_pair(spark, sf))


TRIPS = "trips AS (SELECT ref3 AS triplet, count(*) AS n FROM cls WHERE site_class IN ('taxa1_mut', 'taxa2_mut', 'identical') GROUP BY ref3)"
PAIR_TRIPS = "trips AS (SELECT triplet, count(*) / 2.0 AS n FROM (SELECT ref3 AS triplet FROM cls WHERE site_class IN ('identical', 'differs') UNION ALL SELECT t1_3 FROM cls WHERE site_class IN ('identical', 'differs')) GROUP BY triplet)"


@query("trio_triplets", f"{TRIO}, {TRIPS} SELECT * FROM trips")
def trio_triplets(spark, sf):
    return sites.triplets(_trio(spark, sf))


@query("pair_triplets", f"{PAIR}, {PAIR_TRIPS} SELECT triplet, CAST(n AS DOUBLE) AS n FROM trips")
def pair_triplets(spark, sf):
    return sites.pair_triplets(_pair(spark, sf))


@query("ref_difference_spectrum", f"{TRIO} SELECT ref3[1] || '[' || t1_3[2] || '>' || ref3[2] || ']' || ref3[3] AS mutation, count(*) AS n FROM cls WHERE site_class = 'ref_differs' GROUP BY 1")
def ref_difference_spectrum(spark, sf):
    return sites.ref_differences(_trio(spark, sf))


@query("non_consecutive", f"{LINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i FROM lines) SELECT b.chrom, count(*) AS n FROM ranked a JOIN ranked b ON a.chrom = b.chrom AND a.i = b.i - 1 JOIN ranked c ON c.chrom = b.chrom AND c.i = b.i + 1 WHERE a.qc IS NULL AND b.qc IS NULL AND c.qc IS NULL AND c.pos - a.pos <> 2 GROUP BY b.chrom")
def non_consecutive(spark, sf):
    return _scan(spark, sf, gaps=True).where("gap").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


NEAR = "near AS (SELECT w.*, EXISTS (SELECT 1 FROM lines e WHERE e.chrom = w.chrom AND e.pos BETWEEN w.pos - 5 AND w.pos + 5 AND (e.del_1 OR e.del_2 OR e.ins_1 OR e.ins_2)) AS near FROM cls w)"


@query("near_indel_windows", f"{TRIO}, {NEAR} SELECT chrom, count(*) FILTER (near) AS near, count(*) AS n FROM near GROUP BY chrom")
def near_indel_windows(spark, sf):
    own = sites.contexts(_scan(spark, sf, indel_window=5), TAXA)
    return own.groupBy("chrom").agg(F.count_if("near").alias("near"), F.count(F.lit(1)).alias("n"))


@query("near_indel_spectrum", f"{TRIO}, {NEAR} SELECT CASE site_class WHEN 'taxa1_mut' THEN 1 ELSE 2 END AS taxon, ref3[1] || '[' || ref3[2] || '>' || CASE site_class WHEN 'taxa1_mut' THEN t1_3[2] ELSE t2_3[2] END || ']' || ref3[3] AS mutation, count(*) AS n FROM near WHERE near AND site_class IN ('taxa1_mut', 'taxa2_mut') GROUP BY ALL")
def near_indel_spectrum(spark, sf):
    own = sites.contexts(_scan(spark, sf, indel_window=5), TAXA).where("near")
    return sites.spectrum(sites.classify_trio(own))


@query("mask_merge", f"WITH {SPANS}, {MERGED} SELECT chrom, s AS start, e AS \"end\" FROM mask")
def mask_merge(spark, sf):
    return _mask(spark, sf)


MASKED = f"{LINES}, {SPANS}, left_ AS (SELECT l.*, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i FROM lines l WHERE NOT EXISTS (SELECT 1 FROM hidden s WHERE s.chrom = l.chrom AND l.pos = s.pos))"


@query("mask_join_calls", f"{MASKED.replace('lines AS MATERIALIZED', 'all_lines AS MATERIALIZED', 1).replace('FROM lines l', 'FROM all_lines l')}, lines AS (SELECT * FROM left_), {CONTEXT}, {CLASS_TRIO}, {MUT} SELECT taxon, chrom, pos, mutation FROM muts")
def mask_join_calls(spark, sf):
    return sites.trio_calls(_trio(spark, sf, _mask(spark, sf)))


@query("masked_gaps", f"{MASKED} SELECT b.chrom, count(*) AS n FROM left_ a JOIN left_ b ON a.chrom = b.chrom AND a.i = b.i - 1 JOIN left_ c ON c.chrom = b.chrom AND c.i = b.i + 1 WHERE a.qc IS NULL AND b.qc IS NULL AND c.qc IS NULL AND c.pos - a.pos <> 2 GROUP BY b.chrom")
def masked_gaps(spark, sf):
    return _scan(spark, sf, mask=_mask(spark, sf), gaps=True).where("gap").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


FIVE = f"""{LINES}, mid AS MATERIALIZED (SELECT * FROM lines WHERE qc IS NULL), flank AS MATERIALIZED (SELECT * FROM mid WHERE ref = base_1 AND ref = base_2),
  five AS (SELECT m.chrom, m.pos, a.ref || b.ref || m.ref || c.ref || d.ref AS ref5, m.base_1 AS t1, m.base_2 AS t2 FROM mid m
  JOIN flank a ON a.k = m.k - 2 JOIN flank b ON b.k = m.k - 1 JOIN flank c ON c.k = m.k + 1 JOIN flank d ON d.k = m.k + 2)"""


@query("five_mer_spectrum", f"{FIVE} SELECT CASE WHEN t1 <> ref5[3] THEN 1 ELSE 2 END AS taxon, ref5[1:2] || '[' || ref5[3] || '>' || CASE WHEN t1 <> ref5[3] THEN t1 ELSE t2 END || ']' || ref5[4:5] AS mutation, count(*) AS n FROM five WHERE (t1 = ref5[3]) <> (t2 = ref5[3]) GROUP BY ALL")
def five_mer_spectrum(spark, sf):
    return sites.five_mer_spectrum(sites.five_mers(_scan(spark, sf, halo=True), TAXA, TILE))


@query("five_mer_opportunity", f"{FIVE} SELECT ref5 AS kmer, count(*) AS n FROM five WHERE t1 = ref5[3] OR t2 = ref5[3] GROUP BY ref5")
def five_mer_opportunity(spark, sf):
    return sites.five_mer_opportunity(sites.five_mers(_scan(spark, sf, halo=True), TAXA, TILE))


# ---------------------------------------------------------------- rates

M96 = f"""m96 AS (SELECT taxon, CASE WHEN mutation[3] IN ('A', 'G') THEN {COMP.format('mutation[7]')} || '[' || {COMP.format('mutation[3]')} || '>' || {COMP.format('mutation[5]')} || ']' || {COMP.format('mutation[1]')} ELSE mutation END AS mutation, count(*) AS n FROM muts GROUP BY ALL)"""
T32 = f"t32 AS (SELECT CASE WHEN triplet[2] IN ('A', 'G') THEN {rc_sql('triplet')} ELSE triplet END AS triplet, sum(n) AS o FROM trips GROUP BY 1)"
RATES = f"{TRIO}, {MUT}, {TRIPS}, {M96}, {T32}, rate AS (SELECT taxon, mutation, n, CAST(coalesce(o, 0) AS BIGINT) AS opportunity, coalesce(n / nullif(o, 0), 0) AS rate FROM m96 LEFT JOIN t32 ON triplet = mutation[1] || mutation[3] || mutation[7])"


def _counted(spark, df: DataFrame) -> DataFrame:
    """One scan for a spectrum and its opportunities: a row for each class, context and label, some thousands at most."""
    keys = [c for c in ("site_class", "ref3", "t1_3", "t2_3", "label") if c in df.columns]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("site_class") != "not_acgt")
    return spark.createDataFrame(counts.collect(), counts.schema)


def _two(trips: DataFrame) -> DataFrame:
    return trips.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("taxon"), "triplet", "n")


@query("normalize_96", f"{RATES} SELECT taxon, mutation, n, opportunity, round(rate, 9) AS rate, CAST(round_even(rate / (SELECT sum(rate) FROM rate q WHERE q.taxon = r.taxon) * 10000, 0) AS BIGINT) AS scaled FROM rate r")
def normalize_96(spark, sf):
    c = _counted(spark, _trio(spark, sf))
    own = rates.normalize(sites.spectrum(c), _two(sites.triplets(c)), ["taxon"])
    return own.select("taxon", "mutation", "n", "opportunity", F.round("rate", 9).alias("rate"), "scaled")


@query("scale_10000", f"{RATES} SELECT taxon, mutation, CAST(round_even(n / (SELECT sum(n) FROM rate q WHERE q.taxon = r.taxon) * 10000, 0) AS BIGINT) AS scaled_raw FROM rate r")
def scale_10000(spark, sf):
    c = _counted(spark, _trio(spark, sf))
    return rates.normalize(sites.spectrum(c), _two(sites.triplets(c)), ["taxon"]).select("taxon", "mutation", "scaled_raw")


@query("spectra_table", f"{RATES} SELECT mutation, max(n) FILTER (taxon = 1) AS \"1\", max(n) FILTER (taxon = 2) AS \"2\" FROM rate GROUP BY mutation")
def spectra_table(spark, sf):
    return rates.wide_table(rates.collapse_spectrum(sites.spectrum(_trio(spark, sf)), ["taxon"]), "mutation", "taxon", "n", [1, 2])


@query("normalize_pair", f"""{PAIR}, {FOLD}, {PAIR_TRIPS}, sp AS (SELECT mutation, count(*) AS n FROM cls JOIN fold ON old3 = ref3 AND new3 = t1_3 WHERE site_class = 'differs' GROUP BY mutation),
  al AS (SELECT mutation, n, mutation[1] || mutation[3] || mutation[7] AS a, mutation[1] || mutation[5] || mutation[7] AS b FROM sp),
  op AS (SELECT mutation, n, (SELECT coalesce(sum(t.n), 0) FROM trips t WHERE t.triplet IN (a, b, {rc_sql('a')}, {rc_sql('b')})) AS o FROM al),
  ra AS (SELECT *, coalesce(n / nullif(o, 0), 0) AS rate FROM op)
  SELECT mutation, n, CAST(o AS DOUBLE) AS opportunity, round(rate, 9) AS rate, round(rate / (SELECT sum(rate) FROM ra) * 10000, 6) AS normalized FROM ra""")
def normalize_pair(spark, sf):
    c = _counted(spark, _pair(spark, sf))
    own = rates.normalize_pair(sites.pair_spectrum(c), sites.pair_triplets(c))
    return own.select("mutation", "n", "opportunity", F.round("rate", 9).alias("rate"), F.round("normalized", 6).alias("normalized"))


@query("mutations_per_triplet", f"{TRIO}, {MUT}, {TRIPS} SELECT taxon, count(*) AS mutations, CAST((SELECT sum(n) FROM trips) AS BIGINT) AS triplets, round(count(*) / (SELECT sum(n) FROM trips), 9) AS ratio FROM muts GROUP BY taxon")
def mutations_per_triplet(spark, sf):
    c = _counted(spark, _trio(spark, sf))
    own = rates.mutations_per_triplet(sites.spectrum(c), _two(sites.triplets(c)), ["taxon"])
    return own.select("taxon", "mutations", "triplets", F.round("ratio", 9).alias("ratio"))


# ---------------------------------------------------------------- coverage and density

CONTIG_LENGTHS = "lens AS (SELECT rname, max(start0 + 25) AS length FROM reads WHERE NOT contains(rname, 'alt') GROUP BY rname), bins AS (SELECT rname AS chrom, unnest(range(0, length - 999, 500)) AS b FROM lens)"


def _lens(spark, sf) -> DataFrame:
    own = D.reads(spark, sf).where(~reads.on_alt_contig())
    return own.groupBy(F.col("rname").alias("chrom")).agg(F.max("end0").alias("length"))


def _coverage(spark, sf) -> DataFrame:
    spans = D.reads(spark, sf).select(F.col("rname").alias("chrom"), F.col("start0").alias("start"), F.col("end0").alias("end"))
    return intervals.binned_coverage(spans, _lens(spark, sf), 1000, 500)


COVERAGE = f"{CONTIG_LENGTHS}, cov AS (SELECT b.chrom, b.b AS bin_start, b.b + 500 AS midpoint, coalesce(sum(least(r.start0 + 25, b.b + 1000) - greatest(r.start0, b.b)), 0) / 1000.0 AS coverage FROM bins b LEFT JOIN reads r ON r.rname = b.chrom AND r.start0 < b.b + 1000 AND r.start0 + 25 > b.b GROUP BY ALL)"
DENSITY = "den AS (SELECT b.chrom, b.b AS bin_start, b.b + 500 AS midpoint, count(m.pos) AS n FROM bins b LEFT JOIN muts m ON m.chrom = b.chrom AND m.pos >= b.b AND m.pos < b.b + 1000 GROUP BY ALL)"


@query("binned_coverage", f"{ALL_READS}, {COVERAGE} SELECT chrom, bin_start, midpoint, round(CAST(coverage AS DOUBLE), 6) AS coverage FROM cov")
def binned_coverage(spark, sf):
    return _coverage(spark, sf).withColumn("coverage", F.round("coverage", 6))


# the trio's own reads (rn) beside all reads (reads)
TRIO_ALL = TRIO.replace(f"WITH reads AS ({D.READS_SQL})", f"{ALL_READS}")


def _density(spark, sf, pattern=None) -> DataFrame:
    return intervals.mutation_density(sites.trio_calls(_trio(spark, sf)), _lens(spark, sf), 1000, 500, pattern)


@query("mutation_density", f"{TRIO_ALL}, {MUT}, {CONTIG_LENGTHS}, {DENSITY} SELECT * FROM den")
def mutation_density(spark, sf):
    return _density(spark, sf)


@query("cpg_density", f"{TRIO_ALL}, {MUT.replace('muts AS', 'all_muts AS')}, muts AS (SELECT * FROM all_muts WHERE substring(mutation, 3, 3) = 'C>T' AND mutation[7] = 'G'), {CONTIG_LENGTHS}, {DENSITY} SELECT * FROM den")
def cpg_density(spark, sf):
    return _density(spark, sf, intervals.CPG)


@query("density_by_coverage", f"{TRIO_ALL}, {MUT}, {COVERAGE}, {DENSITY} SELECT chrom, bin_start, midpoint, round(CAST(CASE WHEN coverage > 0 THEN n / coverage ELSE 0 END AS DOUBLE), 6) AS rate FROM den JOIN cov USING (chrom, bin_start, midpoint)")
def density_by_coverage(spark, sf):
    return intervals.density_by_coverage(_density(spark, sf), _coverage(spark, sf)).withColumn("rate", F.round("rate", 6))


# ---------------------------------------------------------------- thresholds


def _annotated_reads(spark, sf, taxa=TAXA, mask=None, reach=2) -> DataFrame:
    """Reads by position, dealt by tile before they are walked."""
    kept = reads.neighbour_mapq(D.reads(spark, sf), tile=TILE).where(F.col("taxon").isin(taxa))
    own = sites.dealt_positions(D.with_bases(kept), None, mask, ["taxon", "mapq", "zn"], reach, TILE)
    return thresholds.annotated(own)


def _annotated_reads_flat(spark, sf) -> DataFrame:
    base = F.expr(D.letter_sql(D.code_sql("cn * 1000003 + start0 + j + 1", "taxon", "j", "ck")))
    kept = reads.neighbour_mapq(D.reads(spark, sf), tile=TILE)
    pos = kept.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("pos", F.col("start0") + F.col("j") + 1)
    deleted = (F.col("ck") % 40 == 3) & F.col("j").isin(10, 11)
    inserted = (F.col("ck") % 37 == 5) & (F.col("j") == 15)
    return pos.select("taxon", "chrom", "pos", F.when(deleted, "*").otherwise(base).alias("base"), "mapq", "zn", (deleted | inserted).alias("rejects"))


def _windows(spark, sf, taxa=TAXA, indel_window=1, mask=None) -> DataFrame:
    own = _annotated_reads(spark, sf, taxa, mask, max(2, indel_window))
    return thresholds.scan(own, D.reference(), taxa, None, indel_window, TILE)


AREADS = f"""{GROUPED}, ar AS MATERIALIZED (SELECT o.taxon, o.cn, o.chrom, o.start0 + n.n_nationkey + 1 AS pos, o.mapq, z.zn, (o.ck % 40 = 3 AND n.n_nationkey IN (10, 11)) OR (o.ck % 37 = 5 AND n.n_nationkey = 15) AS rejects,
    CASE WHEN o.ck % 40 = 3 AND n.n_nationkey IN (10, 11) THEN '*' ELSE {D.letter_sql(D.code_sql('o.cn * 1000003 + o.start0 + n.n_nationkey + 1', 'o.taxon', 'n.n_nationkey', 'o.ck'))} END AS base
  FROM own o JOIN zn z USING (ord) CROSS JOIN nation n WHERE NOT contains(o.rname, 'alt')),
  q AS MATERIALIZED (SELECT *, 0 AS mode, mapq AS q FROM ar UNION ALL SELECT *, 1 AS mode, CASE WHEN zn >= 0 THEN 256 ELSE mapq END AS q FROM ar),
  top AS (SELECT *, row_number() OVER (PARTITION BY taxon, chrom, pos, mode ORDER BY q DESC, base DESC, rejects DESC) AS k FROM q),
  si AS MATERIALIZED (SELECT t.taxon, t.cn, t.chrom, t.pos, t.mode, t.base, t.q AS hi, coalesce((SELECT max(o.q) FROM q o WHERE o.taxon = t.taxon AND o.chrom = t.chrom AND o.pos = t.pos AND o.mode = t.mode AND (o.rejects OR o.base <> t.base)), -1) + 1 AS lo,
    coalesce((SELECT max(o.q) FROM q o WHERE o.taxon = t.taxon AND o.chrom = t.chrom AND o.pos = t.pos AND o.mode = t.mode AND o.rejects), -1) AS indel FROM top t WHERE k = 1)"""


@query("annotated_site_intervals", f"{AREADS} SELECT taxon, chrom, pos, mode, CASE WHEN lo <= hi THEN base END AS base, lo, hi, indel FROM si")
def annotated_site_intervals(spark, sf):
    own = thresholds.site_intervals(_annotated_reads_flat(spark, sf), ["taxon", "chrom", "pos"])
    return own.select("taxon", "chrom", "pos", "mode", "base", "lo", "hi", "indel")


def _awin(extra: str = "") -> str:
    cols = ", ".join(f"{x}{t}.base AS {x}{t}" for x in "amb" for t in TAXA)
    return f"""{AREADS}, ok AS (SELECT * FROM si WHERE lo <= hi), tri AS (SELECT m1.chrom, m1.cn, m1.pos, m1.mode, {cols},
      greatest(0, a1.lo, a2.lo, m1.lo, m2.lo, b1.lo, b2.lo) AS lo, least(256, a1.hi, a2.hi, m1.hi, m2.hi, b1.hi, b2.hi) AS hi FROM ok m1
    JOIN ok m2 ON m2.taxon = 2 AND m2.chrom = m1.chrom AND m2.mode = m1.mode AND m2.pos = m1.pos
    JOIN ok a1 ON a1.taxon = 1 AND a1.chrom = m1.chrom AND a1.mode = m1.mode AND a1.pos = m1.pos - 1 JOIN ok a2 ON a2.taxon = 2 AND a2.chrom = m1.chrom AND a2.mode = m1.mode AND a2.pos = m1.pos - 1
    JOIN ok b1 ON b1.taxon = 1 AND b1.chrom = m1.chrom AND b1.mode = m1.mode AND b1.pos = m1.pos + 1 JOIN ok b2 ON b2.taxon = 2 AND b2.chrom = m1.chrom AND b2.mode = m1.mode AND b2.pos = m1.pos + 1
    WHERE m1.taxon = 1),
    r3 AS (SELECT *, {D.letter_sql(f"{D.h('cn * 1000003 + pos - 1', 1)} % 4")} || {D.letter_sql(f"{D.h('cn * 1000003 + pos', 1)} % 4")} || {D.letter_sql(f"{D.h('cn * 1000003 + pos + 1', 1)} % 4")} AS ref3 FROM tri WHERE lo <= hi),
    ac AS (SELECT chrom, pos, mode, lo, hi, ref3, m1, m2, CASE WHEN NOT (a1 = ref3[1] AND a2 = ref3[1] AND b1 = ref3[3] AND b2 = ref3[3]) THEN 'flanks_not_conserved' WHEN m1 <> ref3[2] AND m2 = ref3[2] THEN 'taxa1_mut'
      WHEN m1 = ref3[2] AND m2 <> ref3[2] THEN 'taxa2_mut' WHEN m1 = ref3[2] THEN 'identical' WHEN m1 = m2 THEN 'ref_differs' ELSE 'all_differ' END AS site_class FROM r3),
    al AS (SELECT *, CASE site_class WHEN 'taxa1_mut' THEN ref3[1] || '[' || ref3[2] || '>' || m1 || ']' || ref3[3] WHEN 'taxa2_mut' THEN ref3[1] || '[' || ref3[2] || '>' || m2 || ']' || ref3[3]
      WHEN 'identical' THEN ref3 WHEN 'ref_differs' THEN ref3[1] || '[' || m1 || '>' || ref3[2] || ']' || ref3[3] ELSE '' END AS label FROM ac){extra}"""


@query("annotated_site_counts", f"{_awin()} SELECT mode, site_class, label, lo, hi, count(*) AS n FROM al GROUP BY ALL")
def annotated_site_counts(spark, sf):
    return thresholds.site_counts(_windows(spark, sf)).drop("indel_mapq")


@query("annotated_calls", f"{_awin()}, {SPANS} SELECT chrom, pos, mode, CASE site_class WHEN 'taxa1_mut' THEN 1 ELSE 2 END AS taxon, label AS mutation, lo, hi, CASE WHEN EXISTS (SELECT 1 FROM hidden s WHERE s.chrom = al.chrom AND s.pos = al.pos) OR EXISTS (SELECT 1 FROM hidden s WHERE s.chrom = al.chrom AND s.pos = al.pos - 1) OR EXISTS (SELECT 1 FROM hidden s WHERE s.chrom = al.chrom AND s.pos = al.pos + 1) THEN 1 ELSE 0 END AS repeat FROM al WHERE site_class IN ('taxa1_mut', 'taxa2_mut')")
def annotated_calls(spark, sf):
    return thresholds.calls(_windows(spark, sf, mask=_mask(spark, sf))).drop("indel_mapq")


@query("derive_calls", f"SELECT chrom, pos, taxon, mutation FROM ({SQL['annotated_calls']}) WHERE mode = 1 AND 30 BETWEEN lo AND hi")
def derive_calls(spark, sf):
    return thresholds.derive_calls(thresholds.calls(_windows(spark, sf, mask=_mask(spark, sf))), 30, True)


@query("annotated_indel_flags", f"{_awin()}, near AS (SELECT al.*, greatest(0, coalesce((SELECT max(s.indel) FROM si s WHERE s.chrom = al.chrom AND s.mode = al.mode AND s.pos BETWEEN al.pos - 3 AND al.pos + 3), 0)) AS indel_mapq FROM al) SELECT mode, site_class, label, lo, hi, indel_mapq, count(*) AS n FROM near GROUP BY ALL")
def annotated_indel_flags(spark, sf):
    return thresholds.site_counts(_windows(spark, sf, indel_window=3))


@query("derive_at_mapq", f"{_awin()} SELECT CASE site_class WHEN 'taxa1_mut' THEN 1 ELSE 2 END AS taxon, label AS mutation, count(*) AS n FROM al WHERE mode = 1 AND 30 BETWEEN lo AND hi AND site_class IN ('taxa1_mut', 'taxa2_mut') GROUP BY ALL")
def derive_at_mapq(spark, sf):
    return thresholds.derive(thresholds.site_counts(_windows(spark, sf)), 30, True)["mut"]


@query("threshold_sweep", f"{_awin()} SELECT t.mapq, mode, site_class, count(*) AS n FROM al JOIN (SELECT unnest([1, 5, 30, 60]) AS mapq) t ON t.mapq BETWEEN lo AND hi GROUP BY ALL")
def threshold_sweep(spark, sf):
    return thresholds.sweep(thresholds.site_counts(_windows(spark, sf)), [1, 5, 30, 60])


# ---------------------------------------------------------------- several species

MULTI = f"""{TRIO}, site AS (SELECT chrom, pos, ref3[1] AS "left", ref3[3] AS "right", ref3[2] AS taxa0, t1_3[2] AS taxa1, t2_3[2] AS taxa2, ref3 FROM win
  WHERE {FLANKS} AND ref3[1] = t2_3[1] AND ref3[3] = t2_3[3] AND (t1_3[2] = ref3[2] OR t2_3[2] = ref3[2]))"""


@query("multi_matching_bases", f'{MULTI} SELECT chrom, pos, "left", "right", taxa0, taxa1, taxa2 FROM site WHERE taxa1 <> taxa2')
def multi_matching_bases(spark, sf):
    own = sites.matrix_sites(_tiled(spark, sf), TAXA).where("varies")
    return own.select("chrom", "pos", "left", "right", F.col("ref").alias("taxa0"), F.col("taxa")[0].alias("taxa1"), F.col("taxa")[1].alias("taxa2"))


@query("multi_triplets", f"{MULTI} SELECT ref3 AS triplet, count(*) AS n FROM site GROUP BY ref3")
def multi_triplets(spark, sf):
    return sites.matrix_sites(_tiled(spark, sf), TAXA).groupBy(F.col("ref3").alias("triplet")).agg(F.count(F.lit(1)).alias("n"))


def _tree() -> Flat:
    root = parse_newick(D.NEWICK)
    columns = index_leaves(root, "outg")
    return Flat.of(root, columns)


def _bit(c: str) -> str:
    return f"CASE {c} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END"


def _both(a: str, b: str) -> str:
    return f"CASE WHEN ({a} & {b}) <> 0 THEN {a} & {b} ELSE {a} | {b} END"


# the tree by hand: ((1,2),(3,4)) beside the outgroup 0
UP = f"""WITH m AS ({D.MATRIX_SQL}), leaf AS (SELECT *, {', '.join(f'{_bit(f"taxa{k}")} AS b{k}' for k in range(5))} FROM m),
  p1 AS (SELECT *, {_both('b1', 'b2')} AS x12, {_both('b3', 'b4')} AS x34 FROM leaf), p2 AS (SELECT *, {_both('x12', 'x34')} AS x FROM p1), p3 AS (SELECT *, {_both('x', 'b0')} AS root FROM p2)"""


@query("fitch_states", f"{UP} SELECT chrom, pos, x12, x34, x, root, count(*) AS n FROM p3 GROUP BY ALL")
def fitch_states(spark, sf):
    tree = _tree()  # parents first: root, inner, (1,2), 1, 2, (3,4), 3, 4, 0
    own = fitch.states(D.matrix(spark, sf), tree)
    return own.groupBy("chrom", "pos", F.col("s2").alias("x12"), F.col("s5").alias("x34"), F.col("s1").alias("x"), F.col("s0").alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query("parsimony_score", f"{UP} SELECT count(*) AS sites, CAST(sum(CAST((b1 & b2) = 0 AS INTEGER) + CAST((b3 & b4) = 0 AS INTEGER) + CAST((x12 & x34) = 0 AS INTEGER) + CAST((x & b0) = 0 AS INTEGER)) AS BIGINT) AS score FROM p3")
def parsimony_score(spark, sf):
    return fitch.score(D.matrix(spark, sf), _tree())


def _down() -> str:
    """The down pass by levels, each a table of the one before it."""
    labels = _tree().label
    sql = f"{UP}, d0 AS (SELECT *, bit_count(root) = 1 AS live0, root AS y0 FROM p3)"
    steps = [("1", "x", "0"), ("2", "x12", "1"), ("3", "b1", "2"), ("4", "b2", "2"), ("5", "x34", "1"), ("6", "b3", "5"), ("7", "b4", "5"), ("8", "b0", "0")]
    for k, (i, s, p) in enumerate(steps):
        sql += f", d{k + 1} AS (SELECT *, live{p} AND (({s} & y{p}) <> 0 OR bit_count({s}) = 1) AS live{i}, CASE WHEN ({s} & y{p}) <> 0 THEN y{p} ELSE {s} END AS y{i}, CAST(live{p} AND ({s} & y{p}) = 0 AND bit_count({s}) > 1 AS INTEGER) AS amb{i} FROM d{k})"
    letter = lambda v: f"CASE {v} WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' ELSE 'T' END"
    rows = " UNION ALL ".join(f"SELECT '{labels[int(p)]}→{labels[int(i)]}' AS branch, chrom, pos, lft || '[' || {letter(f'y{p}')} || '>' || {letter(f'y{i}')} || ']' || rgt AS mutation FROM d8 WHERE live{p} AND live{i} AND y{p} <> y{i}" for i, _, p in steps)
    return f"{sql}, rows AS ({rows}), amb AS (SELECT chrom, CAST(sum(CASE WHEN live0 THEN 0 ELSE 1 END + {' + '.join(f'amb{i}' for i, _, _ in steps)}) AS BIGINT) AS ambiguous FROM d8 GROUP BY chrom)"


@query("fitch_branch_mutations", f"{_down()} SELECT branch, chrom, pos, mutation, count(*) AS n FROM rows GROUP BY ALL")
def fitch_branch_mutations(spark, sf):
    own = fitch.branch_mutations(fitch.resolve(D.matrix(spark, sf), _tree()))
    return own.groupBy("branch", "chrom", "pos", "mutation").agg(F.count(F.lit(1)).alias("n"))


@query("fitch_ambiguous", f"{_down()} SELECT * FROM amb")
def fitch_ambiguous(spark, sf):
    return fitch.resolve(D.matrix(spark, sf), _tree()).groupBy("chrom").agg(F.sum("ambiguous").alias("ambiguous"))


@query("branch_spectra", f"{_down()} SELECT branch, mutation, count(*) AS n FROM rows GROUP BY ALL")
def branch_spectra(spark, sf):
    return fitch.branch_spectra(fitch.branch_mutations(fitch.resolve(D.matrix(spark, sf), _tree())))


_HEAD = f"WITH m AS ({D.MATRIX_SQL}), o AS (SELECT DISTINCT chrom, pos, taxa0, taxa1, taxa2, taxa3, taxa4 FROM m)"


@query("phylip_matrix", f"{_HEAD} " + " UNION ALL ".join(f"SELECT {k} AS taxon, md5(string_agg(taxa{k}, '' ORDER BY chrom, pos)) AS digest, count(*) AS n FROM o" for k in range(5)))
def phylip_matrix(spark, sf):
    return fitch.phylip_digests(fitch.phylip_blocks(D.matrix(spark, sf).dropDuplicates(["chrom", "pos"])))


# ---------------------------------------------------------------- pileup text

# every read shows a point at each of its positions, so what is left of a field is as many points
TEXT = f"WITH reads AS ({D.READS_SQL}), cells AS (SELECT r.*, {D.chrom_sql('r.cn')} AS chrom, r.start0 + n.n_nationkey + 1 AS pos, n.n_nationkey AS j FROM reads r CROSS JOIN nation n)"


@query("clean_bases", f"{TEXT} SELECT chrom, pos, repeat('.', CAST(count(*) AS INTEGER)) AS clean FROM cells GROUP BY chrom, pos")
def clean_bases(spark, sf):
    return _pileup_text(spark, sf).select("chrom", "pos", B.clean_bases("bases").alias("clean"))


@query("split_reads", f"{TEXT} SELECT CASE WHEN j = 0 THEN '^' || chr(mapq + 33) ELSE '' END || '.' || CASE WHEN ck % 37 = 5 AND j = 15 THEN '+12ACGTACGTACGT' ELSE '' END || CASE WHEN j = 24 THEN '$' ELSE '' END AS token, count(*) AS n FROM cells GROUP BY 1")
def split_reads(spark, sf):
    return _pileup_text(spark, sf).select("chrom", "pos", F.explode(B.split_reads("bases")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _pileup_text(spark, sf) -> DataFrame:
    """Pileup fields of the derived reads, with starts, ends and insertions."""
    own = D.reads(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(24))))
    start = F.when(F.col("j") == 0, F.concat(F.lit("^"), F.char(F.col("mapq") + 33))).otherwise("")
    token = F.concat(start, F.lit("."), F.when((F.col("ck") % 37 == 5) & (F.col("j") == 15), "+12ACGTACGTACGT").otherwise(""), F.when(F.col("j") == 24, "$").otherwise(""))
    own = own.groupBy("chrom", (F.col("start0") + F.col("j") + 1).alias("pos"))
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", token.alias("t")))), lambda x: x["t"]), "").alias("bases"))


@query("sample_sites", f"WITH m AS ({D.MATRIX_SQL}) SELECT chrom, pos, taxa0 || taxa1 || taxa2 || taxa3 || taxa4 AS taxa FROM m ORDER BY md5('42|' || chrom || '|' || CAST(pos AS VARCHAR)), chrom, pos LIMIT 1000")
def sample_sites(spark, sf):
    return fitch.sample_sites(D.matrix(spark, sf), 1000).select("chrom", "pos", F.array_join("taxa", "").alias("taxa"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trio_spectrum(spark, sf_dir)


_NAMES = [f"taxa{i}" for i in range(5)]


def _unrooted() -> list:
    """The 15 trees of four taxa beside an outgroup."""
    trees = [(1, 2)]
    for k in (3, 4):
        trees = [t for tree in trees for t in parsimony.grafted(tree, k)]
    return sorted({(0, parsimony.normal(t)) for t in trees}, key=str)


def _tree_sql() -> str:
    """Each tree's score with the states of its nodes as columns of a row each."""
    parts = []
    for tree in _unrooted():
        cols: list[str] = []

        def up(t) -> str:
            if isinstance(t, int):
                return f"m{t}"
            a, b = up(t[0]), up(t[1])
            cols.append(f"CASE WHEN {a} & {b} <> 0 THEN {a} & {b} ELSE {a} | {b} END AS n{len(cols)}, CASE WHEN {a} & {b} = 0 THEN 1 ELSE 0 END AS c{len(cols)}")
            return f"n{len(cols) - 1}"

        up(tree)
        parts.append(f"SELECT '{parsimony.newick(tree, _NAMES)}' AS tree, CAST(sum(c0 + c1 + c2 + c3) AS BIGINT) AS score FROM (SELECT *, {', '.join(cols)} FROM masks)")
    bits = ", ".join(f"CASE taxa{k} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 15 END AS m{k}" for k in range(5))
    return f"WITH m AS ({D.MATRIX_SQL}), masks AS MATERIALIZED (SELECT {bits} FROM m) " + " UNION ALL ".join(parts)


@query("parsimony_tree_scores", _tree_sql())
def parsimony_tree_scores(spark, sf):
    """All trees of the taxa in one pass over the patterns of sites."""
    own = D.matrix(spark, sf)
    constant = parsimony.constant_changes(own)
    return parsimony.tree_scores(parsimony.site_patterns(own), _unrooted()).join(F.broadcast(constant)).select(F.element_at(F.array(*(F.lit(parsimony.newick(t, _NAMES)) for t in _unrooted())), F.col("tree") + 1).alias("tree"), (F.col("score") + F.col("changes")).alias("score"))
