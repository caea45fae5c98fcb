"""Readers of the formats that genome tools exchange, as DataFrames. Malformed lines give no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import clean_bases, split_reads
from ..operators.sites import parse_cigar


def fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """chrom (cut at the first blank), seq. A record is a row, so a file is split only between records; a ">" inside a
    header begins none."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", "")).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return rows.select(F.regexp_extract(head, r"^(\S+)", 1).alias("chrom"), (F.upper(body) if upper else body).alias("seq"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, contig_ord (the file's order, as an increasing number)."""
    rows = spark.read.option("sep", "\t").schema("chrom string, length long, _o long, _b long, _w long").csv(path)
    return rows.select("chrom", "length", F.monotonically_increasing_id().alias("contig_ord"))


def places(rows: DataFrame, order: str) -> DataFrame:
    """Adds place, from 1, of rows whose ``order`` came from monotonically_increasing_id: a row's number in its partition
    behind the rows of the partitions before, which are counted. No task sees all rows."""
    from pyspark.sql import Window

    part, number = F.shiftright(order, 33), F.col(order).bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("place", F.col("_before") + number + 1).drop("_part", "_before")


def fai_of(contigs: DataFrame) -> DataFrame:
    return contigs.select("chrom", F.length("seq").cast("long").alias("length"))


def _fields(line: Column) -> Column:
    return F.split(line, "\t")


def sam(spark: SparkSession, path: str, species: str = "") -> DataFrame:
    """Alignments: species, ord, qname, flag, rname, start0, end0, mapq, cigar, seq, zn. Headers and lines with fewer
    than 11 fields give no row."""
    return parse_sam(spark.read.text(path), species)


def parse_sam(lines: DataFrame, species: str = "") -> DataFrame:
    """``sam`` of lines (value), as files or an aligner give them."""
    rows = lines.where(~F.col("value").startswith("@")).select(_fields(F.col("value")).alias("f"), F.monotonically_increasing_id().alias("ord")).where(F.size("f") >= 11)
    f = lambda i: F.col("f")[i]
    num = lambda i: F.expr(f"try_cast(f[{i}] as int)")
    cigar = F.when(f(5) != "*", parse_cigar(f(5)))
    tag = F.regexp_extract(F.array_join(F.slice("f", 12, 1000), "\t"), r"(?:^|\t)ZN:i:(-?\d+)", 1)
    out = rows.select(
        F.lit(species).alias("species"), "ord", f(0).alias("qname"), num(1).alias("flag"), f(2).alias("rname"), (num(3) - 1).alias("start0"), num(4).alias("mapq"),
        cigar.alias("cigar"), F.when(f(9) != "*", F.upper(f(9))).alias("seq"), F.when(tag != "", tag.cast("int")).alias("zn"),
    ).where("flag is not null and start0 is not null and mapq is not null")
    span = F.aggregate("cigar", F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(0))
    return out.withColumn("end0", F.col("start0") + F.coalesce(span, F.lit(0)))


def fragment_order(reads: DataFrame) -> DataFrame:
    """Adds frag_ord, the order of pseudo-reads, from the span in their names: contig by contig, then by start."""
    from pyspark.sql import Window

    from ..functions.bases import read_span

    chrom, start, _ = read_span("qname")
    own = reads.withColumn("_c", chrom).withColumn("_s", start)
    # contigs are few; their ranks place each contig's fragments behind those of the contigs before it
    sizes = own.groupBy("species", "_c").agg(F.max("_s").alias("_m"))
    before = Window.partitionBy("species").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_b", F.coalesce(F.sum(F.col("_m").cast("long") + 1).over(before), F.lit(0)))
    return own.join(sizes, ["species", "_c"]).withColumn("frag_ord", F.col("_b") + F.col("_s")).drop("_c", "_s", "_m", "_b")


def pileup(spark: SparkSession, path: str, n_samples: int, annotated: bool = False) -> DataFrame:
    """chrom, pos, ref and, for each sample, a struct of depth, bases (and quals; mapq and zn if annotated)."""
    width = 5 if annotated else 3
    rows = spark.read.text(path).select(_fields(F.col("value")).alias("f"))
    rows = rows.where(F.size("f") == 3 + width * n_samples) if annotated else rows.where(F.size("f") >= 3 * n_samples + 2)
    names = ["depth", "bases", "quals", "mapq", "zn"][:width]
    sample = lambda k: F.struct(*(F.get("f", F.lit(3 + width * k + i)).alias(n) for i, n in enumerate(names)))
    out = rows.select(F.col("f")[0].alias("chrom"), F.expr("try_cast(f[1] as int)").alias("pos"), F.upper(F.substring(F.col("f")[2], 1, 1)).alias("ref"), F.array(*map(sample, range(n_samples))).alias("samples"))
    return out.where("pos is not null")


def pileup_lines(rows: DataFrame, n_samples: int) -> DataFrame:
    """Lines of parsed pileup text in the form of aggregated alignments: cov_t, base_t, del_t, ins_t, dis_t. Commas and
    points are the reference; a sample without reads is tested before its star counts as a deletion."""
    out = rows
    for t in range(1, n_samples + 1):
        s = F.col("samples")[t - 1]
        # the sign behind a read start is a quality and may look like an indel
        body = F.regexp_replace(s["bases"], r"\^.", "")
        clean = F.upper(F.translate(clean_bases(s["bases"]), ",", "."))
        cov = F.coalesce(F.expr(f"try_cast(samples[{t - 1}].depth as int)") >= 1, F.lit(False))
        letters = F.array_distinct(F.filter(F.split(F.translate(clean, "*", ""), ""), lambda x: x != ""))
        base = F.when(cov & (F.size(letters) == 1), F.when(letters[0] == ".", F.col("ref")).otherwise(letters[0]))
        out = out.withColumn(f"cov_{t}", cov).withColumn(f"base_{t}", base).withColumn(f"del_{t}", cov & body.contains("*")).withColumn(f"ins_{t}", cov & body.contains("+"))
        out = out.withColumn(f"dis_{t}", cov & (F.size(letters) > 1))
    return out.drop("samples")


def annotated_reads(rows: DataFrame, n_samples: int) -> DataFrame:
    """A row for each read of an annotated pileup: taxon, chrom, pos, ref, base, mapq, zn, rejects."""
    parts = None
    for t in range(1, n_samples + 1):
        s = F.col("samples")[t - 1]
        one = rows.where(s["depth"] != "0").select("chrom", "pos", "ref", F.arrays_zip(split_reads(s["bases"]).alias("token"), F.split(s["mapq"], "").alias("q"), F.split(s["zn"], ",").alias("zn")).alias("z"))
        one = one.select("chrom", "pos", "ref", F.explode("z").alias("r")).where("r.token is not null and r.q is not null and r.zn is not null and r.q <> ''")
        first = F.when(F.substring("r.token", 1, 1) == "^", F.substring("r.token", 3, 1)).otherwise(F.substring("r.token", 1, 1))
        body = F.when(F.substring("r.token", 1, 1) == "^", F.substring(F.col("r.token"), 3, 100000)).otherwise(F.col("r.token"))
        base = F.when(first.isin(".", ","), F.lit(".")).otherwise(F.upper(first))
        own = one.select(F.lit(t).alias("taxon"), "chrom", "pos", "ref", base.alias("base"), (F.ascii("r.q") - 33).alias("mapq"), F.col("r.zn").cast("int").alias("zn"), (body.contains("*") | body.contains("+")).alias("rejects"))
        parts = own if parts is None else parts.unionByName(own)
    return parts


def repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (chrom, start, end; 1-based, ends in) of a .out file: lines of at least 7 fields that begin with a
    number."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 7) & F.col("f")[0].rlike(r"^[0-9.]+$"))
    a, b = F.col("f")[5].cast("int"), F.col("f")[6].cast("int")
    return rows.select(F.col("f")[4].alias("chrom"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end")).where("start is not null and end is not null")


def windowmasker(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of ``>contig`` records with lines ``start - end`` from 0, both ends in."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    line = F.explode(F.slice(F.split("value", "\n"), 2, 1 << 30))
    rows = rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), line.alias("l")).where(F.col("l").rlike(r"^\s*\d+\s*-\s*\d+"))
    part = lambda i: F.regexp_extract("l", r"^\s*(\d+)\s*-\s*(\d+)", i).cast("int") + 1
    return rows.select("chrom", part(1).alias("start"), part(2).alias("end"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(f.alias("f")).where(F.size("f") >= 3)
    return rows.select(F.col("f")[0].alias("chrom"), (F.col("f")[1].cast("int") + 1).alias("start"), F.col("f")[2].cast("int").alias("end"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema("chromosome string, start int, end int").csv(path).withColumnRenamed("chromosome", "chrom")


def counts_json(spark: SparkSession, path: str, name: str = "label") -> DataFrame:
    """label, n of a {label: n} object."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "map<string,double>")).alias(name, "n"))


COUNTS_HEADERS = {
    ("continuity", "site_class", "label", "mapq_lo", "mapq_hi", "count"): "mode int, site_class string, label string, lo int, hi int, n long",
    ("continuity", "site_class", "label", "mapq_lo", "mapq_hi", "indel_mapq", "count"): "mode int, site_class string, label string, lo int, hi int, indel_mapq int, n long",
}
CALLS_HEADERS = {
    ("chromosome", "position", "continuity", "taxon", c, "mapq_lo", "mapq_hi", "repeat", *extra): f"chrom string, pos int, mode int, taxon string, {c} string, lo int, hi int, repeat int" + ", indel_mapq int" * bool(extra)
    for c in ("mutation", "change")
    for extra in ((), ("indel_mapq",))
}


def _known(spark: SparkSession, path: str, sep: str, headers: dict) -> DataFrame:
    first = spark.read.text(path).limit(1).collect()
    own = tuple(first[0].value.rstrip("\n").split(sep)) if first else ()
    if own not in headers:
        raise ValueError(f"{path}: header {own} is none of the known ones")
    out = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).schema(headers[own]).csv(path).na.fill("", ["label"] if "label" in headers[own] else [])
    return out if "indel_mapq" in out.columns else out.withColumn("indel_mapq", F.lit(None).cast("int"))


def site_counts(spark: SparkSession, path: str) -> DataFrame:
    return _known(spark, path, "\t", COUNTS_HEADERS)


def annotated_calls(spark: SparkSession, path: str) -> DataFrame:
    return _known(spark, path, ",", CALLS_HEADERS)


def matrix(spark: SparkSession, path: str, n_taxa: int) -> DataFrame:
    """chrom, pos, left, right, taxa of a variable-site table."""
    cols = [f"taxa{i}" for i in range(n_taxa)]
    schema = "chromosome string, position int, left string, right string, " + ", ".join(f"{c} string" for c in cols)
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.select(F.col("chromosome").alias("chrom"), F.col("position").alias("pos"), "left", "right", F.array(*cols).alias("taxa"))


def chroms_with_reads(alignments: DataFrame) -> DataFrame:
    return alignments.where(F.col("flag").bitwiseAND(4) == 0).select(F.col("rname").alias("chrom")).distinct()
