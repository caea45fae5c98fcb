"""Writers. Large tables are written in parallel; small ones as one file, through a temporary name."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system, complete or not there."""
    tmp, fs = _path(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    to, _ = _path(spark, path)
    fs.delete(to, False)
    fs.rename(tmp, to)


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    return spark.read.text(path, wholetext=True).first().value if fs.exists(p) else None


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def fastq(fragments: DataFrame, path: str) -> None:
    """Four lines a fragment: its name with the 1-based span, bases, plus, top qualities."""
    name = F.concat(F.lit("@"), F.concat_ws("_", "chrom", "start", "end"))
    text = F.concat_ws("\n", name, "seq", F.lit("+"), F.regexp_replace("seq", ".", "I"))
    fragments.select(text.alias("value")).write.mode("overwrite").text(path)


def sam(alignments: DataFrame, path: str) -> None:
    cigar = F.coalesce(F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), ""), F.lit("*"))
    zn = F.when(F.col("zn").isNotNull(), F.concat(F.lit("ZN:i:"), F.col("zn")))
    cols = ["qname", "flag", "rname", F.col("start0") + 1, "mapq", cigar, F.lit("*"), F.lit(0), F.lit(0), F.coalesce("seq", F.lit("*")), F.lit("*"), zn]
    alignments.select(F.concat_ws("\t", *cols).alias("value")).write.mode("overwrite").text(path)


def sorted_alignments(alignments: DataFrame, path: str) -> None:
    """Parquet in the order of position, so that a region is read by its statistics."""
    alignments.repartitionByRange("rname", "start0").sortWithinPartitions("rname", "start0").write.mode("overwrite").parquet(path)


def calls_csv(calls: DataFrame, path: str, fai: DataFrame | None = None) -> None:
    """chromosome, position and the rest, contigs in the order of the index; parts are in order."""
    own = calls if fai is None else calls.join(fai.select("chrom", "contig_ord"), "chrom", "left")
    order = (["contig_ord"] if fai is not None else ["chrom"]) + ["pos"]
    own.orderBy(*order).drop("contig_ord").withColumnsRenamed({"chrom": "chromosome", "pos": "position"}).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def counts_json(counts: DataFrame, label: str, path: str) -> None:
    """{label: n} of a bounded set of labels."""
    rows = counts.select(label, "n").orderBy(label).collect()
    write_text(counts.sparkSession, path, json.dumps({r[0]: r[1] for r in rows}, indent=1))


def table_tsv(table: DataFrame, key: str, path: str) -> None:
    """A small table in the order of its key."""
    rows = table.orderBy(key).collect()
    lines = ["\t".join(table.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows)]
    write_text(table.sparkSession, path, "\n".join(lines) + "\n")


def bed(intervals: DataFrame, path: str) -> None:
    own = intervals.select("chrom", (F.col("start") - 1).alias("start"), "end")
    own.orderBy("chrom", "start").write.mode("overwrite").option("sep", "\t").csv(path)


def read_intervals(intervals: DataFrame, path: str) -> None:
    own = intervals.select(F.col("chrom").alias("chromosome"), "start", "end")
    own.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def site_counts(counts: DataFrame, path: str, indel: bool) -> None:
    cols = [F.col("mode").alias("continuity"), "site_class", "label", F.col("lo").alias("mapq_lo"), F.col("hi").alias("mapq_hi"), *(["indel_mapq"] if indel else []), F.col("n").alias("count")]
    own = counts.orderBy("mode", "site_class", "label", "lo", "hi", "indel_mapq").select(*cols)
    own.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").option("emptyValue", "").csv(path)


def annotated_calls(calls: DataFrame, path: str, indel: bool) -> None:
    own = calls.orderBy("chrom", "pos", "mode").select(
        F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.col("mode").alias("continuity"), "taxon", "mutation", F.col("lo").alias("mapq_lo"), F.col("hi").alias("mapq_hi"), "repeat", *(["indel_mapq"] if indel else [])
    )
    own.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def matrix_csv(sites: DataFrame, n_taxa: int, path: str) -> None:
    cols = [F.col("taxa")[i].alias(f"taxa{i}") for i in range(n_taxa)]
    sites.orderBy("chrom", "pos").select(F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), "left", "right", *cols).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def branches(mutations: DataFrame, path: str, header: bool = True) -> None:
    """A folder a branch, tables with tabs; without header as older tools write them."""
    mutations.write.mode("overwrite").partitionBy("branch").option("header", header).option("sep", "\t").option("compression", "gzip").csv(path)


def phylip_infile(blocks: DataFrame, path: str) -> None:
    """One file of blocks (taxon, part, i, bases; of ``fitch.phylip_blocks``), a line a taxon. Blocks are written in
    order as they pass one task, so that neither it nor the driver holds a line."""
    from .bam import open_path

    from_, fs = _path(blocks.sparkSession, f"{path}.tmp")
    tmp = fs.makeQualified(from_).toString()  # Arrow's file systems know neither working folder nor default
    blocks.write.mode("overwrite").parquet(f"{path}.blocks")
    own = blocks.sparkSession.read.schema(blocks.schema).parquet(f"{path}.blocks")
    taxa, sites = own.agg(F.countDistinct("taxon"), F.sum(F.when(F.col("taxon") == 0, F.length("bases")))).first()

    def run(batches):
        fs, at = open_path(tmp)
        with fs.open_output_stream(at) as out:
            out.write(f"{taxa} {sites or 0}\n".encode())
            taxon = None
            for batch in batches:
                for t, bases in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if t != taxon:
                        out.write((f"{'' if taxon is None else chr(10)}{f'taxa{t}':<10}").encode())
                        taxon = t
                    out.write(bases.as_py().encode())
            if taxon is not None:
                out.write(b"\n")
        yield pa.RecordBatch.from_pydict({"done": [1]})

    own.repartition(1).sortWithinPartitions("taxon", "part", "i").select("taxon", "bases").mapInArrow(run, "done long").collect()
    to, _ = _path(blocks.sparkSession, path)
    fs.delete(to, False)
    fs.rename(from_, to)
    remove(blocks.sparkSession, f"{path}.blocks")


def merge_summary(spark: SparkSession, path: str, section: dict) -> dict:
    """Adds sections to a JSON summary."""
    old = read_text(spark, path)
    out = (json.loads(old) if old else {}) | section
    write_text(spark, path, json.dumps(out, indent=1, sort_keys=True))
    return out
