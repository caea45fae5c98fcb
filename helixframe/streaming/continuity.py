"""Neighbourhoods of pseudo-reads over a stream, micro-batch by micro-batch.

A pseudo-read is decided when the ``run - 1`` pseudo-reads behind it are known. The state of a species is its last
``2 * (run - 1)`` pseudo-reads that count: those that wait, and as many before them that they may depend on. It is a
table for each epoch, so a stream that starts again goes on where it was, and an epoch that is replayed finds the state
it had and gives the same rows. Batches must come in the order of pseudo-reads, as files of an aligner do; within a
batch order does not matter. A pseudo-read that counts and comes when one at its place or behind it is decided is late: it
could have changed what is decided, so it is told, and set apart or an error, but never used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reads import continuity_status, neighbour_mapq, well_mapped


class NeighbourStream:
    """For ``foreachBatch``: ``sink(rows, epoch)`` gets each batch's decided rows; an epoch that comes again gives the
    same rows, so a sink that replaces an epoch's rows is exact. ``close()`` decides the rows that still wait.
    ``late(rows, epoch)`` gets what came late, if there is any; without it such rows are an error."""

    def __init__(self, sink: Callable[[DataFrame, int], None], state_path: str, decide: Callable[[DataFrame], DataFrame], low_mapq: int, run: int, late: Callable[[DataFrame, int], None] | None = None):
        if run < 2:
            raise ValueError("the run must be at least 2")
        self.sink, self.path, self.decide, self.low_mapq, self.reach, self.late = sink, state_path.rstrip("/"), decide, low_mapq, run - 1, late

    def _epochs(self, spark: SparkSession) -> list[int]:
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n[5:]) for n in names if n.startswith("epoch") and whole(n))

    def _state(self, spark: SparkSession, before: float) -> DataFrame | None:
        """What the last epoch before this one left."""
        known = [e for e in self._epochs(spark) if e < before]
        return spark.read.parquet(f"{self.path}/epoch{known[-1]}") if known else None

    def _forget(self, spark: SparkSession, before: int) -> None:
        """Drops states that no replay can ask for: the last two stay."""
        for e in [e for e in self._epochs(spark) if e < before][:-1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch{e}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def _counts(self):
        return well_mapped() & (F.col("mapq") >= self.low_mapq)

    def _in_time(self, batch: DataFrame, old: DataFrame, epoch: int) -> DataFrame:
        """A batch without its late rows, which are told."""
        top = old.where("_decided").groupBy("species").agg(F.max("frag_ord").alias("_top"))  # a row a species
        is_late = F.coalesce(self._counts() & (F.col("frag_ord") <= F.col("_top")), F.lit(False))
        own = batch.join(F.broadcast(top), "species", "left").withColumn("_late", is_late)
        late = own.where("_late").select(*batch.columns)
        n = late.count()
        if n and self.late is None:
            raise ValueError(f"{n} rows of epoch {epoch} came behind rows that are decided")
        if n:
            self.late(late, epoch)
        return own.where("not _late").select(*batch.columns)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = self._state(spark, epoch)
        rows = (batch if old is None else self._in_time(batch, old, epoch)).withColumn("_decided", F.lit(False))
        rows = (rows if old is None else rows.unionByName(old)).persist()
        try:
            groups = rows.where(self._counts()).select("species", "frag_ord").distinct()
            rank = F.row_number().over(Window.partitionBy("species").orderBy(F.desc("frag_ord")))  # of one batch
            last = groups.withColumn("_r", rank).where(F.col("_r") <= 2 * self.reach)
            edge = last.groupBy("species").agg(F.min(F.when(F.col("_r") <= self.reach, F.col("frag_ord"))).alias("_wait"), F.min("frag_ord").alias("_keep")).persist()  # a row a species
            decided = self.decide(rows).join(F.broadcast(edge), "species", "left")
            waits = F.coalesce(self._counts() & (F.col("frag_ord") >= F.col("_wait")), F.lit(False))
            self.sink(decided.where(~F.col("_decided") & ~waits).drop("_decided", "_wait", "_keep"), epoch)
            kept = rows.join(F.broadcast(edge), "species").where(self._counts() & (F.col("frag_ord") >= F.col("_keep")))
            kept = kept.withColumn("_decided", F.col("frag_ord") < F.col("_wait")).select(*batch.columns, "_decided")
            kept.write.mode("overwrite").parquet(f"{self.path}/epoch{epoch}")
            edge.unpersist()
        finally:
            rows.unpersist()
        self._forget(spark, epoch)

    def close(self, spark: SparkSession) -> None:
        old = self._state(spark, float("inf"))
        if old is not None:
            self.sink(self.decide(old).where("not _decided").drop("_decided"), -1)


class ContinuityStream(NeighbourStream):
    """The continuity filter: rows with their status."""

    def __init__(self, sink, state_path: str, low_mapq: int = 1, threshold: int = 60, run: int = 2, late=None):
        super().__init__(sink, state_path, lambda rows: continuity_status(rows, low_mapq, threshold, run), low_mapq, run, late)


class NeighbourQualityStream(NeighbourStream):
    """The tagger: rows that stay, with zn."""

    def __init__(self, sink, state_path: str, low_mapq: int = 1, late=None):
        super().__init__(sink, state_path, lambda rows: neighbour_mapq(rows, low_mapq), low_mapq, 2, late)
