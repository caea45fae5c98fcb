"""What several operators share: scratch tables in the cluster's shared folder, row keys, connected components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells rows of documents apart: whether the id is null, the id (0 for null) and a hash of the text.
ROW_KEY = ["none", "id", "th"]
ROW_SCHEMA = "none boolean, id long, th long"


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="helixframe-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or its context's checkpoint
    folder. A session on one machine may do without; a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _own_dir()
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        remove(spark, path)


class Scratch:
    """Written tables that cut lineage; they outlive lost executors.

    An operator drops what its result no longer reads before it returns. The rest belongs to the result and stays until
    the interpreter ends, as a lazy result may be read at any time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/helixframe-{name}-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keys() -> list:
    return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).cast("long").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).cast("long").alias("th")]


def row_keys(docs: DataFrame) -> DataFrame:
    """ROW_KEY and text."""
    return docs.select(*_keys(), "text")


def one_row_each(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """docs joined with ``other`` by ROW_KEY, with the columns of docs and what else ``other`` has. Of rows with equal
    keys the one whose columns have the smallest hash stays, so texts are dealt once and copies have a defined result."""
    taken = {f.name for f in docs.schema if "map<" in f.dataType.simpleString()}
    order = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if c not in taken))
    own = docs.select(*_keys(), F.struct(order.alias("o"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).alias("own"))
    more = [c for c in other.columns if c not in ROW_KEY] if how not in ("left_semi", "left_anti") else []
    own = own.join(other, ROW_KEY, how)
    own = own.groupBy(*ROW_KEY).agg(F.min_by("own.row", "own.o").alias("row"), *(F.first(c).alias(c) for c in more))
    return own.select("row", *more) if more else own.select("row.*")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): component is the smallest id that can be reached.

    Alternating large-star and small-star rounds. A node's smallest neighbour is a grouped minimum, which combines
    before the shuffle. It is written, and joined back from there, so that a hub's edges in that join come straight from
    a shuffle, which adaptive execution splits over several tasks.
    Nodes with no edge are absent. Self-loops and nulls are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = scratch.save(e, f"{name}-0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last, i = mark(e), 0
    while last[0]:
        i += 1
        if i > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = scratch.save(large, f"{name}-large")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a > b").distinct()
        e = scratch.save(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = mark(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    out = scratch.save(e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots), name)
    scratch.drop(f"{name}-{i}", f"{name}-low", f"{name}-large", f"{name}-least")
    return out
