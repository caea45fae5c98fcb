"""Embedding near-duplicates through a pivot-permutation index.

At most ``n_pivots`` reference points are drawn from the rows with the smallest hashes (a bounded sample), spread apart,
so that a dense group holds one and not a share of them: between many pivots in one group noise decides the order. A
vector is described by its ``prefix`` nearest pivots in order. An inverted list of a pivot holds the vectors that have
it in their prefix. Vectors that share at least ``shared`` pivots are candidates, counted in the lists, and candidates
are verified by cosine in double precision.

A dense group of the sample also has a leader, with a list of all vectors near it, who are candidates whatever pivots
they share: nearly all of them link. Leaders are numbered before pivots. A pair that shares several lists belongs to the
smallest one they share, so that each link counts once.

Equal vectors are reduced to one row with a count first. A long list is cut in blocks, and each pair of blocks is a task
of its own, so no list is gathered as a whole. A task emits a number of links for each vector and a spanning forest of
the links, never the pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and form
components of their own; repeated rows (equal vec_id and vector) count as vectors of their own; vectors of different
lengths never link; null ids keep n_links but have no component id unless a linked vector has one, and are kept where
none has; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components

MIN_COSINE = 0.9
PREFIX = 10
SHARED = 2
LIST_ROWS = 512  # aimed at for a list
MAX_PIVOTS = 4096
BLOCK = 2048
SAMPLE = 8192  # rows that pivots and leaders are drawn from
SPREAD = 0.5  # cosine that two pivots stay under
DENSE = 4  # sampled rows near a leader, itself among them


def usable(column: str):
    """A vector that may link: no null or non-finite component, and not all zero."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & sound & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric matrix of links."""
    unseen, out = np.ones(len(near), bool), []
    unseen[~near.any(1)] = False
    while unseen.any():
        start = int(np.argmax(unseen))
        unseen[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & unseen)
            unseen[new] = False
            out += [(x, y) for y in new.tolist()]
            todo += new.tolist()
    return out


def spread_rows(x: np.ndarray, n: int, cosine: float) -> np.ndarray:
    """The places of n rows at most, each the first that no earlier one is as near to as ``cosine``."""
    free, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if len(out) == n:
            break
        if free[i]:
            out.append(i)
            free &= x @ x[i] < cosine
    return np.array(out, np.int64)


def choose_pivots(vectors: DataFrame, n: int, min_cosine: float = MIN_COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Leaders of dense groups and n pivots at most, of the rows with the smallest hashes: a bounded sample."""
    rows = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(max(n, SAMPLE)).collect()
    if not rows:
        return np.empty((0, 0)), np.empty((0, 0))
    x = unit_rows(np.array([r.v for r in rows], np.float64))
    near = near_leader(min_cosine)
    n_near = np.concatenate([(x[lo : lo + 512] @ x.T >= near).sum(1) for lo in range(0, len(x), 512)])
    dense = x[n_near >= DENSE]
    return dense[spread_rows(dense, len(dense), near)], x[spread_rows(x, n, SPREAD)]


def near_leader(min_cosine: float) -> float:
    """A little under the cosine of links, so that a group at that limit has few leaders."""
    return min_cosine - (1 - min_cosine) / 2


def postings(vectors: DataFrame, leaders: np.ndarray, pivots: np.ndarray, prefix: int, near_cosine: float) -> DataFrame:
    """pivot, key, v, near: a row for each list that a vector is in, leaders' lists first; ``near`` names them all."""
    m = min(prefix, len(pivots))
    n = len(leaders)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit_rows(matrix(part.column(1)))
                score = x @ pivots.T
                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
                row, leader = np.nonzero(x @ leaders.T >= near_cosine) if n else (np.empty(0, np.int64),) * 2
                row, name = np.concatenate((row, np.repeat(np.arange(len(x)), m))), np.concatenate((leader, n + top.ravel()))
                by = np.argsort(row, kind="stable")
                row, name = row[by], pa.array(name[by].astype(np.int32))
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x))))).astype(np.int32)
                near, rows = pa.ListArray.from_arrays(pa.array(ends), name), pa.array(row)
                yield pa.RecordBatch.from_arrays([name, part.column(0).take(rows), part.column(1).take(rows), near.take(rows)], names=["pivot", "key", "v", "near"])

    return vectors.select("key", "v").mapInArrow(run, "pivot int, key long, v array<double>, near array<int>")


def verify(table: pa.Table, min_cosine: float, shared: int, n_leaders: int = 0) -> pa.Table:
    """Links within one list, or between two blocks of it: key with its number of links, and the forest's links. Lists
    below ``n_leaders`` are those of leaders."""
    side = table["side"].to_numpy()
    keys = table["key"].to_numpy()
    order = np.lexsort((keys, side))
    table, side, keys = table.take(pa.array(order)), side[order], keys[order]
    x = unit_rows(matrix(table["v"].combine_chunks()))
    near = table["near"].combine_chunks()
    pivot = int(table["pivot"][0].as_py())
    names, codes = np.unique(near.flatten().to_numpy(), return_inverse=True)
    has = np.zeros((len(keys), len(names)), np.float32)
    has[np.repeat(np.arange(len(keys)), near.value_lengths().to_numpy()), codes] = 1
    links = np.zeros((len(keys), len(keys)), bool)
    before = int(np.searchsorted(names, pivot))
    own = int(np.searchsorted(names, n_leaders))  # pivots from here on
    for lo in range(0, len(keys), 512):
        part = slice(lo, lo + 512)
        candidate = has[part, own:] @ has[:, own:].T >= shared if pivot >= n_leaders else np.ones((len(x[part]), len(x)), bool)
        if before:
            candidate &= has[part, :before] @ has[:, :before].T == 0  # else a list before this one has the pair
        links[part] = candidate & (x[part] @ x.T >= min_cosine)
    links[np.arange(len(keys)), np.arange(len(keys))] = False
    if side.any():  # two different blocks: each has its own pairs elsewhere
        links &= side[:, None] != side[None, :]
    n = links.sum(1)
    linked = np.flatnonzero(n)
    pairs = np.array(forest(links), np.int64).reshape(-1, 2)
    a = np.concatenate((keys[linked], keys[pairs[:, 0]]))
    b = np.concatenate((keys[linked], keys[pairs[:, 1]]))
    return pa.table({"a": a, "b": b, "n": np.concatenate((_weighted(links, table)[linked], np.zeros(len(pairs), np.int64)))})


def _weighted(links: np.ndarray, table: pa.Table) -> np.ndarray:
    return links @ table["copies"].to_numpy().astype(np.int64)


def near_duplicates(rows: DataFrame, min_cosine: float = MIN_COSINE, prefix: int = PREFIX, shared: int = SHARED, n_pivots: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id for rows of (vec_id, embedding)."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "permutations")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("ok", usable("v")).withColumn("v", F.when(F.col("ok"), F.col("v")))
    rows = scratch.save(rows.withColumn("h0", F.xxhash64("v")).withColumn("h1", F.xxhash64(F.lit(1), "v")), "rows")
    sound = rows.where("ok")
    # copies: one row for each different vector (told by 128 bits), whose key is its place in a written table
    copies = sound.groupBy("h0", "h1").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = scratch.save(copies.withColumn("key", F.monotonically_increasing_id()), "distinct")
    results, dropped = [], []
    for width in [r.w for r in distinct.select(F.size("v").alias("w")).distinct().orderBy("w").collect()]:
        own = distinct.where(F.size("v") == width)
        n = own.count()
        leaders, pivots = choose_pivots(own, n_pivots or max(16, min(MAX_PIVOTS, prefix * n // LIST_ROWS)), min_cosine)
        results.append(_linked(own, leaders, pivots, min_cosine, prefix, min(shared, len(pivots)), scratch, f"w{width}"))
        dropped += [f"lists-w{width}", f"links-w{width}"]
    if not results:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    found = scratch.save(found, "found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("n = 0").select("a", "b"), scratch)
    own = distinct.join(counts, "key", "left").join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    own = scratch.save(own.select("h0", "h1", "first", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "own")
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    known = scratch.save(own.join(least, "component").select("h0", "h1", "n_links", "component_id"), "known")
    scratch.drop("distinct", "found", "cc", "own", *dropped)
    # two written tables: adaptive execution can split the rows of a vector that is very many rows'
    linked = sound.select("vec_id", "h0", "h1").join(known, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def _linked(own: DataFrame, leaders: np.ndarray, pivots: np.ndarray, min_cosine: float, prefix: int, shared: int, scratch: Scratch, name: str) -> DataFrame:
    lists = scratch.save(postings(own, leaders, pivots, prefix, near_leader(min_cosine)).join(own.select("key", "copies"), "key"), f"lists-{name}")
    sizes = lists.groupBy("pivot").count()  # a row for each list, MAX_PIVOTS + SAMPLE at most
    blocks = sizes.select("pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = lists.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # a row goes to every pair of blocks that its own block is in
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "copies", "v", "near")
    n_leaders = len(leaders)
    out = dealt.groupBy("pivot", "lo", "hi").applyInArrow(lambda t: verify(t, min_cosine, shared, n_leaders), "a long, b long, n long")
    return scratch.save(out, f"links-{name}")


def op6_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
