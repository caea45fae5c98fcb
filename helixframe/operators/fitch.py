"""Fitch parsimony as generated columns: one bit mask a node, children first for the sets, parents first for the states.
The tree is fixed, so both passes are narrow projections of the matrix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import directed_label, settle
from ..plans.tree import Flat

BITS = {"A": 1, "C": 2, "G": 4, "T": 8}


def _mask(c: Column) -> Column:
    out = F.lit(16)  # any other sign is a state of its own
    for base, bit in BITS.items():
        out = F.when(c == base, bit).otherwise(out)
    return out


def _letter(m: Column) -> Column:
    out = F.lit("N")
    for base, bit in BITS.items():
        out = F.when(m == bit, base).otherwise(out)
    return out


def _join(a: Column, b: Column) -> Column:
    both = a.bitwiseAND(b)
    return F.when(both != 0, both).otherwise(a.bitwiseOR(b))


def _levels(tree: Flat) -> tuple[list[list[int]], list[list[int]]]:
    """Nodes by height over their leaves, and by depth below the root."""
    n = len(tree.parent)
    height, depth = [0] * n, [0] * n
    for i in reversed(range(n)):
        height[i] = 1 + max(height[c] for c in tree.children[i]) if tree.children[i] else 0
    for i in range(1, n):
        depth[i] = depth[tree.parent[i]] + 1
    return [[[i for i in range(n) if of[i] == k] for k in range(max(of) + 1)] for of in (height, depth)]


def states(matrix: DataFrame, tree: Flat) -> DataFrame:
    """Adds s0, s1, ...: each node's set of states. Children are joined in their order; ``unions`` counts the joins
    that had nothing in common, which is the parsimony score where every node has two children."""
    unions = F.lit(0)
    for level in _levels(tree)[0]:
        fresh = {}
        for i in level:
            if not tree.children[i]:
                fresh[f"s{i}"] = _mask(F.col("taxa")[tree.column[i]])
                continue
            cur = F.col(f"s{tree.children[i][0]}")
            for c in tree.children[i][1:]:
                unions = unions + (cur.bitwiseAND(F.col(f"s{c}")) == 0).cast("int")
                cur = _join(cur, F.col(f"s{c}"))
            fresh[f"s{i}"] = cur
        matrix = settle(matrix, fresh)
    return matrix.withColumn("unions", unions)


def resolve(matrix: DataFrame, tree: Flat) -> DataFrame:
    """Adds changes, an array of (branch, old, new), and ambiguous, the number of points that couldn't be resolved: the
    root, or nodes with several states none of which is the parent's; their subtrees are left."""
    keep = [*matrix.columns, "unions"]
    out = states(matrix, tree)
    one = lambda c: F.bit_count(c) == 1
    ambiguous = F.when(one(F.col("s0")), 0).otherwise(1)
    out = settle(out, {"alive0": one(F.col("s0")), "x0": F.col("s0")})
    changes = []
    for level in _levels(tree)[1][1:]:
        fresh = {}
        for i in level:
            p = tree.parent[i]
            own, parent, alive = F.col(f"s{i}"), F.col(f"x{p}"), F.col(f"alive{p}")
            inside = own.bitwiseAND(parent) != 0
            ambiguous = ambiguous + F.when(alive & ~inside & ~one(own), 1).otherwise(0)
            branch = f"{tree.label[p]}→{tree.label[i]}"
            changes.append(F.when(alive & ~inside & one(own), F.struct(F.lit(branch).alias("branch"), _letter(parent).alias("old"), _letter(own).alias("new"))))
            fresh |= {f"alive{i}": alive & (inside | one(own)), f"x{i}": F.when(inside, parent).otherwise(own)}
        out = settle(out, fresh)
    return out.select(*keep, F.array_compact(F.array(*changes)).alias("changes"), ambiguous.alias("ambiguous"))


def branch_mutations(resolved: DataFrame) -> DataFrame:
    """branch, chrom, pos, mutation."""
    rows = resolved.select("chrom", "pos", "left", "right", F.explode("changes").alias("c"))
    return rows.select("c.branch", "chrom", "pos", directed_label("left", "c.old", "c.new", "right").alias("mutation"))


def branch_spectra(mutations: DataFrame) -> DataFrame:
    return mutations.groupBy("branch", "mutation").agg(F.count(F.lit(1)).alias("n"))


def score(matrix: DataFrame, tree: Flat) -> DataFrame:
    """One row: sites and the parsimony score of the tree."""
    return states(matrix, tree).agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum("unions"), F.lit(0)).alias("score"))


MOST_SITES = 1_000_000  # that a tree search is given


def sample_sites(matrix: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All sites if there are n at most, else n of them without replacement: those with the smallest md5 of seed,
    contig and position. Counts by the hash's beginning tell where the n-th lies, so only that part is ranked."""
    matrix = matrix.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "chrom", F.col("pos").cast("string")).cast("binary")))
    part = F.substring("_h", 1, 4)
    counts = sorted((r["p"], r["n"]) for r in matrix.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 at most
    whole = 0
    for p, count in counts:
        if whole + count > n:
            rest = matrix.where(part == p).orderBy("_h", "chrom", "pos").limit(n - whole)
            return matrix.where(part < p).unionByName(rest).drop("_h")
        whole += count
    return matrix.drop("_h")


def phylip_blocks(matrix: DataFrame) -> DataFrame:
    """taxon, part, i, bases: each taxon's bases in order of position, in blocks. Sites are sorted by ranges, and a task
    turns some thousands at a time; parts, and the blocks of a part, are in order."""
    parts = 4 * int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = matrix.select("chrom", "pos", F.array_join("taxa", "", "N").alias("bases")).repartitionByRange(parts, "chrom", "pos").sortWithinPartitions("chrom", "pos")

    def run(batches):
        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.frombuffer("".join(batch.column(0).to_pylist()).encode(), np.uint8).reshape(batch.num_rows, -1)
            n = table.shape[1]
            cols = [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([i] * n, pa.int32()), pa.array([x.tobytes().decode() for x in table.T])]
            yield pa.RecordBatch.from_arrays(cols, names=["taxon", "part", "i", "bases"])
            i += 1

    return rows.select("bases").mapInArrow(run, "taxon int, part int, i int, bases string")


def phylip_digests(blocks: DataFrame) -> DataFrame:
    """taxon, digest (md5) and n of each taxon's line, which passes a task block by block and is never held."""

    def run(batches):
        taxon, seen, n = None, hashlib.md5(), 0
        out = lambda: pa.RecordBatch.from_pydict({"taxon": pa.array([taxon], pa.int32()), "digest": [seen.hexdigest()], "n": [n]})
        for batch in batches:
            for t, bases in zip(batch.column(0).to_pylist(), batch.column(1)):
                if t != taxon:
                    if taxon is not None:
                        yield out()
                    taxon, seen, n = t, hashlib.md5(), 0
                bases = bases.as_py().encode()
                seen.update(bases)
                n += len(bases)
        if taxon is not None:
            yield out()

    dealt = blocks.repartition("taxon").sortWithinPartitions("taxon", "part", "i")
    return dealt.select("taxon", "bases").mapInArrow(run, "taxon int, digest string, n long")
