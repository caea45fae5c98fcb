"""Exact top-k inner products by a Voronoi join.

Inner products become distances: with M the largest norm, x gets one more component sqrt(M^2 - |x|^2) and a query q a
zero, so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and for queries of one cell the largest products are the smallest distances
up to |q|. To compare across norms queries are scaled to length M first, which changes no query's order.

Queries and data are grouped by their nearest pivots. From a summary of each cell (its radius, and the k + 1 rows
nearest its pivot) follows, for each cell of queries, a bound on how far any k-th neighbour can be. A row is replicated
only to the cells of queries whose bound it can meet: neither its distance to the pivot less the cell's radius, nor its
distance to the plane halfway between that pivot and its own one, behind which all the cell's queries lie, may exceed
the bound. Bounds carry a slack for rounding, and scores are computed again in integers, so the result is exact.

Cells of queries that lie near each other form groups of about ``BLOCK_QUERIES`` queries, and a row goes once to each
group that has a cell for it: in many dimensions the bounds spare little, and then each row meets each group once. Rows
dealt are thus at most rows times queries over ``BLOCK_QUERIES``, so a block is as large as a task can well hold. A
group is solved in blocks of queries and of replicated rows, whose results are merged. There are about as many pivots as
the root of the rows, ``MAX_PIVOTS`` at most, from a bounded sample, and the summary has at most (k + 1) rows a cell.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different
lengths don't meet; null ids take no part; repeated rows are candidates each, but a query is one row of its id, and no
row of its own id is its candidate; with fewer candidates than k all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .permutation_index import matrix

K = 10
MIN_PIVOTS, MAX_PIVOTS = 16, 1024
BLOCK_ROWS = 1 << 15
BLOCK_QUERIES = 1 << 14
SLACK = 1e-6  # of M, many times the rounding of these sums


def _augment(x: np.ndarray, big: float, query: bool) -> np.ndarray:
    """Rows with one more component, over M."""
    x = x / big
    norm = (x * x).sum(1)
    if query:
        scale = np.where(norm > 0, 1 / np.sqrt(np.where(norm > 0, norm, 1)), 0)
        return np.column_stack((x * scale[:, None], np.zeros(len(x))))
    return np.column_stack((x, np.sqrt(np.maximum(0, 1 - norm))))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))


class Join:
    """The pivots, and after ``bound`` the radius and bound of each cell of queries."""

    def __init__(self, pivots: np.ndarray, big: float, k: int):
        self.pivots, self.big, self.k = pivots, big, k
        n = len(pivots)
        self.radius, self.limit = np.full(n, -1.0), np.full(n, np.inf)
        self.group = np.zeros(n, np.int64)
        between = _distances(pivots, pivots)
        self.twice = np.where(between > SLACK, 2 * between, np.inf)  # from pivots too near for a plane nothing follows

    def cells(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(_augment(x, self.big, query), self.pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(d)), cell]

    def bound(self, radius: dict[int, float], nearest: list[tuple[int, float, int]]) -> None:
        """radius: of the cells of queries. nearest: cell, distance and id of the ids nearest each pivot. k ids besides
        a query's own lie within its cell's bound."""
        cell, d = np.array([c for c, _, _ in nearest], int), np.array([x for _, x, _ in nearest])
        ids = np.array([i for _, _, i in nearest], np.int64)
        between = _distances(self.pivots, self.pivots)
        for c, r in radius.items():
            self.radius[c] = r
            upper = r + between[c, cell] + d
            order = np.argsort(upper, kind="stable")
            _, first = np.unique(ids[order], return_index=True)
            upper = upper[order[np.sort(first)]]
            self.limit[c] = upper[self.k] if len(upper) > self.k else np.inf

    def form_groups(self, count: dict[int, int], size: int) -> None:
        """Groups of neighbouring cells: a walk from cell to nearest cell, cut where a group has ``size`` queries."""
        left, between = set(count), _distances(self.pivots, self.pivots)
        cell, group, held = min(left, default=None), 0, 0
        while cell is not None:
            left.discard(cell)
            self.group[cell] = group
            held += count[cell]
            if held >= size:
                group, held = group + 1, 0
            cell = min(left, key=lambda c: (between[cell, c], c), default=None)

    def wanted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and group of queries, for each that the row may serve."""
        d = _distances(_augment(x, self.big, False), self.pivots)
        cell = d.argmin(1)
        beyond = (d * d - d[np.arange(len(d)), cell][:, None] ** 2) / self.twice[cell]
        near = np.maximum(d - self.radius, beyond) <= self.limit + SLACK
        order = np.argsort(np.where(self.radius >= 0, self.group, -1), kind="stable")
        order = order[self.radius[order] >= 0]  # cells of queries, a group's together
        if not len(order):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        groups, starts = np.unique(self.group[order], return_index=True)
        row, at = np.nonzero(np.logical_or.reduceat(near[:, order], starts, axis=1))
        return row, groups[at]


def top_k(rows: DataFrame, is_query, k: int = K, n_pivots: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for rows of (vec_id, v), v an array of longs, and a condition for queries."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "voronoi")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = scratch.save(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("q")), "rows")
    out_schema = "query_id long, rank int, vec_id long, score long"
    out = None
    for width in sorted(r.w for r in rows.select(F.size("v").alias("w")).distinct().collect()):
        own = _top_k(rows.where(F.size("v") == width), k, n_pivots, scratch, f"w{width}")
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], out_schema) if out is None else out


def _top_k(rows: DataFrame, k: int, n_pivots: int | None, scratch: Scratch, name: str) -> DataFrame:
    """``top_k`` for vectors of one length; q marks queries."""
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most, n_rows = rows.agg(F.max(square), F.count(F.lit(1))).first()
    big = max(1.0, float(most) ** 0.5) * (1 + 1e-9)
    n_pivots = n_pivots or max(MIN_PIVOTS, min(MAX_PIVOTS, int(n_rows**0.5)))
    sample = rows.select("v").orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(n_pivots).collect()  # bounded
    pivots = np.unique(_augment(np.array([r["v"] for r in sample], np.float64), big, False), axis=0)
    join = Join(pivots, big, k)

    def assign(batches):
        for batch in batches:
            x, q = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            cell, d = join.cells(x, False)
            ids = batch.column(0).to_numpy()
            cols = [(cell, d, np.zeros(len(cell), bool), ids)]
            if q.any():
                cell, d = join.cells(x[q], True)
                cols.append((cell, d, np.ones(len(cell), bool), ids[q]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols)], names=["cell", "d", "q", "vec_id"])

    cells = rows.mapInArrow(assign, "cell long, d double, q boolean, vec_id long")
    # each cell's k + 1 nearest ids: a heap in each group would do, here a rank over cell and a random part first
    part = Window.partitionBy("cell", "part").orderBy("d")
    near = cells.where("not q").groupBy("cell", "vec_id").agg(F.min("d").alias("d")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    near = near.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("r") <= k + 1)
    nearest = [(r["cell"], r["d"], r["vec_id"]) for r in near.select("cell", "d", "vec_id").collect()]
    of_cell = cells.where("q").groupBy("cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    join.bound({r["cell"]: r["r"] for r in of_cell}, nearest)
    join.form_groups({r["cell"]: r["n"] for r in of_cell}, BLOCK_QUERIES)

    def replicate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                p = batch.slice(at, 2048)
                row, cell = join.wanted(matrix(p.column(1)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell), p.column(0).take(take), p.column(1).take(take)], names=["cell", "vec_id", "v"])

    def place(batches):
        for batch in batches:
            cell, _ = join.cells(matrix(batch.column(1)), True)
            yield pa.RecordBatch.from_arrays([pa.array(join.group[cell]), batch.column(0), batch.column(1)], names=["cell", "vec_id", "v"])

    schema = "cell long, vec_id long, v array<long>"
    data = scratch.save(rows.select("vec_id", "v").mapInArrow(replicate, schema), f"data-{name}")
    queries = scratch.save(rows.where("q").select("vec_id", "v").dropDuplicates(["vec_id"]).mapInArrow(place, schema), f"queries-{name}")

    def blocks(df: DataFrame, size: int) -> DataFrame:
        """cell, n: blocks of each group; a row for each of n_pivots groups at most."""
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))

    n = blocks(data, BLOCK_ROWS).withColumnRenamed("n", "n_data").join(blocks(queries, BLOCK_QUERIES).withColumnRenamed("n", "n_queries"), "cell")
    n = F.broadcast(spark.createDataFrame(n.collect(), n.schema))
    spread = lambda df, own, other, mine, others: df.join(n, "cell").withColumn(mine, F.pmod(F.xxhash64("vec_id", "v"), F.col(own)).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("cell", "db", "qb", "vec_id", "v")
    left = spread(data, "n_data", "n_queries", "db", "qb").groupBy("cell", "db", "qb")
    right = spread(queries, "n_queries", "n_data", "qb", "db").groupBy("cell", "db", "qb")

    def integers(t: pa.Table) -> np.ndarray:
        return t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)

    def solve(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        """The best of one block of rows for one block of queries, in integers."""
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not rows.num_rows or not wanted.num_rows:
            return none
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        ids = rows["vec_id"].to_numpy()[order]
        x = integers(rows)[order]
        out: list[tuple] = []
        query_ids, q = wanted["vec_id"].to_numpy(), integers(wanted)
        exact = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * x.shape[1] < 1 << 53
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            score = (part.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else part @ x.T
            for i, own in enumerate(score):
                other = ids != query_ids[at + i]
                own, its = own[other], ids[other]
                best = np.argsort(-own, kind="stable")[:k] if len(own) <= 4 * k else _best(own, k)
                out.append((np.full(len(best), query_ids[at + i]), its[best], own[best]))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = left.cogroup(right).applyInArrow(solve, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, the first of equals first."""
    least = np.partition(score, len(score) - k)[len(score) - k]
    at = np.flatnonzero(score >= least)
    return at[np.argsort(-score[at], kind="stable")][:k]


def scaled(column: str, scale: int = 1024):
    """floor(scale * x) of each component as a double; null where a component is null or not finite."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def op4_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", scaled("embedding").alias("v"))
    return top_k(rows, F.coalesce(F.pmod(F.col("vec_id"), F.lit(100)) == 0, F.lit(False)))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
