"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots. The bytes of each slot are aggregated (as many rows as slots, whatever the
input), and a versioned slot-to-shard map is edited, not rebuilt, when shards are rebalanced or added. Only the map is
ever broadcast; it has ``n_slots`` rows.

Edge cases: a null text has no bytes and size 1; a null id hashes like any value; repeated rows share a slot and get
places of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, exists, shared_dir

N_SLOTS = 4096


@dataclass
class SlotMap:
    """Versions of a slot-to-shard map; versions[v][slot] is the shard. Edits append a version."""

    n_slots: int
    n_shards: int
    versions: list[list[int]] = field(default_factory=list)

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(n_slots, n_shards, [[s % n_shards for s in range(n_slots)]])

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.current):
            out[shard] += weights[slot]
        return out

    def rebalance(self, weights: list[int], max_moves: int | None = None, slack: int = 0) -> int:
        """Moves or swaps slots between the fullest and the emptiest shard while that narrows their gap, and the gap
        is over ``slack``. Returns the number of slots moved; the map, if edited, is a new version."""
        owner, loads, moved = list(self.current), self.loads(weights), 0
        held: list[set[int]] = [set() for _ in range(self.n_shards)]
        for slot, shard in enumerate(owner):
            if weights[slot]:
                held[shard].add(slot)
        while max_moves is None or moved < max_moves:
            order = sorted(range(self.n_shards), key=lambda s: (loads[s], s))
            lo, hi = order[0], order[-1]
            gap = loads[hi] - loads[lo]
            best, move = gap, None
            for slot in held[hi]:
                left = abs(gap - 2 * weights[slot])
                if (left, slot) < (best, -1 if move is None else move[0]):
                    best, move = left, (slot, None)
            if move is None or best > gap // 4:  # no single slot closes most of the gap: try a swap
                ups = sorted((weights[s], s) for s in held[hi])
                downs = sorted((weights[s], s) for s in held[lo])
                j = 0
                for w, s in ups:
                    while j + 1 < len(downs) and abs(gap - 2 * (w - downs[j + 1][0])) <= abs(gap - 2 * (w - downs[j][0])) and downs[j + 1][0] <= w:
                        j += 1
                    if downs and abs(gap - 2 * (w - downs[j][0])) < best:
                        best, move = abs(gap - 2 * (w - downs[j][0])), (s, downs[j][1])
            if move is None or best >= gap or gap <= slack:
                break
            for slot, a, b in ((move[0], hi, lo), (move[1], lo, hi)):
                if slot is not None:
                    owner[slot] = b
                    held[a].discard(slot)
                    held[b].add(slot)
                    loads[a] -= weights[slot]
                    loads[b] += weights[slot]
                    moved += 1
        if moved:
            self.versions.append(owner)
        return moved

    def add_shard(self, weights: list[int]) -> int:
        """One more shard, which takes slots from the others and gives none; a new version."""
        owner, new = list(self.current), self.n_shards
        loads = [*self.loads(weights), 0]
        self.n_shards += 1
        target = sum(loads) / self.n_shards
        moved = 0
        for slot in sorted(range(self.n_slots), key=lambda s: (-weights[s], s)):
            shard = owner[slot]
            if weights[slot] and loads[shard] - weights[slot] >= target - weights[slot] / 2 and loads[new] + weights[slot] <= target + weights[slot] / 2:
                owner[slot] = new
                loads[shard] -= weights[slot]
                loads[new] += weights[slot]
                moved += 1
        self.versions.append(owner)
        return moved

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds a table for each version that ``path`` doesn't hold yet; versions never change."""
        for v, owner in enumerate(self.versions):
            if not exists(spark, f"{path}/version-{v}/_SUCCESS"):
                rows = [(self.n_shards if v == len(self.versions) - 1 else max(owner) + 1, slot, shard) for slot, shard in enumerate(owner)]
                spark.createDataFrame(rows, "n_shards int, vslot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version-{v}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The map with all its versions, or none where nothing is kept."""
        versions, n_shards = [], 0
        while exists(spark, f"{path}/version-{len(versions)}/_SUCCESS"):
            rows = spark.read.parquet(f"{path}/version-{len(versions)}").orderBy("vslot").collect()  # a row for each slot
            versions.append([r.shard for r in rows])
            n_shards = rows[0].n_shards
        return cls(len(versions[0]), n_shards, versions) if versions else None


def with_slots(df: DataFrame, key: list, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds ``vslot``, the virtual slot of each record."""
    return df.withColumn("vslot", F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int"))


def slot_weights(rows: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: n_slots rows at most reach the driver."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[r.vslot], count[r.vslot] = r["size"], r.n
    return size, count


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Shards of near-equal bytes, with every row's place in its shard.

    ``map_path`` keeps the slot map between runs: a run loads its last version, adds shards if there are to be more,
    moves what slots it must for shards of near-equal bytes, and adds its edits as versions. Without it the map starts
    anew. A kept map with another number of slots, or with more shards than asked for, is refused.

    Returns doc_id, size, text_crc32, vslot, map_version, shard, slot. ``slot`` counts from 0 without gaps in each
    shard: rows are numbered within their virtual slot, and each virtual slot starts where the one before it ends, so
    no shard is ever sorted as a whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = scratch.save(with_slots(rows, ["doc_id", "size", "text_crc32"], n_slots), "rows")
    size, count = slot_weights(rows, n_slots)
    slots = (SlotMap.load(spark, map_path) if map_path else None) or SlotMap.initial(n_slots, n_shards)
    if slots.n_slots != n_slots or slots.n_shards > n_shards:
        raise ValueError(f"{map_path}: {slots.n_slots} slots, {slots.n_shards} shards")
    while slots.n_shards < n_shards:
        slots.add_shard(size)
    slots.rebalance(size)
    if map_path:
        slots.save(spark, map_path)
    base, at = [0] * n_slots, [0] * n_shards
    for v, shard in enumerate(slots.current):
        base[v] = at[shard]
        at[shard] += count[v]
    table = spark.createDataFrame([(v, s, base[v]) for v, s in enumerate(slots.current)], "vslot int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("place", place).join(F.broadcast(table), "vslot").select(
        "doc_id", "size", "text_crc32", "vslot", F.lit(len(slots.versions) - 1).alias("map_version"), "shard", (F.col("base") + F.col("place") - 1).alias("slot")
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the map of these tables lies in the cluster's shared folder, for the next run to edit
    kept = f"{shared_dir(spark)}/helixframe-slot-maps/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    out = shard_documents(documents(spark, sf_dir), map_path=kept)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
