"""Ordered neighbourhoods without one task a contig.

Lines are dealt by contig and tile. A line's neighbours lie in its tile, or are the last line of the tile before or the
first of the tile behind, which a window over tiles (a row each) finds. Frames of a few positions see copies of the
lines near a tile's edges instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1_000_000


def tile_of(pos: str, tile: int) -> Column:
    return F.floor(F.col(pos) / tile).cast("long")


def with_neighbours(lines: DataFrame, keys: list[str], pos: str, cols: list[str], tile: int = TILE) -> DataFrame:
    """Adds ``before`` and ``behind``, structs of pos and cols of the adjacent lines, however far they are."""
    tiled = lines.withColumn("_tile", tile_of(pos, tile))
    line = F.struct(pos, *[c for c in cols if c != pos])
    own = Window.partitionBy(*keys, "_tile").orderBy(pos)
    ends = tiled.groupBy(*keys, "_tile").agg(F.min_by(line, pos).alias("_first"), F.max_by(line, pos).alias("_last"))
    tiles = Window.partitionBy(*keys).orderBy("_tile")
    ends = ends.select(*keys, "_tile", F.lag("_last").over(tiles).alias("_back"), F.lead("_first").over(tiles).alias("_ahead"))
    out = tiled.withColumn("before", F.lag(line).over(own)).withColumn("behind", F.lead(line).over(own)).join(ends, [*keys, "_tile"])
    return out.withColumn("before", F.coalesce("before", "_back")).withColumn("behind", F.coalesce("behind", "_ahead")).drop("_tile", "_back", "_ahead")


def with_halo(lines: DataFrame, pos: str, reach: int, tile: int = TILE) -> DataFrame:
    """Adds ``_tile`` and ``_own``; lines within reach of another tile come there too, not as its own."""
    tile = max(tile, 2 * reach + 1)
    tiles = F.array_distinct(F.array(*(F.floor((F.col(pos) + d) / tile).cast("long") for d in (0, -reach, reach))))
    return lines.withColumn("_tile", F.explode(tiles)).withColumn("_own", F.col("_tile") == tile_of(pos, tile))


def in_tile(keys: list[str], pos: str) -> Window:
    """Lines with a halo, in order: all frames of one scan use this window, so lines are dealt once."""
    return Window.partitionBy(*keys, "_tile").orderBy(pos)


def far_neighbours(lines: DataFrame, keys: list[str], pos: str, cols: list[str]) -> DataFrame:
    """``before`` and ``behind`` of the lines with a halo that have none there, from a row for each tile."""
    line = F.struct(pos, *cols)
    ends = lines.where("_own").groupBy(*keys, "_tile").agg(F.min_by(line, pos).alias("_first"), F.max_by(line, pos).alias("_last"))
    tiles = Window.partitionBy(*keys).orderBy("_tile")
    ends = ends.select(*keys, "_tile", F.lag("_last").over(tiles).alias("far_before"), F.lead("_first").over(tiles).alias("far_behind"))
    return lines.join(ends, [*keys, "_tile"], "left")


def at_offsets(lines: DataFrame, keys: list[str], pos: str, cols: list[str], offsets: list[int], tile: int = TILE) -> DataFrame:
    """Adds a struct of cols at each offset (``m2 m1 p1 p2``), null where no line is at that position. Lines that have a
    halo of that reach already aren't dealt again."""
    reach = max(abs(d) for d in offsets)
    own = in_tile(keys, pos)
    out = lines if "_tile" in lines.columns else with_halo(lines, pos, reach, tile)
    for d in offsets:
        # lines are distinct positions, so the line d positions away is among the d next ones
        steps = range(1, abs(d) + 1)
        move = F.lag if d < 0 else F.lead
        found = [F.when(move(F.col(pos), k).over(own) == F.col(pos) + d, move(F.struct(*cols), k).over(own)) for k in steps]
        out = out.withColumn(("m" if d < 0 else "p") + str(abs(d)), F.coalesce(*found))
    return out.where("_own").drop("_tile", "_own")
