"""Nested blocks: inserts joined with block definitions level by level, carrying the composed placement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G

def expand_blocks(entities: DataFrame, blocks: DataFrame, max_depth: int = 3, degrees: bool | None = None, transform: bool = True) -> DataFrame:
    """Leaves of top-level ``entities`` and of the ``blocks`` that they insert, with world x, y and depth.

    Both have type, name (of the block that an INSERT places), x, y, x_scale, y_scale, rotation and whatever else; ``blocks`` also
    has block. One equi-join for each level; what lies deeper than ``max_depth`` is dropped, so cycles end. A scale of 0 or
    null is 1, a null rotation 0. With ``transform`` off, positions stay local.
    """
    columns = [c for c in entities.columns if c not in ("x", "y")]
    level = entities.withColumns({"_m": G.insert_matrix(0.0, 0.0, 1.0, 1.0, 0.0), "depth": F.lit(0)})
    scale = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c)).otherwise(1.0)
    found = []
    for depth in range(max_depth + 1):
        at = G.apply_matrix(F.col("_m"), F.col("x"), F.col("y")) if transform else G.point(F.col("x"), F.col("y"))
        found.append(level.where("type <> 'INSERT'").select(*columns, at["x"].alias("x"), at["y"].alias("y"), "depth"))
        if depth == max_depth:
            break
        own = G.insert_matrix(F.col("x"), F.col("y"), scale("x_scale"), scale("y_scale"), F.coalesce("rotation", F.lit(0.0)), degrees)
        placed = level.where("type = 'INSERT' and name is not null").select("root_id", F.col("name").alias("block"), G.compose(F.col("_m"), own).alias("_m"))
        level = placed.join(blocks, "block").drop("block").withColumn("depth", F.lit(depth + 1))
    return reduce(DataFrame.unionByName, found)
