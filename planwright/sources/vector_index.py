"""An exact vector index on files: cells about pivots, searched cell by cell with bounds.

The folder has ``cells`` (unit vectors, partitioned by cell) and ``pivots`` (one row per cell: pivot, radius, number). A search reads the pivots, then the cells
that can hold an answer, as pruned partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.functions import vectors as V

#: Slack of the bounds, for rounding.
SLACK = 1e-6


def write_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = 64, keep: tuple[str, ...] = ()) -> None:
    """Write the index of the vectors with a length; ``keep`` names columns to store with them. Pivots are the ``cells`` vectors with the least hashes of their ids."""
    rows = vectors.where(F.col(vector_col).isNotNull() & (V.norm(F.col(vector_col)) > 0))
    rows = rows.select(F.col(id_col).alias("id"), V.unit(F.col(vector_col)).alias("v"), *keep)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()  # as many as cells
    pivots = np.array([r["v"] for r in chosen]).reshape(len(chosen), -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                like = m @ pivots.T
                near = like.argmax(axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * like[np.arange(len(m)), near]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*b.schema.names, "cell", "far"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows.mapInArrow(place, f"{kinds}, cell int, far double").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    told = vectors.sparkSession.read.parquet(f"{path}/cells").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    known = vectors.sparkSession.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>")
    told.join(known, "cell").write.mode("overwrite").parquet(f"{path}/pivots")


def search_index(spark: SparkSession, path: str, query: list[float], k: int) -> tuple[DataFrame, list[int]]:
    """((id, score, kept columns) of the ``k`` unit vectors most like ``query``, best first, ties by id; the cells that were read).

    The nearest cells that hold k vectors give a k-th distance; a cell is read only if its pivot lies no farther than that distance and its own radius.
    Exact, whatever the pivots. A query without length finds nothing.
    """
    q = np.asarray(query, float)
    size = float(np.sqrt((q * q).sum()))
    meta = spark.read.parquet(f"{path}/pivots").collect()  # one row per cell
    if not size or not meta:
        return spark.read.parquet(f"{path}/cells").select("id", F.lit(None).cast("double").alias("score")).limit(0), []
    q = q / size
    away = {r["cell"]: float(np.sqrt(((np.array(r["pivot"]) - q) ** 2).sum())) for r in meta}
    order = sorted(meta, key=lambda r: (away[r["cell"]], r["cell"]))
    first, held = [], 0
    for r in order:
        if held < k:
            first.append(r["cell"])
            held += r["n"]

    def best(cells: list[int]) -> DataFrame:
        rows = spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(cells))
        score = V.dot(F.col("v"), F.array(*map(F.lit, q.tolist())))
        rest = [c for c in rows.columns if c not in ("v", "far", "cell", "id")]
        return rows.select("id", score.alias("score"), *rest).orderBy(F.desc("score"), "id").limit(k)

    found = best(first).select("score").collect()  # k rows
    reach = float(np.sqrt(max(0.0, 2 - 2 * min(r["score"] for r in found)))) if len(found) == k else 2.0
    wanted = sorted({*first, *(r["cell"] for r in meta if away[r["cell"]] - r["radius"] <= reach + SLACK)})
    return best(wanted), wanted
