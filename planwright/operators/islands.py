"""Gaps and islands over sorted runs, without a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.operators.ordering import sorted_runs
from planwright.staging import staged


def _with_parts(rows: DataFrame, parts: DataFrame, group: list[str], added: list[str]) -> DataFrame:
    """``rows`` with ``added`` columns of the row of ``parts`` for the same run and group; nulls are a group."""
    own = parts.select(F.col("_run").alias("_r"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), *added)
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)), F.col("_run") == F.col("_r"))
    return rows.join(own, same).drop("_r", *(f"_g{k}" for k in range(len(group))))


def islands(rows: DataFrame, group: list[str], order: list[str], value: str, gap: Column | float) -> DataFrame:
    """``rows`` with ``island``, a number from 0 in each group: a new one begins where ``value`` lies over ``gap`` from that of the row before.

    The order is ``group``, then ``order`` (ascending; it has to be total for a result that is always the same). A null value keeps to the island before it.
    Runs are numbered by themselves; only their first and last values and their numbers of islands meet in one place.
    """
    runs = sorted_runs(rows, [*group, *order], "island-runs")
    within = Window.partitionBy("_run", *group).orderBy("_place")
    earlier = Window.partitionBy(*group).orderBy("_run")
    ends = runs.groupBy("_run", *group).agg(F.max_by(value, "_place").alias("_last"))
    ends = ends.withColumn("_tail", F.lag("_last").over(earlier))
    stepped = _with_parts(runs.withColumn("_before", F.lag(value).over(within)), ends, group, ["_tail"])
    far = F.abs(F.col(value) - F.coalesce("_before", "_tail")) > gap
    marked = staged(stepped.withColumn("_cut", F.coalesce(far, F.lit(False)).cast("int")), "islands")
    counts = marked.groupBy("_run", *group).agg(F.sum("_cut").alias("_cuts"))
    counts = counts.withColumn("_offset", F.coalesce(F.sum("_cuts").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = marked.withColumn("_own", F.sum("_cut").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = _with_parts(numbered, counts, group, ["_offset"])
    return out.select(*rows.columns, (F.col("_own") + F.col("_offset")).alias("island"))


#: The height of text whose height is unknown; the least width of a band and its width in text heights; the same of a line gap.
TEXT_HEIGHT, BAND, BAND_HEIGHTS, LINE_GAP, LINE_HEIGHTS = 80.0, 300.0, 3.0, 250.0, 2.5


def stacked_texts(rows: DataFrame, key: str) -> DataFrame:
    """(``key``, first_id, size, text): texts of two lines and more that stand under each other.

    ``rows``: key, id, text, x, y and height (null or not above 0: unknown). A key's median height gives the width of its bands (multiples from x = 0
    on, each centred on one) and the widest gap between lines. Within a band lines go from the highest y down, of equal y by id, null
    ids first; a gap ends a text. Lines are joined by a space, blank and null ones add none; texts that are blank as a whole, and rows without a place, are left out.
    Rows may repeat; a null key is a key.
    """
    tall = F.coalesce(F.percentile(F.when(F.col("height") > 0, F.col("height")), F.lit(0.5)), F.lit(TEXT_HEIGHT))
    tall = rows.groupBy(F.col(key).alias("_key")).agg(tall.alias("_tall"))
    placed = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).join(tall, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    wide, gap = F.greatest(F.lit(BAND), BAND_HEIGHTS * F.col("_tall")), F.greatest(F.lit(LINE_GAP), LINE_HEIGHTS * F.col("_tall"))
    lines = placed.select(key, "id", "text", "y", (-F.col("y")).alias("_down"), F.floor(F.col("x") / wide + 0.5).alias("_band"), gap.alias("_gap"))
    numbered = islands(lines, [key, "_band"], ["_down", "id", "text"], "y", F.col("_gap"))
    found = numbered.groupBy(key, "_band", "island").agg(F.array_sort(F.collect_list(F.struct("_down", "id", "text"))).alias("lines"))
    said = F.filter(F.transform("lines", lambda r: r["text"]), lambda t: t.isNotNull() & (F.length(F.trim(t)) > 0))
    out = found.select(key, F.col("lines")[0]["id"].alias("first_id"), F.size("lines").alias("size"), F.trim(F.array_join(said, " ")).alias("text"))
    return out.where("size > 1 and text <> ''")
