"""Operators that need a total order without putting all rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.staging import staged


def with_row_number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name``: position of each row from 0 in the order of ``order``.

    Rows are dealt by range and sorted within tasks; only each task's row count meets in one place.
    """
    n = F.spark_partition_id().alias("_part")
    dealt = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", n), "ranges")
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, inner).join(offsets, "_part").withColumn(name, F.col(name) - 1 + F.col("_before")).drop("_part", "_before")


def sorted_runs(rows: DataFrame, order: list[str], name: str = "runs") -> DataFrame:
    """``rows`` staged as runs that ascend by ``order``, run after run; added are _run and _place (from 0, gapless in a run).

    A run is what one task has sorted. Equal rows are dealt by a hash of their place in the input too, so many copies of one row
    are not one run. Give it a scan or a staged table, which a lost executor's tasks read again in the same order.
    """
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    # numbers of rows in a task ascend from 0 in their low 33 bits; the task is above
    at = F.monotonically_increasing_id()
    return staged(dealt.withColumn("_at", at).select(*rows.columns, F.shiftright("_at", 33).cast("int").alias("_run"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")), name)


def runs_of_groups(runs: DataFrame, group: list[str]) -> DataFrame:
    """Of ``sorted_runs`` whose order begins with ``group``: each run's part of each group, with _rows, _total (rows of the group) and _shift.

    ``_place + _shift`` is a row's place in its group, from 0. There are as many rows as runs, and one more for each border of groups.
    """
    parts = runs.groupBy("_run", *group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    return parts.select("_run", *group, "_rows", F.sum("_rows").over(whole).alias("_total"), shift.alias("_shift"))


def exact_percentiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with the percentile of ``value`` at each of ``shares`` (name -> 0 to 1), between two values by their distance, as ``percentile`` gives it; null without values.

    Different values are counted, dealt by range and summed up within tasks; only each task's count meets in one place, not the values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = staged(counts.repartitionByRange("_v").select("_v", "_n", F.spark_partition_id().alias("_part")), "values")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = dealt.groupBy("_part").agg(F.sum("_n").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    placed = dealt.join(F.broadcast(offsets), "_part").withColumn("_end", F.sum("_n").over(Window.partitionBy("_part").orderBy("_v")) + F.col("_before"))
    total = dealt.agg(F.sum("_n").alias("_total"))
    ranked = placed.crossJoin(F.broadcast(total))
    at = {name: share * (F.col("_total") - 1) for name, share in shares.items()}
    held = lambda rank: F.when((F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end")), F.col("_v"))
    ends = [F.max(held(f(at[name]))).alias(f"_{side}{k}") for k, name in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))]
    found = ranked.agg(F.max("_total").alias("_total"), *ends)

    def between(k: int, name: str) -> Column:
        low, high, place = F.col(f"_low{k}"), F.col(f"_high{k}"), at[name]
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*(between(k, name).alias(name) for k, name in enumerate(shares)))


#: Tables up to this number of rows are sent to all tasks.
SENT = 10_000


def counted_side(few: DataFrame) -> DataFrame:
    """A staged table for a join: sent to all tasks if it has few rows as counted, else shuffled."""
    return F.broadcast(few) if few.count() <= SENT else few.hint("merge")


def group_percentiles(rows: DataFrame, group: list[str], values: dict[str, tuple[str, str]], shares: dict[str, float], total: str, bins: int = 4096) -> DataFrame:
    """(``group``, ``total``, a column {share}_{value} each): percentiles of ``values`` in each group, as ``percentile`` gives them, and the rows of the group.

    ``values``: column -> the columns of two bounds that hold it, the same in all rows of a group; neither these nor the group's columns are null. Values are counted in bins first; then only those in bins
    that hold a rank asked for are looked at one by one. So no task holds a group's values, however large the group is.
    """
    names = list(values)

    def binned(c: str) -> Column:
        v, low, high = (F.col(k).cast("double") for k in (c, *values[c]))
        return F.when(high > low, F.least(F.greatest(F.floor((v - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))).otherwise(0).cast("int")

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), F.col(c).cast("double").alias("v"), binned(c).alias("bin")) for k, c in enumerate(names)))).alias("e")
    flat = rows.select(*group, each).select(*group, "e.*")
    by = [*group, "axis"]
    whole = Window.partitionBy(*by)
    before = lambda over: F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counts = flat.groupBy(*by, "bin").agg(F.count("*").alias("_n"))
    placed = counts.select(*by, "bin", "_n", before(whole.orderBy("bin")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    place = [share * (F.col("_total") - 1) for share in shares.values()]
    ranks = [f(p).cast("long") for p in place for f in (F.floor, F.ceil)]
    here = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    asked = staged(placed.where(reduce(Column.__or__, (here(r) for r in ranks))).select(*by, "bin", "_before", "_total"), "asked-bins")
    own = flat.join(counted_side(asked), [*by, "bin"]).groupBy(*by, "bin", "_before", "_total", "v").agg(F.count("*").alias("_n"))
    own = own.withColumn("_before", F.col("_before") + before(Window.partitionBy(*by, "bin").orderBy("v")))
    found = own.groupBy(*by).agg(F.max("_total").alias("_total"), *(F.max(F.when(here(r), F.col("v"))).alias(f"_r{i}") for i, r in enumerate(ranks)))

    def between(i: int) -> Column:
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        return F.when(low == high, low).otherwise((F.ceil(place[i]) - place[i]) * low + (place[i] - F.floor(place[i])) * high)

    told = found.select(*by, "_total", *(between(i).alias(f"_p{i}") for i in range(len(place))))
    return told.groupBy(*group).agg(F.max("_total").alias(total), *(F.max(F.when(F.col("axis") == k, F.col(f"_p{i}"))).alias(f"{share}_{c}") for k, c in enumerate(names) for i, share in enumerate(shares)))
