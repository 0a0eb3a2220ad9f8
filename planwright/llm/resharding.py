"""Minimum-cost-flow resharding: from the bytes of the old shards and the new ones' capacities to the fewest bytes moved.

The flow runs from old shards to new ones: bytes that stay cost nothing, bytes that move cost one through a hub. Its amounts
become block transfers: each old shard's rows are laid out in one order, and ranges of their running bytes go to the new
shards. Only shards that lose or gain rows are written again.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.operators.ordering import runs_of_groups, sorted_runs
from planwright.staging import _folder, staged

#: Bytes that each row takes besides its text.
ROW_BYTES = 8
#: A layout with more shards than this isn't planned on the driver.
MOST_SHARDS = 65_536


class Flow:
    """Minimum-cost flow by shortest augmenting paths with potentials; arcs have capacities and costs of 0 or more."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """The arc's number; the next number is its way back."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.out)
        while True:
            far: list[int | None] = [None] * len(self.out)
            came: list[int] = [-1] * len(self.out)
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b, total = self.to[e], d + self.cost[e] + height[a] - height[self.to[e]]
                    if self.room[e] and (far[b] is None or total < far[b]):
                        far[b], came[b] = total, e
                        heapq.heappush(heap, (total, b))
            if far[sink] is None:
                return
            for i, d in enumerate(far):
                height[i] += far[sink] if d is None else min(d, far[sink])
            path, b = [], sink
            while b != source:
                path.append(came[b])
                b = self.to[came[b] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def transfers(old: Sequence[int], new: Sequence[int]) -> list[list[tuple[int, int]]]:
    """For each old shard its (new shard, bytes), staying bytes first; ``old`` and ``new`` are sizes with equal sums.

    Shard ``i`` stays shard ``i``. Amounts through the hub are dealt in the order of the shards' numbers.
    """
    if sum(old) != sum(new):
        raise ValueError("old sizes and new capacities have different sums")
    m, n = len(old), len(new)
    hub, source, sink = m + n, m + n + 1, m + n + 2
    f = Flow(m + n + 3)
    for i, size in enumerate(old):
        f.arc(source, i, size, 0)
    for j, size in enumerate(new):
        f.arc(m + j, sink, size, 0)
    stay = [f.arc(i, m + i, min(old[i], new[i]), 0) for i in range(min(m, n))]
    leave = [f.arc(i, hub, old[i], 1) for i in range(m)]
    enter = [f.arc(hub, m + j, new[j], 0) for j in range(n)]
    f.run(source, sink)
    used = lambda e: f.room[e ^ 1]
    plan: list[list[tuple[int, int]]] = [[(i, used(stay[i]))] if i < n and used(stay[i]) else [] for i in range(m)]
    wanting = [[j, used(e)] for j, e in enumerate(enter) if used(e)]
    for i, e in enumerate(leave):
        amount = used(e)
        while amount:
            j, open_ = wanting[0]
            part = min(amount, open_)
            plan[i].append((j, part))
            amount -= part
            wanting[0][1] -= part
            if not wanting[0][1]:
                wanting.pop(0)
    return plan


def even(total: int, shards: int) -> list[int]:
    """``total`` in ``shards`` parts that differ by one at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def planned(rows: DataFrame, shards: int, keys: list[str], capacities: Sequence[int] | None = None) -> DataFrame:
    """``rows`` with ``shard``; they have old (int), size (long) and ``keys``, which make their order in an old shard.

    Rows lie in the order of a hash of the first key, so every range has rows of all sizes; a row that the end of a range cuts goes where its middle
    lies. A second, small flow from what came out to the same capacities moves only the smallest rows of each shard, and
    leaves it about half of one of them from its capacity.
    """
    once = _laid(rows.withColumn("shard", F.col("old")), shards, [F.xxhash64(keys[0]), *map(F.col, keys)], capacities)
    return _laid(once, shards, [-F.col("size"), *map(F.col, keys)], capacities)


def _laid(rows: DataFrame, shards: int, order: list[Column], capacities: Sequence[int] | None) -> DataFrame:
    """``rows`` with ``shard`` changed to where the flow from these shards to the capacities takes them; ``order`` is that within a shard."""
    sizes = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum("size")).limit(MOST_SHARDS + 1).collect()}
    if len(sizes) > MOST_SHARDS or shards > MOST_SHARDS or max(sizes, default=0) >= MOST_SHARDS:
        raise ValueError(f"over {MOST_SHARDS} shards")
    old = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    total = sum(old)
    if capacities:
        # given capacities are shares of what there is
        ends = [total * sum(capacities[: k + 1]) // sum(capacities) for k in range(shards)]
        new = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    else:
        new = even(total, shards)
    ends = [(i, [2 * sum(x for _, x in p[: k + 1]) for k in range(len(p))], [j for j, _ in p]) for i, p in enumerate(transfers(old, new)) if p]
    ranges = rows.sparkSession.createDataFrame(ends, "shard int, ends array<long>, targets array<int>")
    by = {f"_order{k}": c for k, c in enumerate(order)}
    runs = sorted_runs(rows.withColumns(by), ["shard", *by], "old-shards")
    parts = runs.groupBy("_run", "shard").agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_run", "shard", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"))
    # as many rows as old shards, which are bounded above
    parts = parts.join(F.broadcast(ranges), "shard")
    upto = F.sum("size").over(Window.partitionBy("_run", "shard").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    middle = 2 * (F.col("_before") + F.col("_upto")) - F.col("size")
    passed = F.least(F.size(F.filter("ends", lambda e: e <= middle)) + 1, F.size("targets"))
    out = runs.withColumn("_upto", upto).join(parts, ["_run", "shard"]).withColumn("shard", F.element_at("targets", passed))
    return staged(out.select(*rows.columns), "resharded")


def with_slots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``slot``: the place within ``shard`` in the order of ``keys``, gapless from 0."""
    runs = sorted_runs(rows, ["shard", *keys], "new-shards")
    spans = runs_of_groups(runs, ["shard"]).select("_run", "shard", "_shift")
    return runs.join(spans, ["_run", "shard"]).select(*rows.columns, (F.col("_place") + F.col("_shift")).cast("long").alias("slot"))


def reshard(docs: DataFrame, old: Column, shards: int = 24, capacities: Sequence[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    ``old``: the shard (int, from 0) that a row lies in; shard sizes then follow ``capacities`` (shares; all alike if not given) to about half a small
    row for each transfer, and the fewest bytes move. Size is the text's UTF-8 bytes plus 8; a null text has none, and the checksum of none, 0.
    Slots ascend by id (null first), checksum and old shard. Repeated rows are rows of their own; equal texts of one old shard lie side by side, so
    they go together unless a range ends among them. A null old shard counts as 0. Empty tables give no rows. Only the id, text and what ``old`` reads are used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + F.lit(ROW_BYTES)
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old"))
    placed = planned(staged(rows, "rows"), shards, ["text_crc32", "doc_id"], capacities)
    out = with_slots(placed, ["doc_id", "text_crc32", "old"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def rewrite_shards(spark: SparkSession, path: str, shards: int, capacities: Sequence[int] | None = None, text_col: str = "text") -> DataFrame:
    """Reshard a Parquet folder with one ``shard=<n>`` folder per shard; only shards that lose or gain rows are written again.

    Returns the transfers: old_shard, shard, bytes. Rows are known by their file and place in it, so ids play no part. The affected shards are
    staged whole before any of them is replaced, so a run that stops while planning leaves the folder as it was. Folders of shards
    that are left without rows are removed. A folder in which nothing has to move is not touched.
    """
    store = spark.read.parquet(path)
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + F.lit(ROW_BYTES)
    row = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = staged(store.select(F.col("shard").cast("int").alias("old"), size.alias("size"), *row), "rows")
    placed = planned(rows, shards, ["_row", "_file"], capacities)
    moves = placed.where("old <> shard").select("_file", "_row", F.col("shard").alias("_to"))
    flows = placed.where("old <> shard").groupBy(F.col("old").alias("old_shard"), "shard").agg(F.sum("size").alias("bytes"))
    told = staged(flows, "transfers")
    hit = sorted({r[k] for r in told.collect() for k in (0, 1)})  # pairs of shards, bounded with them
    if not hit:
        return told
    touched = store.where(F.col("shard").isin(hit)).select(*store.columns, *row)
    fresh = staged(touched.join(moves, ["_file", "_row"], "left").withColumn("shard", F.coalesce("_to", "shard")).select(*store.columns), "affected")
    fresh.repartition("shard", F.pmod(F.xxhash64(*[c for c in store.columns if c != "shard"]), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    left = {r[0] for r in fresh.select("shard").distinct().collect()}
    for k in hit:
        if k not in left:
            where, files = _folder(spark, f"{path}/shard={k}")
            files.delete(where, True)
    return told
