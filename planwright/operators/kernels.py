"""Numpy kernels for steps whose order matters, run by group."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_1d(hist: np.ndarray, seed: float, low: float, width: float, gap: int) -> tuple[float, float]:
    """The occupied interval around ``seed``: bounded by runs of ``gap`` bins at or below 2 % of the upper-quartile bin (1 at least)."""
    n = len(hist)
    full = np.sort(hist[hist > 0])
    whole = (low, low + width * n)
    if not len(full):
        return whole
    quiet = hist <= max(1, math.ceil(int(full[len(full) * 3 // 4]) * 0.02))
    at = min(n - 1, max(0, int((seed - low) / width)))
    if quiet[at]:
        busy = np.flatnonzero(~quiet)
        if not len(busy):
            return whole
        at = int(busy[np.lexsort((busy, np.abs(busy - at)))[0]])  # the nearest, of two the lower
    ends = []
    for side in (quiet[at::-1], quiet[at:]):
        run = np.convolve(side, np.ones(gap, int))[gap - 1 :] if len(side) >= gap else np.zeros(0)
        gaps = np.flatnonzero(run[: len(side) - gap + 1] == gap)
        ends.append(int(gaps[0]) - 1 if len(gaps) else len(side) - 1)
    return low + (at - ends[0]) * width, low + (at + ends[1] + 1) * width


def slot_udf(gap: int):
    """Column function (hist array, seed, low, width) -> struct<low, high>."""

    @F.pandas_udf("low double, high double")
    def find(hist: pd.Series, seed: pd.Series, low: pd.Series, width: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([slot_1d(np.asarray(h), s, a, w, gap) for h, s, a, w in zip(hist, seed, low, width, strict=True)], columns=["low", "high"])

    return find


def histogram(rows: DataFrame, values: list[str], low: Column, high: Column, bins: int, keys: list[str]) -> DataFrame:
    """(keys, hist array of ``bins`` counts, low, width) of endpoint columns; what lies outside counts in the end bins."""
    width = F.when(high - low > 1e-9, (high - low) / bins).otherwise(1.0)
    at = lambda c: F.least(F.greatest(((F.col(c) - low) / width).cast("int"), F.lit(0)), F.lit(bins - 1))
    ends = [f"_bin{i}" for i in range(len(values))]
    # rows whose ends share their bins are counted before they are dealt to these
    each = rows.select(*keys, low.alias("low"), width.alias("width"), *(at(c).alias(e) for c, e in zip(values, ends, strict=True)))
    each = each.groupBy(*keys, *ends).agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("width").alias("width"))
    each = each.select(*keys, "n", "low", "width", F.explode(F.array(*ends)).alias("bin"))
    counts = each.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.first("low").alias("low"), F.first("width").alias("width"))
    table = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.first("low").alias("low"), F.first("width").alias("width"))
    return table.withColumn("hist", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))).drop("m")


def suppress(boxes: Column, most: float) -> Column:
    """Greedy suppression of an ordered array of box structs: a box goes if its IoU with one kept before is ``most`` or more."""
    from planwright.functions.geometry import iou

    none = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, none, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) >= most), kept).otherwise(F.array_append(kept, b)))


def laplacian_encodings(edges: DataFrame, key: str, k: int = 8) -> DataFrame:
    """(key, node, encoding array of k): eigenvectors of the normalised Laplacian after the first, signs fixed, zero padded."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(group[["src", "dst"]].to_numpy())
        a = np.zeros((len(nodes), len(nodes)))
        i, j = np.searchsorted(nodes, group["src"]), np.searchsorted(nodes, group["dst"])
        a[i, j] = a[j, i] = 1
        d = a.sum(axis=1)
        s = 1 / np.sqrt(np.maximum(d, 1))
        _, v = np.linalg.eigh(np.eye(len(nodes)) - s[:, None] * a * s[None, :])
        v = v[:, 1 : k + 1]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
        v = np.hstack([v, np.zeros((len(nodes), k - v.shape[1]))])
        return pd.DataFrame({key: group[key].iloc[0], "node": nodes, "encoding": list(v)})

    kind = edges.schema[key].dataType.simpleString()
    return edges.groupBy(key).applyInPandas(run, f"`{key}` {kind}, node long, encoding array<double>")


def topology(edges: DataFrame, key: str) -> DataFrame:
    """(key, diameter of the largest component, articulation points) by breadth-first and depth-first walks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(group["src"], group["dst"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

        def far(start: int) -> dict[int, int]:
            seen, now = {start: 0}, [start]
            while now:
                now = [m for n in now for m in sorted(near[n]) if m not in seen and not seen.update({m: seen[n] + 1})]
            return seen

        left, largest = set(near), {}
        for n in sorted(near):
            if n in left:
                seen = far(n)
                left -= set(seen)
                largest = seen if len(seen) > len(largest) else largest
        diameter = max(max(far(n).values()) for n in largest)
        order, low, cut = {}, {}, set()
        for root in sorted(near):
            if root in order:
                continue
            stack, children = [(root, None, iter(sorted(near[root])))], 0
            order[root] = low[root] = len(order)
            while stack:
                n, up, rest = stack[-1]
                m = next(rest, None)
                if m is None:
                    stack.pop()
                    if stack:
                        p = stack[-1][0]
                        low[p] = min(low[p], low[n])
                        if p != root and low[n] >= order[p]:
                            cut.add(p)
                elif m not in order:
                    children += n == root
                    order[m] = low[m] = len(order)
                    stack.append((m, n, iter(sorted(near[m]))))
                elif m != up:
                    low[n] = min(low[n], order[m])
            if children > 1:
                cut.add(root)
        return pd.DataFrame([(group[key].iloc[0], diameter, len(cut))], columns=[key, "diameter", "articulation_points"])

    kind = edges.schema[key].dataType.simpleString()
    return edges.groupBy(key).applyInPandas(run, f"`{key}` {kind}, diameter int, articulation_points int")


def polygonise(segments: DataFrame, key: str, least: float = 0.1, digits: int = 6) -> DataFrame:
    """(key, area, cx, cy, points): faces of the plane graph of each key's segments (x1, y1, x2, y2), area at least ``least``.

    Segments are cut where they cross or touch; half-edges are walked around faces, turning as far right as they can.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        s = np.unique(group[["x1", "y1", "x2", "y2"]].to_numpy(float).round(digits), axis=0)
        cuts: list[set[tuple[float, float]]] = [{(a, b), (c, d)} for a, b, c, d in s.tolist()]
        boxes = np.stack([np.minimum(s[:, 0], s[:, 2]), np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 0], s[:, 2]), np.maximum(s[:, 1], s[:, 3])], axis=1)
        for i in range(len(s)):
            near = np.flatnonzero((boxes[:, 0] <= boxes[i, 2]) & (boxes[:, 2] >= boxes[i, 0]) & (boxes[:, 1] <= boxes[i, 3]) & (boxes[:, 3] >= boxes[i, 1]))
            x1, y1, x2, y2 = s[i]
            for j in near[near > i].tolist():
                x3, y3, x4, y4 = s[j]
                det = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
                if abs(det) > 1e-12:
                    t = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / det
                    u = ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / det
                    if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                        p = (round(x1 + t * (x2 - x1), digits) + 0.0, round(y1 + t * (y2 - y1), digits) + 0.0)
                        cuts[i].add(p)
                        cuts[j].add(p)
                else:
                    for a, b, k in ((x3, y3, i), (x4, y4, i), (x1, y1, j), (x2, y2, j)):
                        p, q = s[k][:2], s[k][2:]
                        if abs((q[0] - p[0]) * (b - p[1]) - (q[1] - p[1]) * (a - p[0])) < 1e-9 and min(p[0], q[0]) <= a <= max(p[0], q[0]) and min(p[1], q[1]) <= b <= max(p[1], q[1]):
                            cuts[k].add((a, b))
        near_: dict[tuple[float, float], set[tuple[float, float]]] = {}
        for points in cuts:
            line = sorted(points)
            for a, b in pairwise(line):
                near_.setdefault(a, set()).add(b)
                near_.setdefault(b, set()).add(a)
        turn = {p: sorted(q, key=lambda r, p=p: math.atan2(r[1] - p[1], r[0] - p[0])) for p, q in near_.items()}
        used, out = set(), []
        for p in sorted(turn):
            for q in turn[p]:
                face, a, b = [], p, q
                while (a, b) not in used:
                    used.add((a, b))
                    face.append(a)
                    around = turn[b]
                    a, b = b, around[around.index(a) - 1]
                if len(face) > 2:
                    f = np.array(face)
                    cross = f[:, 0] * np.roll(f[:, 1], -1) - np.roll(f[:, 0], -1) * f[:, 1]
                    area = cross.sum() / 2
                    if area >= least:  # inner faces run counter-clockwise
                        cx = ((f[:, 0] + np.roll(f[:, 0], -1)) * cross).sum() / (6 * area)
                        cy = ((f[:, 1] + np.roll(f[:, 1], -1)) * cross).sum() / (6 * area)
                        out.append((group[key].iloc[0], float(area), float(cx), float(cy), len(face)))
        return pd.DataFrame(out, columns=[key, "area", "cx", "cy", "points"])

    kind = segments.schema[key].dataType.simpleString()
    return segments.groupBy(key).applyInPandas(run, f"`{key}` {kind}, area double, cx double, cy double, points int")


def kmeans(xy: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """The centre of each point: Lloyd's rounds from the farthest points on; of equally near centres the least number."""
    by = np.argsort(xy[:, 0], kind="stable")
    p, x = xy[by], xy[by, 0]
    wide = lambda far: np.sqrt(far) * (1 + 1e-9) + 1e-9
    c, own = np.empty((k, 2)), np.zeros(len(p), np.int64)
    c[0] = xy[0]
    far = ((p - c[0]) ** 2).sum(axis=1)
    for j in range(1, k):
        most = far.max()
        c[j] = xy[by[far == most].min()]
        lo, hi = np.searchsorted(x, c[j, 0] - wide(most)), np.searchsorted(x, c[j, 0] + wide(most), "right")
        d = ((p[lo:hi] - c[j]) ** 2).sum(axis=1)
        nearer = d < far[lo:hi]
        far[lo:hi][nearer] = d[nearer]
        own[lo:hi][nearer] = j
    for done in range(rounds):
        if done:
            order = np.argsort(c[:, 0], kind="stable")
            cx, new, at = c[order, 0], np.empty_like(own), 0
            limit = wide(((p - c[own]) ** 2).sum(axis=1))
            while at < len(p):
                to = min(at + 1024, len(p))
                reach = limit[at:to].max()
                some = np.sort(order[np.searchsorted(cx, x[at] - reach) : np.searchsorted(cx, x[to - 1] + reach, "right")])
                step = max(1, (1 << 21) // len(some))
                for lo in range(at, to, step):
                    hi = min(lo + step, to)
                    new[lo:hi] = some[((p[lo:hi, None] - c[some]) ** 2).sum(axis=2).argmin(axis=1)]
                at = to
            if (new == own).all():
                break
            own = new
        back = np.empty_like(own)
        back[by] = own
        n = np.bincount(back, minlength=k)
        mean = np.stack([np.bincount(back, xy[:, i], minlength=k) for i in (0, 1)], axis=1) / np.maximum(n, 1)[:, None]
        c = np.where(n[:, None] > 0, mean, c)
    out = np.empty_like(own)
    out[by] = own
    return out


def kmeans_chunks(nodes: DataFrame, key: str, per_chunk: int = 30, rounds: int = 50) -> DataFrame:
    """(key, node, chunk): each layout's nodes (columns node, x, y) by k-means, k = nodes / ``per_chunk`` rounded up, 2 at least.

    Centres begin at nodes that are farthest from those taken before, from the node of least number on, so the result is always the same. Nodes are
    held against the centres that can be nearer than the one they had, as told by x: not against all.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        xy = group[["x", "y"]].to_numpy(float)
        own = kmeans(xy, min(len(xy), max(2, -(-len(xy) // per_chunk))), rounds)
        return pd.DataFrame({key: group[key].iloc[0], "node": group["node"], "chunk": own.astype("int32")})

    kind = nodes.schema[key].dataType.simpleString()
    return nodes.groupBy(key).applyInPandas(run, f"`{key}` {kind}, node long, chunk int")
