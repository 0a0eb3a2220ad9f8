"""Faces of the linework within tiles, many tiles at once in numpy; see ``faces.tiled``."""

from __future__ import annotations

import numpy as np

#: Cells of a tile's side.
TILE = 128
#: Decimals of coordinates, and how near boxes count as touching, so that no way of rounding parts what hangs together.
DIGITS, TOUCH = 6, 2e-6


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which row, a number from its first on), for each of ``count`` numbers of every row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def boxes(s: np.ndarray, grow: float = 0.0) -> np.ndarray:
    """min x, min y, max x, max y of segments."""
    return np.stack([np.minimum(s[:, 0], s[:, 2]) - grow, np.minimum(s[:, 1], s[:, 3]) - grow, np.maximum(s[:, 0], s[:, 2]) + grow, np.maximum(s[:, 1], s[:, 3]) + grow], axis=1)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :2] <= b[:, 2:]).all(axis=1) & (a[:, 2:] >= b[:, :2]).all(axis=1)


def _in_cells(box: np.ndarray, tile: np.ndarray, origin: np.ndarray, cell: float, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell of its tile) for each cell of the row's own tile (of ``side`` by ``side``) that its box touches."""
    low = np.maximum(np.floor(box[:, :2] / cell).astype(np.int64) - origin[tile] * side, 0)
    high = np.minimum(np.floor(box[:, 2:] / cell).astype(np.int64) - origin[tile] * side, side - 1)
    size = np.maximum(high - low + 1, 0)
    row, k = expand(np.zeros(len(box), np.int64), size[:, 0] * size[:, 1])
    return row, (tile[row] * side + low[row, 0] + k // size[row, 1]) * side + low[row, 1] + k % size[row, 1]


def _within(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal codes."""
    by = np.argsort(code, kind="stable")
    row, code = row[by], code[by]
    at, k, out = np.arange(len(row)), 1, [(row[:0], row[:0])]
    while len(at):
        at = at[at + k < len(row)]
        at = at[code[at] == code[at + k]]
        out.append((row[at], row[at + k]))
        k += 1
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _across(row: np.ndarray, code: np.ndarray, other: np.ndarray, other_code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and another one with equal codes, each once."""
    by = np.argsort(other_code, kind="stable")
    low, high = (np.searchsorted(other_code[by], code, side) for side in ("left", "right"))
    k, at = expand(low, high - low)
    pair = np.unique(np.stack([row[k], other[by[at]]], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def _firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each different one, in order; which of these each row is)"""
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[by[1:]] != c[by[:-1]]
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def open_rows(tile: np.ndarray, s: np.ndarray, crossing: np.ndarray, origin: np.ndarray, cell: float, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each segment hangs together with one that goes on in another tile, pairs of segments whose boxes meet)"""
    box = boxes(s, TOUCH / 2)
    i, j = _within(*_in_cells(box, tile, origin, cell, side))
    met = _meet(box[i], box[j])
    pair = np.unique(np.minimum(i, j)[met] * len(s) + np.maximum(i, j)[met])
    i, j = pair // max(1, len(s)), pair % max(1, len(s))
    out = crossing.copy()
    a, b = i, j
    while True:
        one = out[a] != out[b]
        if not one.any():
            return out, i, j
        out[a[one]] = out[b[one]] = True
        left = ~(out[a] & out[b])
        a, b = a[left], b[left]


def _pieces(tile: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """[piece, (tile, ax, ay, bx, by)]: segments between all points where pairs cross, touch or overlap."""
    p, q = s[i], s[j]
    (ix, iy), (jx, jy) = (p[:, 2:] - p[:, :2]).T, (q[:, 2:] - q[:, :2]).T
    det = ix * jy - iy * jx
    dx, dy = (q[:, :2] - p[:, :2]).T
    slant = np.abs(det) > 1e-12
    by = np.where(slant, det, 1.0)
    t, u = (dx * jy - dy * jx) / by, (dx * iy - dy * ix) / by
    hit = slant & (t >= -1e-9) & (t <= 1 + 1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9)
    at = np.round(p[hit, :2] + t[hit, None] * (p[hit, 2:] - p[hit, :2]), DIGITS) + 0.0
    seg, points = [i[hit], j[hit]], [at, at]
    for own, other, whole in ((i, q, p), (j, p, q)):  # of parallel ones the ends of the one that lie on the other
        for e in (other[:, :2], other[:, 2:]):
            straight = np.abs((whole[:, 2] - whole[:, 0]) * (e[:, 1] - whole[:, 1]) - (whole[:, 3] - whole[:, 1]) * (e[:, 0] - whole[:, 0])) < 1e-9
            on = ~slant & straight & _meet(np.hstack([e, e]), boxes(whole))
            seg.append(own[on])
            points.append(e[on])
    every = np.arange(len(s))
    seg, points = np.concatenate([every, every, *seg]), np.concatenate([s[:, :2], s[:, 2:], *points])
    first, _ = _firsts(seg, points[:, 0], points[:, 1])
    seg, points = seg[first], points[first]
    next_ = np.flatnonzero(seg[1:] == seg[:-1])
    out = np.column_stack([tile[seg[next_]], points[next_], points[next_ + 1]])
    return out[_firsts(*out.T)[0]]


def faces_of(tile: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(tile, area, cx, cy, points, box of the inner faces of area ``least`` and more; the borders, as segments; the face of each border)"""
    pieces = _pieces(tile, s, i, j)
    n = len(pieces)
    half = np.concatenate([pieces, pieces[:, [0, 3, 4, 1, 2]]])
    _, corner = _firsts(*half[:, :3].T)
    order = np.lexsort((np.arctan2(half[:, 4] - half[:, 2], half[:, 3] - half[:, 1]), corner))
    before = np.roll(order, 1)
    starts = np.flatnonzero(np.r_[True, corner[order[1:]] != corner[order[:-1]]]) if n else np.zeros(0, np.int64)
    before[starts] = order[np.r_[starts[1:], len(order)][: len(starts)] - 1]
    turned = np.empty(2 * n, np.int64)
    turned[order] = before
    step = turned[(np.arange(2 * n) + n) % max(1, 2 * n)]
    name, jump = np.arange(2 * n), step
    while (name != name[step]).any():
        name, jump = np.minimum(name, name[jump]), jump[jump]
    # sums are taken from a point of the face on, so that far from the origin no digits are lost
    a, b, at = half[:, 1:3] - half[name, 1:3], half[:, 3:5] - half[name, 1:3], half[name, 1:3]
    cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
    area = np.bincount(name, cross, 2 * n) / 2
    kept = np.flatnonzero(area >= least)
    number = np.full(2 * n, -1)
    number[kept] = np.arange(len(kept))
    centre = [np.bincount(name, (a[:, k] + b[:, k]) * cross, 2 * n)[kept] / (6 * area[kept]) + at[kept, k] for k in (0, 1)]
    own = np.flatnonzero(number[name] >= 0)
    own = own[np.argsort(number[name[own]], kind="stable")]
    face, border = number[name[own]], half[own, 1:]
    box = np.full((len(kept), 4), np.inf)
    np.minimum.at(box[:, :2], face, border[:, :2])
    box[:, 2:] = -np.inf
    np.maximum.at(box[:, 2:], face, border[:, :2])
    return {"tile": half[kept, 0].astype(np.int64), "area": area[kept], "cx": centre[0], "cy": centre[1], "points": np.bincount(face, minlength=len(kept)), "box": box}, border, face


def _apart(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distance of points from segments."""
    dx, dy = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
    long = dx * dx + dy * dy
    t = np.where(long > 0, np.clip(((x - s[:, 0]) * dx + (y - s[:, 1]) * dy) / np.where(long > 0, long, 1.0), 0.0, 1.0), 0.0)
    return np.hypot(s[:, 0] + t * dx - x, s[:, 1] + t * dy - y)


def near_or_inside(tile: np.ndarray, s: np.ndarray, faces: dict[str, np.ndarray], border: np.ndarray, face: np.ndarray, origin: np.ndarray, cell: float, side: int, near: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, face): the lines less than ``near`` from a face's border, or that begin inside it."""
    ftile = faces["tile"]
    i, j = _across(*_in_cells(boxes(s, near), tile, origin, cell, side), *_in_cells(boxes(border), ftile[face], origin, cell, side))
    met = _meet(boxes(s, near)[i], boxes(border)[j])
    i, j = i[met], j[met]
    far = np.minimum.reduce([*(_apart(s[i, e], s[i, e + 1], border[j]) for e in (0, 2)), *(_apart(border[j, e], border[j, e + 1], s[i]) for e in (0, 2))])
    out = [np.stack([i, face[j]], axis=1)[far < near]]
    begin = s[:, [0, 1, 0, 1]]
    i, j = _across(*_in_cells(begin, tile, origin, cell, side), *_in_cells(faces["box"], ftile, origin, cell, side))
    met = _meet(begin[i], faces["box"][j])
    i, j = i[met], j[met]
    first, size = np.searchsorted(face, np.arange(len(ftile))), faces["points"]
    step = max(1, (1 << 21) // max(1, int(size.max(initial=1))))
    for lo in range(0, len(i), step):  # an odd number of borders lies to the right
        a, b = i[lo : lo + step], j[lo : lo + step]
        row, k = expand(first[b], size[b])
        x, y, e = s[a[row], 0], s[a[row], 1], border[k]
        cut = (e[:, 1] > y) != (e[:, 3] > y)
        cut[cut] = x[cut] < e[cut, 0] + (y[cut] - e[cut, 1]) / (e[cut, 3] - e[cut, 1]) * (e[cut, 2] - e[cut, 0])
        odd = np.bincount(row, cut, len(a)) % 2 == 1
        out.append(np.stack([a[odd], b[odd]], axis=1))
    pair = np.unique(np.concatenate(out), axis=0)
    return pair[:, 0], pair[:, 1]


def in_sight(box: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether boxes share an x with any of the boxes ``of``, and a y with any."""
    out = np.ones(len(box), bool)
    for k in (0, 1):
        by = np.argsort(of[:, k])
        most = np.maximum.accumulate(of[by, k + 2])
        at = np.searchsorted(of[by, k], box[:, k + 2], "right") - 1
        out &= (at >= 0) & (most[np.maximum(at, 0)] >= box[:, k])
    return out
