"""Copy detection on image columns by local descriptors.

Corners are found on several scales of every image; the direction of the intensity centroid turns a fixed pattern of 256
brightness tests, which gives a binary descriptor that stands crops, turns and edits elsewhere in the picture. Two images are
linked if enough of their nearest descriptors agree on one shift, turn and scale. Equal images are one class from the start.

No key keeps apart descriptors that may differ in BITS of 256 bits, so all pairs of classes are compared: blocks of images meet each
other, and the inner products of their descriptors as signs tell which corners are within BITS. Only images with enough such corners are
verified. A pair of blocks gives the counts of links of its images and a spanning forest of its links, not the links, so a large group
of near copies costs time with the square of its size, but rows in proportion to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.operators.graph import connected_components
from planwright.staging import staged

SCALES, RADIUS = (1.0, 1.5, 2.25), 7
#: Bands of a descriptor, and the bytes of each.
BANDS, BAND_BYTES = 6, 5
#: The strongest corners of each cell of CELL by CELL pixels of each scale are kept, and the STRONGEST over all.
CELL, CORNERS, STRONGEST = 32, 4, 32
#: Bands that near copies mostly share, bits by which two descriptors may differ, corners that must agree.
MEETINGS, BITS, AGREEING = 2, 48, 5
#: Pixels within which corners are at one place, and how much nearer than the next place's a descriptor must be.
PLACE, CLEARLY = 6.0, 0.8
#: Corners of a block of images, at least and at most about; blocks that a small table is cut into.
LEAST_BLOCK, BLOCK, BLOCKS = 1024, 65536, 24
#: Corners of the two sides that are compared at once; columns by eights.
ROWS, COLUMNS = 512, 1024

#: (y, x) of the points of a patch.
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])
#: Directions that patterns are turned to.
TURNS = 64
FEATURE = np.dtype([("y", "<f4"), ("x", "<f4"), ("angle", "<f4"), ("scale", "<f4"), ("bits", "u1", 32)])


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def read_image(data: bytes | None) -> np.ndarray | None:
    """A binary PGM or PPM (colours are averaged) as floats; None for anything else."""
    try:
        kind, rest = data[:2], data[2:]
        if kind not in (b"P5", b"P6"):
            return None
        numbers = []
        while len(numbers) < 3:
            rest = rest.lstrip()
            if rest[:1] == b"#":
                rest = rest[rest.index(b"\n") :]
                continue
            end = next(i for i, c in enumerate(rest) if chr(c).isspace())
            numbers.append(int(rest[:end]))
            rest = rest[end:]
        width, height, most = numbers
        planes = 3 if kind == b"P6" else 1
        if most > 255 or width < 1 or height < 1 or len(rest) - 1 < width * height * planes:
            return None
        pixels = np.frombuffer(rest[1 : 1 + width * height * planes], np.uint8).reshape(height, width, planes)
        return pixels.mean(axis=2, dtype=np.float32)
    except (TypeError, ValueError, StopIteration, AttributeError):
        return None


def _blur(a: np.ndarray) -> np.ndarray:
    """By 1 2 1 along both axes; what is beyond an edge is taken from the other side."""
    for axis in (1, 2):
        side = np.concatenate([a.take([-1], axis), a, a.take([0], axis)], axis)
        n = a.shape[axis]
        part = lambda k: side[:, k : k + n] if axis == 1 else side[:, :, k : k + n]  # noqa: B023, E731
        out = part(0) + part(2)
        out += a
        out += a
        out *= a.dtype.type(0.25) if a.dtype.kind == "f" else 0.25
        a = out
    return a


def _resize(a: np.ndarray, scale: float) -> np.ndarray:
    """Each image made smaller by linear interpolation."""
    for axis in (1, 2):
        n = int(a.shape[axis] / scale)
        at = np.minimum(np.arange(n) * scale, a.shape[axis] - 1)
        low = np.minimum(at.astype(int), a.shape[axis] - 2) if a.shape[axis] > 1 else np.zeros(n, int)
        part = (at - low).astype(np.float32)
        part = part[None, :, None] if axis == 1 else part[None, None, :]
        a = np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, a.shape[axis] - 1), axis) * part
    return a


def _flat(shape: tuple[int, ...], n: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (n * shape[1] + y) * shape[2] + x


def _tell(smooth: np.ndarray, n: np.ndarray, y: np.ndarray, x: np.ndarray, angle: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """[corner, test]: is the first point darker than the second, both turned by the corner's angle (to the nearest of TURNS)?"""
    turn = np.arange(TURNS) * 2 * np.pi / TURNS
    sin, cos = np.sin(turn)[:, None, None], np.cos(turn)[:, None, None]
    edge = RADIUS + 1
    dy = np.clip(np.rint(tests[None, ..., 0] * cos + tests[None, ..., 1] * sin), -edge, edge).astype(np.int64)
    dx = np.clip(np.rint(-tests[None, ..., 0] * sin + tests[None, ..., 1] * cos), -edge, edge).astype(np.int64)
    offset = dy * smooth.shape[2] + dx  # [turn, test, point]
    near = np.rint(angle * (TURNS / 2 / np.pi)).astype(np.int64) % TURNS
    at, flat = _flat(smooth.shape, n, y, x), smooth.ravel()
    out = np.zeros((len(n), len(tests)), bool)
    for lo in range(0, len(n), 1024):
        own = slice(lo, lo + 1024)
        out[own] = flat[at[own, None] + offset[near[own], :, 0]] < flat[at[own, None] + offset[near[own], :, 1]]
    return out


@cache
def pattern(count: int = 256, tried: int = 1024) -> np.ndarray:
    """The tests: pairs of points from a normal distribution within the patch, of which those are taken that come out either way
    alike often and least depend on each other, as seen on corners of noise of three grains. Always the same."""
    rng = np.random.default_rng(20)
    tests = np.clip(rng.normal(0, RADIUS / 2.2, (2 * tried, 2, 2)), -RADIUS + 1, RADIUS - 1)
    tests = tests[np.hypot(*(tests[:, 0] - tests[:, 1]).T) >= 2.5][:tried]  # nearer points may fall on one pixel
    seen = []
    for grain in (2, 6, 14):
        a = rng.normal(0, 1, (24, 96, 96)).astype(np.float32)
        for _ in range(grain):
            a = _blur(a)
        a = 128 + 40 * a / a.std()
        found = describe(a, tests[:256])
        n = np.repeat(np.arange(len(a)), [len(f) for f in found])
        f = np.concatenate(found)
        own = f["scale"] == 1
        seen.append(_tell(_blur(_blur(a)), n[own], f["y"][own].astype(int), f["x"][own].astype(int), f["angle"][own], tests))
    told = np.concatenate(seen).astype(np.float32)
    share = told.mean(axis=0)
    alike = np.abs(np.nan_to_num(np.corrcoef(told.T), nan=1.0))
    order = np.argsort(np.abs(share - 0.5), kind="stable")
    for most in np.arange(0.2, 1.01, 0.05):
        taken: list[int] = []
        for k in order.tolist():
            if not taken or alike[k, taken].max() <= most:
                taken.append(k)
                if len(taken) == count:
                    # dealt over the bands, so that each has as telling ones as the others
                    n = 8 * BAND_BYTES * BANDS
                    return tests[np.r_[np.array(taken[:n]).reshape(-1, BANDS).T.ravel(), taken[n:]]]
    raise ValueError("too few tests tried")


def describe(images: np.ndarray, tests: np.ndarray | None = None) -> list[np.ndarray]:
    """FEATURE records of each of some images [image, y, x] of one size; the strongest CORNERS of each cell of each scale, and the STRONGEST over all."""
    tests = pattern() if tests is None else tests
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in images]
    for scale in SCALES:
        a = _blur(_resize(images.astype(np.float32), scale) if scale > 1 else images.astype(np.float32))
        if min(a.shape[1:]) < 2 * RADIUS + 4:
            break
        dy, dx = np.gradient(a, axis=1), np.gradient(a, axis=2)
        yy, xx, xy = _blur(_blur(dy * dy)), _blur(_blur(dx * dx)), _blur(_blur(dx * dy))
        strength = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        peak = strength > 1.0
        edge = RADIUS + 1
        peak[:, :edge] = peak[:, -edge:] = peak[:, :, :edge] = peak[:, :, -edge:] = False
        n, y, x = np.nonzero(peak)
        own = strength[n, y, x]
        best = np.ones(len(n), bool)
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                if sy or sx:
                    best &= own > strength[n, y + sy, x + sx]
        n, y, x = n[best], y[best], x[best]
        if not len(n):
            continue
        cell = (n * (a.shape[1] // CELL + 1) + y // CELL) * (a.shape[2] // CELL + 1) + x // CELL
        by = np.lexsort((-strength[n, y, x], cell))
        starts = np.flatnonzero(np.r_[True, np.diff(cell[by]) > 0])
        place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        kept = np.zeros(len(n), bool)
        kept[by[place < CORNERS]] = True
        patch = a.ravel()[_flat(a.shape, n, y, x)[:, None] + _DISC[:, 0] * a.shape[2] + _DISC[:, 1]]
        angle = np.arctan2(patch @ _DISC[:, 0].astype(np.float32), patch @ _DISC[:, 1].astype(np.float32))
        told = _tell(_blur(a), n, y, x, angle, tests)
        record = np.zeros(len(n), FEATURE)
        record["y"], record["x"], record["angle"], record["scale"] = y * scale, x * scale, angle, scale
        record["bits"] = np.packbits(told, axis=1)
        power = strength[n, y, x]
        for i in np.unique(n).tolist():
            own = n == i
            found[i].append((power[own], record[own], kept[own]))
    out = []
    for parts in found:
        if not parts:
            out.append(np.zeros(0, FEATURE))
            continue
        power, record, kept = (np.concatenate(p) for p in zip(*parts, strict=True))
        by = np.argsort(-power, kind="stable")
        out.append(record[by[kept[by] | (np.arange(len(by)) < STRONGEST)]])
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Corners of ``a`` whose nearest descriptor in ``b`` tells of one shift, turn and scale, at most.

    A nearest descriptor counts if it is within BITS, is the nearest both ways, and is clearly nearer than any at another place of ``b``:
    patterns that come back within a picture tell nothing of where it is from.
    """
    if not len(a) or not len(b):
        return 0
    x, y = (np.ascontiguousarray(f["bits"]).view("<u8") for f in (a, b))
    to, least, next_ = np.zeros(len(a), int), np.zeros(len(a), int), np.zeros(len(a), int)
    back, nearest = np.zeros(len(b), int), np.full(len(b), 257)
    elsewhere = np.hypot(b["y"][:, None] - b["y"], b["x"][:, None] - b["x"]) > PLACE
    step = max(1, (1 << 20) // len(b))
    for at in range(0, len(a), step):
        apart = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int32)
        to[at : at + step], least[at : at + step] = apart.argmin(axis=1), apart.min(axis=1)
        next_[at : at + step] = np.where(elsewhere[to[at : at + step]], apart, 257).min(axis=1)
        low, own = apart.min(axis=0), apart.argmin(axis=0) + at
        back, nearest = np.where(low < nearest, own, back), np.minimum(low, nearest)
    good = np.flatnonzero((least <= BITS) & (least <= CLEARLY * next_) & (back[to] == np.arange(len(a))))
    if len(good) < 2:
        return len(good)
    p, q = a[good], b[to[good]]
    # corners of several scales at one place are one
    spots = np.rint(np.stack([p["y"], p["x"]], axis=1) / np.float32(PLACE))
    at = np.unique(spots, axis=0, return_inverse=True)[1].ravel()
    of_place = np.zeros((len(good), at.max() + 1), np.float32)
    of_place[np.arange(len(good)), at] = 1
    best, step = 0, max(1, (1 << 20) // len(good))
    for lo in range(0, len(good), step):
        own = slice(lo, lo + step)
        turn, scale = (q["angle"] - p["angle"])[own, None], (q["scale"] / p["scale"])[own, None]
        sin, cos = np.sin(turn) * scale, np.cos(turn) * scale
        y, x = p["y"] - p["y"][own, None], p["x"] - p["x"][own, None]
        far = np.hypot(y * cos + x * sin - (q["y"] - q["y"][own, None]), -y * sin + x * cos - (q["x"] - q["x"][own, None]))
        near = far <= 3 + 0.05 * np.hypot(y, x)
        best = max(best, int((near.astype(np.float32) @ of_place > 0).sum(axis=1).max()))
    return best


def table_keys(features: np.ndarray) -> np.ndarray:
    """[corner, band]: the number of the table and the band."""
    bands = features["bits"][:, : BANDS * BAND_BYTES].reshape(-1, BANDS, BAND_BYTES).astype(np.int64)
    return (bands << np.arange(0, 8 * BAND_BYTES, 8)).sum(axis=2) | np.arange(BANDS, dtype=np.int64) << 8 * BAND_BYTES


def _may_link(a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray, agree: int) -> Iterator[tuple[int, int]]:
    """The images (by place) of two blocks of which ``agree`` corners of the first have a descriptor of the second within BITS; without it they can't agree.

    ``a``, ``b``: FEATURE records, ``a_of``, ``b_of``: the rising places of their images.
    """
    signs = lambda f: np.unpackbits(f["bits"], axis=1).astype(np.float32) * 2 - 1
    there = np.concatenate([signs(b), np.zeros((-len(b) % 8, 256), np.float32)])
    images = int(b_of[-1]) + 1
    ends = np.flatnonzero(np.diff(a_of, append=-1)) + 1  # of images
    lo = 0
    while lo < len(a):
        # whole images, so that all corners of one are counted together
        fit = ends[ends <= lo + ROWS]
        hi = int(fit[-1]) if len(fit) and fit[-1] > lo else int(ends[ends > lo][0])
        met = []
        for row in range(lo, hi, ROWS):
            own = signs(a[row : min(hi, row + ROWS)])
            for col in range(0, len(b), COLUMNS):
                near = own @ there[col : col + COLUMNS].T >= 256 - 2 * BITS
                # few are, so those of eight at once that hold any are looked at
                eight = np.flatnonzero(near.view(np.uint64))
                which, bit = np.nonzero(near.reshape(-1, 8)[eight])
                i, j = divmod(eight[which] * 8 + bit, near.shape[1])
                met.append((i + row) * images + b_of[j + col])
        corners = np.unique(np.concatenate(met))
        pair, n = np.unique(a_of[corners // images] * images + corners % images, return_counts=True)
        for k in pair[n >= agree].tolist():
            yield divmod(k, images)
        lo = hi


def _links(blocks: tuple, others: tuple, agree: int) -> Iterator[tuple[int, int]]:
    """(image, lesser image): the links between two blocks (images, corners of each, FEATURE records), or within one."""
    (a, n, x), (b, m, y) = blocks, others
    start, begin = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(m)]
    for i, j in _may_link(x, np.repeat(np.arange(len(a)), n), y, np.repeat(np.arange(len(b)), m), agree):
        one, two = (int(a[i]), x[start[i] : start[i + 1]]), (int(b[j]), y[begin[j] : begin[j + 1]])
        if a is b and one[0] <= two[0]:
            continue  # met the other way round
        one, two = max(one, two, key=lambda t: t[0]), min(one, two, key=lambda t: t[0])
        if agreeing(one[1], two[1]) >= agree:
            yield one[0], two[0]


def _compared(agree: int):
    """Pairs of blocks -> rows (image, other, n): links that connect what all links do (n is null), and the number of links of each image (other is null)."""

    def block(row: list[bytes]) -> tuple:
        return np.frombuffer(row[0], "<i8"), np.frombuffer(row[1], "<i8"), np.frombuffer(row[2], FEATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, *rest = (c[k].as_py() for c in batch.columns)
                one = block(rest[:3])
                two = one if a == b else block(rest[3:])
                root: dict[int, int] = {}
                degree: dict[int, int] = defaultdict(int)

                def top(i: int) -> int:
                    while (up := root.get(i, i)) != i:  # noqa: B023
                        root[i] = i = root.get(up, up)  # noqa: B023
                    return i

                forest = []
                for src, dst in _links(one, two, agree):
                    degree[src] += 1
                    degree[dst] += 1
                    high, low = top(src), top(dst)
                    if high != low:
                        root[high] = low
                        forest.append((src, dst))
                src, dst, n = [s for s, _ in forest] + list(degree), [d for _, d in forest] + [None] * len(degree), [None] * len(forest) + list(degree.values())
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(n, pa.int64())], ["image", "other", "n"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, image, features) in the order of blocks -> a row for each block."""

    def row(block: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(f) // FEATURE.itemsize for _, f in held], "<i8")
        data = [np.array([i for i, _ in held], "<i8").tobytes(), sizes.tobytes(), b"".join(f for _, f in held)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([d], pa.binary()) for d in data)], ["block", "images", "sizes", "features"])

    now, held = None, []
    for b in batches:
        for block, image, features in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and block != now:
                yield row(now, held)
                held = []
            now = block
            held.append((image, features))
    if held:
        yield row(now, held)


def compare_all(features: DataFrame, agree: int = AGREEING) -> DataFrame:
    """(image, other, n) of ``features`` (image, features): see ``_compared``. Each pair of images is compared once, in the task of its pair of blocks."""
    some = features.where("length(features) > 0").select("image", "features")
    corners = (some.agg(F.sum(F.length("features").cast("long"))).first()[0] or 0) // FEATURE.itemsize
    count = max(1, round(corners / min(BLOCK, max(LEAST_BLOCK, corners // BLOCKS))))
    dealt = some.select(F.pmod(F.xxhash64("image"), F.lit(count)).alias("block"), "image", "features")
    blocks = staged(dealt.repartition(min(count, 4096), "block").sortWithinPartitions("block", "image").mapInArrow(_pack, "block long, images binary, sizes binary, features binary"), "blocks")
    side = lambda n: blocks.select(F.col("block").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("images", "sizes", "features"))).hint("merge")
    pairs = features.sparkSession.range(count).select(F.col("id").alias("a"), F.explode(F.sequence("id", F.lit(count - 1))).alias("b"))
    first = ["a_images", "a_sizes", "a_features"]
    # a block that meets itself is sent once
    other = [F.when(F.col("a") != F.col("b"), F.col(c)).alias(c) for c in ("b_images", "b_sizes", "b_features")]
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *first, *other)
    met = met.repartition(min(count * (count + 1) // 2, 4096), "a", "b")
    return met.mapInArrow(_compared(agree), "image long, other long, n long")


def find_copies(media: DataFrame, id_col: str, media_col: str, agree: int = AGREEING) -> DataFrame:
    """One row for each row: ``id_col``, n_corners, component_id (smallest id that links lead to) and n_links (of its class).

    All pairs of different media are compared; those that agree in ``agree`` corners are linked. n_links counts all links of a class to
    others. Neither depends on partitions.

    Media are binary PGM or PPM; null, empty and unreadable ones have no corners (n_corners null) and only link to equal
    bytes; a null is alone. Equal media are one class; ids may repeat; null ids are passed over as component ids.
    """
    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), F.unhex(F.substring(F.sha2(media_col, 256), 1, 32)).alias("key"))
    classes = rows.where("key is not null").groupBy("key").agg(F.first("media").alias("media"), F.min("id").alias("least"))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                images = [read_image(x) for x in part.column(1).to_pylist()]
                by = defaultdict(list)
                for k, image in enumerate(images):
                    if image is not None:
                        by[image.shape].append(k)
                found: list[np.ndarray | None] = [None] * len(images)
                for members in by.values():
                    for k, f in zip(members, describe(np.stack([images[k] for k in members])), strict=True):
                        found[k] = f
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([None if f is None else f.tobytes() for f in found], pa.binary())], ["key", "least", "features"])

    # images are numbered in the order of their keys, however many partitions there are
    ordered = classes.select("key", "media", "least").repartitionByRange("key").sortWithinPartitions("key")
    described = staged(ordered.mapInArrow(detect, f"key binary, least {kind}, features binary").withColumn("image", F.monotonically_increasing_id()), "features")

    told = staged(compare_all(described, agree), "links")
    linked = told.where("other is not null").select(F.col("image").alias("src"), F.col("other").alias("dst"))
    roots = staged(connected_components(linked).select(F.col("node").alias("image"), "component"), "image-roots")
    degree = told.where("other is null").groupBy("image").agg(F.sum("n").alias("n_links"))
    rooted = staged(described.join(roots, "image", "left").join(degree, "image", "left").select("key", "least", (F.length("features") / FEATURE.itemsize).cast("int").alias("n_corners"), F.coalesce("component", "image").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "rooted")
    named = staged(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "n_corners", "component_id", "n_links"), "named")
    alone = F.when(F.col("key").isNull(), F.col("id"))
    return rows.select("id", "key").join(named, "key", "left").select(F.col("id").alias(id_col), "n_corners", F.coalesce("component_id", alone).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


@cache
def _textures(dims: int, size: int) -> np.ndarray:
    """A fixed noise picture for each component, as rows; only blurred so far that corners and descriptors are stable."""
    noise = np.random.default_rng(64).normal(0, 1, (dims, size, size)).astype(np.float32)
    noise = _blur(_blur(noise))
    return (noise / noise.std()).reshape(dims, -1)


def render_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64) -> DataFrame:
    """A square PGM of each vector's direction: a noise picture for each component, weighed by it. Null for a null or empty vector.

    The tables hold no media; this makes a media column of them. Near vectors look alike, and unrelated ones have no details in common,
    as is true of photographs. Null components count as 0, and so do NaN; infinite ones as 1 and -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = [None] * b.num_rows
            by = defaultdict(list)
            for k, v in enumerate(b.column(1).to_pylist()):
                if v:
                    by[len(v)].append((k, [0.0 if x is None else x for x in v]))
            for dims, rows in by.items():
                for lo in range(0, len(rows), 256):
                    part = rows[lo : lo + 256]
                    v = np.nan_to_num(np.array([x for _, x in part], np.float64), nan=0, posinf=1, neginf=-1)
                    v = (v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]).astype(np.float32)
                    for (k, _), image in zip(part, np.clip(128 + 40 * (v @ _textures(dims, size)), 0, 255), strict=True):
                        out[k] = write_pgm(image.reshape(size, size))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "media"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, media binary")
