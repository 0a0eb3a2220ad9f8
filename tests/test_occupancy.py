"""Stacked texts, islands, pyramids, components and boxes at seeds against plain versions."""

import random
from collections import defaultdict
from statistics import median

from pyspark.sql import functions as F

from planwright.operators import occupancy
from planwright.operators.islands import islands, stacked_texts
from planwright.plans import shapes
from planwright.sources.drawings import drawing

SF = "/root/testdata/sf0.001"


def test_islands_over_runs(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(4000), k) for k in range(3000)] + [("a", None, 9999)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(9)
    got = {r.id: (r.g, r.island) for r in islands(df, ["g"], ["v", "id"], "v", 9).collect()}
    want, now, last = {}, 0, {}
    for g, v, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        if g not in last:
            now = 0
        elif v is not None and last[g] is not None and v - last[g] > 9:
            now += 1
        last[g] = v
        want[k] = (g, now)
    assert got == want and max(i for _, i in got.values()) > 5


def plain_stacks(rows):
    out = []
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        tall = median([r[5] for r in own if r[5] and r[5] > 0] or [80.0])
        wide, gap = max(300.0, 3 * tall), max(250.0, 2.5 * tall)
        bands = defaultdict(list)
        for r in own:
            if r[3] is not None and r[4] is not None:
                bands[(r[3] / wide + 0.5) // 1].append(r)
        for band in bands.values():
            groups = []
            for r in sorted(band, key=lambda r: (-r[4], r[1])):
                if groups and groups[-1][-1][4] - r[4] <= gap:
                    groups[-1].append(r)
                else:
                    groups.append([r])
            for g in groups:
                text = " ".join(r[2] for r in g if (r[2] or "").strip()).strip()
                if len(g) > 1 and text:
                    out.append((key, g[0][1], len(g), text))
    return out


def test_stacked_texts(spark):
    rng = random.Random(2)
    rows = []
    for k in range(900):
        text = rng.choice(["", " ", None, f"line {k}", f"Zeile {k}"])
        rows.append((rng.choice(["a", "b", None]), k, text, float(rng.randrange(-900, 3000)), rng.choice([None, *map(float, range(0, 40_000, 170))]), rng.choice([None, 0.0, -3.0, 40.0, 260.0])))
    df = spark.createDataFrame(rows, "layer string, id long, text string, x double, y double, height double")
    got = sorted(map(str, map(tuple, stacked_texts(df, "layer").collect())))
    assert got == sorted(map(str, plain_stacks(rows))) and len(got) > 50
    assert stacked_texts(df.limit(0), "layer").collect() == []


def flood(cells, start):
    seen, work = {start}, [start]
    while work:
        x, y = work.pop()
        for c in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if c in cells and c not in seen:
                seen.add(c)
                work.append(c)
    return seen


def plain_seed_boxes(points, seeds, scales):
    out = []
    for scale in scales:
        grown = defaultdict(set)
        for file, x, y in points:
            grown[file] |= {(x // scale + a, y // scale + b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        for seed, file, x, y in seeds:
            sx, sy = x // scale, y // scale
            near = min(((cx - sx) ** 2 + (cy - sy) ** 2, cx, cy) for cx, cy in grown[file] or {(1e9, 1e9)})
            if near[0] <= 36:
                c = flood(grown[file], near[1:])
                x1, y1, x2, y2 = min(a for a, _ in c), min(b for _, b in c), max(a for a, _ in c), max(b for _, b in c)
                held = sum(x1 <= a <= x2 and y1 <= b <= y2 for a, b in grown[file])
                out.append((seed, file, scale, x1 * scale, y1 * scale, (x2 + 1) * scale, (y2 + 1) * scale, len(c), round(held / ((x2 - x1 + 1) * (y2 - y1 + 1)), 6)))
    return sorted(out)


def test_seed_boxes_of_the_whole_table(spark):
    points = [(r.file_id, x, y) for r in drawing(spark, SF, "regions").collect() for x, y in ((r.x0, r.y0), (r.x0 + r.w, r.y0 + r.h))]
    seeds = [(r.seed_id, r.file_id, r.x, r.y) for r in shapes.label_seeds(spark, SF).collect()]
    got = sorted(map(tuple, shapes.r12_seed_fill(spark, SF).collect()))
    assert got == plain_seed_boxes(points, seeds, (20, 40, 80)) and len({g[0] for g in got}) > 5


def test_large_boxes_are_counted_by_tiles(spark):
    rng = random.Random(3)
    points = [(rng.randrange(2), float(x), float(x + rng.randrange(-40, 40))) for x in range(0, 4000, 3)] + [(0, None, 1.0)]
    seeds = [(k, rng.randrange(3), float(rng.randrange(-100, 4000)), float(rng.randrange(-100, 4000))) for k in range(30)]
    cells = occupancy.pyramid(spark.createDataFrame(points, "file_id int, x double, y double"), ["file_id"], 10, 2).drop("n")
    got = occupancy.boxes_at_seeds(cells, spark.createDataFrame(seeds, "seed_id long, file_id int, x double, y double"), "seed_id", ["file_id"])
    got = sorted(tuple(r) for r in got.withColumn("fill", F.round("fill", 6)).collect())
    assert got == plain_seed_boxes([p for p in points if p[1] is not None], seeds, (10, 20)) and got


def test_components_stay_in_their_drawing(spark):
    cells = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 1, 0), (1, 5, 5)], "file_id int, cx long, cy long")
    for diagonal, parts in ((True, 3), (False, 4)):
        got = occupancy.cell_components(cells, ["file_id"], diagonal).select("component").distinct().count()
        assert got == parts
